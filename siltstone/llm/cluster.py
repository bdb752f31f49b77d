"""Shared-folder tables and distributed connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to Python; both bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 400, 16 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, as one row may hold a very long text, and let workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, here])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder
    is made, once per application.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = getattr(sc, "_siltstone_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        sc._siltstone_scratch = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    This cuts lineage, so a lost executor costs one task and never the stages
    before, and what several branches read is computed once. The path is kept on
    the returned frame for ``forget``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by ``saved`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_siltstone_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, component)``.

    ``component`` is the smallest node reachable. Alternates large-star and
    small-star steps, which keep the edge count linear and converge in a
    logarithmic number of rounds; each round is written to the shared folder.
    Nodes without an edge are absent; self loops and repeated edges are ignored.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        lows = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(lows, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lows.select("a", F.col("m").alias("b")))
        nxt = saved(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        forget(e)
        e = nxt
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("connected components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
