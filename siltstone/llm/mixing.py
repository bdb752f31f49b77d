"""Mix sources to target weights by a low-discrepancy slot schedule.

Slots 0, 1, 2, ... are golden-ratio points; the cumulative shares of the sources cut the
unit interval, so each slot names a source and every stretch of the schedule is mixed near
the targets. Slots are ranked within their source, and the k-th slot of a source takes the
k-th block of equally many words of that source's stream: its documents in hashed order,
repeated as often as the target asks.

Scale: only source totals reach the driver. Streams are laid out by bucket totals, a
prefix sum over at most ``BUCKETS`` rows a source, and a running sum inside each bucket, so
a source with a third of all rows is spread over all tasks. Slot ranks come from counts of
fixed chunks in the same two steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from siltstone.llm import cluster
from siltstone.llm.minhash import _free

#: 2**64 over the golden ratio: slot i lies at i * GOLDEN mod 2**64.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BUCKETS, CHUNK, BLOCK_WORDS, MAX_SOURCES = 4096, 1 << 16, 4096, 1_000_000
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of all words by weight; none above ``most`` times its size, the excess reshared by weight."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while free:
        unit = left / sum(weights[k] for k in free)
        over = [k for k in free if unit * weights[k] > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = unit * weights[k]
            break
        for k in over:
            out[k] = float(most * sizes[k])
            left -= out[k]
            free.remove(k)
    return out


def _slots(edges: list[int], n: int, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(edges, np.uint64)
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                slot = np.arange(chunk * CHUNK, min(n, (chunk + 1) * CHUNK), dtype=np.uint64)
                source = np.searchsorted(cuts, slot * GOLDEN, side="right")
                order = np.argsort(source, kind="stable")
                kinds, at, size = np.unique(source[order], return_index=True, return_counts=True)
                if count_only:
                    cols = [np.full(len(kinds), chunk, np.int64), kinds.astype(np.int64), size.astype(np.int64)]
                    names = ["chunk", "source_no", "n"]
                else:
                    local = np.arange(len(slot)) - np.repeat(at, size)
                    cols = [np.full(len(slot), chunk, np.int64), source[order].astype(np.int64), local.astype(np.int64), slot[order].astype(np.int64)]
                    names = ["chunk", "source_no", "local", "slot"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return run


def _schedule(spark, blocks: list[int]) -> DataFrame:
    """(source_no, block, slot): every block of every source in exactly one slot."""
    n = sum(blocks)
    if n == 0:
        return spark.createDataFrame([], "source_no long, block long, slot long")
    ends = np.cumsum(np.array(blocks, dtype=object))
    edges = [min((int(e) << 64) // n, (1 << 64) - 1) for e in ends[:-1]]
    chunks = spark.range(0, -(-n // CHUNK))
    counts = chunks.mapInArrow(_slots(edges, n, True), "chunk long, source_no long, n long")
    before = Win.partitionBy("source_no").orderBy("chunk").rowsBetween(Win.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    limit = spark.createDataFrame([(k, b) for k, b in enumerate(blocks)], "source_no long, blocks long")
    ranked = (
        chunks.mapInArrow(_slots(edges, n, False), "chunk long, source_no long, local long, slot long")
        .join(offsets, ["chunk", "source_no"])
        .select("source_no", (F.col("before") + F.col("local")).alias("block"), "slot")
        .join(F.broadcast(limit), "source_no")
        .where("block < blocks")
        .drop("blocks")
    )
    # The points fall short of a share by a few slots at most; those blocks follow at the end.
    found = counts.groupBy("source_no").agg(F.sum("n").alias("n"))
    late = (
        limit.join(found, "source_no", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .where("n < blocks")
        .select("source_no", F.explode(F.sequence("n", F.col("blocks") - 1)).alias("block"))
        .withColumn("slot", F.lit(n) + F.col("block"))
    )
    return ranked.unionByName(late)


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), most: int = 3, block_words: int = BLOCK_WORDS, seed: int = 17, row_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Schedule ``docs(doc_id, text, source)``: (rows, pieces).

    ``rows``: row_no, doc_id, source, size (words), source_size, target, one for every input
    row. ``pieces``: slot, row_no, doc_id, epoch, from_word, to_word: what each slot of the
    mix takes, in the order of slot, epoch and row. Sources in code point order, null last,
    weigh ``weights``, repeating. A source's pieces sum to its target, rounded; no row is
    taken more than ``most`` times over.

    Defined cases: null, empty and all-space texts have size 0 and no piece. A null source
    is a source. Null and repeated doc_ids are rows of their own. Other columns are ignored.
    An empty table gives two empty results. More than a million sources raise an error.
    """
    spark = docs.sparkSession
    cluster.tune(spark)
    row_no = F.col(row_column) if row_column else F.monotonically_increasing_id()
    # Rows without an id, and rows of one id, are spread over the buckets by their texts and then by their places.
    same = F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(seed))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(same, row_no)).otherwise(same)
    base = cluster.saved(
        docs.select(
            row_no.alias("row_no"),
            "doc_id",
            "source",
            F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
        ).withColumn("bucket", F.pmod("key", F.lit(BUCKETS))),
        "sizes",
    )
    totals = base.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.s for r in totals]
    aims = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], most)
    takes = [min(round(t), most * s) for t, s in zip(aims, sizes)]
    table = spark.createDataFrame(
        [(k, r.source, r.s, t, n) for k, (r, t, n) in enumerate(zip(totals, aims, takes))], "source_no long, src string, source_size long, target double, take long"
    )
    rows = base.join(F.broadcast(table), base.source.eqNullSafe(table.src)).drop("src")
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("s"))
    earlier = Win.partitionBy("source_no").orderBy("bucket").rowsBetween(Win.unboundedPreceding, -1)
    starts = sums.select("source_no", "bucket", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("at"))
    inside = Win.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "size", "row_no").rowsBetween(Win.unboundedPreceding, -1)
    placed = (
        rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["source_no", "bucket"])
        .withColumn("at", F.col("at") + F.col("own"))
        .where("size > 0 AND take > 0")
    )
    cut = (
        placed.withColumn("epoch", F.explode(F.expr("sequence(0L, (take - 1) div source_size)")))
        .withColumn("lo", F.expr("epoch * source_size + at"))
        .withColumn("hi", F.expr("least(lo + size, take)"))
        .where("lo < hi")
        .withColumn("block", F.explode(F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})")))
        .select(
            "source_no",
            "block",
            "row_no",
            "doc_id",
            "epoch",
            F.expr(f"greatest(lo, block * {block_words}) - lo").alias("from_word"),
            F.expr(f"least(hi, (block + 1) * {block_words}) - lo").alias("to_word"),
        )
    )
    schedule = _schedule(spark, [-(-n // block_words) for n in takes])
    pieces = schedule.join(cut, ["source_no", "block"]).select("slot", "row_no", "doc_id", "epoch", "from_word", "to_word")
    return rows.select("row_no", "doc_id", "source", "size", "source_size", "target"), pieces


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row per epoch in which a row has a share.

    A row taken whole keeps its text; of the one row a source's target ends in, the words
    taken stay, with single spaces. ``n_chars``, if there is one, follows the text.
    """
    row, lo, hi, words = _free(docs.columns, "__row", "__from", "__to", "__size")
    kept = cluster.saved(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    rows, pieces = mix(kept, row_column=row, **options)
    share = pieces.groupBy("row_no", "epoch").agg(F.min("from_word").alias(lo), F.max("to_word").alias(hi)).drop("epoch").withColumnRenamed("row_no", row)
    size = rows.select(F.col("row_no").alias(row), F.col("size").alias(words))
    cut = F.expr(f"array_join(slice(regexp_extract_all(text, '{WORD}', 0), cast({lo} + 1 as int), cast({hi} - {lo} as int)), ' ')")
    out = kept.join(share.join(size, row), row)
    whole = (F.col(lo) == 0) & (F.col(hi) == F.col(words))
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the words the mix takes of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows, pieces = mix(docs)
    taken = pieces.groupBy("row_no").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return rows.join(taken, "row_no", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
