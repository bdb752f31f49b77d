"""Embeddings as canonical rows: checked, in double precision, with a hash of their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W

SCHEMA = "vec_id long, label long, dim int, h1 long, h2 long, vec binary"


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        single = pa.types.is_float32(batch.column(2).type.value_type)
        dims, h1, h2, vecs = [], [], [], []
        for item in batch.column(2):
            v = None
            if item.is_valid and item.values.null_count == 0 and len(item.values):
                x = item.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    v = x
            if v is None:
                dims.append(0), h1.append(0), h2.append(0), vecs.append(None)
                continue
            at = W.mix(np.arange(1, len(v) + 1, dtype=np.uint64))
            bits = v.view(np.uint64)
            dims.append(len(v))
            h1.append(np.add.reduce(W.mix(bits ^ at)).view(np.int64))
            h2.append(np.add.reduce(W.mix(bits + at) * np.uint64(3)).view(np.int64))
            vecs.append((v.astype(np.float32) if single else v).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(vecs, pa.binary())],
            ["vec_id", "label", "dim", "h1", "h2", "vec"],
        )


def canonical(rows: DataFrame) -> DataFrame:
    """``rows(vec_id, embedding, label)`` with ``vec`` null where the vector is null, empty, zero or holds null or non-finite components.

    ``vec`` holds the components in the precision they come in, four bytes for floats and
    eight for all else; ``matrix`` gives doubles. A label that is no whole number counts by
    the hash of its text.
    """
    have, kinds = rows.columns, dict(rows.dtypes)
    label = F.lit(None).cast("long")
    if "label" in have:
        label = F.col("label").cast("long") if kinds["label"] in ("tinyint", "smallint", "int", "bigint", "boolean") else F.xxhash64(F.col("label").cast("string"))
        label = F.when(F.col("label").isNotNull(), label)
    embedding = F.col("embedding") if kinds["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), embedding.alias("embedding")).mapInArrow(_canonical, SCHEMA)


def matrix(column, dim: int) -> np.ndarray:
    """Rows of doubles; rows may be stored as floats or as doubles."""
    raw = b"".join(column.to_pylist())
    n = len(column) * dim
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n else np.float64).reshape(-1, dim).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sampled(rows: DataFrame, most: int, most_bytes: int = 64 << 20) -> np.ndarray:
    """Up to ``most`` vectors of the commonest dimension, those of lowest hash, at most ``most_bytes`` of them: for fitting only."""
    top = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if top is None:
        return np.zeros((0, 1))
    n = max(1, min(most, most_bytes // (8 * top.dim)))
    share = min(1.0, 1.5 * n / top.n)
    low = rows.where((F.col("dim") == top.dim) & (F.pmod(F.col("h1"), F.lit(1 << 20)) <= int(share * (1 << 20)))).select("vec", "h1", "h2")
    # In a fixed order, so that reruns fit the same trees.
    return matrix(pa.array([r.vec for r in low.orderBy("h1", "h2").limit(n).collect()], pa.binary()), top.dim)
