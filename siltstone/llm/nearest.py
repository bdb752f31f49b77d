"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected on a few Gaussian (2-stable) directions: the squared projected
distance over the squared true one follows a chi-square law. A kd-tree over projections
yields a query's projected neighbours in growing order of a lower bound; each is verified
by its true distance, until the bound is so large that a vector nearer than the current
k-th best would have shown up before with the wanted chance (the chi-square test).

Scale: the upper levels of the kd-tree, fitted on a bounded sample, deal all vectors to
cells; a cell builds its own lower levels. A query first searches its own cell, which gives
it a radius, and then only the cells that the test cannot rule out. Queries meet cells in
blocks; a cell reads its queries as a stream. Equal vectors are one row with its smallest
ids, as many as an answer can hold, so a common vector cannot swell a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import cluster
from siltstone.llm import vectors as V

DIRECTIONS, CELL_ROWS, LEAF_ROWS, SAMPLE, CHANCE = 8, 4096, 64, 50_000, 0.995


def chi_square_cdf(x: np.ndarray, m: int = DIRECTIONS) -> np.ndarray:
    """For an even number of degrees of freedom."""
    h = np.minimum(np.asarray(x, float), 1e4) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for k in range(1, m // 2):
        term = term * h / k
        total = total + term
    return 1 - np.exp(-h) * total


def stop_ratio(chance: float) -> float:
    """Squared projected over squared true distance from which the search may stop."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid) < chance else (lo, mid)
    return hi


class KdTree:
    """Median splits on the widest direction; leaves are row ranges of ``order`` with their boxes."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        self.splits: list[tuple[int, float, int, int]] = []  # direction, cut, left, right; leaves are ~index
        lows, highs = [], []

        def build(a: int, b: int) -> int:
            part = points[self.order[a:b]]
            width = np.ptp(part, axis=0) if b > a else np.zeros(points.shape[1])
            axis = int(width.argmax())
            if b - a <= leaf_rows or width[axis] == 0:
                self.leaves.append((a, b))
                lows.append(part.min(axis=0) if b > a else np.full(points.shape[1], np.inf))
                highs.append(part.max(axis=0) if b > a else np.full(points.shape[1], -np.inf))
                return ~(len(self.leaves) - 1)
            v = part[:, axis]
            cut = float(np.median(v))
            if cut == v.max():
                cut = float(v[v < cut].max())
            left = v <= cut
            self.order[a:b] = np.concatenate([self.order[a:b][left], self.order[a:b][~left]])
            here, mid = len(self.splits), a + int(left.sum())
            self.splits.append((axis, cut, 0, 0))
            x, y = build(a, mid), build(mid, b)
            self.splits[here] = (axis, cut, x, y)
            return here

        self.root = build(0, len(points))
        self.low, self.high = np.array(lows), np.array(highs)

    def opened(self) -> None:
        """Stretch the boxes over all space, so that they hold points the tree was not fitted on."""
        m = self.low.shape[1]
        self.low, self.high = np.full((len(self.leaves), m), -np.inf), np.full((len(self.leaves), m), np.inf)
        stack = [(self.root, np.full(m, -np.inf), np.full(m, np.inf))]
        while stack:
            node, low, high = stack.pop()
            if node < 0:
                self.low[~node], self.high[~node] = low, high
                continue
            axis, cut, x, y = self.splits[node]
            mid = high.copy(), low.copy()
            mid[0][axis] = mid[1][axis] = cut
            stack += [(x, low, mid[0]), (y, mid[1], high)]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = ~node
                continue
            axis, cut, x, y = self.splits[node]
            left = points[rows, axis] <= cut
            stack += [(x, rows[left]), (y, rows[~left])]
        return out

    def bounds(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


class Index:
    """Projection and the upper tree; small enough to go with each task."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 11):
        self.dim = sample.shape[1]
        self.directions = np.random.default_rng(seed).standard_normal((self.dim, DIRECTIONS))
        self.tree = KdTree(sample @ self.directions, max(16, -(-len(sample) // max(1, cells))))
        self.tree.opened()


def _smallest(queries: bool):
    """Rows of (cell, is_query, id, bound, ids, vec) for the first round: candidates in their cell, queries in theirs."""

    def make(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = V.matrix(batch.column(2), index.dim)
                cell = index.tree.leaf_of(x @ index.directions)
                m = batch.num_rows
                ids = pa.array([[]] * m, pa.list_(pa.int64())) if queries else batch.column(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array([int(queries)] * m, pa.int32()), batch.column(0), pa.array([math.inf] * m, pa.float64()), ids, batch.column(2)],
                    ["cell", "is_query", "id", "bound", "ids", "vec"],
                )

        return run

    return make


def _elsewhere(index: Index, ratio: float):
    """Second round: the cells, other than its own, that the test cannot rule out at a query's radius."""

    def run(batches):
        for batch in batches:
            x = V.matrix(batch.column(2), index.dim)
            p = x @ index.directions
            own = index.tree.leaf_of(p)
            radius = batch.column(1).to_numpy(zero_copy_only=False)
            rows, cells = [], []
            for k in range(batch.num_rows):
                far = index.tree.bounds(p[k])
                near = np.flatnonzero(far <= ratio * radius[k] ** 2)
                near = near[near != own[k]]
                rows.append(np.full(len(near), k)), cells.append(near)
            at, cell = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (rows, cells))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(np.ones(len(at), np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array([[]] * len(at), pa.list_(pa.int64())), batch.column(2).take(take)],
                ["cell", "is_query", "id", "bound", "ids", "vec"],
            )

    return run


def _search(index: Index, k: int, ratio: float):
    """Rows sorted by cell, candidates first; emits each query's best of the cell: query_id, vec_id, score."""

    def answer(x, tree, ids, q, query_id, bound):
        """Verify leaf after leaf in the order of their lower bounds."""
        p = q @ index.directions
        far = tree.bounds(p)
        best: list[tuple[float, int]] = []
        limit = bound
        for leaf in np.argsort(far, kind="stable"):
            if far[leaf] > ratio * limit * limit:
                break
            a, b = tree.leaves[leaf]
            rows = tree.order[a:b]
            d = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
            for r in np.flatnonzero(d <= limit):
                best.extend((float(d[r]), i) for i in ids[rows[r]] if i != query_id)
            if len(best) >= k:
                best.sort()
                del best[k:]
                limit = min(limit, best[-1][0])
        best.sort()
        return best[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tree, x, ids = None, None, None, []
        parts: list[np.ndarray] = []
        for batch in batches:
            out_q, out_v, out_s = [], [], []
            cells, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists, own, bounds = batch.column(4).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            vecs = V.matrix(batch.column(5), index.dim) if batch.num_rows else None
            for r in range(batch.num_rows):
                if cells[r] != cell:
                    cell, tree, parts, ids = cells[r], None, [], []
                if not kinds[r]:
                    parts.append(vecs[r])
                    ids.append(lists[r])
                    continue
                if not parts:
                    continue
                if tree is None:
                    x = np.array(parts)
                    tree = KdTree(x @ index.directions, LEAF_ROWS)
                for score, vec in answer(x, tree, ids, vecs[r], own[r], bounds[r]):
                    out_q.append(own[r]), out_v.append(vec), out_s.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = 10, chance: float = CHANCE) -> DataFrame:
    """The ``k`` nearest of ``rows(vec_id, embedding)`` to each of ``queries(vec_id, embedding)``, itself excluded by vec_id.

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance in double precision,
    nearest first, ties to the smaller vec_id). ``chance``: that of a true neighbour to be
    seen before the search stops.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null vec_id take no part. Vectors are compared with those of their own
    dimension; each dimension that is asked for has an index. With fewer than ``k`` candidates all are returned. Of repeated rows of one vec_id each is a
    candidate; a query repeated with one vec_id is answered once per distinct vector.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    cluster.tune(spark)
    base = V.canonical(rows.select("vec_id", "embedding")).where("vec IS NOT NULL AND vec_id IS NOT NULL")
    # A query leaves out its own id, so k + 1 ids of equal vectors are enough.
    first = Window.partitionBy("dim", "h1", "h2").orderBy("vec_id")
    classes = cluster.saved(
        base.withColumn("_n", F.row_number().over(first)).where(f"_n <= {k + 1}").groupBy("dim", "h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec")),
        "classes",
    )
    asked = V.canonical(queries.select("vec_id", "embedding")).where("vec IS NOT NULL AND vec_id IS NOT NULL").dropDuplicates(["vec_id", "dim", "h1", "h2"])
    asked = cluster.saved(asked.select("dim", F.col("vec_id").alias("id"), "vec"), "queries")
    wanted = {r.dim for r in asked.select("dim").distinct().collect()}
    counts = sorted((r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect() if r.dim in wanted)
    out = None
    for dim, count in counts:
        part = _of_dimension(classes.where(f"dim = {dim}"), asked.where(f"dim = {dim}").drop("dim"), count, k, chance)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _of_dimension(classes: DataFrame, asked: DataFrame, count: int, k: int, chance: float) -> DataFrame:
    """Answers to ``asked(id, vec)`` from ``count`` distinct vectors ``classes(dim, ids, vec)`` of one dimension."""
    sample = V.sampled(classes, SAMPLE)
    index = Index(sample, min(-(-count // CELL_ROWS), max(1, len(sample) // 16)))
    ratio = stop_ratio(chance)
    schema = "cell long, is_query int, id long, bound double, ids array<long>, vec binary"
    held = cluster.saved(classes.select(F.col("ids")[0].alias("id"), "ids", "vec").mapInArrow(_smallest(False)(index), schema), "cells")

    def searched(who: DataFrame) -> DataFrame:
        return held.unionByName(who).repartition("cell").sortWithinPartitions("cell", "is_query", "id").mapInArrow(_search(index, k, ratio), "query_id long, vec_id long, score double")

    at_home = asked.select("id", F.array().cast("array<long>").alias("ids"), "vec").mapInArrow(_smallest(True)(index), schema)
    near = cluster.saved(searched(at_home), "near")
    radius = near.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("r")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("r")).alias("r"))
    reached = asked.join(radius, "id", "left").select("id", F.coalesce("r", F.lit(math.inf)).alias("bound"), "vec")
    more = searched(reached.mapInArrow(_elsewhere(index, ratio), schema))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = near.unionByName(more).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the 10 nearest of every vector whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
