"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits unit vectors recursively along random directions at the median; a point
near a split goes to both sides (spill), so a close pair rarely parts, and several trees
make a miss of it negligible. Vectors of one label are compared within each leaf, exactly
and in double precision. A pair that meets in several leaves counts in the first only.

Scale: equal vectors are one row with a count. Trees are fitted on a bounded sample; every
row is routed through them. Leaves over a block size are cut into blocks and pairs of
blocks compared as groups of their own, so no task holds an unbounded group and no pair is
lost. Pairs are never emitted: a leaf returns link counts and a forest of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import cluster
from siltstone.llm import vectors as V
from siltstone.llm.minhash import _blocks, group_bounds, grouped

TREES, LEAF_ROWS, SAMPLE, BLOCK = 5, 256, 50_000, 1024
#: Rows of the sample a split is fitted on at least.
LEAST_FIT = 16


class Tree:
    """Inner node k has children 2k + 1 and 2k + 2; leaves are the nodes of the last level."""

    def __init__(self, sample: np.ndarray, depth: int, spill: float, rng: np.random.Generator):
        self.depth, self.spill = depth, spill
        self.directions = rng.standard_normal(((1 << depth) - 1, sample.shape[1]))
        self.directions /= np.sqrt((self.directions**2).sum(axis=1, keepdims=True))
        self.cuts = np.zeros((1 << depth) - 1)
        parts = {0: sample}
        for k in range(len(self.cuts)):
            x = parts.pop(k)
            p = x @ self.directions[k]
            self.cuts[k] = np.median(p) if len(p) else 0.0
            parts[2 * k + 1], parts[2 * k + 2] = x[p <= self.cuts[k]], x[p > self.cuts[k]]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves each row belongs to."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            off = np.einsum("ij,ij->i", x[row], self.directions[node]) - self.cuts[node]
            left, right = off <= self.spill, off > -self.spill
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - ((1 << self.depth) - 1)


def fit(sample: np.ndarray, largest: int, cosine: float, seed: int = 3) -> list[Tree]:
    """``largest``: rows of the commonest label. The spill is one standard deviation of a linked pair's difference along a direction."""
    if not len(sample):
        return []
    depth = max(0, min(math.ceil(math.log2(max(1, largest / LEAF_ROWS))), int(math.log2(max(1, len(sample) / LEAST_FIT)))))
    spill = math.sqrt(2 - 2 * cosine) / math.sqrt(sample.shape[1])
    rng, unit = np.random.default_rng(seed), V.unit(sample)
    return [Tree(unit, depth, spill, rng) for _ in range(TREES)]


def _route(trees: list[Tree], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list[list[int]] = [[-1] for _ in range(batch.num_rows)]
            fits = np.flatnonzero(batch.column(2).to_numpy() == dim)
            if len(fits) and trees:
                x = V.unit(V.matrix(batch.column(4).take(pa.array(fits)), dim))
                for k in fits:
                    codes[k] = []
                for t, tree in enumerate(trees):
                    for r, leaf in zip(*tree.leaves(x)):
                        codes[fits[r]].append(t << 32 | int(leaf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sorted(c) for c in codes], pa.list_(pa.int64()))], ["rep", "label", "dim", "n", "vec", "h1", "h2", "codes"])

    return run


def _compare(cosine: float):
    """Group key: label, dim, code, lo, hi; then rep, n, own block, codes, vec. Emits link counts (b null) and forest edges."""

    def run(batches):
        for table in grouped(batches, 5):
            bounds = group_bounds(table, 5)
            key = [table.column(k).to_numpy() for k in range(5)]
            rep, n, own = (table.column(k).to_numpy() for k in (5, 6, 7))
            out_a, out_b, out_n = [], [], []
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s < 2:
                    continue
                x = V.unit(V.matrix(table.column(9).slice(s, e - s), int(key[1][s])))
                code, cross = key[2][s], key[3][s] != key[4][s]
                lists = table.column(8).slice(s, e - s).to_pylist()
                earlier = sorted({c for row in lists for c in row if c < code})
                at = {c: k for k, c in enumerate(earlier)}
                seen = np.zeros((e - s, max(1, len(earlier))), np.float32)
                for r, row in enumerate(lists):
                    for c in row:
                        if c < code:
                            seen[r, at[c]] = 1
                links = x @ x.T >= cosine
                np.fill_diagonal(links, False)
                side = own[s:e]
                if cross:
                    links &= side[:, None] != side[None, :]
                if not links.any():
                    continue
                new = links & (seen @ seen.T == 0)
                count = new @ n[s:e]
                hit = np.flatnonzero(count)
                out_a.append(rep[s:e][hit]), out_b.append(np.full(len(hit), -1)), out_n.append(count[hit])
                free = links.any(axis=1)
                while free.any():
                    queue = [int(np.flatnonzero(free)[0])]
                    free[queue[0]] = False
                    while queue:
                        y = queue.pop()
                        found = np.flatnonzero(links[y] & free)
                        free[found] = False
                        out_a.append(np.full(len(found), rep[s + y])), out_b.append(rep[s + found]), out_n.append(np.zeros(len(found), np.int64))
                        queue.extend(found.tolist())
            cat = lambda v: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)
            a, b, c = cat(out_a), cat(out_b), cat(out_n)
            edge = c == 0
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~edge), pa.array(c)], ["a", "b", "links"])

    return run


def near_duplicate_vectors(rows: DataFrame, *, cosine: float = 0.98) -> DataFrame:
    """Links between vectors of equal label: vec_id, n_links, component_id, kept for each of ``rows(vec_id, embedding, label)``.

    Defined cases: a vector that is null, empty, zero or holds null or non-finite components,
    and one with a null label, links with nothing. Vectors of different dimension do not
    link. A row with a null vec_id takes no part: no links, null component, kept. Repeated
    rows link with each other. Other columns are ignored. An empty table gives an empty result.
    """
    cluster.tune(rows.sparkSession)
    base = cluster.saved(V.canonical(rows), "vectors")
    usable = base.where("vec IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    reps = cluster.saved(usable.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "classes")
    largest = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sample = V.sampled(reps, SAMPLE)
    trees = fit(sample, largest, cosine)
    routed = reps.select("rep", "label", F.col("dim").cast("long").alias("dim"), "n", "vec", "h1", "h2").mapInArrow(
        _route(trees, sample.shape[1]), "rep long, label long, dim long, n long, vec binary, h1 long, h2 long, codes array<long>"
    )
    routed = cluster.saved(routed, "routed")
    # Leaves are sized and cut into blocks on rows without vectors; a vector is sent once, to its blocks.
    in_leaf = routed.select("label", "dim", F.explode("codes").alias("code"), "rep", "h1", "h2")
    sizes = in_leaf.groupBy("label", "dim", "code").agg(F.count("*").alias("m")).where("m > 1")
    dealt = _blocks(in_leaf.join(sizes, ["label", "dim", "code"]), f"cast(ceil(m / {BLOCK}) as long)").select("label", "dim", "h1", "h2", "code", "lo", "hi", F.col("_own").alias("own"))
    found = cluster.saved(
        dealt.join(routed, ["label", "dim", "h1", "h2"])
        .select("label", "dim", "code", "lo", "hi", "rep", "n", "own", "codes", "vec")
        .repartition("label", "dim", "code", "lo", "hi")
        .sortWithinPartitions("label", "dim", "code", "lo", "hi", "rep")
        .mapInArrow(_compare(cosine), "a long, b long, links long"),
        "links",
    )
    cluster.forget(routed)
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    parts = cluster.saved(cluster.components(found.where("b IS NOT NULL").select("a", "b")), "parts")
    named = (
        reps.drop("vec")
        .join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "dim", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    on = (base.label == named.label) & (base.dim == named.dim) & (base.h1 == named.h1) & (base.h2 == named.h2) & base.vec.isNotNull() & base.vec_id.isNotNull()
    component = F.coalesce("component", base.vec_id)
    return base.join(named, on, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == base.vec_id, F.lit(True)).alias("kept")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op5: cosine of 0.98 or more within equal labels."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] e from embeddings
  where embedding is not null and label is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), l as (
  select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98
), r as (
  select x, y from l union select r.x, l.y from r join l on r.y = l.x
), m as (
  select x, min(y) low from r group by 1
), k as (
  select x, count(*) n from l group by 1
)
select d.vec_id, coalesce(k.n, 0) as n_links, least(d.vec_id, coalesce(m.low, d.vec_id)) as component_id, d.vec_id <= coalesce(m.low, d.vec_id) as kept
from embeddings d left join k on k.x = d.vec_id left join m on m.x = d.vec_id
"""
