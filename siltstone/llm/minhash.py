"""Near-duplicate texts by circulant MinHash, banding and exact verification.

Signatures come from two permutations of the 32-bit hash space. The first, sigma,
scatters the shingles once; coordinate k is the minimum of the second, pi, over the
scattered shingles circularly shifted by k steps. Texts that share a band are compared
by their signatures (within a wide margin), groups of similar texts found that way are
then compared on their full shingle sets, and only pairs that pass there are links.

Scale: equal sets collapse to one representative before anything is compared, so a
large group of copies costs one row. Buckets and groups over a block size are dealt to
blocks, so no task holds an unbounded group. Inside a block a search tree is grown instead
of emitting all pairs: the output is linear in its size and keeps every connection. Each
row of a large group is first searched in two blocks, dealt in two ways, which connects
most of a group of alike texts; only rows outside its largest connected part then meet all
others, block by block. So a row is copied as often as there are blocks of such rows, and
no pair that could still connect two parts is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import cluster
from siltstone.llm import words as W

COORDINATES = 100
_SIGMA = np.uint64(0xD6E8FEB86659FD93)
_SHIFTS = (np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B1)).astype(np.uint32)
#: Rows of a signature block, and rows and bytes of a verification block.
BUCKET_BLOCK, VERIFY_BLOCK, VERIFY_BYTES = 4096, 1024, 4 << 20


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set of 64-bit shingle hashes."""
    base = ((shingle_set * _SIGMA) >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(base), 2048):
        x = base[None, i : i + 2048] + _SHIFTS[:, None]
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def banding(percent: int, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): the most rows a band may have so that a pair at the threshold is missed with at most this chance."""
    j = percent / 100
    rows = max(r for r in range(1, 11) if r == 1 or (1 - j**r) ** (COORDINATES // r) <= miss)
    return COORDINATES // rows, rows


def least_agreement(percent: int) -> int:
    """Equal coordinates, six standard deviations under what the threshold gives."""
    j = percent / 100
    return max(1, math.floor(COORDINATES * (j - 6 * math.sqrt(j * (1 - j) / COORDINATES))))


def _sign(n_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offs = W.buffers(batch.column(1))
            w, first = W.word_hashes(body, offs)
            sets = W.distinct_per_text(*W.shingles(w, first, n_words))
            h1, h2, keys, low = [], [], [], []
            n_bytes = np.diff(offs)
            salt = W.mix(np.arange(1, bands + 1, dtype=np.uint64))
            for s in sets:
                if not len(s):
                    h1.append(0), h2.append(0), keys.append(None), low.append(None)
                    continue
                h1.append(np.add.reduce(W.mix(s)).view(np.int64))
                h2.append(np.add.reduce(W.mix(s ^ _SIGMA) * np.uint64(3)).view(np.int64))
                sig = signature(s)
                part = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
                h = salt.copy()
                for k in range(rows):
                    h = W.mix(h * np.uint64(0x9E3779B97F4A7C15) + part[:, k])
                keys.append(h.view(np.int64))
                low.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary()), pa.array(n_bytes, pa.int64())],
                ["doc_id", "n_shingles", "h1", "h2", "keys", "sig", "n_bytes"],
            )

    return run


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Cut sorted batches into tables of whole groups; the first ``n_keys`` columns are the key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)])
        end = keys[:, -1]
        change = np.flatnonzero((keys != end[:, None]).any(axis=0))
        cut = int(change[-1]) + 1 if len(change) else 0
        if last is not None and (keys[:, 0] != last).any() and held and cut == 0:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = end
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, n_keys: int) -> np.ndarray:
    keys = np.stack([table.column(k).to_numpy() for k in range(n_keys)])
    change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
    return np.concatenate([[0], change, [table.num_rows]])


def _pairs(a: list, b: list) -> pa.RecordBatch:
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cat(a)), pa.array(cat(b))], ["a", "b"])


def _similar(least: int):
    """Per bucket block: a forest that connects all rows with enough equal coordinates; rows of equal ``known`` are connected."""

    def run(batches):
        for table in grouped(batches, 3):
            bounds = group_bounds(table, 3)
            rep = table.column(3).to_numpy()
            known = table.column(4).to_numpy()
            sig = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(-1, COORDINATES)
            size = np.diff(bounds)
            out_a, out_b = [], []
            two = bounds[:-1][size == 2]
            hit = two[(sig[two] == sig[two + 1]).sum(axis=1) >= least]
            out_a.append(rep[hit]), out_b.append(rep[hit + 1])
            for g in np.flatnonzero(size > 2):
                rest = np.arange(bounds[g], bounds[g + 1])
                while len(rest) > 1:
                    queue, rest = [rest[0]], rest[1:]
                    while queue and len(rest):
                        x = queue.pop()
                        mates = known[rest] == known[x]
                        if mates.any():
                            queue.extend(rest[mates])
                            rest = rest[~mates]
                        near = (sig[rest] == sig[x]).sum(axis=1) >= least
                        found = rest[near]
                        if len(found):
                            out_a.append(np.full(len(found), rep[x])), out_b.append(rep[found])
                            queue.extend(found)
                            rest = rest[~near]
            yield _pairs(out_a, out_b)

    return run


def _verify(n_words: int, percent: int):
    """Per block of similar texts: a forest that connects all pairs whose full sets pass; rows of equal ``known`` are connected."""

    def run(batches):
        for table in grouped(batches, 3):
            bounds = group_bounds(table, 3)
            rep, known = (table.column(k).to_numpy() for k in (3, 4))
            text = table.column(5).combine_chunks()
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            out_a, out_b = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                w, first = W.word_hashes(*W.buffers(text.slice(a, b - a)))
                sets = W.distinct_per_text(*W.shingles(w, first, n_words))
                del w
                size = np.array([len(s) for s in sets])
                rest = np.flatnonzero(size)
                if not len(rest):
                    continue
                _, ids = np.unique(np.concatenate(sets), return_inverse=True)
                ids = ids.astype(np.int32)
                at = np.concatenate([[0], np.cumsum(size)])
                mark = np.zeros(int(ids.max()) + 1, np.int32)
                rest_ids, rest_at, live = ids, at[rest], np.ones(len(rest), bool)
                queue: list[int] = []
                while live.any():
                    if 2 * live.sum() < len(rest):
                        rest = rest[live]
                        rest_ids = np.concatenate([ids[at[r] : at[r + 1]] for r in rest])
                        rest_at, live = np.concatenate([[0], np.cumsum(size[rest])[:-1]]), np.ones(len(rest), bool)
                    if not queue:
                        k = int(live.argmax())
                        queue.append(rest[k])
                        live[k] = False
                        continue
                    x = queue.pop()
                    mates = live & (known[a + rest] == known[a + x])
                    queue.extend(rest[mates])
                    live &= ~mates
                    if not live.any():
                        break
                    own = ids[at[x] : at[x + 1]]
                    mark[own] = 1
                    shared = np.add.reduceat(mark[rest_ids], rest_at)
                    mark[own] = 0
                    ok = live & (100 * shared >= percent * (size[rest] + size[x] - shared))
                    if ok.any():
                        found = rest[ok]
                        out_a.append(np.full(len(found), rep[a + x])), out_b.append(rep[a + found])
                        queue.extend(found)
                        live &= ~ok
            yield _pairs(out_a, out_b)

    return run


def _connected(members: DataFrame, payload: DataFrame, search) -> DataFrame:
    """Components, as (node, component), of the links ``search`` finds between members of one group.

    ``members(g, rep, blocks)``: a group and the blocks its rows need; ``payload(rep, data)``: what is compared.
    """

    def searched(dealt: DataFrame) -> DataFrame:
        rows = dealt.select("g", "lo", "hi", "rep", "known").join(payload, "rep").select("g", "lo", "hi", "rep", "known", "data")
        return rows.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "rep").mapInArrow(search, "a long, b long")

    ways = F.when(F.col("blocks") > 1, F.expr("array(0L, 1L)")).otherwise(F.expr("array(0L)"))
    twice = members.withColumn("hi", F.explode(ways)).withColumn("lo", F.expr("pmod(xxhash64(rep, hi), blocks)"))
    parts = cluster.saved(cluster.components(searched(twice.withColumn("known", F.col("rep")))), "parts")
    wide = members.where("blocks > 1").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("g", "rep", "blocks", F.coalesce("component", "rep").alias("known"))
    wide = cluster.saved(wide, "wide")
    largest = (
        wide.groupBy("g", "known").agg(F.count("*").alias("m"), F.max("blocks").alias("blocks")).groupBy("g")
        .agg(F.sum("m").alias("n"), F.max(F.struct("m", "known")).alias("top"), F.max("blocks").alias("blocks"))
        .where("n > top.m")
        .selectExpr("g", "top.known as top", "cast(ceil((n - top.m) * blocks / n) as long) as outer_blocks", "cast(ceil(top.m * blocks / n) as long) as inner_blocks")
    )
    if largest.isEmpty():
        cluster.forget(wide)
        return parts
    # Blocks of rows outside the largest part come first; they meet every block, blocks of the largest part only these.
    pairs = (
        wide.join(largest, "g")
        .withColumn("own", F.expr("if(known = top, outer_blocks + pmod(xxhash64(rep), inner_blocks), pmod(xxhash64(rep), outer_blocks))"))
        .withColumn("other", F.explode(F.expr("sequence(0L, if(known = top, outer_blocks, outer_blocks + inner_blocks) - 1)")))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
    )
    found = searched(pairs)
    out = cluster.saved(cluster.components(found.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))), "parts")
    cluster.forget(wide, parts)
    return out


def _blocks(df: DataFrame, n_blocks: str) -> DataFrame:
    """Put each row into every pair of blocks its own block belongs to: columns lo, hi."""
    return (
        df.withColumn("_n", F.expr(n_blocks))
        .withColumn("_own", F.expr("pmod(xxhash64(rep), _n)"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("_n - 1"))))
        .withColumn("lo", F.least("_own", "_other"))
        .withColumn("hi", F.greatest("_own", "_other"))
    )


def near_duplicates(docs: DataFrame, *, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``.

    Returns a row per row of ``docs``: doc_id, n_shingles, component_id, kept. Two texts
    are linked when 100 * |A & B| >= percent * |A | B| on their sets of distinct
    ``n_words``-word shingles (fewer words: the whole sequence is one shingle).
    ``component_id`` is the smallest doc_id reachable over links.

    Defined cases: a null, empty or all-space text has no shingles and links with nothing.
    A row with a null doc_id links with nothing, has a null component_id and is kept.
    Repeated rows of one doc_id each get a row; where their texts differ they count
    as one document, linked with whatever any of them is linked with. Columns besides the two are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    cluster.tune(spark)
    bands, rows = banding(percent)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cluster.saved(
        source.mapInArrow(_sign(n_words, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, sig binary, n_bytes long"), "signed"
    )
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = cluster.saved(
        usable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.max("n_bytes").alias("n_bytes")), "reps"
    )
    keyed = reps.select(F.explode("keys").alias("g"), "rep")
    buckets = keyed.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").selectExpr("g", f"cast(ceil(n / {BUCKET_BLOCK}) as long) as blocks")
    members = cluster.saved(keyed.join(buckets, "g"), "members")
    similar = _connected(members, reps.select("rep", F.col("sig").alias("data")), _similar(least_agreement(percent)))
    alike = cluster.saved(similar.select(F.col("component").alias("g"), F.col("node").alias("rep")).join(reps.select("rep", "n_bytes"), "rep"), "alike")
    needs = f"cast(greatest(1, ceil(count(*) / {VERIFY_BLOCK}), ceil(sum(n_bytes) / {VERIFY_BYTES})) as long) as blocks"
    groups = cluster.saved(alike.join(alike.groupBy("g").agg(F.expr(needs)), "g").select("g", "rep", "blocks").distinct(), "groups")
    texts = cluster.saved(source.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.col("text").alias("data")), "similar")
    linked = _connected(groups, texts, _verify(n_words, percent))
    cluster.forget(members, similar, alike, groups, texts)
    named = (
        reps.select("h1", "h2", F.col("n_shingles").alias("n_of"), "rep")
        .join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", "n_of", F.coalesce("component", "rep").alias("set_component"))
    )
    on = (signed.h1 == named.h1) & (signed.h2 == named.h2) & (signed.n_shingles == named.n_of) & signed.doc_id.isNotNull()
    return signed.join(named, on, "left").select(
        "doc_id", "n_shingles", F.coalesce("set_component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("set_component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _free(columns: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that are no column yet, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with ``row``: the place of (doc_id, text) among all, in that order; null where doc_id is."""
    n, mine = _free([*docs.columns, row], "__n", "__own")
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"), F.lit("-")))
    texts = Window.partitionBy(mine).orderBy(F.col("text").cast("string"))
    ranked = cluster.saved(docs.withColumn(mine, own).withColumn(n, F.dense_rank().over(texts)).drop(mine), "ranked")
    known = ranked.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), n).distinct().orderBy("doc_id", n)
    places = known.rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1]))
    places = cluster.saved(docs.sparkSession.createDataFrame(places, f"doc_id long, {n} int, {row} long"), "places")
    return ranked.join(places, ["doc_id", n], "left").drop(n)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of its smallest doc_id, then least text.

    Decided by row: where rows of one doc_id have different texts, each is compared by its own. Rows
    with a null doc_id, and those without a word, are near duplicates of nothing and all stay.
    Columns of any name pass through.
    """
    cluster.tune(docs.sparkSession)
    row, key, n = _free(docs.columns, "__row", "__key", "__n")
    same = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    ids = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long")).agg(F.count("*").alias("rows"), F.min(same).alias("low"), F.max(same).alias("high"))
    most, mixed = ids.agg(F.max("rows"), F.max(F.expr("low <> high"))).first()
    # Numbering costs two more shuffles of the texts; where no doc_id has two texts, it is their number.
    rows = _numbered(docs, row) if mixed else docs.withColumn(row, F.col("doc_id").cast("long"))
    gone = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), **options).where(~F.col("kept")).select(F.col("doc_id").alias(row)).distinct()
    left = rows.join(gone, row, "left_anti")
    if (most or 0) < 2:  # no row is repeated, which saves a shuffle of the texts
        return left.select(*docs.columns)
    has_word = F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]")
    own = F.coalesce(F.when(has_word, F.col(row).cast("string")), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"), F.lit("-")))
    order = Window.partitionBy(key).orderBy("text")
    return left.withColumn(key, own).withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: three-word shingles, Jaccard of 85 percent or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, n_words=3, percent=85)


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) sh from w
), n as (
  select doc_id, count(*) n from s group by 1
), c as (
  select a.doc_id x, b.doc_id y, count(*) both_have from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2
), l as (
  select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * both_have >= 85 * (a.n + b.n - both_have)
), e as (
  select x, y from l union all select y, x from l
), r as (
  select x, y from e union select r.x, e.y from r join e on r.y = e.x
), m as (
  select x, min(y) low from r group by 1
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) as component_id, d.doc_id <= coalesce(m.low, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join m on m.x = d.doc_id
"""
