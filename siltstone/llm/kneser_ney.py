"""Interpolated modified Kneser-Ney word model of any order, counted in Spark and read by memory map.

Vocabulary: every task folds its words into a sorted run of distinct 64-bit hashes, split
over shards; a shard sums them, writes its sorted hash array into the shared folder and
numbers its words by falling count, so that a word's id is small where it is frequent.

Counting: tasks look ids up in the mapped vocabulary, fold their n-grams into runs of
distinct ones, and send them to shards by the 64-bit hash of the whole n-gram. A shard of
level k sums its grams, writes their sorted hash array, and sends on to level k - 1 what
each gram is to its suffix (one more left context) and to its prefix (one more follower),
summed within the shard. As whole grams are hashed, a word or a context that makes up a
third of the text is spread over all shards and reaches any one as one row a shard.

Scoring: the n-grams of a few megabytes of text at a time are looked up in sorted order,
shard after shard; an array is mapped for its look-up and let go, so what a worker holds
does not grow with the model. All 64 bits of a hash are compared. Nothing about the corpus
is collected but a handful of totals.

Files: every shard of every level is written, an empty one too, and a manifest at the end;
a file that is missing or too short is an error, never an unseen n-gram.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import cluster
from siltstone.llm import words as W
from siltstone.llm.minhash import group_bounds, grouped

ORDER = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of the end token and of the token that stands before a text; a word meets one of them with a chance of 2**-63.
END, BEGIN = np.uint64(0x5BF0_3635_DE5C_A1B1), np.uint64(0xC2B7_4F1D_9A60_77E3)
#: Tokens whose n-grams a task folds at a time, distinct words it holds, tokens it scores at a time, bytes of text a shard stands for.
FOLD, WORDS, SCORE, SHARD_BYTES = 1 << 21, 1 << 20, 1 << 19, 8_000_000
#: Bytes of text whose hashes are held at a time, in counting and in scoring; rows end where they end.
TEXT_BYTES, SCORE_BYTES = 8 << 20, 4 << 20
#: Bits of a hash a gram file stores with each gram, 40 where the bits above are few enough for a table of them; those are given by the shard and the place.
STORED, TABLE_BITS = (40, 48), 17
_MAX_BITS = 20


# ---- tokens and grams ------------------------------------------------------------------------------------------------


def tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, offsets per text); each text ends in END."""
    w, first = W.word_hashes(body, offsets)
    ends = first[1:] + np.arange(len(first) - 1)
    tok = np.empty(len(w) + len(ends), np.uint64)
    is_word = np.ones(len(tok), bool)
    is_word[ends] = False
    tok[is_word] = w
    tok[ends] = END
    return tok, np.concatenate([[0], ends + 1]).astype(np.int64)


def padded(ids: np.ndarray, starts: np.ndarray, begin: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``order - 1`` begins before each text, and the places of the tokens among them."""
    n = len(starts) - 1
    at = np.arange(len(ids)) + np.repeat((np.arange(n) + 1) * (order - 1), np.diff(starts))
    out = np.full(len(ids) + n * (order - 1), begin, np.uint64)
    out[at] = ids
    return out, at


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = W.mix(columns[0] * _ODD + np.uint64(11 + len(columns)))
    for c in columns[1:]:
        h = W.mix(h * _ODD + c)
    return h


def _heads(sorted_keys: np.ndarray) -> np.ndarray:
    head = np.empty(len(sorted_keys), bool)
    if len(head):
        head[0] = True
        np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=head[1:])
    return np.flatnonzero(head)


def _sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, heads) if len(heads) else values[:0]


def _edges(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of runs of equal values."""
    cut = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]) if len(shard) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(shard[a]), int(a), int(b)


# ---- runs ------------------------------------------------------------------------------------------------------------


def _put_small(x: np.ndarray) -> bytes:
    """Counts as single bytes; 255 and more follow with their places."""
    low = np.minimum(x, 255).astype(np.uint8)
    at = np.flatnonzero(low == 255).astype(np.int64)
    return np.array([len(at)], np.int64).tobytes() + at.tobytes() + x[at].astype(np.int64).tobytes() + low.tobytes()


def _get_small(data, n: int, at: int) -> tuple[np.ndarray, int]:
    m = int(np.frombuffer(data, np.int64, 1, at)[0])
    out = np.frombuffer(data, np.uint8, n, at + 8 + 16 * m).astype(np.int64)
    out[np.frombuffer(data, np.int64, m, at + 8)] = np.frombuffer(data, np.int64, m, at + 8 + 8 * m)
    return out, at + 8 + 16 * m + n


def _pack(columns: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Rows sorted by their first column, which goes as differences; the bytes of a column stand by significance."""
    parts = [np.array([len(columns[0])], np.int64).tobytes()]
    for k, c in enumerate(columns):
        x = np.ascontiguousarray(np.diff(c, prepend=np.uint64(0)) if k == 0 else c)
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        parts += [bytes([width]), x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*parts, *(_put_small(x) for x in counts)]))


def _unpack(blob: bytes, n_columns: int, n_counts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at = int(np.frombuffer(data, np.int64, 1)[0]), 8
    columns, counts = [], []
    for k in range(n_columns):
        width = data[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, width * n, at + 1).reshape(width, n).T
        x = wide.view(np.uint64)[:, 0]
        columns.append(np.cumsum(x, dtype=np.uint64) if k == 0 else x)
        at += 1 + width * n
    for _ in range(n_counts):
        x, at = _get_small(data, n, at)
        counts.append(x)
    return columns, counts


#: What a row is: a run of grams (or words) with counts, grams as suffixes, grams as contexts, totals of a shard.
GRAMS, SUFFIXES, CONTEXTS, TOTALS, NOTHING = range(5)
_ROW = "shard long, kind int, level int, blob binary, stat array<long>"
_NAMES = ["shard", "kind", "level", "blob", "stat"]
_STATS = ("n1", "n2", "n3", "n4", "n3plus", "types", "tokens", "largest")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], _NAMES)


def _sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield _rows(rows[i : i + 64])


def _gram_rows(kind: int, level: int, columns: list[np.ndarray], counts: list[np.ndarray], bits: int) -> list[tuple]:
    """Runs by shard of the whole gram; within a shard by ids, which pack better than hashes."""
    if not len(columns[0]):
        return []
    shard = gram_hash(columns) >> np.uint64(64 - bits)
    # Shard, first id and as much of the second as fits in one key: rows pack as well as fully sorted.
    width = int(max(c.max() for c in columns[:2])).bit_length()
    room = 64 - bits - width
    key = columns[1] << np.uint64(room - width) if room >= width else columns[1] >> np.uint64(width - room)
    order = np.argsort(shard << np.uint64(64 - bits) | columns[0] << np.uint64(room) | key)
    shard = shard.astype(np.int64)
    out = []
    for s, a, b in _edges(shard[order]):
        rows = order[a:b]
        out.append((s, kind, level, _pack([c[rows] for c in columns], [x[rows] for x in counts]), None))
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for table in grouped(batches, 1):
        bounds = group_bounds(table, 1)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield int(table.column(0)[int(a)].as_py()), table.slice(a, b - a)


def _of_counts(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)] + [int((x >= 3).sum())]


# ---- files -----------------------------------------------------------------------------------------------------------


def _write(path: str, n: int, parts: list[bytes]) -> None:
    """Whole or not at all: a task that runs twice writes the same file. Starts with its rows and its size."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    size = 16 + sum(len(p) for p in parts)
    with open(own, "wb") as f:
        f.write(np.array([n, size], np.int64).tobytes())
        for p in parts:
            f.write(p)
    os.replace(own, path)


def _mapped(path: str) -> tuple[np.memmap, int]:
    """A file of the model and its rows; an error where it is missing or not whole."""
    raw = np.memmap(path, np.uint8, "r")
    n, size = (int(x) for x in raw[:16].view(np.int64)) if len(raw) >= 16 else (0, -1)
    if size != len(raw):
        raise OSError(f"{path}: damaged file of the model, {len(raw)} bytes")
    return raw, n


def _codes(columns: list[np.ndarray]) -> list[bytes]:
    """Rows of several counts as numbers of the distinct rows, the commonest first.

    How many distinct rows and how many rows beyond the 255 commonest; the distinct rows;
    places and numbers of those beyond; a byte for every row.
    """
    table = np.stack(columns, axis=1)
    room = 60 // len(columns)
    small = (table < 1 << room).all(axis=1)
    key = np.zeros(len(table), np.int64)
    for c in columns:
        key = key << room | c
    _, first, at = np.unique(key[small], return_index=True, return_inverse=True)
    distinct, numbers = table[small][first], np.zeros(len(table), np.int64)
    numbers[small] = at
    if not small.all():
        large, at = np.unique(table[~small], axis=0, return_inverse=True)
        numbers[~small] = len(distinct) + at.reshape(-1)
        distinct = np.concatenate([distinct, large])
    by_count = np.argsort(-np.bincount(numbers, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(distinct), np.int64)
    rank[by_count] = np.arange(len(distinct))
    numbers = rank[numbers]
    over = np.flatnonzero(numbers >= 255)
    head = np.array([len(distinct), len(over)], np.int64).tobytes()
    return [head, distinct[by_count].tobytes(), over.tobytes(), numbers[over].tobytes(), np.minimum(numbers, 255).astype(np.uint8).tobytes()]


def _decode(raw: np.ndarray, at: int, n: int, n_columns: int, rows: np.ndarray) -> np.ndarray:
    m, k = (int(x) for x in np.frombuffer(raw, np.int64, 2, at))
    at += 16
    table = np.frombuffer(raw, np.int64, m * n_columns, at).reshape(m, n_columns)
    at += 8 * m * n_columns
    numbers = np.frombuffer(raw, np.uint8, n, at + 16 * k)[rows].astype(np.int64)
    over = np.flatnonzero(numbers == 255)
    if len(over):
        places = np.frombuffer(raw, np.int64, k, at)
        numbers[over] = np.frombuffer(raw, np.int64, k, at + 8 * k)[np.searchsorted(places, rows[over])]
    return table[numbers]


def _write_grams(path: str, keys: np.ndarray, bits: int, counts: list[np.ndarray]) -> None:
    """``keys`` sorted hashes of the shard: upper bits by a table of how many grams have them, 32 and 8 or 16 bits in two arrays."""
    for stored in STORED:
        radix = max(0, 64 - stored - bits)
        if radix > TABLE_BITS and stored != STORED[-1]:
            continue
        many = np.bincount(((keys >> np.uint64(stored)) & np.uint64((1 << radix) - 1)).astype(np.int64), minlength=1 << radix)
        if many.max() < 256 or stored == STORED[-1]:
            break
    kind, rest = (np.uint8, np.uint8) if stored == 40 else (np.uint32, np.uint16)
    high, low = (keys >> np.uint64(stored - 32)).astype(np.uint32), keys.astype(rest)
    _write(path, len(keys), [np.array([stored], np.int64).tobytes(), many.astype(kind).tobytes(), high.tobytes(), low.tobytes(), *_codes(counts)])


def _find_grams(path: str, bits: int, keys: np.ndarray, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``keys`` that are in the file, their counts)."""
    raw, n = _mapped(path)
    none = np.zeros(0, np.int64), np.zeros((0, n_columns), np.int64)
    if not n or not len(keys):
        return none
    stored = int(np.frombuffer(raw, np.int64, 1, 16)[0])
    radix = max(0, 64 - stored - bits)
    kind, rest = (np.uint8, np.uint8) if stored == 40 else (np.uint32, np.uint16)
    places = np.zeros((1 << radix) + 1, np.int64)
    np.cumsum(np.frombuffer(raw, kind, 1 << radix, 24), out=places[1:])
    at = 24 + np.dtype(kind).itemsize * (1 << radix)
    high, low = np.frombuffer(raw, np.uint32, n, at), np.frombuffer(raw, rest, n, at + 4 * n)
    bucket = ((keys >> np.uint64(stored)) & np.uint64((1 << radix) - 1)).astype(np.int64)
    want, check = (keys >> np.uint64(stored - 32)).astype(np.uint32), keys.astype(rest)
    lo, end = places[bucket], places[bucket + 1]
    hi = end.copy()
    for _ in range(int(max(1, (hi - lo).max())).bit_length()):  # all binary searches a step at a time
        mid, active = (lo + hi) >> 1, lo < hi
        less = high[np.minimum(mid, n - 1)] < want
        lo, hi = np.where(active & less, mid + 1, lo), np.where(active & ~less, mid, hi)
    found = np.full(len(keys), -1, np.int64)
    open_rows = np.arange(len(keys))
    while len(open_rows):  # rows with equal 32 bits follow each other
        p = lo[open_rows]
        inside = p < end[open_rows]
        open_rows, p = open_rows[inside], p[inside]
        same = high[p] == want[open_rows]
        open_rows, p = open_rows[same], p[same]
        hit = low[p] == check[open_rows]
        found[open_rows[hit]] = p[hit]
        open_rows = open_rows[~hit]
        lo[open_rows] += 1
    where = np.flatnonzero(found >= 0)
    return where, _decode(raw, at + (4 + low.itemsize) * n, n, n_columns, found[where])


# ---- vocabulary ------------------------------------------------------------------------------------------------------


def _texts(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of about ``most`` bytes of text at a time: (rows, token hashes, offsets)."""
    held, size = [], 0

    def out():
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        text = table.column(column)
        return table, *tokens(*W.buffers(text.chunk(0) if text.num_chunks else pa.array([], pa.string())))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
        if size >= most:
            yield out()
            size = 0
    if held:
        yield out()


def _fold_words(bits: int):
    def run(batches):
        key, n = np.array([BEGIN]), np.zeros(1, np.int64)

        def out():
            shard = (key >> np.uint64(64 - bits)).astype(np.int64)
            yield from _sent([(s, GRAMS, 1, _pack([key[a:b]], [n[a:b]]), None) for s, a, b in _edges(shard)])

        for _, tok, _ in _texts(batches, 0, TEXT_BYTES):
            u, c = np.unique(tok, return_counts=True)
            both = np.concatenate([key, u])
            order = np.argsort(both, kind="stable")
            heads = _heads(both[order])
            key, n = both[order][heads], _sums(np.concatenate([n, c])[order], heads)
            if len(key) >= WORDS:
                yield from out()
                key, n = np.array([BEGIN]), np.zeros(1, np.int64)
        yield from out()

    return run


def _reduce_words(folder: str):
    """Write a vocabulary shard: sorted hashes, ranks by falling count; and its counts by rank, as the first rank of each."""

    def run(batches):
        for shard, table in _shards(batches):
            key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for kind, blob in zip(table.column(1).to_pylist(), table.column(3)):
                if kind != GRAMS:
                    continue
                (k,), (c,) = _unpack(blob.as_py(), 1, 1)
                both = np.concatenate([key, k])
                order = np.argsort(both, kind="stable")
                heads = _heads(both[order])
                key, n = both[order][heads], _sums(np.concatenate([n, c])[order], heads)
            by_count = np.lexsort((key, -n))
            rank = np.empty(len(key), np.uint32)
            rank[by_count] = np.arange(len(key))
            _write(f"{folder}/vocabulary-{shard}", len(key), [key.tobytes(), rank.tobytes()])
            count, first = np.unique(-n[by_count], return_index=True)
            _write(f"{folder}/count-{shard}", len(key), [np.array([len(count)], np.int64).tobytes(), (-count).tobytes(), first.tobytes()])
            yield _rows([(shard, TOTALS, 0, None, [0, 0, 0, 0, 0, int((n > 0).sum()), int(n.sum()), len(key)])])

    return run


class Vocabulary:
    """Word hashes to ids: 1 + rank * shards + shard, so that small ids are frequent; 0 is unknown."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.begin = int(self.ids(np.array([BEGIN]))[0])

    def ids(self, tok: np.ndarray) -> np.ndarray:
        keys, at = np.unique(tok, return_inverse=True)
        out = np.zeros(len(keys), np.uint64)
        for s, a, b in _edges((keys >> np.uint64(64 - self.bits)).astype(np.int64)):
            raw, n = _mapped(f"{self.folder}/vocabulary-{s}")
            if not n:
                continue
            have, rank = np.frombuffer(raw, np.uint64, n, 16), np.frombuffer(raw, np.uint32, n, 16 + 8 * n)
            p = np.minimum(np.searchsorted(have, keys[a:b]), n - 1)
            known = have[p] == keys[a:b]
            out[a:b][known] = (rank[p[known]].astype(np.uint64) << np.uint64(self.bits)) + np.uint64(s + 1)
        return out[at]


# ---- counting --------------------------------------------------------------------------------------------------------


def _fold_grams(folder: str, bits: int, order: int):
    def run(batches):
        words = Vocabulary(folder, bits)
        for _, tok, starts in _texts(batches, 0, TEXT_BYTES):
            ids, at = padded(words.ids(tok), starts, words.begin, order)
            del tok
            for i in range(0, len(at), FOLD):
                here = at[i : i + FOLD]
                columns = [ids[here - (order - 1 - k)] for k in range(order)]
                h = gram_hash(columns)
                by_hash = np.argsort(h)
                heads = _heads(h[by_hash])
                first, n = by_hash[heads], np.diff(heads, append=len(by_hash))
                del h, by_hash, heads
                columns = [c[first] for c in columns]
                yield from _sent(_gram_rows(GRAMS, order, columns, [n], bits))
                del columns, first, n

    return run


def _reduce(folder: str, bits: int, level: int, top: bool):
    """Sum a shard of a level, write it, and send on what its grams are to their suffixes and prefixes."""

    def read(table: pa.Table, kind: int, n_counts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Distinct grams of one kind, sorted by hash, and their sums; run after run, so that only distinct grams are held."""
        held_key, held_columns, held_counts = np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * level, [np.zeros(0, np.int64)] * n_counts
        parts, size = [], 0

        def fold():
            nonlocal held_key, held_columns, held_counts
            columns = [np.concatenate([held_columns[k], *(p[0][k] for p in parts)]) for k in range(level)]
            counts = [np.concatenate([held_counts[k], *(p[1][k] for p in parts)]) for k in range(n_counts)]
            parts.clear()
            key = gram_hash(columns)
            order = np.argsort(key)
            heads = _heads(key[order])
            first = order[heads]
            held_key, held_columns = key[first], [c[first] for c in columns]
            held_counts = [_sums(c[order], heads) for c in counts]

        for of, blob in zip(table.column(1).to_pylist(), table.column(3)):
            if of == kind:
                parts.append(_unpack(blob.as_py(), level, n_counts))
                size += len(parts[-1][0][0])
                if size >= FOLD:
                    fold()
                    size = 0
        if parts:
            fold()
        return held_key, held_columns, held_counts

    def run(batches):
        for shard, table in _shards(batches):
            for t in table.filter(pc.equal(table.column(1), TOTALS)).to_batches():
                yield t
            key, columns, (n,) = read(table, GRAMS if top else SUFFIXES, 1)
            if top:
                _write_grams(f"{folder}/gram{level}-{shard}", key, bits, [n])
            else:
                c_key, _, contexts = read(table, CONTEXTS, 4)
                both = np.union1d(key, c_key)
                out = [np.zeros(len(both), np.int64) for _ in range(5)]
                out[0][np.searchsorted(both, key)] = n
                at = np.searchsorted(both, c_key)
                for k in range(4):
                    out[1 + k][at] = contexts[k]
                _write_grams(f"{folder}/gram{level}-{shard}", both, bits, out)
                del both, out, at, c_key, contexts
            rows = [(shard, TOTALS, level, None, [*_of_counts(n), len(n), int(n.sum()), 0])]
            # Of grams that start at a text's start all have the same left context: they count as often as they occur.
            follows = np.where(columns[1] == np.uint64(begin[0]), n, 1) if level > 2 else np.ones_like(n)
            for kind, part, counts in ((SUFFIXES, columns[1:], [follows]), (CONTEXTS, columns[:-1], [n, n == 1, n == 2, n >= 3])):
                h = gram_hash(part)
                order = np.argsort(h)
                heads = _heads(h[order])
                first = order[heads]
                part, sums = [c[first] for c in part], [_sums(np.asarray(x, np.int64)[order], heads) for x in counts]
                del h, order, heads, first
                rows += _gram_rows(kind, level - 1, part, sums, bits) if level > 2 else _word_rows(kind, part[0], sums, bits)
            yield from _sent(rows)

    begin: list[int] = []

    def started(batches):
        begin.append(Vocabulary(folder, bits).begin)
        yield from run(batches)

    return started


def _word_rows(kind: int, ids: np.ndarray, counts: list[np.ndarray], bits: int) -> list[tuple]:
    """Runs by vocabulary shard, sorted by rank."""
    shard = ((ids - np.uint64(1)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    rank = (ids - np.uint64(1)) >> np.uint64(bits)
    order = np.lexsort((rank, shard))
    return [(s, kind, 1, _pack([rank[order[a:b]]], [x[order[a:b]] for x in counts]), None) for s, a, b in _edges(shard[order])]


def _finish_words(folder: str):
    """Write each word's counts by rank: occurrences, left contexts, and as a context: total, followers seen once, twice, more."""

    def run(batches):
        for shard, table in _shards(batches):
            for t in table.filter(pc.equal(table.column(1), TOTALS)).to_batches():
                yield t
            raw, n = _mapped(f"{folder}/count-{shard}")
            m = int(np.frombuffer(raw, np.int64, 1, 16)[0])
            count, first = np.frombuffer(raw, np.int64, 2 * m, 24).reshape(2, m)
            sums = [np.zeros(n, np.int64) for _ in range(5)]
            for kind, blob in zip(table.column(1).to_pylist(), table.column(3)):
                if kind in (SUFFIXES, CONTEXTS):
                    (rank,), counts = _unpack(blob.as_py(), 1, 1 if kind == SUFFIXES else 4)
                    for k, c in enumerate(counts):
                        sums[k if kind == SUFFIXES else 1 + k][rank.astype(np.int64)] += c
            _write(f"{folder}/word-{shard}", n, _codes([np.repeat(count, np.diff(first, append=n)), *sums]))
            yield _rows([(shard, TOTALS, 1, None, [*_of_counts(sums[0]), int((sums[0] > 0).sum()), int(sums[0].sum()), 0])])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Amounts taken off counts 0, 1, 2, and 3 or more; where counts of counts are missing, the usual 0.5, 1, 1.5."""
    if not (n1 and n2):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


class Model:
    """A model in a folder. Workers map its files shard by shard as sorted look-ups reach them."""

    def __init__(self, folder: str):
        with open(f"{folder}/manifest.json") as f:
            m = json.load(f)
        self.folder, self.bits, self.order = folder, m["bits"], m["order"]
        self.totals = {int(k): v for k, v in m["totals"].items()}
        self.n_tokens, self.n_vocab = self.totals[0]["tokens"], self.totals[0]["types"]
        self.d = {k: discounts(*(self.totals[k][x] for x in ("n1", "n2", "n3", "n4"))) for k in range(1, self.order + 1)}
        self.words = Vocabulary(folder, self.bits)

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        """Rows of 6 counts; zeros for unknown words."""
        out = np.zeros((len(ids), 6), np.int64)
        place = ids - np.uint64(1)
        shard = np.where(ids == 0, -1, (place & np.uint64((1 << self.bits) - 1)).astype(np.int64))
        order = np.argsort(shard, kind="stable")
        for s, a, b in _edges(shard[order]):
            if s >= 0:
                rows = order[a:b]
                raw, n = _mapped(f"{self.folder}/word-{s}")
                out[rows] = _decode(raw, 16, n, 6, (place[rows] >> np.uint64(self.bits)).astype(np.int64))
        return out

    def gram_counts(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct hashes: the count at the highest level; else left contexts, and as a context: total, followers seen once, twice, more."""
        width = 1 if level == self.order else 5
        out = np.zeros((len(keys), width), np.int64)
        for s, a, b in _edges((keys >> np.uint64(64 - self.bits)).astype(np.int64)):
            where, counts = _find_grams(f"{self.folder}/gram{level}-{s}", self.bits, keys[a:b], width)
            out[a + where] = counts
        return out

    def _probabilities(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences, probability) of the tokens at the places ``at`` of padded ids."""
        u, place = np.unique(ids, return_inverse=True)
        counts = self.word_counts(u)
        t, d = self.totals[1], self.d[1]
        uniform = 1.0 / (self.n_vocab + 1)
        if t["tokens"]:
            left = (d[1] * t["n1"] + d[2] * t["n2"] + d[3] * t["n3plus"]) / t["tokens"]
            low = np.maximum(counts[:, 1] - d[np.minimum(counts[:, 1], 3)], 0) / t["tokens"] + left * uniform
        else:
            low = np.full(len(u), uniform)
        p, context = low[place[at]], counts[:, 2:][place[at - 1]]
        occurrences = counts[:, 0][place[at]]
        for level in range(2, self.order + 1):
            h = gram_hash([ids[max(0, level - 1 - k) : len(ids) - k] for k in range(level - 1, -1, -1)])  # the gram that ends at place i + level - 1
            rows = h[at - (level - 1)]
            top = level == self.order
            keys, where = np.unique(rows if top else np.concatenate([rows, h[at - level]]), return_inverse=True)
            found = self.gram_counts(level, keys)
            n = found[where[: len(at)], 0]
            d, total = self.d[level], np.maximum(context[:, 0], 1)
            back = (d[1] * context[:, 1] + d[2] * context[:, 2] + d[3] * context[:, 3]) / total
            p = np.where(context[:, 0] > 0, np.maximum(n - d[np.minimum(n, 3)], 0) / total + back * p, p)
            if not top:
                context = found[where[len(at) :], 1:]
        return occurrences, p

    def score(self, tok: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens known, base score, log10 probability."""
        ids, at = padded(self.words.ids(tok), starts, self.words.begin, self.order)
        count, p = np.empty(len(at), np.int64), np.empty(len(at))
        for i in range(0, len(at), SCORE):
            here = at[i : i + SCORE]
            lo = max(0, int(here[0]) - self.order)
            # A place before the first one keeps the contexts of the first text in reach.
            part = np.concatenate([[np.uint64(self.words.begin)], ids[lo : int(here[-1]) + 1]])
            count[i : i + SCORE], p[i : i + SCORE] = self._probabilities(part, here - lo + 1)
        add = lambda x: np.add.reduceat(x, starts[:-1]) if len(starts) > 1 else x[:0]  # noqa: E731  each text has its end
        return add((count > 0).astype(np.int64)), add(np.log10((count + 1) / (self.n_tokens + self.n_vocab + 1))), add(np.log10(p))


def _scorer(folder: str):
    def run(batches):
        model = Model(folder)
        for table, tok, starts in _texts(batches, 2, SCORE_BYTES):
            known, base, score = model.score(tok, starts)
            columns = [pa.array(np.diff(starts).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
            part = pa.Table.from_arrays([table.column(0), table.column(1), *columns], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
            yield from part.combine_chunks().to_batches()

    return run


def train(texts: DataFrame, *, order: int = ORDER) -> str:
    """Count ``texts(text)`` into a model of ``order``; returns its folder, under ``spark.checkpoint.dir``.

    Null, empty and all-space texts are the end token alone. An empty table gives a model in which every token is unknown.
    """
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = texts.sparkSession
    cluster.tune(spark)
    at = urlparse(cluster.new_path(spark, "ngrams"))
    if at.scheme not in ("", "file"):
        raise ValueError(f"workers memory-map the model: spark.checkpoint.dir must be a folder mounted on every host, not {at.scheme}:")
    folder = at.path
    rows = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(_MAX_BITS, max(2, int(np.ceil(np.log2(max(1, size / SHARD_BYTES))))))
    # One row a shard, so that each writes its file.
    every = spark.range(1 << bits).select(
        F.col("id").alias("shard"), F.lit(NOTHING).alias("kind"), F.lit(0).alias("level"), F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("array<long>").alias("stat")
    )

    def by_shard(df: DataFrame, then: Callable) -> DataFrame:
        return df.unionByName(every).repartition("shard").sortWithinPartitions("shard").mapInArrow(then, _ROW)

    def totals(df: DataFrame) -> dict[int, dict[str, int]]:
        sums = [F.sum(F.col("stat")[k]).alias(name) for k, name in enumerate(_STATS)]
        return {r.level: {k: r[k] or 0 for k in _STATS} for r in df.where(f"kind = {TOTALS}").groupBy("level").agg(*sums).collect()}

    found = totals(by_shard(rows.mapInArrow(_fold_words(bits), _ROW), _reduce_words(folder)))
    grams = rows.mapInArrow(_fold_grams(folder, bits, order), _ROW)
    for level in range(order, 1, -1):
        grams = by_shard(grams, _reduce(folder, bits, level, level == order))
    found |= totals(by_shard(grams, _finish_words(folder)))
    own = f"{folder}/manifest.json.{uuid.uuid4().hex}"
    with open(own, "w") as f:
        json.dump({"bits": bits, "order": order, "totals": found}, f)
    os.replace(own, f"{folder}/manifest.json")
    return folder


def language_model_scores(docs: DataFrame, *, order: int = ORDER) -> DataFrame:
    """Train on ``docs(doc_id, text, held_out)`` where not ``held_out``, score every row.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram)
    and score (the model's log10 probability of the text and its end).

    Defined cases: null, empty and all-space texts are the end token alone. A null
    ``held_out`` counts as false. Repeated rows count and are scored each. Other columns
    are ignored. Without training rows every token has probability 1 / (V + 1), V = 0. An
    empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    folder = train(rows.where(~F.col("held_out")).select("text"), order=order)
    n_tokens = Model(folder).n_tokens
    return rows.mapInArrow(_scorer(folder), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: rows whose crc32(doc_id) mod 7 is 2 are held out; a null doc_id is trained on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return language_model_scores(docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))))
