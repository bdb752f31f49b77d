"""Repeated substrings by merging shard Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts earlier is removed.

1. Anchors. Texts are written once, as chunk files in the shared folder. Of the
   ``GRAM``-byte grams in each window of ``length`` bytes the one of least hash is the
   window's anchor; equal windows have equal anchors at equal places, and each anchor stands
   for a few windows in a row. A chunk's distinct anchors go by hash to shards, which answer
   with those that occur more than once.
2. Contexts. The bytes of the windows of such an anchor are its context. Equal contexts of a
   chunk go as one string with several places.
3. Merge. The contexts of a shard's anchors are gathered to batches of whole groups; equal
   ones, by their bytes, are one weighted string. The strings of a batch are dealt over
   shards, each shard gets its Burrows-Wheeler transform, and the transforms are merged by
   iterative interleave refinement: round h stably deals the interleave by the symbols
   before the suffixes, after which suffixes are in order of their first h bytes and share a
   block exactly if these are equal. After ``length`` rounds the blocks of a weight over one
   are the repeated intervals: no suffix is sorted again. All of a block but its earliest
   place are repeats.
4. Removal. The covered ranges of a text are joined and cut out of its chunk.

Hashes only decide what meets; what is equal is decided by bytes.

Scale: what is shuffled are distinct anchors (one in 35 bytes), the contexts of repeated
ones, and ranges; texts are not shuffled. An anchor with more than ``WIDE`` places, as in a
passage that a third of all texts share, is split into its windows: a chunk sends the hash
of each distinct window, and of those that occur in several chunks one copy, which goes
through the merge as a string of its own. So no key ever has more than one row a chunk, and
no group more than ``WIDE`` strings.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import cluster
from siltstone.llm import words as W
from siltstone.llm.minhash import group_bounds, grouped

LENGTH, GRAM = 100, 32
#: Bytes and rows of a chunk, bytes of text a shard stands for, places of an anchor that is not split.
CHUNK, CHUNK_ROWS, SHARD_BYTES, WIDE = 8 << 20, 1 << 17, 12_000_000, 2048
#: Bytes of text a task of a later stage stands for. The partitions are counted from the text, as what they are sent is far smaller.
TASK_BYTES = 64 << 20
#: Bytes of the strings of a batch, transforms of a batch.
BATCH_BYTES, TRANSFORMS = 1 << 20, 4
_POS = np.uint64((1 << 24) - 1)
_STEP = 1 << 20
_TABLE = np.random.default_rng(971).integers(1, 1 << 63, 256, dtype=np.uint64)


def _prefix_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = W._power_tables(len(b) + 1)
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * power[: len(b)], out=s[1:])
    return s, inverse


def anchors(body: np.ndarray, offsets: np.ndarray, length: int, hash_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, windows) of the anchors of texts laid end to end, in order; windows lie within texts.

    A hash cut to fewer ``hash_bits`` only lets more anchors meet.
    """
    found = []
    for c in range(0, max(0, len(body) - length + 1), _STEP):
        part = body[c : c + _STEP + length - 1]
        s, inverse = _prefix_hashes(part)
        g = len(part) - GRAM + 1
        grams = W.mix((s[GRAM:] - s[:-GRAM]) * inverse[:g])
        if hash_bits < 64:
            grams >>= np.uint64(63)
            grams >>= np.uint64(1)
        m = (grams & ~_POS) | np.arange(g, dtype=np.uint64)
        width, span = length - GRAM + 1, 1
        while span * 2 <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < width:
            m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
        place = (m & _POS).astype(np.int64)
        change = np.zeros(len(place) + 1, np.int32)
        k = len(place)
        lo, hi = np.clip(offsets[:-1] - c, 0, k), np.clip(offsets[1:] - length + 1 - c, 0, k)
        some = lo < hi
        np.add.at(change, lo[some], 1)
        np.add.at(change, hi[some], -1)
        inside = np.cumsum(change[:-1]) > 0
        head = inside.copy()
        head[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
        first = np.flatnonzero(head)
        stops = np.flatnonzero(head | ~inside)
        after = np.searchsorted(stops, first, side="right")
        end = np.concatenate([stops, [k]])[after]
        # Anchors are least hashes: mixed once more, or most of them would meet in the first shards.
        found.append((W.mix(grams[place[first]] + np.uint64(1)), first + c, end - first))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def join_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch become one; sorted."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(head)[1:] - 1, [len(start) - 1]])
    return start[head], end[last]


# ---- Burrows-Wheeler transforms --------------------------------------------------------------------------------------


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order and Burrows-Wheeler transform of a shard: (string, offset, symbol before, place of the longer suffix), in suffix order.

    Symbol 0 stands before a string's first byte and for its end; ends are ordered by string.
    """
    m = len(strings)
    sizes = np.array([len(x) + 1 for x in strings])
    n = int(sizes.sum())
    ends = np.cumsum(sizes) - 1
    x = np.zeros(n, np.int64)
    keep = np.ones(n, bool)
    keep[ends] = False
    x[keep] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    first = np.where(keep, x + m, 0)
    first[ends] = np.arange(m)
    base = m + 257
    wide = np.concatenate([first, np.zeros(256, np.int64)])
    key, span = first.copy(), 1
    while base ** (span + 1) < 1 << 62:
        key = key * base + wide[span : span + n]
        span += 1
    order = np.argsort(key)
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    single = head & np.concatenate([head[1:], [True]])
    open_rows = order[~single]
    while len(open_rows):
        after = rank[np.minimum(open_rows + span, n - 1)]
        key = rank[open_rows] << 32 | after
        o = np.argsort(key)
        rows, key = open_rows[o], key[o]
        group = np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32])
        head = np.concatenate([[True], key[1:] != key[:-1]])
        i = np.arange(len(rows))
        start = np.maximum.accumulate(np.where(group, i, 0))
        rank[rows] = (key >> 32) + np.maximum.accumulate(np.where(head, i, 0)) - start
        single = head & np.concatenate([head[1:], [True]])
        open_rows = rows[~single]
        span *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    string = np.searchsorted(ends, order)
    offset = order - (ends - sizes + 1)[string]
    previous = np.maximum(order - 1, 0)
    return string, offset, np.where(offset > 0, x[previous], 0), np.where(offset > 0, rank[previous], 0)


def merge(symbols: np.ndarray, before: np.ndarray, first: np.ndarray, depth: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Interleave refinement of the Burrows-Wheeler transforms of several shards.

    Suffixes are named by their place in the shards' orders, one shard after the other:
    ``symbols`` are the transforms, ``before`` the places of the suffixes one symbol longer,
    ``first`` the places to begin with, each with ``depth`` symbols before it. Round h deals
    the interleave stably by the symbols before its suffixes; then suffixes stand by their
    first h symbols and share a block exactly if these are equal. A suffix alone in its block
    stays alone, and so do the longer ones it leads to: it leaves the interleave, and is a
    repeated interval of its own if it is ``heavy``. Returns the suffixes that share their
    first ``depth`` symbols with others, in merged order, with their blocks; and the heavy
    ones that left, with the symbols they were short of ``depth``.
    """
    at = first.astype(np.int32)
    block = np.zeros(len(at), np.int32)
    rounds = [(symbols, before, 1)] * depth
    if symbols.dtype == np.uint8:  # two rounds in one: dealing by pairs of symbols is dealing by one and then the other
        pair = symbols[before].astype(np.uint16) << 8 | symbols
        rounds = [(pair, before[before], 2)] * (depth // 2) + [(symbols, before, 1)] * (depth % 2)
    left = depth
    alone, short = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for dealt, longer, taken in rounds:
        if not len(at):
            break
        symbol = dealt[at]
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        earlier, at = block[order], longer[at[order]]
        left -= taken
        head = np.empty(len(order) + 1, bool)
        head[0] = head[-1] = True
        np.not_equal(symbol[1:], symbol[:-1], out=head[1:-1])
        head[1:-1] |= earlier[1:] != earlier[:-1]
        keep = ~(head[:-1] & head[1:])
        leaving = at[~keep]
        leaving = leaving[heavy[leaving]]
        alone.append(leaving)
        short.append(np.full(len(leaving), left))
        block = np.cumsum(head[:-1], dtype=np.int32)[keep]
        at = at[keep]
    return at, block, np.concatenate(alone), np.concatenate(short)


def repeated(strings: list[bytes], weights: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of distinct strings that occur more than once, a string counting as often as its weight: (string, offset, block)."""
    none = np.zeros(0, np.int64)
    if not strings:
        return none, none, none
    string, offset, symbols, before, base = [], [], [], [], 0
    for k in range(min(TRANSFORMS, len(strings))):
        shard = np.arange(k, len(strings), TRANSFORMS)
        of, at, symbol, longer = transform([strings[i] for i in shard])
        string.append(shard[of]), offset.append(at), symbols.append(symbol), before.append(longer + base)
        base += len(of)
    symbols, string, offset = (np.concatenate(x) for x in (symbols, string, offset))
    symbols = symbols.astype(np.uint8 if symbols.max() < 256 else np.uint16)
    place, block, alone, short = merge(symbols, np.concatenate(before).astype(np.int32), np.flatnonzero(offset >= length), length, weights[string] > 1)
    own = np.arange(len(alone)) + (int(block.max()) + 1 if len(block) else 0)
    return np.concatenate([string[place], string[alone]]), np.concatenate([offset[place], offset[alone] - short]), np.concatenate([block, own]).astype(np.int64)


def later_ranges(strings: list[bytes], owner: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is covered by windows that also start earlier: (row of ``places``, from, to), the ends counted from the row's start.

    ``places``: rows (doc, th, start), ``owner`` the string that stands there; a window is at one place of one string only.
    """
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0], owner))
    first = np.searchsorted(owner[order], np.arange(len(strings)))
    weights = np.diff(first, append=len(order))
    string, offset, block = repeated(strings, weights, length)
    if not len(string):
        return (np.zeros(0, np.int64),) * 3
    doc, th, start = places[order[first[string]]].T
    o = np.lexsort((start + offset, th, doc, block))
    won = np.zeros(len(string), bool)
    won[o[np.concatenate([[True], block[o][1:] != block[o][:-1]])]] = True

    def ranges(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Joined windows by string: (string, from, to)."""
        s, a = string[rows], offset[rows]
        k = np.lexsort((a, s))
        s, a = s[k], a[k]
        head = np.concatenate([[True], (s[1:] != s[:-1]) | (a[1:] > a[:-1] + length)]) if len(s) else np.zeros(0, bool)
        last = np.concatenate([np.flatnonzero(head)[1:] - 1, [len(s) - 1]]) if len(s) else np.zeros(0, np.int64)
        return s[head], a[head], a[last] + length

    # The first place of a string keeps the windows it won; all other places lose every repeated one.
    s, a, e = ranges(np.flatnonzero(~won))
    out = [(order[first[s]], a, e)]
    s, a, e = ranges(np.arange(len(string)))
    times = weights[s] - 1
    row = np.repeat(np.arange(len(s)), times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + 1
    out.append((order[first[s[row]] + nth], a[row], e[row]))
    return tuple(np.concatenate(x) for x in zip(*out))


# ---- files and rows --------------------------------------------------------------------------------------------------


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    at = urlparse(path)
    return (pafs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else pafs.FileSystem.from_uri(path)


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers and of bytes; numbers by significance of their bytes, without upper zeros."""
    parts = [bytes([len(arrays)])]
    for x in arrays:
        wide = x.dtype != np.uint8
        x = np.ascontiguousarray(x)
        width = max(1, (int(x.view(np.uint64).max()).bit_length() + 7) // 8) if wide and len(x) else 1
        parts += [bytes([wide, width]), np.array([len(x)], np.int64).tobytes(), x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if wide else x.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _load(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(data[0]):
        wide, width, n = data[at], data[at + 1], int(np.frombuffer(data, np.int64, 1, at + 2)[0])
        x = np.frombuffer(data, np.uint8, width * n, at + 10)
        if wide:
            y = np.zeros((n, 8), np.uint8)
            y[:, :width] = x.reshape(width, n).T
            x = y.view(np.int64)[:, 0]
        out.append(x)
        at += 10 + width * n
    return out


class Chunk:
    """Texts laid end to end, with their ids."""

    def __init__(self, doc_id, null, doc, th, offsets, body):
        self.doc_id, self.null, self.doc, self.th, self.offsets, self.body = doc_id, null, doc, th, offsets, body

    def write(self, path: str) -> None:
        """Whole or not at all: a task that runs twice writes the same file."""
        fs, at = _file(path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        own = f"{at}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(_dump(self.doc_id, self.null, self.doc, self.th, self.offsets, self.body))
        fs.move(own, at)

    @classmethod
    def read(cls, path: str) -> Chunk:
        fs, at = _file(path)
        with fs.open_input_stream(at) as f:
            return cls(*_load(f.read()))

    def joined(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges that overlap or touch within a text become one: (row, start, end)."""
        row = np.searchsorted(self.offsets, start, side="right") - 1
        start, end = join_ranges(start + row, end + row)  # a gap of one between texts
        row = np.searchsorted(self.offsets + np.arange(len(self.offsets)), start, side="right") - 1
        return row, start - row, end - row

    def places(self, start: np.ndarray) -> np.ndarray:
        """Rows (doc, th, start)."""
        row = np.searchsorted(self.offsets, start, side="right") - 1
        return np.stack([self.doc[row], self.th[row], start], axis=1)


#: What a row is: a chunk there is; anchors of a chunk for a shard; a shard's answer to a chunk; contexts for a shard; ranges of a chunk; windows of split anchors for a shard; those of them to send.
CHUNKS, ANCHORS, ANSWER, CONTEXTS, RANGES, WINDOWS, WANTED = range(7)
_ROW = "shard long, chunk long, kind int, data binary"


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for i in range(0, len(rows), 64):
        cols = list(zip(*rows[i : i + 64]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["shard", "chunk", "kind", "data"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[int], pa.ChunkedArray]]:
    """(key, other key, kinds, data) of rows sorted by their first column."""
    for table in grouped(batches, 1):
        bounds = group_bounds(table, 1)
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = table.slice(a, b - a)
            yield int(part.column(0)[0].as_py()), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3)


def _cuts(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to)."""
    cut = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]]) if len(sorted_values) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(sorted_values[a]), int(a), int(b)


def _shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


# ---- stages ----------------------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Chunk]:
    held: list[tuple] = []
    size = rows = 0

    def out() -> Chunk:
        doc_id, null, doc, th, sizes, body = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return Chunk(doc_id, null.astype(np.uint8), doc, th, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), body)

    for batch in batches:
        body, offs = W.buffers(batch.column(3))
        a = 0
        while a < batch.num_rows:
            b = min(batch.num_rows, max(a + 1, int(np.searchsorted(offs, offs[a] + most - size))))
            ids = batch.column(0).slice(a, b - a)
            part = [batch.column(k).slice(a, b - a).to_numpy() for k in (1, 2)]
            held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), *part, np.diff(offs[a : b + 1]), body[offs[a] : offs[b]]))
            size, rows, a = size + int(offs[b] - offs[a]), rows + b - a, b
            if size >= most or rows >= CHUNK_ROWS:
                yield out()
                size = rows = 0
    if held:
        yield out()


def _distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(sorted distinct keys, how often, cuts by shard)."""
    u, n = np.unique(keys, return_counts=True)
    return u, n, list(_cuts(_shard_of(u, bits)))


def _fold(folder: str, length: int, bits: int, most: int, hash_bits: int):
    """Texts to chunk files, and the distinct anchors of each chunk by shard."""

    def run(batches):
        # The same rows of a partition make the same chunks whenever a task runs again.
        name = TaskContext.get().partitionId() << 24
        for chunk in _chunks(batches, most):
            chunk.write(f"{folder}/{name}")
            h, _, _ = anchors(chunk.body, chunk.offsets, length, hash_bits)
            u, n, cuts = _distinct(h, bits)
            rows = [(s, name, ANCHORS, _dump(np.diff(u[a:b], prepend=np.uint64(0)), n[a:b])) for s, a, b in cuts]
            yield from _rows([(-1 - name, name, CHUNKS, None), *rows])
            name += 1

    return run


def _answer(wide: int):
    """Of a shard's anchors: 0 for those that occur once, 1, or 2 if more often than ``wide``; to each chunk in the order it sent them."""

    def run(batches):
        for shard, chunks, kinds, data in _groups(batches):
            if shard < 0:
                yield from _rows([(shard, c, k, None) for c, k in zip(chunks, kinds)])
                continue
            sent = [_load(x.as_py()) for x in data]
            u, at = np.unique(np.concatenate([np.cumsum(d.view(np.uint64), dtype=np.uint64) for d, _ in sent]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in sent]), minlength=len(u))
            state = ((n > 1).astype(np.uint8) + (n > wide))[at].astype(np.uint8)
            ends = np.cumsum([len(d) for d, _ in sent])
            yield from _rows([(shard, c, ANSWER, _dump(state[e - len(d) : e])) for c, e, (d, _) in zip(chunks, ends, sent)])

    return run


def _pack_strings(keys: list[int], strings: list[bytes], owner: np.ndarray, places: np.ndarray) -> bytes:
    """Strings sorted by key; places sorted by string: (doc, th, start)."""
    k = np.array(keys, np.uint64)
    sizes = np.array([len(x) for x in strings], np.int64)
    return _dump(np.diff(k, prepend=np.uint64(0)), sizes, np.bincount(owner, minlength=len(strings)).astype(np.int64), *places.T, np.frombuffer(b"".join(strings), np.uint8))


def _string_rows(name: int, found: dict[tuple[int, bytes], list[int]], chunk: Chunk, bits: int) -> list[tuple]:
    """``found``: key and string to starts; a row a shard."""
    rows = []
    items = sorted(found.items())
    for s, a, b in _cuts(_shard_of(np.array([k for (k, _), _ in items], np.uint64), bits)):
        part = items[a:b]
        owner = np.repeat(np.arange(len(part)), [len(at) for _, at in part])
        places = chunk.places(np.array([x for _, at in part for x in at], np.int64))
        rows.append((s, name, CONTEXTS, _pack_strings([k for (k, _), _ in part], [t for (_, t), _ in part], owner, places)))
    return rows


def _range_row(name: int, start: np.ndarray, end: np.ndarray) -> tuple:
    order = np.argsort(start, kind="stable")
    return -1 - name, name, RANGES, _dump(np.diff(start[order].astype(np.int64), prepend=0), (end - start)[order].astype(np.int64))


def _cut(folder: str, length: int, bits: int, hash_bits: int):
    """The contexts of a chunk's repeated anchors, as distinct strings with their places; split anchors as windows."""

    def run(batches):
        for name, shards, kinds, data in _groups(batches):
            yield from _rows([(-1 - name, name, CHUNKS, None)])
            answers = {s: _load(x.as_py())[0] for s, k, x in zip(shards, kinds, data) if k == ANSWER}
            if not any(x.any() for x in answers.values()):
                continue
            chunk = Chunk.read(f"{folder}/{name}")
            h, first, windows = anchors(chunk.body, chunk.offsets, length, hash_bits)
            u, _, cuts = _distinct(h, bits)
            state = np.concatenate([answers[s] for s, _, _ in cuts])[np.searchsorted(u, h)]
            body = chunk.body.tobytes()
            found: dict[tuple[int, bytes], list[int]] = {}
            hit = np.flatnonzero(state == 1)
            for key, a, e in zip(h[hit].tolist(), first[hit].tolist(), (first + windows + length - 1)[hit].tolist()):
                found.setdefault((key, body[a:e]), []).append(a)
            yield from _rows(_string_rows(name, found, chunk, bits))
            del found
            hit = np.flatnonzero(state == 2)
            if len(hit):
                yield from _split(name, chunk, body, first[hit], windows[hit], length, bits, hash_bits)

    return run


def _split(name: int, chunk: Chunk, body: bytes, first: np.ndarray, windows: np.ndarray, length: int, bits: int, hash_bits: int) -> Iterator[pa.RecordBatch]:
    """Windows of split anchors: a chunk's later copies are ranges at once, the first of each goes on as a hash."""
    start = np.repeat(first - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
    places = chunk.places(start)
    earliest: dict[bytes, int] = {}
    later = []
    for k in np.lexsort((start, places[:, 1], places[:, 0])).tolist():
        a = int(start[k])
        if earliest.setdefault(body[a : a + length], a) != a:
            later.append(a)
    if later:
        at = np.array(later, np.int64)
        yield from _rows([_range_row(name, *chunk.joined(at, at + length)[1:])])
    keys = np.array([xxhash.xxh3_64_intdigest(w) for w in earliest], np.uint64)
    if hash_bits < 64:
        keys[:] = 0
    at = np.array(list(earliest.values()), np.int64)
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    yield from _rows([(s, name, WINDOWS, _dump(np.diff(keys[a:b], prepend=np.uint64(0)), at[a:b])) for s, a, b in _cuts(_shard_of(keys, bits))])


def _merged(length: int):
    """Contexts of a shard to ranges of chunks; windows that several chunks sent are asked for."""

    def strings_of(chunks, kinds, data):
        """Distinct strings by key, the string of each place, and (doc, th, start, chunk) of each place."""
        number: dict[bytes, int] = {}
        keys, owner, places = [], [], []
        for c, kind, x in zip(chunks, kinds, data):
            if kind != CONTEXTS:
                continue
            key, sizes, n, doc, th, start, raw = _load(x.as_py())
            raw, ends = raw.tobytes(), np.cumsum(sizes)
            at = []
            for k, e, size in zip(np.cumsum(key.view(np.uint64), dtype=np.uint64).tolist(), ends.tolist(), sizes.tolist()):
                i = number.setdefault(raw[e - size : e], len(number))
                if i == len(keys):
                    keys.append(k)
                at.append(i)
            owner.append(np.repeat(np.array(at, np.int64), n))
            places.append(np.stack([doc, th, start, np.full(len(doc), c, np.int64)], axis=1))
        return keys, list(number), owner, places

    def run(batches):
        for shard, chunks, kinds, data in _groups(batches):
            if shard < 0:
                yield from _rows([(shard, c, k, x.as_py()) for c, k, x in zip(chunks, kinds, data)])
                continue
            keys, strings, owner, places = strings_of(chunks, kinds, data)
            if strings:
                yield from ranges_of(np.array(keys, np.uint64), strings, np.concatenate(owner), np.concatenate(places))
            del keys, strings, owner, places
            sent = [(c, _load(x.as_py())) for c, k, x in zip(chunks, kinds, data) if k == WINDOWS]
            if sent:
                u, at, n = np.unique(np.concatenate([np.cumsum(d.view(np.uint64), dtype=np.uint64) for _, (d, _) in sent]), return_inverse=True, return_counts=True)
                several = (n > 1)[at]
                ends = np.cumsum([len(d) for _, (d, _) in sent])
                asked = [(c, d, p, several[e - len(d) : e]) for (c, (d, p)), e in zip(sent, ends)]
                yield from _rows([(-1 - c, c, WANTED, _dump(np.cumsum(d)[w], p[w])) for c, d, p, w in asked if w.any()])

    def ranges_of(keys, strings, owner, places):
        by_key = np.argsort(keys, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[by_key] = np.arange(len(keys))
        owner = rank[owner]
        order = np.argsort(owner, kind="stable")
        owner, places = owner[order], places[order]
        weight = np.bincount(owner, minlength=len(keys))
        keys = keys[by_key]
        group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1
        sizes = np.array([len(strings[i]) for i in by_key])
        # A group of one place has no repeat.
        some = np.bincount(group, weights=weight)[group] > 1
        volume = np.cumsum(np.where(some, sizes, 0)) // BATCH_BYTES
        batch = volume[np.searchsorted(group, group)]  # whole groups
        out = []
        for _, a, b in _cuts(batch):
            rows = np.arange(a, b)[some[a:b]]
            if not len(rows):
                continue
            lo, hi = np.searchsorted(owner, [a, b])
            mine = np.flatnonzero(some[owner[lo:hi]]) + lo
            local = np.searchsorted(rows, owner[mine])
            row, start, end = later_ranges([strings[i] for i in by_key[rows]], local, places[mine][:, :3], length)
            at = places[mine[row]]
            out.append((at[:, 3], at[:, 2] + start, at[:, 2] + end))
        chunk, start, end = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        order = np.argsort(chunk, kind="stable")
        rows = []
        for c, a, b in _cuts(chunk[order]):
            k = order[a:b]
            rows.append(_range_row(c, start[k], end[k]))
        yield from _rows(rows)

    return run


def _cut_windows(folder: str, length: int, bits: int):
    """The windows of split anchors that other chunks have too, as strings."""

    def run(batches):
        for name, _, _, data in _groups(batches):
            asked = [_load(x.as_py()) for x in data]
            keys, at = np.concatenate([k for k, _ in asked]).view(np.uint64), np.concatenate([a for _, a in asked])
            chunk = Chunk.read(f"{folder}/{name}")
            found = {(k, chunk.body[a : a + length].tobytes()): [a] for k, a in zip(keys.tolist(), at.tolist())}
            yield from _rows(_string_rows(name, found, chunk, bits))

    return run


def _remove(folder: str, keep_text: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for name, _, of, data in _groups(batches):
            chunk = Chunk.read(f"{folder}/{name}")
            found = [_load(x.as_py()) for k, x in zip(of, data) if k == RANGES]
            start = np.concatenate([np.cumsum(a) for a, _ in found] or [np.zeros(0, np.int64)])
            end = start + np.concatenate([n for _, n in found] or [start])
            row, start, end = chunk.joined(start, end)
            bounds = np.searchsorted(row, np.arange(len(chunk.doc) + 1))
            body, out = chunk.body.tobytes(), []
            for d, (lo, hi) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())):
                kept, at = [], lo
                for a, e in zip(start[bounds[d] : bounds[d + 1]].tolist(), end[bounds[d] : bounds[d + 1]].tolist()):
                    kept.append(body[at:a])
                    at = e
                left = b"".join([*kept, body[at:hi]])
                doc_id = None if chunk.null[d] else int(chunk.doc_id[d])
                out.append((doc_id, hi - lo, hi - lo - len(left), int(bounds[d + 1] - bounds[d]), hashlib.sha256(left).hexdigest(), left if keep_text else None))
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 1000]), kinds)], names)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, th, body): rows by (doc, th) are distinct; th is 0 unless a doc_id is repeated or null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("body"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 OR doc_id IS NULL").limit(1).count() == 0:
        return rows.select("doc_id", F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("th"), "body")
    named = rows.where("doc_id IS NOT NULL").withColumn("th", F.row_number().over(Window.partitionBy("doc_id").orderBy("body")).cast("long"))
    others = rows.where("doc_id IS NULL").withColumn("th", F.monotonically_increasing_id())
    return cluster.saved(named.unionByName(others).select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "th", "body"), "numbered")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, keep_text: bool = False, chunk_bytes: int = CHUNK, wide: int = WIDE, hash_bits: int = 64) -> DataFrame:
    """Remove repeated strings from ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a
    smaller doc_id, or earlier in the same text); strings are judged on the input. ``kept``
    holds the bytes left where ``keep_text``, else null. ``length`` is over 32. The result
    does not depend on ``chunk_bytes``, ``wide`` and ``hash_bits``.

    Defined cases: a null text is empty. Rows with a null doc_id come last. Rows of one
    doc_id are texts of their own, in the order of their bytes. Other columns are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cluster.tune(spark)
    folder = cluster.new_path(spark, "chunks")
    rows = _numbered(docs)
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = max(2, int(np.ceil(np.log2(max(1, total / SHARD_BYTES)))))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)

    def by(key: str, df: DataFrame, then: Callable) -> DataFrame:
        other = "chunk" if key == "shard" else "shard"
        return df.select(key, other, "kind", "data").repartition(parts, key).sortWithinPartitions(key).mapInArrow(then, _ROW)

    folded = rows.mapInArrow(_fold(folder, length, bits, chunk_bytes, hash_bits), _ROW)
    contexts = by("chunk", by("shard", folded, _answer(wide)), _cut(folder, length, bits, hash_bits))
    merged = cluster.saved(by("shard", contexts, _merged(length)), "ranges")
    more = by("shard", by("chunk", merged.where(f"kind = {WANTED}"), _cut_windows(folder, length, bits)), _merged(length))
    ranges = merged.where(f"kind <> {WANTED}").unionByName(more).select("chunk", "shard", "kind", "data").repartition(parts, "chunk").sortWithinPartitions("chunk")
    return ranges.mapInArrow(_remove(folder, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: 100-byte strings that start earlier."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
