"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z is lower-cased.
All work is done on whole column buffers in blocks cut at word ends, so neither many
short texts nor one very long text needs a Python step per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE[_SPACE] = 0
#: Lower-casing and the per-byte random values in one look-up.
_VALUE = _TABLE[_LOWER]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK + 4096)
        inverse = pow(_ODD, -1, 1 << 64)
        tables = []
        for base in (_ODD, inverse):
            t = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:
                step = np.uint64(pow(base, done, 1 << 64))
                more = min(done, size - done)
                t[done : done + more] = t[:more] * step
                done += more
            tables.append(t)
        _powers[:] = tables
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_binary()), np.int64
    if column.null_count:
        column = column.fill_null(b"" if not pa.types.is_string(column.type) else "")
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (n + 1 values)."""
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[body]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = ~space[inner]
    if offsets[0] < n:
        begins[0] = not space[0]
    starts = np.flatnonzero(begins)
    del begins
    first = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + _BLOCK)))
        b = int(starts[j]) if j < len(starts) else n
        power, inverse = _power_tables(b - a)
        v = _VALUE[body[a:b]]
        v *= power[: b - a]
        at = starts[i:j] - a
        s = np.add.reduceat(v, at)
        s *= inverse[at]
        out[i:j] = mix(s)
        i = j
    return out, first


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within each text, in order, and their offsets.

    A text of 1 to n - 1 words gives its whole sequence as one shingle; one without
    words gives none.
    """
    counts = np.diff(first)
    full = np.maximum(counts - n + 1, 0)
    short = (counts > 0) & (counts < n)
    per = full + short
    offs = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=offs[1:])
    out = np.empty(offs[-1], np.uint64)
    if len(words) >= n:
        m = len(words) - n + 1
        h = words[:m].copy()
        for k in range(1, n):
            h *= np.uint64(_ODD)
            h += words[k : k + m]
        h = mix(h)
        keep = np.zeros(m + 1, np.int32)
        a, b = first[:-1][full > 0], (first[:-1] + full)[full > 0]
        np.add.at(keep, a, 1)
        np.add.at(keep, b, -1)
        where = np.ones(offs[-1], bool)
        where[offs[:-1][short]] = False
        out[where] = h[np.cumsum(keep[:-1]) > 0]
    for d in np.flatnonzero(short):
        h = np.array([counts[d]], np.uint64)
        for w in words[first[d] : first[d + 1]]:
            h = mix(h * np.uint64(_ODD) + w)
        out[offs[d]] = h[0]
    return out, offs


def distinct_per_text(hashes: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    out = []
    for a, b in zip(offs[:-1], offs[1:]):
        s = np.sort(hashes[a:b])
        if len(s) > 1:
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        out.append(s)
    return out
