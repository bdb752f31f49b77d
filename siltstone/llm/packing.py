"""Pack tokenised documents into fixed windows by best-fit decreasing.

Documents are tokenised once, overlong ones cut into full windows, and the rest is packed
whole, longest first, each into the open window it fits most tightly. Best fit depends on
lengths alone, so it runs on the histogram of lengths (one count per length, at most the
window size): a segment tree over remaining capacities finds the tightest open windows, and
all equal pieces that best fit would send to windows of one capacity are placed in one step.
Each step is a run: so many ranks of one length go to so many consecutive windows. Pieces
get a rank within their length from per-task counts and a prefix sum, and look their run up.

Scale: no piece reaches the driver, only 2,048 counts; ranks need no sort of a hot length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from siltstone.llm import cluster

WINDOW, END_ID, CACHED_WORDS = 2048, 1, 1_000_000
GROUP_BYTES = 1 << 21  # of texts whose words are looked up together
_SPLIT = "<|endoftext|>"
_tokenizers: dict = {}

#: What a tokenizer has to do to texts before its merges for words to be parted here.
_SUFFIX = "</w>"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PARTING = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Words of printable ASCII and the letters of Latin-1, which NFC leaves alone, and the tokenizer's parts of their lower case.
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+|\n")
_MARK = b"\xff" * 4  # stands for the end of a word; no id is that large


class WordTokenizer:
    """Ids of texts as little-endian bytes.

    The tokenizer never joins across white space, so ids are those of the words in turn;
    words seen before come from a bounded cache. Latin words are lower-cased and parted into
    letters, digits and signs here as the tokenizer does it, and new parts are encoded
    together by its merges alone; the last token of each part ends in the suffix. Of other
    words, those with a capital or a last full stop or comma take the ids of their plain
    form, and new ones are encoded by the whole tokenizer in one call with a special token
    between them. So are all words of a tokenizer that prepares texts in another way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.split_id = self.inner.token_to_id(_SPLIT)
        self.cache: dict[str, bytes] = {}
        self.merges = None
        spec = json.loads(self.inner.to_str())
        model = spec["model"]
        known = {"normalizer": _NORMALIZER, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [_PARTING, _BYTES]}, "truncation": None, "padding": None}
        same = all(spec[k] == v for k, v in known.items()) and all("<|" in t["content"] for t in spec["added_tokens"])
        if same and model["type"] == "BPE" and model["end_of_word_suffix"] == _SUFFIX and not model["dropout"]:
            bare = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTES]}
            self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": bare, "added_tokens": []}))
            self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.last[[i for token, i in model["vocab"].items() if token.endswith(_SUFFIX)]] = True

    def _learn_parts(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 500):
            some = parts[i : i + 500]
            ids = np.array(self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(some):  # a vocabulary without some last byte
                self._learn(some)
                continue
            data, a = ids.tobytes(), 0
            for part, b in zip(some, ends):
                self.cache[part] = data[4 * a : 4 * b]
                a = b

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if "<|" not in w]
        for i in range(0, len(plain), 5000):
            part = plain[i : i + 5000]
            ids = np.array(self.inner.encode(_SPLIT.join(part), add_special_tokens=False).ids, "<u4")
            ends = np.concatenate([[-1], np.flatnonzero(ids == self.split_id), [len(ids)]])
            data = ids.tobytes()
            for w, a, b in zip(part, (ends[:-1] + 1).tolist(), ends[1:].tolist()):
                self.cache[w] = data[4 * a : 4 * b]
        for w in words:
            if "<|" in w:
                self.cache[w] = np.array(self.inner.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_all(self, words: set[str]) -> None:
        if self.merges is not None:
            latin = [w for w in words if _LATIN.fullmatch(w) and "<|" not in w]
            if latin:
                self._learn_latin(latin)
                words = words.difference(latin)
        plain = {w: _plain(w) for w in words}
        if plain:
            self._learn(list({".", ",", *(core for core, _ in plain.values())}.difference(self.cache)))
        for w, (core, sign) in plain.items():
            self.cache[w] = self.cache[core] + self.cache[sign] if sign else self.cache[core]

    def _learn_latin(self, words: list[str]) -> None:
        cache, whole, mixed = self.cache, [], []
        for w in words:
            (whole if w.isalpha() else mixed).append(w)
        lower = [w.lower() for w in whole]
        parts = _PARTS.findall("\n".join(mixed).lower())
        self._learn_parts(list({*lower, *parts}.difference(cache, "\n")))
        cache.update(zip(whole, map(cache.__getitem__, lower)))
        cache["\n"] = _MARK
        cache.update(zip(mixed, b"".join(map(cache.__getitem__, parts)).split(_MARK)))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // GROUP_BYTES)) + 1).tolist(), len(texts)]
        return [ids for a, b in zip(cuts, cuts[1:]) if a < b for ids in self._encode(texts.slice(a, b - a))]

    def _encode(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        at = np.array(split.offsets, np.int64)
        coded = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        words, cache = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.cache
        found = list(map(cache.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            if len(cache) + len(new) > CACHED_WORDS:
                cache.clear()
            self._learn_all({words[k] for k in new})
        for k in new:
            found[k] = cache[words[k]]
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(ids) + 1, 8 * ids.offset)[at - at[0]].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(bounds, bounds[1:])]


def _plain(word: str) -> tuple[str, str]:
    """(form without capitals and closing sign, closing sign)."""
    sign = ""
    if len(word) > 1 and word[-1] in ".," and word[-2].isalpha():
        word, sign = word[:-1], word[-1]
    if word.isalpha() and not word.islower() and "\u03a3" not in word and "\u0130" not in word:  # their lower case depends on more than the letter
        word = word.lower()
    return word, sign


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(path: str, window: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen, task = _tokenizer(path), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode(pc.fill_null(batch.column(1), ""))):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, window):
                    size = min(window, n - a)
                    data = ids[4 * a : 4 * (a + size)]
                    rows.append((doc, a, size, zlib.crc32(data), n, task, int(seen[size]), data if keep_ids else None))
                    seen[size] += 1
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "local", "ids"])

    return run


class OpenWindows:
    """Runs of open windows by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, window: int):
        self.leaf = 1 << window.bit_length()
        self.any = [False] * (2 * self.leaf)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def push(self, capacity: int, first: int, n: int) -> None:
        self.runs.setdefault(capacity, []).append((first, n))
        self._set(capacity, True)

    def pop(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        if not self.runs[capacity]:
            self._set(capacity, False)
        return run

    def _set(self, capacity: int, to: bool) -> None:
        i = self.leaf + capacity
        self.any[i] = to
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity in use that is ``length`` at least."""
        i = self.leaf + length
        while not self.any[i]:
            while i & 1:
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.leaf:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaf


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first window, pieces a window, offset), sorted by length and rank.

    The pieces of rank r in a run go to window first + (r - first rank) // pieces, one after
    the other from ``offset``. The same packing as placing the pieces singly: once a piece is
    in a window, that window is the tightest for the next of its length while it fits.
    """
    free, runs, used = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = free.tightest(length)
            if capacity is None:
                n = -(-left // (window // length))
                free.push(window, used, n)
                used += n
                continue
            first, n = free.pop(capacity)
            each = capacity // length
            full = min(n, left // each)
            if not full:
                full, each = 1, left
            runs.append((length, rank, first, each, window - capacity))
            rank += full * each
            left -= full * each
            if capacity > each * length:
                free.push(capacity - each * length, first, full)
            if n > full:
                free.push(capacity, first + full, n - full)
    return sorted(runs)


def _assign(runs: list[tuple]):
    def run(batches):
        table = np.array(runs, np.int64).reshape(-1, 5)
        wide = np.int64(1) << 50
        starts = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            _, first_rank, first, each, offset = table[np.searchsorted(starts, length * wide + rank, side="right") - 1].T
            at = rank - first_rank
            cols = [*batch.columns[:5], pa.array(first + at // each), pa.array(offset + (at % each) * length), batch.column(6)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)``: one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (the
    piece's little-endian 32-bit ids where ``keep_ids``, else null). Every document ends in
    ``end_id``; what of a sequence is not covered is padding.

    Defined cases: a null or empty text is its end id alone. Null and repeated doc_ids are
    documents of their own. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cluster.tune(spark)
    pieces = cluster.saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            _pieces(tokenizer or default_tokenizer(), window, end_id, keep_ids),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, local long, ids binary",
        ),
        "pieces",
    )
    sums = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Win.partitionBy("length").orderBy("task").rowsBetween(Win.unboundedPreceding, -1)
    ranks = sums.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_decreasing(counts, window)
    return (
        pieces.join(ranks, ["length", "task"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local")).alias("rank"), "ids")
        .mapInArrow(_assign(runs), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op9: windows of 2,048 ids of the 49k-word tokenizer."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("ids")
