"""Personal data by fixed patterns and a semi-Markov conditional random field.

Four patterns give the base spans. The field adds spans the patterns cannot see (addresses
with a bracketed at, numbers without a country code, grouped digits): it scores
whole candidate segments with features of the entire span (its shape, digit count, check
sum, octets, the word before), and dynamic programming over segment ends, with entities
of bounded length, chooses boundaries and types jointly.

The field is trained here, by conditional likelihood, on sentences drawn from a small
generator of formats and look-alikes (fixed seed), so it is the same in every run. It
scores segments of two sorts: those that hold a bracketed at (in any case), and those
that start and end in a word with a digit or an @, where at most two words and 12
characters of one line lie between such words. Text without these signs has no segment.

Scale: one pass over whole texts, no shuffle. All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import cluster

KINDS = ("email", "ip", "card", "phone")
#: Words an entity spans at most.
MAX_WORDS = 6

# The base patterns. Possessive forms and look-behinds do not change what matches.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping ``local@domain.tld``: found from each @, as the local part is the whole run before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by kind in the order of ``KINDS``, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


_AT = re.compile(r"[(\[][aA][tT][)\]]")
_TRIGGER = re.compile(rf"[0-9@]|{_AT.pattern}")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"\S+")
_CUE = re.compile(r"^(?:tel|phone|call|mobile|fax|telefon|tél|llame|card|visa|mastercard|karte|carte|tarjeta|mail|e-mail|email|contact|ip|host|address|from)\W*$", re.I)
_OPEN, _CLOSE = "\"'<", ".,;:!?\"'>"


def trigger_words(text: str) -> list[tuple[int, int]]:
    """Words that hold a trigger; each scan starts where the last word ended."""
    out, done = [], 0
    m = _TRIGGER.search(text)
    while m:
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        out.append((start, end))
        done = end
        m = _TRIGGER.search(text, end)
    return out


def close(text: str, a: int, b: int) -> bool:
    """Whether ``a`` to ``b`` may lie between two trigger words of an entity: one line, short, two words at most."""
    return b - a <= 12 and "\n" not in text[a:b] and len(text[a:b].split()) <= 2


def words_before(text: str, at: int, done: int) -> list[tuple[int, int]]:
    """The last words of ``text[done:at]``, as many as an entity can have before another word."""
    out: list[tuple[int, int]] = []
    while len(out) < MAX_WORDS - 1:
        while at > done and text[at - 1].isspace():
            at -= 1
        end = at
        while at > done and not text[at - 1].isspace():
            at -= 1
        if at == end:
            break
        out.append((at, end))
    return out[::-1]


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of trigger words that are close, with the words between, as word spans; a bracketed at brings all words an entity around it can have."""
    out: list[list[tuple[int, int]]] = []
    for a, b in trigger_words(text):
        done = out[-1][-1][1] if out else 0
        spelled = _AT.search(text, a, b)
        if a >= done:
            before = words_before(text, a, done) if spelled else []
            if out and close(text, done, a):
                out[-1] += [m.span() for m in _WORD.finditer(text, done, a)]
            elif out and before and not text[done : before[0][0]].strip():
                out[-1] += before
            else:
                out.append(before)
            out[-1].append((a, b))
        if spelled:
            done = out[-1][-1][1]
            out[-1] += [m.span() for m in islice(_WORD.finditer(text, b), MAX_WORDS - 1) if m.start() >= done]
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without surrounding quotes and closing punctuation."""
    while a < b and text[a] in _OPEN:
        a += 1
    while b > a and text[b - 1] in _CLOSE:
        b -= 1
    return a, b


_PLAIN_MAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
# A plain dot has no space beside it, or the next sentence would look like part of the domain.
_DOT = r"(?: ?[(\[]dot[)\]] ?|\.)"
_SPELLED_MAIL = re.compile(rf"[\w.%+-]+ ?[(\[]at[)\]] ?[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_][\w-]*", re.I)


def span_features(span: str, before: str, n_words: int) -> list[str]:
    """Features of a whole segment and the word before it."""
    digits = [c for c in span if c.isdigit()]
    letters = sum(c.isalpha() for c in span)
    nd = len(digits)
    f = ["bias", f"words={n_words}", f"digits={'0' if not nd else '<7' if nd < 7 else '7-8' if nd < 9 else '9-12' if nd < 13 else '13-15' if nd < 16 else '16' if nd == 16 else '17+'}"]
    f.append("letters=no" if not letters else "letters=yes")
    if _CUE.match(before):
        f.append("cue")
    if "@" in span:
        f.append("at")
        if _PLAIN_MAIL.fullmatch(span):
            f.append("mail")
    elif _SPELLED_MAIL.fullmatch(span):
        f.append("spelled-mail")
    if nd and not letters:
        if 13 <= nd <= 19 and luhn("".join(digits)):  # a longer run of digits is no card
            f.append("luhn")
        groups = re.split(r"\D+", span.strip("+() "))
        f.append("groups=" + "-".join(str(min(len(g), 5)) for g in groups[:6]))
        other = "".join(sorted({c for c in span if not c.isdigit()}))
        f.append(f"signs={other}")
        if span.startswith(("+", "(")):
            f.append("opens=" + span[0])
        parts = span.split(".")
        if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts):
            f.append("octets")
    return f


class SemiMarkov:
    """Weights by (type, feature); type 0, outside, has score 0 and takes one word at a time."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.weights = weights or {}

    def scores(self, features: list[str]) -> np.ndarray:
        out = np.zeros(len(KINDS))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                out += w
        return out

    def decode(self, n: int, segments: dict[tuple[int, int], np.ndarray]) -> list[tuple[int, int, int]]:
        """Best segmentation of ``n`` words: (first, end, kind)."""
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], None
            for i in range(max(0, j - MAX_WORDS), j):
                s = segments.get((i, j))
                if s is not None:
                    k = int(s.argmax())
                    if best[i] + s[k] > best[j]:
                        best[j], back[j] = best[i] + float(s[k]), (i, k)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((i, j, k))
                j = i
        return out[::-1]


def candidates(text: str, words: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
    """Features of all segments that hold a bracketed at, or start and end in trigger words and are close throughout."""
    marked = [bool(_TRIGGER.search(text, a, b)) for a, b in words]
    spelled = [bool(_AT.search(text, a, b)) for a, b in words]
    before_all = text[max(0, words[0][0] - 40) : words[0][0]].split()
    out = {}
    for i in range(len(words)):
        last, whole, around = i, marked[i], False
        for j in range(i + 1, min(len(words), i + MAX_WORDS) + 1):
            around = around or spelled[j - 1]
            if marked[j - 1]:
                whole = whole and (j - 1 == i or close(text, words[last][1], words[j - 1][0]))
                last = j - 1
            if not (around or whole and marked[j - 1]):
                continue
            a, b = trimmed(text, words[i][0], words[j - 1][1])
            if a >= b:
                continue
            prev = text[words[i - 1][0] : words[i - 1][1]] if i else before_all[-1] if before_all else ""
            out[i, j] = span_features(text[a:b], prev, j - i)
    return out


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence with entities and look-alikes: text and (start, end, kind)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = rng.choice("3456") + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def email():
        a, b, c = w() + rng.choice(["", "." + d(2), d(1)]), w(), rng.choice(["com", "org", "net", "de"])
        return rng.choice([f"{a}@{b}.{c}", f"{a}@{w()}.{b}.{c}", f"{a} (at) {b} (dot) {c}", f"{a}(at){b}.{c}", f"{a} [at] {b}.{c}"])

    def grouped_card():
        c, sep = card(), rng.choice([" ", "-", "", "", ".", "  "])
        return sep.join(c[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = rng.choice("23456789") + d(2), d(3), d(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {d(7)}", f"00{d(2)} {a} {b} {c}", f"{a}.{b}.{c}"])

    ip = lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4))
    makers = (email, ip, grouped_card, phone)
    alike = (
        lambda: d(rng.randint(1, 6)),
        lambda: f"{d(4)}-{d(2)}-{d(2)}",
        lambda: f"{d(1)}.{d(1)}.{d(2)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32)),
        lambda: d(rng.choice([7, 8, 10, 11, 14, 16])),
        lambda: f"{d(2)}:{d(2)}",
        lambda: f"{w()}={d(3)}{w()}{d(4)}",
        lambda: f"{d(3)}.{d(2)}",
        lambda: f"@{w()}",
        lambda: f"{d(3)} {d(3)}",
        lambda: f"{d(4)}, {d(4)}",
        lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)),
    )
    text, spans = w(), []
    for _ in range(rng.randint(1, 4)):
        text += " " + rng.choice([w(), w(), "call", "mail", "card:", "tel"]) + " "
        if rng.random() < 0.55:
            k = rng.randrange(len(KINDS))
            s = makers[k]()
            spans.append((len(text), len(text) + len(s), k))
        else:
            s = rng.choice(alike)()
        text += s + rng.choice(["", "", ",", "."])
    return text + " " + w(), spans


def train(n_examples: int = 500, epochs: int = 8, rate: float = 0.15, seed: int = 5) -> SemiMarkov:
    """Stochastic gradient ascent on the conditional log-likelihood of generated segmentations."""
    rng, data = random.Random(seed), []
    for _ in range(n_examples):
        text, spans = _example(rng)
        for words in regions(text):
            found = candidates(text, words)
            gold = {}
            for i, j in found:
                at = trimmed(text, words[i][0], words[j - 1][1])
                for a, b, k in spans:
                    if (a, b) == at:
                        gold[i, j] = k
            data.append((len(words), found, gold))
    model = SemiMarkov()
    for epoch in range(epochs):
        rng.shuffle(data)
        step = rate / (1 + 0.3 * epoch)
        for n, found, gold in data:
            score = {s: model.scores(f) for s, f in found.items()}
            ahead = np.full(n + 1, -np.inf)
            ahead[0] = 0.0
            ends: dict[int, list[int]] = {}
            for i, j in found:
                ends.setdefault(j, []).append(i)
            for j in range(1, n + 1):
                terms = [ahead[j - 1]] + [ahead[i] + v for i in ends.get(j, ()) for v in score[i, j]]
                ahead[j] = np.logaddexp.reduce(terms)
            behind = np.full(n + 1, -np.inf)
            behind[n] = 0.0
            starts: dict[int, list[int]] = {}
            for i, j in found:
                starts.setdefault(i, []).append(j)
            for i in range(n - 1, -1, -1):
                terms = [behind[i + 1]] + [behind[j] + v for j in starts.get(i, ()) for v in score[i, j]]
                behind[i] = np.logaddexp.reduce(terms)
            for (i, j), features in found.items():
                push = -np.exp(ahead[i] + score[i, j] + behind[j] - ahead[n])
                if (i, j) in gold:
                    push[gold[i, j]] += 1
                push *= step
                for f in features:
                    model.weights[f] = model.weights.get(f, np.zeros(len(KINDS))) * (1 - 1e-4) + push
    return model


def all_spans(text: str, base: list[tuple[str, int, int]], model: SemiMarkov) -> list[tuple[str, int, int]]:
    """Base spans and those the field adds, which never overlap a base span; by kind, then start."""
    out = list(base)
    for words in regions(text):
        lo, hi = words[0][0], words[-1][1]
        taken = [(a, b) for _, a, b in base if a < hi and b > lo]
        if taken and all(any(a < y and b > x for a, b in taken) for x, y in words if _TRIGGER.search(text, x, y)):
            continue
        found = candidates(text, words)
        free = {}
        for (i, j), f in found.items():
            a, b = words[i][0], words[j - 1][1]
            if not any(x < b and y > a for x, y in taken):
                free[i, j] = model.scores(f)
        for i, j, k in model.decode(len(words), free):
            a, b = trimmed(text, words[i][0], words[j - 1][1])
            out.append((KINDS[k], a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _spans(weights: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkov(weights)
        for batch in batches:
            counts, sha, spans = [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_spans(text, base, model)))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(n[:, k])) for k in range(len(KINDS))), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return run


def find_spans(docs: DataFrame) -> DataFrame:
    """Spans of ``docs(doc_id, text)``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Defined cases: null and empty texts have no spans (the digest is that of the empty
    string). Null and repeated doc_ids are rows of their own. Other columns are ignored. An
    empty table gives an empty result.
    """
    cluster.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _spans(train().weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans of ``text`` masked; null stays null."""
    weights, held = train().weights, {}

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        model = held.setdefault("m", SemiMarkov(weights))
        out = []
        for t in texts:
            text = t.as_py()
            out.append(masked(text, all_spans(text, base_spans(text), model)) if text else text)
        return pa.array(out, pa.string())

    cluster.tune(docs.sparkSession)
    return docs.withColumn("text", mask(F.col("text").cast("string")))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: personal data in every document."""
    return find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
