"""Toxicity by a weighted finite-state pattern grammar.

A lexicon of insulting words and stems is learned from labelled rows; threats, targets,
negations and reporting verbs are closed word classes. Five small transducers read the
words of a clause from left to right, each rewriting the symbols the one before it passes
on: insults get their learned weight, a threat counts only with a target close by, a target
raises an insult, a negation or a reporting frame lowers it. They are composed on the fly
into one machine. A clause's weight is the log-odds the machine gathered; a text's score
joins its clauses.

Scale: fitting reads a bounded, documented number of labelled rows (chosen by hash), and
the model is a few hundred entries. Scoring is one pass over whole texts: an Aho-Corasick
automaton finds lexicon entries, and only the clauses around them are read word by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import cluster
from siltstone.llm import words as W
from siltstone.llm.minhash import signature

#: Labelled rows of each label that are used for fitting, at most.
FIT_TOXIC, FIT_CLEAN = 4000, 8000
#: Lengths of stems; entries a lexicon holds at most; evidence an entry needs (log-likelihood ratio, log-odds).
STEMS, LEXICON, LEAST_LLR, LEAST_ODDS = (4, 5, 6, 7, 8), 1000, 28.0, 1.8
THRESHOLD = 0.7
#: Share of a further clause's weight that adds to the strongest; share of a stem's texts one word, or a longer stem, may explain.
FURTHER, ONE_WORD, LONGER = 0.25, 0.7, 0.9
#: MinHash coordinates of a fitting row, and how many equal ones make it a copy.
SKETCH, ALIKE = 24, 8

# Closed word classes of English, German, French and Spanish.
THREATS = frozenset("kill hurt destroy murder stab shoot beat strangle töte töten umbringen tuer frapper matar matarte".split())
TARGETS = frozenset("you your yours yourself u he she they them him her dich dir euch du ihr toi vous tu te ti usted ustedes".split())
NEGATIONS = frozenset("not no never isn't aren't don't doesn't wasn't nobody nicht kein keine nie pas jamais nunca".split())
REPORTING = frozenset("said says wrote told quoted claimed called reported sagte schrieb dit écrit dijo escribió".split())

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_MARKS = ".!?;\n"
_END = re.compile(f"[{_MARKS}]")


class Transducer:
    """Reads symbols, writes symbols with weights; ``step(state, symbol) -> (state, symbol, weight)``."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step


def composed(*cascade: Transducer) -> Transducer:
    """Each machine reads what the one before it writes. Arcs are built when first taken and kept."""
    arcs: dict = {}

    def step(state, symbol):
        key = (state, symbol)
        if key not in arcs:
            states, weight, out = [], 0.0, symbol
            for machine, s in zip(cascade, state):
                s, out, w = machine.step(s, out)
                states.append(s)
                weight += w
            arcs[key] = tuple(states), out, weight
        return arcs[key]

    return Transducer(tuple(m.start for m in cascade), step)


def _insult(lexicon_weight: dict[str, float]) -> Transducer:
    """Symbols ``insult:<entry>`` get the entry's weight."""

    def step(state, symbol):
        return (state, "insult", lexicon_weight[symbol[7:]]) if symbol.startswith("insult:") else (state, symbol, 0.0)

    return Transducer(0, step)


def _threat() -> Transducer:
    """A threat turns into an insult of fixed weight when a target follows within three words."""

    def step(left, symbol):
        if symbol == "threat":
            return 3, "other", 0.0
        if symbol == "target" and left:
            return 0, "insult", 4.0
        return max(0, left - 1), symbol, 0.0

    return Transducer(0, step)


def _target() -> Transducer:
    """An insult within four words after a target weighs more."""

    def step(left, symbol):
        if symbol == "target":
            return 4, "other", 0.0
        if symbol == "insult":
            return max(0, left - 1), symbol, 0.7 if left else 0.0
        return max(0, left - 1), symbol, 0.0

    return Transducer(0, step)


def _negation() -> Transducer:
    """An insult within two words after a negation weighs less."""

    def step(left, symbol):
        if symbol == "negation":
            return 2, "other", 0.0
        return max(0, left - 1), symbol, -2.5 if symbol == "insult" and left else 0.0

    return Transducer(0, step)


def _reported() -> Transducer:
    """Insults after a reporting verb in the clause weigh less."""

    def step(seen, symbol):
        if symbol == "reporting":
            return 1, "other", 0.0
        return seen, symbol, -2.0 if symbol == "insult" and seen else 0.0

    return Transducer(0, step)


class Grammar:
    """``entries``: lexicon entry to weight (log-odds); stems end in ``*``."""

    def __init__(self, entries: dict[str, float], prior: float):
        import ahocorasick

        self.entries, self.prior = entries, prior
        self.machine = composed(_insult(entries), _threat(), _target(), _negation(), _reported())
        self.triggers = ahocorasick.Automaton()
        for e in {*(x.rstrip("*") for x in entries), *THREATS}:
            self.triggers.add_word(e, len(e))
        self.triggers.make_automaton()

    def symbol(self, word: str) -> str:
        if word in self.entries:
            return f"insult:{word}"
        stems = [s for n in STEMS if len(word) >= n and (s := f"{word[:n]}*") in self.entries]
        if stems:
            return f"insult:{max(stems, key=self.entries.get)}"
        for kind, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("reporting", REPORTING)):
            if word in words:
                return kind
        return "other"

    def clause(self, text: str) -> float:
        """Log-odds of the matched patterns of a clause."""
        state, total = self.machine.start, 0.0
        for m in _WORD.finditer(text):
            state, _, w = self.machine.step(state, self.symbol(m.group()))
            total += w
        return max(0.0, total)

    def score(self, text: str | None) -> float:
        """0 to 1. Clauses without a lexicon entry or threat weigh 0 and are not read."""
        best, total, done = 0.0, 0.0, 0
        low = (text or "").lower()
        for end, size in self.triggers.iter(low):
            a = end - size + 1
            if a < done or (a and low[a - 1].isalpha()):
                continue
            start = max(done, *(low.rfind(mark, done, a) + 1 for mark in _MARKS))
            stop = _END.search(low, a)
            done = stop.start() if stop else len(low)
            weight = self.clause(low[start:done])
            best, total = max(best, weight), total + weight
        # Clauses of one text are no independent evidence: the strongest counts in full, the others in part.
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.prior + best + FURTHER * (total - best)))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that have each word and stem, summed per batch."""
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORD.findall((text or "").lower()))
            seen = set(words)
            for n in STEMS:
                seen.update(w[:n] + "*" for w in words if len(w) >= n)
            (toxic if label else clean).update(seen)
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([clean[w] for w in names], pa.int64())], ["entry", "toxic", "clean"]
        )


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some MinHash coordinates of each text; none for a text without words."""
    for batch in batches:
        w, first = W.word_hashes(*W.buffers(batch.column(0)))
        sets = W.distinct_per_text(*W.shingles(w, first, 2))
        out = [signature(s)[:SKETCH].astype(int).tolist() if len(s) else [] for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "sketch"])


def _distinct(sketches: list[tuple[int, list[int]]]) -> list[int]:
    """The first id of each group of texts that have ``ALIKE`` coordinates in common with a kept one."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for doc_id, sketch in sketches:
        common = Counter(i for c in enumerate(sketch) for i in seen.get(c, ()))
        if not common or max(common.values()) < ALIKE:
            kept.append(doc_id)
            for c in enumerate(sketch):
                seen.setdefault(c, []).append(doc_id)
    return sorted(set(kept))


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learn the lexicon from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Uses up to ``FIT_TOXIC`` and ``FIT_CLEAN`` labelled ids, those of lowest hash. Labels
    that are null or name no document teach nothing; of texts that are nearly copies the one of
    the least id teaches; an id labelled twice counts as toxic
    if either row says so. Without toxic rows the lexicon is empty.
    """
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ranked = ids.withColumn("_h", F.xxhash64("doc_id"))
    chosen = ranked.where("toxic = 1").orderBy("_h", "doc_id").limit(FIT_TOXIC).unionByName(ranked.where("toxic = 0").orderBy("_h", "doc_id").limit(FIT_CLEAN)).drop("_h")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most FIT_TOXIC + FIT_CLEAN ids
    rows = cluster.saved(rows.select(F.col("text").cast("string").alias("text"), "toxic", "doc_id"), "labelled")
    # Copies of one text are one observation, or its chance words would look significant.
    sketches = sorted((r.doc_id, r.sketch) for r in rows.mapInArrow(_sketches, "doc_id long, sketch array<long>").collect())
    single = docs.sparkSession.createDataFrame([(i,) for i in _distinct(sketches)], "doc_id long")
    rows = rows.join(F.broadcast(single), "doc_id").select("text", "toxic")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, q = n.get(1, 0), n.get(0, 0)
    if not p:
        return Grammar({}, -4.0)
    odds = F.expr(f"ln((toxic + 0.5) / {p + 1}) - ln((clean + 0.5) / {q + 1})")
    rate = p / (p + q)
    # Twice the log-likelihood ratio of the entry's own share of toxic texts against the overall one.
    share = F.expr("toxic / (toxic + clean)")
    llr = 2 * (F.col("toxic") * F.log(share / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - rate + 1e-12))).otherwise(0))
    found = (
        rows.mapInArrow(_features, "entry string, toxic long, clean long")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic > 0")
        .withColumn("odds", odds)
        .withColumn("llr", llr)
        .where((F.col("odds") >= LEAST_ODDS) & (F.col("llr") >= LEAST_LLR))
        .orderBy(F.desc("llr"), "entry")
        .limit(LEXICON)
        .collect()
    )
    # A stem that one word, or one longer stem, explains is too short: it would only add unrelated words that begin alike.
    share = {r.entry: LONGER if r.entry.endswith("*") else ONE_WORD for r in found}
    real = [
        r
        for r in found
        if not (r.entry.endswith("*") and any(x.entry != r.entry and len(x.entry.rstrip("*")) >= len(r.entry) - 1 and x.entry.startswith(r.entry[:-1]) and x.toxic >= share[x.entry] * r.toxic for x in found))
    ]
    entries = {r.entry: min(6.0, r.odds) for r in real}
    # What texts without any match are worth: toxic rows the lexicon misses against clean ones.
    grammar = Grammar(entries, 0.0)
    missed = rows.mapInArrow(_unmatched(grammar.entries), "toxic int, n long").groupBy("toxic").agg(F.sum("n").alias("n")).collect()
    n0 = {r.toxic: r.n for r in missed}
    prior = math.log((n0.get(1, 0) + 0.5) / (n0.get(0, 0) + 0.5))
    cluster.forget(rows)
    return Grammar(entries, max(-4.0, min(-1.0, prior)))


def _unmatched(entries: dict[str, float]):
    def run(batches):
        grammar = Grammar(entries, 0.0)
        for batch in batches:
            miss = [int(label) for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if grammar.score(text) <= 0.5]
            yield pa.RecordBatch.from_arrays([pa.array(miss, pa.int32()), pa.array([1] * len(miss), pa.int64())], ["toxic", "n"])

    return run


def scored(docs: DataFrame, grammar: Grammar, column: str = "toxicity") -> DataFrame:
    """``docs`` with a column (0 to 1), from the text alone; null and empty texts get the prior."""
    entries, prior, held = grammar.entries, grammar.prior, {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if "g" not in held:
            held["g"] = Grammar(entries, prior)
        return pa.array([held["g"].score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(column, score(F.col("text").cast("string")))


def split(docs: DataFrame, column: str = "held_out") -> DataFrame:
    """Adds a column: crc32 of doc_id as text, mod 3, is 1; false for a null doc_id."""
    return docs.withColumn(column, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))


def toxicity(docs: DataFrame, labels: DataFrame, score_column: str = "toxicity", held_column: str = "held_out") -> DataFrame:
    """Fit on rows of ``docs`` that are not held out, score all: ``docs`` with both columns.

    Defined cases: rows with a null doc_id teach nothing and are scored; null and empty texts
    get the prior. Repeated rows are scored each. Columns other than doc_id and text never
    matter; one named like an added column is replaced. An empty table gives an empty result.
    """
    cluster.tune(docs.sparkSession)
    marked = split(docs, held_column)
    grammar = fit(marked.where(~F.col(held_column)), labels.select("doc_id", "toxic"))
    return scored(marked, grammar, score_column)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: a score for every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels).select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
