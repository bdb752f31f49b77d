"""Text operators against brute force on small tables with nulls, ties, repeats and long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import kneser_ney, minhash, mixing, packing, pii, suffix_dedup
from siltstone.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, bucket long, key string, n long"


def frame(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "k", 2) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(60)] + ["Ünï", "the", "THE"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 120))) for _ in range(30)]
    rows = [(i, t, f"s{i % 5}") for i, t in enumerate(base)]
    for i in range(12):  # near copies, chains of them, exact copies
        words = base[i % 4].split()
        for _ in range(1 + i % 3):
            words[rng.randrange(len(words))] = "edit%d" % i
        rows.append((100 + i, " ".join(words), "s1"))
        rows.append((200 + i, base[i % 3].upper() if i % 2 else base[i % 3] + "\n", "s2"))
    rows += [(900, None, None), (901, "", "s0"), (902, " \t\n", "s0"), (903, "one", "s9"), (904, "one", None), (905, "one two", "s9"), (906, "ab " * 3000, "s0"), (907, "ab " * 3000, "s0")]
    return rows


def test_shingles_are_those_of_words():
    import pyarrow as pa

    texts = ["A b\tc d", None, "", "x", "x y", "\x0ba  b c\r\nd e", "ü Ü"]
    w, first = W.word_hashes(*W.buffers(pa.array(texts)))
    words = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(first).tolist() == [len(x) for x in words]
    assert len(set(w.tolist())) == len({x for r in words for x in r})
    sets = W.distinct_per_text(*W.shingles(w, first, 3))
    want = [{tuple(r[k : k + 3]) for k in range(len(r) - 2)} if len(r) > 2 else {tuple(r)} if r else set() for r in words]
    assert [len(s) for s in sets] == [len(s) for s in want]


def brute_components(rows, n, percent):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    return sets, group


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, n, percent):
    sets, want = brute_components(corpus, n, percent)
    got = minhash.near_duplicates(frame(spark, corpus), n_words=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}
    assert len(got) == len(corpus)


def test_near_duplicates_of_odd_rows(spark, monkeypatch):
    rows = [(None, "a b c d", "s"), (None, "a b c d", "s"), (5, "a b c d", "s"), (5, "a b c d", "s"), (9, "a b c d", "s")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, None, True)] * 2 + [(5, 5, True)] * 2 + [(9, 5, False)], key=repr)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    kept = minhash.deduplicated(frame(spark, rows)).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted([None, None, 5], key=repr)
    assert list(kept[0].asDict()) == frame(spark, []).columns


def test_duplicates_are_decided_by_row(spark):
    rng = random.Random(12)
    one, two, three, four = (" ".join(f"{c}{rng.randrange(900)}" for _ in range(40)) for c in "pqrs")
    rows = [(4, one, "s"), (4, two, "s"), (4, two, "s"), (7, one + " end", "s"), (7, three, "s"), (2, two + " end", "s"), (9, four, "s"), (9, four + " end", "s")]
    rows += [(9, "", "s"), (9, None, "s"), (9, " ", "s"), (5, "", "s"), (5, "", "s"), (None, one, "s"), (None, one, "s")]
    kept = collections.Counter((r.doc_id, r.text) for r in minhash.deduplicated(frame(spark, rows)).collect())
    want = [(4, one), (7, three), (2, two + " end"), (9, four), (9, ""), (9, None), (9, " "), (5, ""), (5, ""), (None, one), (None, one)]
    assert kept == collections.Counter(want)
    assert collections.Counter((r.doc_id, r.text) for r in minhash.deduplicated(frame(spark, [r for r in rows if r[0] == 5])).collect()) == {(5, ""): 2}


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(minhash, "VERIFY_BLOCK", 6)
    rng = random.Random(8)
    base = ["w%d" % rng.randrange(500) for _ in range(150)]
    rows = []
    for i in range(50):
        words = list(base)
        words[rng.randrange(150)] = "x%d" % i
        rows.append((i, " ".join(words), "s"))
    _, want = brute_components(rows, 5, 80)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_large_groups_of_several_parts(spark, monkeypatch, seed):
    """Rows outside the largest part of a group meet all others: chains, pairs and lone rows, copies of ids, empty texts."""
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(minhash, "VERIFY_BLOCK", 4)
    rng = random.Random(seed)
    base = ["w%d" % rng.randrange(900) for _ in range(120)]
    rows, texts = [], [base]
    for i in range(90):
        words = list(rng.choice(texts[-30:] if i % 3 else texts[:1]))
        for _ in range(rng.choice([1, 2, 6])):
            words[rng.randrange(120)] = "x%d" % rng.randrange(10**6)
        texts.append(words)
        rows.append((i, " ".join(words), "s"))
    _, want = brute_components(rows, 5, 80)
    assert len(set(want.values())) > 3 and max(collections.Counter(want.values()).values()) > 8
    got = minhash.near_duplicates(frame(spark, [*rows, (3, "", "s"), (4, None, "s")])).collect()
    assert {r.doc_id: r.component_id for r in got if r.n_shingles} == want


def test_only_rows_outside_the_largest_part_meet_all_others(spark):
    """Copies of rows of a group of 400 in blocks of 10: two each, and those of 3 lone rows once more for each block."""
    seen = spark.sparkContext.accumulator(0)

    def search(batches):
        import pyarrow as pa

        for table in minhash.grouped(batches, 3):
            seen.add(table.num_rows)
            data, rep, out = table.column(5).to_pylist(), table.column(3).to_pylist(), []
            bounds = minhash.group_bounds(table, 3)
            for s, e in zip(bounds[:-1], bounds[1:]):
                alike = [k for k in range(s, e) if data[k] == "alike"]
                out += [(rep[alike[0]], rep[k]) for k in alike[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    members = spark.range(400).selectExpr("7L as g", "id as rep", "40L as blocks")
    got = minhash._connected(members, spark.range(400).selectExpr("id as rep", "if(id in (5, 50, 200), 'lone', 'alike') as data"), search).collect()
    assert {(r.node, r.component) for r in got} == {(k, 0) for k in range(400) if k not in (5, 50, 200)}
    assert seen.value <= 2 * 400 + 400 + 3 * 41


def test_banding_misses_little():
    for percent in (80, 85):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-5


# ---- repeated strings --------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    """Rows in the order of ids (null last) and bytes; (n_bytes, n_removed, n_spans, sha) by place in ``rows``."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, (rows[k][1] or "").encode()))
    seen, out = set(), {}
    for k in order:
        b = (rows[k][1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


def repeats_corpus():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij  é") for _ in range(n))
    passage, long = text(300), text(900)
    rows = [(i, text(rng.randint(0, 400)), "s") for i in range(12)]
    for i in range(12, 30):
        a = rng.randrange(200)
        rows.append((i, text(rng.randrange(60)) + passage[a : a + rng.randint(80, 250)] + text(rng.randrange(60)), "s"))
    for i in range(30, 40):
        x = list(long)
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] = "#"
        rows.append((i, "".join(x), "s"))
    rows += [(50, "ab" * 300, "s"), (51, "a" * 500, "s"), (52, "xab" * 100, "s"), (53, None, "s"), (54, "", "s"), (55, long, "s"), (56, long, "s")]
    return rows


@pytest.mark.parametrize(
    "options",
    [{}, {"wide": 1, "chunk_bytes": 900}, {"wide": 4, "chunk_bytes": 3000}, {"hash_bits": 0}, {"hash_bits": 0, "wide": 1, "chunk_bytes": 2000}],
    ids=["whole", "all split", "some split", "hashes collide", "hashes collide, all split"],
)
def test_repeats(spark, options):
    rows = repeats_corpus()
    want = brute_repeats(rows, 100)
    got = suffix_dedup.remove_repeats(frame(spark, rows), **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {rows[k][0]: v for k, v in want.items()}


def test_repeats_of_other_lengths(spark):
    rows = repeats_corpus()
    want = brute_repeats(rows, 47)
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=47, chunk_bytes=4000, wide=6, keep_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == {rows[k][0]: v for k, v in want.items()}


def test_repeats_of_odd_rows(spark):
    long = "".join(random.Random(9).choice("abcdef") for _ in range(400))
    rows = [(None, long, "s"), (7, long, "s"), (7, long, "s"), (7, long[:150], "s"), (3, "x" + long[50:], "s"), (None, None, "s")]
    want = brute_repeats(rows, 100)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(((rows[k][0], *v) for k, v in want.items()), key=repr)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_merge_of_transforms():
    rng = random.Random(1)
    for _ in range(300):
        length, n = rng.choice([1, 2, 3, 5, 8]), rng.randint(0, 12)
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(n)]
        place = np.array([(rng.randint(0, 2), 0, 100 * i) for i in range(n)], np.int64).reshape(-1, 3)
        strings = sorted(set(texts))
        row, start, end = suffix_dedup.later_ranges(strings, np.array([strings.index(x) for x in texts], np.int64), place, length)
        at = collections.defaultdict(list)
        for i, x in enumerate(texts):
            for k in range(len(x) - length + 1):
                at[x[k : k + length]].append((*(place[i] + (0, 0, k)).tolist(), i, k))
        want = {(t[3], t[4] + j) for v in at.values() for t in v if t[:3] > min(v)[:3] for j in range(length)}
        assert {(i, j) for i, a, e in zip(row.tolist(), start.tolist(), end.tolist()) for j in range(a, e)} == want


def test_each_window_has_one_anchor(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.choice([0, 50, 99, 100, 101, 700, 3000]))) for _ in range(30)]
    b, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    of = lambda: {s: h for h, f, n in zip(*(x.tolist() for x in suffix_dedup.anchors(b, offs, 100))) for s in range(f, f + n)}
    whole = of()
    assert sorted(whole) == [s for a, e in zip(offs, offs[1:]) for s in range(a, e - 99)]
    assert len(set(whole.values())) < len(whole) / 20
    monkeypatch.setattr(suffix_dedup, "_STEP", 600)
    assert of() == whole


# ---- mixing ------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 1000], [5, 1], 3) == [30.0, 980.0]
    assert mixing.targets([0, 0], [5, 2], 3) == [0.0, 0.0] and mixing.targets([], [], 3) == []


@pytest.mark.parametrize("block", [7, 4096])
def test_mix(spark, corpus, block):
    rows, pieces = mixing.mix(frame(spark, corpus), block_words=block)
    rows, pieces = rows.collect(), pieces.collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((i, len((t or "").encode().split())) for i, t, _ in corpus)
    taken, size, target = collections.Counter(), collections.Counter(), {}
    source = {r.row_no: r.source for r in rows}
    for r in rows:
        size[r.source] += r.size
        target[r.source] = r.target
    by_row = collections.Counter()
    for p in pieces:
        taken[source[p.row_no]] += p.to_word - p.from_word
        by_row[p.row_no] += p.to_word - p.from_word
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.5
    assert all(by_row[r.row_no] <= 3 * r.size for r in rows)
    slots = collections.defaultdict(int)
    for p in pieces:
        slots[p.slot] += p.to_word - p.from_word
    assert max(slots.values()) <= block
    again = mixing.mix(frame(spark, corpus), block_words=block)[1].collect()
    assert sorted(again) == sorted(pieces)


def test_every_stretch_of_the_schedule_is_near_the_targets(spark):
    blocks = [700, 40, 230, 1, 1029]
    order = [r.source_no for r in mixing._schedule(spark, blocks).orderBy("slot").collect()]
    assert collections.Counter(order) == dict(enumerate(blocks))
    count = np.zeros(len(blocks))
    for k, source in enumerate(order, 1):
        count[source] += 1
        assert (abs(count - k * np.array(blocks) / sum(blocks)) < 8).all()


def test_rows_without_ids_are_spread(spark):
    rows, pieces = mixing.mix(spark.createDataFrame([(None, f"some words {i % 7}", "s") for i in range(400)], "doc_id long, text string, source string"))
    assert rows.count() == 400 and {r.t for r in pieces.groupBy("row_no").agg(F.sum(F.expr("to_word - from_word")).alias("t")).collect()} == {3}


def test_columns_like_the_inner_ones_pass_through(spark):
    rng = random.Random(3)
    words = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(30))
    one = words()
    rows = [(1, one, "a", 5, 6, 7, "x"), (2, one + " end", "b", 8, 9, 10, "y"), (2, words(), "b", 1, 2, 3, "z"), (3, words(), "c", 4, 4, 4, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __ROW int, __n int, __size int, __key string")
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted([rows[0], rows[2], rows[3]])
    out = mixing.mixed(df)
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} <= {r[3:] for r in rows}


def test_mixed_texts(spark, corpus):
    docs = frame(spark, corpus)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    rows, _ = mixing.mix(docs)
    want = {s: t for s, t in {(r.source, r.target) for r in rows.collect()}}
    got = collections.Counter()
    for r in out.collect():
        got[r.source] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert all(abs(got[s] - t) <= 0.5 for s, t in want.items())
    assert mixing.mixed(frame(spark, [])).count() == 0


# ---- packing -----------------------------------------------------------------------------------------------------


def plain_best_fit(lengths, window):
    """Best-fit decreasing, a piece at a time: sorted fills."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, free in enumerate(open_) if free >= n]
        if fits:
            k = min(fits, key=lambda k: open_[k])
            open_[k] -= n
        else:
            open_.append(window - n)
    return sorted(open_)


def test_best_fit_by_counts_is_best_fit():
    rng = random.Random(6)
    for _ in range(60):
        window = rng.choice([8, 16, 50])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 120))]
        counts = collections.Counter(lengths)
        runs = packing.best_fit_decreasing(dict(counts), window)
        fill, places = collections.Counter(), collections.defaultdict(list)
        for j, (length, rank, first, each, offset) in enumerate(runs):
            end = next((r[1] for r in runs[j + 1 :] if r[0] == length), counts[length])
            for r in range(rank, end):
                w = first + (r - rank) // each
                fill[w] += length
                places[w].append((offset + (r - rank) % each * length, length))
        assert sorted(window - f for f in fill.values()) == plain_best_fit(lengths, window)
        for p in places.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:])) and min(p)[0] == 0


def test_pack(spark, corpus):
    from tokenizers import Tokenizer

    rows = [*corpus, (None, "Straße. ÉCOLE, x<|endoftext|>y don't Ab1.", "s")]
    got = packing.pack(frame(spark, rows), keep_ids=True).collect()
    inner = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted(((i, inner.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows), key=repr)
    texts = collections.defaultdict(dict)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        texts[r.doc_id][r.start] = r.ids
    assert sorted(((i, np.frombuffer(b"".join(p[s] for s in sorted(p)), "<u4").tolist()) for i, p in texts.items()), key=repr) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for p in by.values():
        assert sum(n for _, n in p) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:]))
    assert packing.pack(frame(spark, [])).count() == 0


def odd_texts():
    rng = random.Random(9)
    signs = [chr(i) for i in range(33, 127)] + [chr(i) for i in range(0xA0, 0x100)]
    pieces = ["don't", "WE'LL", "'S", "&'re", "</w>", "<|x", "<|endoftext|>", "\x01", "\u212a", "\u0130", "\u03a3\u03a3", "e\u0301", "\u0301", "Привет,", "日本", "ﬁ", "x" * 300, "a1b22"]
    for gap in (" ", "\n", "\t\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "  "):
        for _ in range(40):
            words = ["".join(rng.choices(signs, k=rng.randint(0, 9))) for _ in range(20)] + rng.sample(pieces, 6)
            rng.shuffle(words)
            yield gap.join(words)
    yield from ["", " ", "\n", *pieces, *signs, " ".join(signs), "".join(signs)]


def test_ids_are_the_tokenizers(monkeypatch):
    tok, texts = packing.WordTokenizer(packing.default_tokenizer()), list(odd_texts())
    want = [np.array(tok.inner.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tok.encode(texts) == want
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    monkeypatch.setattr(packing, "GROUP_BYTES", 300)
    assert tok.encode(texts) == want and tok.encode([]) == []
    tok.merges, tok.cache = None, {}
    assert tok.encode(texts) == want


def test_latin_words_need_the_merges_alone():
    tok, text = packing.WordTokenizer(packing.default_tokenizer()), "Ünseen wörds, DON'T été\nno? x2y... (ends)."
    want = np.array(tok.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    tok.inner = None  # its normaliser and patterns cost most of the time
    assert tok.encode([text]) == [want]


# ---- language model ----------------------------------------------------------------------------------------------


def brute_kneser_ney(train, order):
    """(vocabulary counts, probability of a token after its history) by the textbook formulas; texts are lists of tokens."""
    c = collections.Counter(w for t in train for w in t)
    grams = {order: collections.Counter()}
    for t in train:
        whole = [0] * (order - 1) + t
        for i in range(order - 1, len(whole)):
            grams[order][tuple(whole[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):  # how many different tokens stand before; a text's start counts as often as it occurs
        grams[k] = collections.Counter()
        for g, n in grams[k + 1].items():
            grams[k][g[1:]] += n if k > 1 and g[1] == 0 else 1
    d, context, kinds = {}, {}, {}
    for k, counts in grams.items():
        d[k] = kneser_ney.discounts(*(collections.Counter(counts.values())[x] for x in (1, 2, 3, 4)))
        context[k], kinds[k] = collections.Counter(), collections.defaultdict(collections.Counter)
        for g, n in counts.items():
            context[k][g[:-1]] += n
            kinds[k][g[:-1]][min(n, 3)] += 1

    def p(history, w):
        out = 1 / (len(c) + 1)
        for k in range(1, order + 1):
            h = tuple(history[len(history) - k + 1 :])
            if context[k][h]:
                n = grams[k][(*h, w)]
                out = (max(n - d[k][min(n, 3)], 0) + sum(d[k][x] * kinds[k][h][x] for x in (1, 2, 3)) * out) / context[k][h]
        return out

    return c, p


@pytest.mark.parametrize(("order", "shard", "fold"), [(2, 2000, 300), (3, 2000, 300), (3, 1 << 30, 1 << 20), (4, 300, 100)])
def test_language_model(spark, corpus, monkeypatch, order, shard, fold):
    for name, value in (("SHARD_BYTES", shard), ("FOLD", fold), ("SCORE", fold), ("WORDS", fold), ("TEXT_BYTES", 4 * fold)):
        monkeypatch.setattr(kneser_ney, name, value)
    docs = frame(spark, corpus).selectExpr("doc_id", "text", "doc_id % 4 = 1 as held_out", "rank", "n")
    got = {r.doc_id: r for r in kneser_ney.language_model_scores(docs, order=order).collect()}
    toks = {i: (t or "").encode().lower().split() + [None] for i, t, _ in corpus}
    c, p = brute_kneser_ney([t for i, t in toks.items() if i % 4 != 1], order)
    n, v, start = sum(c.values()), len(c), [0] * (order - 1)
    for history in (start, [*start, b"the"], [b"w1", b"w2", b"w3"]):
        assert abs(sum(p(history, w) for w in c) + p(history, b"never seen") - 1) < 1e-9
    for i, t in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, i % 4 == 1)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(start + t[:k], w)) for k, w in enumerate(t)), rel_tol=1e-9)


def test_a_missing_or_damaged_model_file_is_an_error(spark, corpus, monkeypatch):
    import os
    import shutil

    folder = kneser_ney.train(frame(spark, corpus).select("text"))
    tok, starts = kneser_ney.tokens(*W.buffers(__import__("pyarrow").array(["w1 w2 w3 the", "never seen"])))
    whole = kneser_ney.Model(folder).score(tok, starts)
    monkeypatch.setattr(kneser_ney, "SCORE", 3)  # a text in pieces
    for x, y in zip(whole, kneser_ney.Model(folder).score(tok, starts)):
        assert np.allclose(x, y, rtol=1e-12)
    shards = 1 << kneser_ney.Model(folder).bits
    assert {f"{kind}-{s}" for kind in ("vocabulary", "word", "gram2", "gram3") for s in range(shards)} <= set(os.listdir(folder))
    for kind in ("vocabulary", "word", "gram2", "gram3"):
        kept = f"{folder}-kept"
        shutil.copytree(folder, kept)
        for s in range(shards):
            with open(f"{folder}/{kind}-{s}", "r+b") as f:
                f.truncate(os.path.getsize(f.name) - 1)
        with pytest.raises(OSError, match="damaged"):
            kneser_ney.Model(folder).score(tok, starts)
        for s in range(shards):
            os.remove(f"{folder}/{kind}-{s}")
        with pytest.raises(FileNotFoundError):
            kneser_ney.Model(folder).score(tok, starts)
        shutil.rmtree(folder)
        os.rename(kept, folder)
    with pytest.raises(FileNotFoundError):
        kneser_ney.Model(folder + "-none")


@pytest.mark.parametrize(("bits", "crowded"), [(2, False), (7, False), (7, True), (18, False)])
def test_grams_with_equal_upper_bits_are_told_apart(tmp_path, bits, crowded):
    rng = np.random.default_rng(3)
    part = lambda most, shift: rng.integers(0, most, 2000).astype(np.uint64) << np.uint64(shift)
    keys = np.unique((np.uint64(1) << np.uint64(64 - bits)) | part(1 << 16, 0) | part(40, 16) | part(1 if crowded else 4, 40) | part(1 if crowded else 4, 48))
    if bits == 18:
        keys &= np.uint64((1 << 46) - 1)
        keys = np.unique(keys | np.uint64(1) << np.uint64(46))
    n = np.arange(len(keys)) + 1
    kneser_ney._write_grams(f"{tmp_path}/g", keys, bits, [n, n * 3000, n % 2, n % 3, n % 5])
    asked = np.unique(np.concatenate([keys, keys ^ np.uint64(1), keys ^ np.uint64(1 << 20), keys ^ np.uint64(1 << 41)]))
    where, counts = kneser_ney._find_grams(f"{tmp_path}/g", bits, asked, 5)
    assert set(asked[where].tolist()) == set(keys.tolist())
    assert (counts[np.argsort(asked[where])] == np.stack([n, n * 3000, n % 2, n % 3, n % 5], axis=1)).all()


def test_language_model_without_rows(spark):
    docs = frame(spark, [(1, "a b", "s")]).selectExpr("doc_id", "text", "true as held_out")
    assert kneser_ney.language_model_scores(docs).first().score == 0
    assert kneser_ney.language_model_scores(docs.where("false")).count() == 0


# ---- personal data -----------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_patterns():
    rng = random.Random(3)
    parts = ["a@b.co", "x.y+z@mail.example.com", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "001.2.3.04", "4111 1111 1111 1111", "4111111111111112", "+1 (606) 555-7814", "+12", "a@b@c.de", "..", "-", " ", "é", "9" * 40, "a.b@c", "@x.y", "+49 30 123456"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", ",", "\n"]) for _ in range(rng.randint(0, 7)))
        assert pii.base_spans(text) == plain_base(text), text


def test_model_adds_spans_and_keeps_base_ones(spark):
    rows = [(1, "call (606) 555-7814 or mail joe (at) corp.com, ip 10.0.0.1", "s"), (2, None, "s"), (3, "", "s"), (4, "no data here 2024-01-02 v1.2.3", "s"), (5, "1.2.3.4 " * 9000, "s")]
    got = {r.doc_id: r for r in pii.find_spans(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        base = plain_base(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_ip == sum(k == "ip" for k, _, _ in base)
    assert "phone:5:19" in got[1].spans and got[4].spans == ""
    masked = {r.doc_id: r.text for r in pii.redacted(frame(spark, rows)).collect()}
    assert masked[2] is None and masked[3] == "" and masked[4] == rows[3][1] and "<IP>" in masked[1] and "<PHONE>" in masked[1]
    assert pii.find_spans(frame(spark, [])).count() == 0


def test_spelled_addresses(spark):
    texts = {
        "mail joe (at) corp.com, ip 10.0.0.1": ["joe (at) corp.com", "10.0.0.1"],
        "write to a [at] b (dot) org now": ["a [at] b (dot) org"],
        "Joe (AT) Corp (DOT) com": ["Joe (AT) Corp (DOT) com"],
        "anna (at) firma.de or bob (at) firma (dot) de. Thanks, call (606) 555-7814": ["anna (at) firma.de", "bob (at) firma (dot) de", "(606) 555-7814"],
        "we met (at) noon. Then all left (at) once": [],
        "(at) " * 500: [],
    }
    model = pii.train()
    for text, want in texts.items():
        found = pii.all_spans(text, pii.base_spans(text), model)
        assert sorted(text[a:b] for _, a, b in found) == sorted(want), text
    first = pii.redacted(frame(spark, [(1, next(iter(texts)), "s")])).first().text
    assert first == "mail <EMAIL>, ip <IP>"


def test_long_words_are_scored():
    model = pii.train()
    for address in ("joe(at)" + "x" * 90 + ".com", "j" * 200 + " (at) " + "corp." * 40 + "de"):
        text = f"mail {address}, please"
        assert [text[a:b] for _, a, b in pii.all_spans(text, pii.base_spans(text), model)] == [address]
    rng = random.Random(6)
    for alphabet in ("0123456789abcdef", "0123456789ABCDEFabcdef+/=", "0123456789"):
        for n in (81, 200, 5000):
            for _ in range(20):
                text = "id " + "".join(rng.choice(alphabet) for _ in range(n)) + " end"
                assert pii.all_spans(text, [], model) == [], text


def test_spelled_addresses_are_trained_on():
    rng = random.Random(99)
    model, want, found = pii.train(), 0, 0
    for _ in range(400):
        text, spans = pii._example(rng)
        spelled = {("email", a, b) for a, b, k in spans if pii.KINDS[k] == "email" and "@" not in text[a:b]}
        want, found = want + len(spelled), found + len(spelled & set(pii.all_spans(text, pii.base_spans(text), model)))
    assert want > 50 and found == want


def test_decoding_is_the_best_segmentation():
    rng = random.Random(2)
    model = pii.SemiMarkov()
    for _ in range(200):
        n = rng.randint(1, 6)
        seg = {(i, j): np.array([rng.uniform(-2, 2) for _ in pii.KINDS]) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.7}

        def best(i):
            if i >= n:
                return 0.0
            return max([best(i + 1)] + [float(seg[i, j].max()) + best(j) for j in range(i + 1, n + 1) if (i, j) in seg])

        found = model.decode(n, seg)
        assert math.isclose(sum(float(seg[i, j][k]) for i, j, k in found), best(0), abs_tol=1e-9)
