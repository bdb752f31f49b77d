"""Main text of pages, toxicity, and the pipeline as a whole."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import cluster, html_text, minhash, packing, toxicity
from siltstone.llm import queries as Q
from tests.conftest import DATA

ARTICLE = "<article><h1>The  title</h1><p>First&amp;foremost <b>bold</b>\n text.<p>Second &lt;para&gt; &#233;&hellip; with <a href='x'>one link</a> in it and more words to read.</p></article>"
WANT = "The title\nFirst&foremost bold text.\nSecond <para> é… with one link in it and more words to read."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p{{}}</style><script>x='</p><p>no'</script></head><body><nav><ul><li><a href=a>menu</a></li></ul></nav>{ARTICLE}<footer>foot text here</footer></body></html>",
        f"<body><div class='ad'>buy this now, it is cheap and good</div><div id=cookie-notice>We use cookies</div>{ARTICLE}<div class='comments'><p>reader says hello</p></div>",
        f"<!-- <p>no</p> --><header><p>Site name</p></header><main>{ARTICLE}</main><aside><p>side</p></aside><form><p>name</p></form><script>var a",
        f"{ARTICLE}<ul><li><a href=1>one more</a></li><li><a href=2>two more</a></li><li><a href=3>three</a></li></ul><img alt='a > b",
    ],
)
def test_article(page):
    assert html_text.extract(page) == WANT


def test_link_lists_of_the_article_stay():
    text = "<p>Long running text of the article with many words in it, and no link at all, so that it is dense enough to be chosen.</p>"
    refs = "<ul><li><a href=1>First reference</a></li><li><a href=2>Second reference</a></li><li><a href=3>Third reference</a></li></ul>"
    links = "<p>See <a href=1>the first of the papers</a>, <a href=2>the second of them</a>, <a href=3>the third of them</a>.</p>"
    lines = html_text.extract(f"<body><nav>menu</nav><article>{text * 3}{refs}{links}{text}</article></body>").split("\n")
    assert lines[3:7] == ["First reference", "Second reference", "Third reference", "See the first of the papers, the second of them, the third of them."] and len(lines) == 8
    beside = html_text.extract(f"<body>{refs * 12}<article>{text * 2}</article></body>").split("\n")
    assert len(beside) == 2 and all(x.startswith("Long running") for x in beside)


def test_broken_pages():
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<script>x</script>") == ""
    assert html_text.extract("just text & more") == "just text & more"
    assert html_text.extract("a < b <p>c") == "a < b\nc"
    deep = "<div>" * 5000 + "inner" + "</div>" * 10
    assert html_text.extract(deep) == "inner"
    assert html_text.extract("<p title='a>b'>x</p><p a=\"1>2\">y") == "x\ny"
    rng = random.Random(1)
    for _ in range(300):
        html_text.extract("".join(rng.choice(["<p>", "</p>", "<div ", "'", '"', ">", "<", "&am", "<b>", "text", "<!--", "-->", "<script>", "</script>", "<li>", "</ul>"]) for _ in range(12)))


def test_pages(spark):
    rows = [(1, "u", f"<body>{ARTICLE}", "x", 1), (None, None, None, "x", 1), (3, "u", "", "x", 1), (3, "u", "", "x", 1), (4, "u", "<p>" + "word " * 60000, "x", 1)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(WANT)), (None, 0), (3, 0), (3, 0), (4, 299_999)]


def test_composition():
    g = toxicity.Grammar({"scum": 5.0, "lowei*": 4.0}, -4.0)
    plain = g.clause("such scum there")
    assert plain == 5.0 and g.clause("you are scum") > plain > g.clause("not scum at all") and plain > g.clause("they wrote about scum")
    assert g.clause("i will kill you") > 0 == g.clause("kill the process")
    assert g.clause("loweixy") == 4.0 and g.clause("xlowei") == 0.0
    assert g.score("") == g.score(None) == g.score("all is well. nothing here")
    assert g.score("Nice. SCUM! fine") > 0.7 > g.score("nice")
    assert g.score("fine. " * 50000 + "scum") > 0.7


def labelled(spark):
    rng = random.Random(3)
    words = ["ab%d" % i for i in range(80)]
    docs, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            t[rng.randrange(30)] = rng.choice(["vilest", "grubz" + rng.choice("abcdefg") + "x"])
        docs.append((i, " ".join(t) + ".", "en", "s", 9, "a", 0.5))
        if i % 10 < 8:
            labels.append((i, 1, int(toxic)))
    docs += [(None, None, "en", "s", 0, "a", 0.5), (None, "vilest", "en", "s", 0, "a", 0.5), (7, "", "en", "s", 0, "a", 0.5)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, toxic string, score double"), spark.createDataFrame([*labels, (None, 1, 1), (9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_long_clauses_are_read_whole():
    grammar = toxicity.Grammar({"blorp": 4.0, "dword": 3.0}, -3.0)
    plain, reported = grammar.score("blorp"), grammar.score("someone said blorp")
    assert reported < plain
    for n in (10, 100, 10_000):
        assert grammar.score("first. someone said " + "word " * n + "blorp") == reported
        assert grammar.score("someone said. " + "word " * n + "blorp") == plain
    # A cut may not start inside a word: "good" + "dword" is another word than "dword".
    assert grammar.score("a" * 20 + "dword" * 100 + " blorp") == plain


def test_toxicity_learns(spark):
    docs, labels = labelled(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        bad = r.text is not None and ("vilest" in r.text or "grubz" in r.text)
        assert (r.toxicity >= toxicity.THRESHOLD) == bad
    none = toxicity.toxicity(docs, labels.where("toxic = 0")).agg(F.max("toxicity")).first()[0]
    assert none < toxicity.THRESHOLD
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_fitting_ignores_held_out_rows(spark):
    docs, labels = labelled(spark)
    first = toxicity.split(docs)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(first.where("NOT held_out"), labels).entries == toxicity.fit(first.where("NOT held_out"), flipped).entries


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(25)] + [(7, 7)]
    low = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in cluster.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in low.items() if x in got}
    assert set(low) - set(got) <= {x for x in low if all(x not in e or e[0] == e[1] for e in edges)}
    assert cluster.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in Q.queries()} and {*Q.queries(), "pipeline"} <= names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "personal data", "source mix", "packing"]
    clean = cluster.saved(stages["toxicity"](spark, docs, DATA), "t1")
    assert clean.columns == columns and 0 < clean.count() <= len(texts)  # few labels teach nothing
    single = cluster.saved(stages["near duplicates"](spark, clean, DATA), "t2")
    assert single.columns == columns
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(clean).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, c in groups.items() if i == c)
    private = cluster.saved(stages["personal data"](spark, single, DATA), "t3")
    assert private.columns == columns and private.count() == single.count()
    assert any("<EMAIL>" in r.text for r in private.collect()) and not any("@mail" in r.text for r in private.collect())
    mix = cluster.saved(stages["source mix"](spark, private, DATA), "t4")
    assert mix.columns == columns
    packed = stages["packing"](spark, mix, DATA)
    assert packed.where("start = 0").count() == mix.count()
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.columns == packed.columns and whole.count() == packed.count()
    assert packed.agg(F.sum("length")).first()[0] == packing.pack(mix).agg(F.sum("length")).first()[0]


def test_pipeline_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, kept string"
    rows = [(None, None, None, None, None, 1.0, "k"), (1, "", "en", None, 0, None, None), (2, "a b", "en", "s", 3, 0.1, "x"), (2, "a b", "en", "s", 3, 0.1, "x")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs = cluster.saved(stage(spark, docs, DATA), name.replace(" ", "_"))


# ---- density -----------------------------------------------------------------------------------------------------


def neutral_page(article="div", extra=""):
    text = "".join(f"<p>{f'Sentence number {i} of the article is here. ' * 6}</p>" for i in range(4))
    return (
        "<body><div class='n'><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div>"
        f"<{article} class='a'><h1>T</h1>{text}{extra}</{article}>"
        "<div class='b'><p>Great post!</p><p>I do not agree with this at all.</p><p>Thanks for sharing it.</p></div>"
        "<div class='c'>Copyright 2024 Example. All rights reserved.</div></body>"
    )


def test_content_of_pages_without_telling_names():
    lines = html_text.extract(neutral_page()).split("\n")
    assert lines[0] == "T" and len(lines) == 5 and all(x.startswith("Sentence number") for x in lines[1:])
    parts = neutral_page().replace("<p>Sentence number 2", "</div><div class='z'><p>Sentence number 2")
    assert html_text.extract(parts).split("\n") == lines


def test_density_decides_on_the_given_pages(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").select("html").collect()]
    got = [html_text.extract(p) for p in pages]
    assert [html_text.extract(re.sub(r'class="[^"]*"', 'class="x7"', p)) for p in pages] == got
    monkeypatch.setattr(html_text, "_content", lambda body: ([body], set()))
    assert all(html_text.extract(p) != g for p, g in zip(pages, got))


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<p class='notice-board'>The board stays.</p>", "The board stays."),
        ("<div class='menu-planning'>Planning stays.</div>", "Planning stays."),
        ("<section id='search-theory'><p>Theory stays.</p></section>", "Theory stays."),
        ("<p>before <math><mi>x</mi><mo>=</mo><mn>2</mn></math> after</p>", "before x=2 after"),
        ("<div class='comment-list'><p>Nice.</p></div>", None),
        ("<aside>Beside.</aside><form>Name <input><button>Send</button></form>", None),
        ("<div class='wide ad-box'>Buy.</div><div class='cookie-notice'>Cookies.</div>", None),
    ],
)
def test_names_in_an_article(inner, text):
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>A first paragraph of text.</p>{inner}<p>last one</p></article><footer>F</footer></body>"
    assert html_text.extract(page).split("\n") == ["T", "A first paragraph of text.", *([text] if text else []), "last one"]


def test_ends_of_raw_elements_are_found_in_any_case():
    page = f"<body><p>{'İ' * 50} first</p><script>var a = '</p>';</script><p>second</p><SCRIPT>b</ScRiPt><p>third</p></body>"
    assert html_text.extract(page).split("\n") == ["İ" * 50 + " first", "second", "third"]


@pytest.mark.parametrize(
    "page",
    [
        lambda k: "<div>" * k + "</section>" * k,
        lambda k: "<i><div>" + "<b>" * k + "</i>" * k,
        lambda k: "<b>" * k + "<p></p>" * k,
        lambda k: "<li><ul>" + "<div>" * k + "<li></li>" * k,
        lambda k: "<p>" + "<div></p>" * k,
    ],
)
def test_nesting_takes_linear_time(page):
    import time

    def took(k):
        began = time.process_time()
        html_text.extract(page(k))
        return time.process_time() - began

    took(100)
    assert min(took(16000) for _ in range(2)) < 16 * max(0.02, min(took(2000) for _ in range(3)))


def test_density_sums_by_the_plain_formula():
    """The counts of the one-pass code against a recursive reading of the definition."""
    rng = random.Random(4)

    def tree(depth):
        kind = rng.choice(["div", "p", "a", "b", "section", "nav"] if depth else ["p", "a"])
        inner = "".join(tree(depth - 1) if depth and rng.random() < 0.6 else "word " * rng.randint(0, 9) for _ in range(rng.randint(1, 4)))
        return f"<{kind}>{inner}</{kind}>"

    for _ in range(60):
        root = html_text.parse(f"<body>{''.join(tree(3) for _ in range(3))}</body>")
        order = html_text._count(root)
        body = next(n for n in order if n.tag == "body")
        html_text._densities(order, body)

        def counts(node):
            """(characters, tags, link characters, link tags)"""
            c = t = lc = lt = 0
            for x in node.children:
                if isinstance(x, str):
                    c += len(" ".join(x.split()))
                else:
                    a = counts(x)
                    c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3]
            return (c, t, c, t + 1) if node.tag in ("a", "nav") else (c, t, lc, lt)

        def plain(node):
            c, t, lc, lt = counts(node)
            b = counts(body)
            if c < 2 or c == lc:
                return 0.0
            inside = c / (c - lc) * lc + (b[2] / b[0] if b[0] else 0) * c + math.e
            return max(0.0, c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(inside))

        for node in order:
            assert math.isclose(node.density, plain(node), rel_tol=1e-9)
            assert math.isclose(node.total, sum(plain(x) for x in node.children if not isinstance(x, str) and x.tag in html_text.BLOCK), rel_tol=1e-9)
        free = lambda n: n is None or not n.marked and free(n.parent)
        sums = [n.total for n in order if n.tag not in ("#root", "body") and free(n)]
        best = html_text._best(body)  # no article here
        assert best.total == max(sums, default=0) if best is not body else 2 * max(sums, default=0) <= body.total or not max(sums, default=0)


# ---- toxicity against a direct reading of the grammar ------------------------------------------------------------


def direct_clause(words, grammar):
    """A clause's weight read rule by rule, without machines."""
    total, threat, target, negation, reported = 0.0, 99, 99, 99, False
    for word in words:
        symbol = grammar.symbol(word)
        insult = None
        threat, target, negation = threat + 1, target + 1, negation + 1
        if symbol.startswith("insult:"):
            insult = grammar.entries[symbol[7:]]
        elif symbol == "threat":
            threat = 0
        elif symbol == "target" and threat <= 3:
            insult, threat = 4.0, 99
        elif symbol == "target":
            target = 0
        elif symbol == "negation":
            negation = 0
        elif symbol == "reporting":
            reported = True
        if insult is not None:
            total += insult + (0.7 if target <= 4 else 0) - (2.5 if negation <= 2 else 0) - (2.0 if reported else 0)
    return max(0.0, total)


def test_composed_grammar_is_the_rules_it_is_made_of():
    grammar = toxicity.Grammar({"idiot": 5.0, "stup*": 3.0, "stupidest*": 4.0, "fool": 2.5}, -3.0)
    rng = random.Random(6)
    vocabulary = ["idiot", "stupid", "stupidests", "fool", "you", "them", "kill", "hurt", "not", "never", "said", "wrote", "tree", "house", "and", "the"]
    for _ in range(3000):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        assert math.isclose(grammar.clause(" ".join(words)), direct_clause(words, grammar), abs_tol=1e-9), words
    for _ in range(300):
        clauses = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 150))] for _ in range(rng.randint(0, 4))]
        weights = [direct_clause(c, grammar) for c in clauses]
        want = -3.0 + max(weights, default=0) + toxicity.FURTHER * (sum(weights) - max(weights, default=0))
        got = grammar.score("".join(" ".join(c) + rng.choice(toxicity._MARKS) for c in clauses))
        assert math.isclose(got, 1 / (1 + math.exp(-max(-30, min(30, want)))), rel_tol=1e-9)
