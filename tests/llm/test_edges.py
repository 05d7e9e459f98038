"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from watchline.llm import decontaminate, html, jaccard, langid, lines, mixing, quality, rules, sharding, urls

CLASHES = ["size", "key", "h", "k", "shard", "Slot", "part", "node", "words", "target", "_p", "place", "times", "cut", "block"]
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
ITEM = "the quick brown fox jumps over the lazy dog while seven wise owls keep a silent watch above the barn tonight"
ROWS = [
    (1, "One small text of some seven words\nand another line of words here", "en", "a"),
    (1, "One small text of some seven words\nand another line of words here", "en", "a"),
    (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", None), (5, LONG, "en", "b"), (6, LONG, "en", "b"),
    (None, "A row without any number but with words", None, "b"), (None, None, None, None), (7, "x", "de", "c"),
    (8, "Ärger über Öl, 12 34 — ça va?", "de", "c"), (9, f"Before it. {ITEM.upper()}! After it.", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), *["z"] * len(CLASHES)) for r in ROWS]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, ddl).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_rules(docs, none):
    got = by_id(rules.ledger(docs))
    assert sum(map(len, got.values())) == len(ROWS) and len(got[1]) == 2
    assert got[1][0].n_words == 13 and got[1][0].failed == 0
    for i in (2, 3, 4):
        assert got[i][0].n_words == got[i][0].word_chars == got[i][0].n_lines == 0
        assert got[i][0].failed == rules.bits(["few_words"])
    assert got[5][0].n_words == 60_000 and got[5][0].n_repeat_words == 0
    assert rules.ledger(none).count() == 0
    assert [r.rejected for r in rules.ablate(rules.ledger(none), rules.POLICIES["strict"]).collect()] == [0] * 6


def test_language(docs, none):
    model = langid.train(docs, steps=3)
    got = by_id(langid.predict(docs, model))
    assert sum(map(len, got.values())) == len(ROWS)
    for i in (2, 3, 4):
        assert (got[i][0].lang_pred, got[i][0].score) == ("und", 0.0)
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for rs in got.values() for r in rs)
    assert got[5][0].lang_pred == got[6][0].lang_pred and got[5][0].score == got[6][0].score
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 0, 0), (8, 0, 1), (8, 1, 0), (9, None, None), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = by_id(quality.scores(docs, model))
    assert sum(map(len, got.values())) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for rs in got.values() for r in rs)
    assert got[2][0].score == got[3][0].score
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for rs in got.values() for r in rs)
    assert {r.score for r in quality.scores(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.scores(none, model).count() == 0 and quality.train(none, labels) == 0.5


def test_jaccard(docs, none):
    got = by_id(jaccard.groups(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [r.n_shingles for r in (got[2][0], got[3][0], got[4][0], got[7][0])] == [0, 0, 0, 1]
    assert [got[i][0].component_id for i in (1, 2, 5, 6, 7)] == [1, 2, 5, 5, 7]
    assert got[5][0].n_shingles == 59_996
    assert {r.component_id for r in got[None]} == {None}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, 9, None, None]))
    assert jaccard.groups(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(3, ITEM, "z"), (1, ITEM, "z"), (2, None, "z"), (4, "too short", "z"), (None, "", "z"),
                                   (5, "some seven words and another line", "z")], "item_id long, text string, seed string")
    got = decontaminate.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.n_items, r.matched) for r in got) == [(1, 5, 1, 6), (9, 1, 2, 12)]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(ROWS)


def test_rows_without_or_with_a_shared_doc_id_are_decided_by_their_own_text(spark):
    """Three rows without a doc_id and two that share one: of each, one leaks, is a near copy or has a copied line."""
    near = ITEM.split()
    clean = "nothing of that kind stands in this text\nit only has lines of its own"
    rows = [(None, f"Before it. {ITEM} after it."), (None, clean), (4, f"Say: {ITEM}"), (4, "four has this clean text as well")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.clean(d, items).collect()) == sorted([clean, rows[3][1]])

    copies = [(None, " ".join(near * 3)), (None, " ".join(near * 3 + ["more"])), (None, clean), (None, clean), (None, None),
              (7, clean + " but for these"), (8, "eight keeps its text"), (8, " ".join(near * 3 + ["still", "more"])),
              (9, "a text that only nine has"), (None, "a text that only nine has")]
    kept = jaccard.one_of_each(spark.createDataFrame(copies, "doc_id long, text string").repartition(3))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame(
        [copies[i] for i in (2, 4, 5, 6, 7, 8)], "doc_id long, text string").collect()))

    lined = [(None, "one line that two of them have\nsome unshared words stand here"),
             (None, "the second has this line alone\none line that two of them have"), (3, "three\none line that two of them have")]
    out = lines.deduplicated(spark.createDataFrame(lined, "doc_id long, text string")).collect()
    left = sorted(x for r in out for x in r.text.split("\n"))
    assert left == sorted({x for _, t in lined for x in t.split("\n")})


def test_mixing(docs, none):
    got = by_id(mixing.mix(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [got[i][0].size for i in (1, 2, 3, 4, 5)] == [13, 0, 0, 0, 60_000]
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for rs in got.values() for r in rs)
    assert got[1][0].taken == got[1][1].taken
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert {k: len(v) for k, v in by_id(out).items()} == {
        k: n for k, v in got.items() if (n := sum(r.times for r in v))}
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0


def test_sharding(docs, none):
    got = sharding.assign(docs, 4).collect()
    assert len(got) == len(ROWS)
    assert all(r.size == 8 for r in got if r.doc_id in (2, 3))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    out = sharding.sharded(docs, 4)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "Slot")] + ["shard", "slot"]
    assert out.count() == len(ROWS)
    assert sharding.assign(none).count() == 0 and sharding.sharded(none).count() == 0


def test_lines(docs, none):
    got = lines.copies(docs)
    assert sorted(tuple(r) for r in got.collect()) == [(6, 0, 5, 0, 0)]
    out = lines.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert by_id(out)[6][0].text == "" and by_id(out)[5][0].text == LONG and by_id(out)[2][0].text is None
    assert lines.copies(none).count() == 0


def test_urls(spark):
    captures = spark.createDataFrame(
        [(1, "http://Bad.Example.com/x/y?q#f", 10), (1, "http://Bad.Example.com/x/y?q#f", 10), (2, None, 10), (3, "no url", 10),
         (4, "https://u:p@bad.example.com:8080", None), (None, "ftp://sub.bad.example.com/ok/page", 30)],
        "page_id long, url string, day int")
    entries = spark.createDataFrame(
        [("deny", "domain", "bad.example.com", "add", 5), ("deny", "domain", "bad.example.com", "remove", 20),
         ("deny", "domain", "bad.example.com", "add", 25), ("allow", "prefix", "sub.bad.example.com/ok", "add", 1),
         ("deny", "prefix", "bad.example.com/x", "add", 12), ("deny", None, None, "add", None),
         ("deny", "domain", "example.com", "add", 3), ("deny", "domain", "example.com", "remove", 3)],
        "list string, kind string, pattern string, action string, day int")
    got = sorted(((r.page_id, r.n_active, r.pattern, r.since, r.verdict) for r in urls.verdicts(captures, entries).collect()), key=str)
    assert got == sorted([(1, 1, "bad.example.com", 5, "drop")] * 2 + [
        (2, 0, None, None, "keep"), (3, 0, None, None, "keep"), (4, 0, None, None, "keep"),
        (None, 2, "sub.bad.example.com/ok", 1, "keep")], key=str)
    assert urls.verdicts(captures.limit(0), entries).count() == 0
    top = spark.createDataFrame([("deny", "domain", "zip", "add", 1), ("deny", "domain", "intranet", "add", 1)],
                                "list string, kind string, pattern string, action string, day int")
    hosts = spark.createDataFrame([(1, "http://a.b.zip/x", 5, "z"), (2, "http://zip/", 5, "z"), (3, "http://wiki.intranet/" + "x" * 50_000, 5, "z"),
                                   (4, "http://zip.org/intranet", 5, "z")], "page_id long, url string, day int, pattern string")
    assert {r.page_id: r.verdict for r in urls.verdicts(hosts, top).collect()} == {1: "drop", 2: "drop", 3: "drop", 4: "keep"}
    assert {r.verdict for r in urls.verdicts(captures, entries.limit(0)).collect()} == {"keep"}


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<body><nav><a>menu</a></nav><article><h1>A &amp; B</h1><p>One<br>two <b>three</p></article>", "z"),
         (1, "u", "<body><nav><a>menu</a></nav><article><h1>A &amp; B</h1><p>One<br>two <b>three</p></article>", "z"),
         (2, None, None, "z"), (3, "v", "", "z"), (None, "w", "<p" * 1000, "z"),
         (4, "x", "<main><p>" + "many words here. " * 20_000 + "</main>", "z")],
        "page_id long, url string, html string, text string")
    for model in (None, html.train(pages)):
        got = sorted(((r.page_id, r.text, r.n_chars) for r in html.extract(pages, model).collect()), key=str)
        assert [r for r in got if r[0] == 1] == [(1, "A & B\nOne two three", 19)] * 2
        assert [r for r in got if r[0] in (2, 3)] == [(2, "", 0), (3, "", 0)]
        assert len(got) == 6 and got[-2][2] == len(("many words here. " * 20_000).strip())
    assert html.extract(pages.limit(0), None).count() == 0
    assert html.train(pages.limit(0)) is None
