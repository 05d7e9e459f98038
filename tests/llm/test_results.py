"""Results against brute force, SQL or held-out labels."""

import itertools
import os
import random
import re
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from watchline.llm import decontaminate, graph, html, jaccard, langid, lines, mixing, quality, queries, rules, sharding, tables, urls
from watchline.storage import new_folder

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), names)


def texts(seed, n, vocabulary=400):
    """Random documents with near copies, shared passages and shared lines."""
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 2)}"
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.5:
            t = list(rng.choice(out))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                i = rng.randrange(len(t) + 1)
                t[i:i + rng.randrange(2)] = [word()] * rng.randrange(2)
        else:
            t = [word() for _ in range(rng.choice([1, 3, 5, 8, 30, 80, 200]))]
        if rng.random() < 0.3:
            t = t + passage
        out.append(t or ["x"])
    return out


def shingles(words):
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(sets):
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("piece", [jaccard.PIECE, 300])
def test_jaccard_groups(spark, monkeypatch, piece):
    monkeypatch.setattr(jaccard, "PIECE", piece)
    made = texts(1, 260)
    df = spark.createDataFrame([(10 * i, " ".join(t).upper() if i % 3 else "\n".join(t)) for i, t in enumerate(made)],
                               "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(df).collect()}
    sets = [shingles(t) for t in made]
    want = {10 * i: (len(s), 10 * r) for i, (s, r) in enumerate(zip(sets, brute_groups(sets)))}
    assert got == want


def test_linked_and_occurrences(monkeypatch):
    rng = random.Random(3)
    for _ in range(30):
        lists = [sorted(rng.sample(range(30), rng.randrange(1, 25))) for _ in range(rng.randrange(1, 30))]
        count = Counter(x for run in lists for x in run)
        for needed in (1, 2, 5, 15, 28):
            for heap, few in ((0, 0), (jaccard.HEAP, 99)):
                monkeypatch.setattr(jaccard, "HEAP", heap)
                monkeypatch.setattr(jaccard, "FEW", few)
                *found, long = jaccard.merged([array("q", run) for run in lists], needed)
                got = dict(zip(*(x.tolist() for x in jaccard.probed(*found, long, needed))))
                assert got == {x: c for x, c in count.items() if c >= needed}
    base = rng.sample(range(10_000), 300)
    sets = []
    for _ in range(150):
        s = set(rng.choice(sets) if sets and rng.random() < 0.5 else base)
        for _ in range(rng.choice([2, 8, 25, 60])):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(10_000))
        sets.append(s)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    forest = jaccard.linked(arrays)
    assert forest == brute_groups(sets)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    up = {n: n for e in edges for n in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in up.items() if n != r}


def test_decontamination(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 5, 7, 8, 9, 11, 12, 13, 30]))] for _ in range(40)]
    docs = []
    for _ in range(150):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        piece = list(rng.choice(items))
        for _ in range(rng.randrange(5)):
            piece[rng.randrange(len(piece))] = "other"
        at = rng.randrange(len(t) + 1)
        docs.append(t[:at] + (piece[rng.randrange(3):] if rng.random() < 0.6 else []) + t[at:])
    docs[:12] = [list(items[i]) for i in range(12)]  # whole documents that are items

    def leak(t, item):
        width = min(12, len(item))
        tolerated = 2 if width == 12 else 1 if width >= 8 else 0
        if width < 5:
            return t == item
        return any(sum(a != b for a, b in zip(t[i:i + width], item[j:j + width])) <= tolerated
                   for i in range(len(t) - width + 1) for j in range(len(item) - width + 1))

    d = spark.createDataFrame([(i, ", ".join(t).title()) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    first = {i: min(j for j, u in enumerate(items) if u == t) for i, t in enumerate(items)}
    want = {(i, first[j]) for i, t in enumerate(docs) for j, u in enumerate(items) if leak(t, u)}
    got = decontaminate.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == sorted(set(range(150)) - {i for i, _ in want})


def test_lowest_of_each_group(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 700 == 1, "few").otherwise(F.lit(None)).alias("g"), "id",
        F.xxhash64("id").alias("h"))
    got = tables.lowest(rows, "g", "h", 100).collect()
    everything = rows.collect()
    for g in ("a", "few", None):
        want = sorted(r.h for r in everything if r.g == g)[:100]
        mine = sorted(r.h for r in got if r.g == g)
        assert mine[:100] == want and len(mine) <= 600
    assert tables.lowest(rows.limit(0), "g", "h", 100).count() == 0


def test_masks_miss_nothing():
    for width in range(8, 12):
        for bad in range(width):
            assert any(bad not in m for _, m in decontaminate.masks_of(width))
    for bad in itertools.combinations(range(decontaminate.SPAN), decontaminate.MISSES):
        assert any(not set(bad) & set(m) for m in decontaminate.MASKS)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_copies(spark):
    rng = random.Random(9)
    made, docs = [], []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(made)) if made and rng.random() < 0.6 else [f"w{rng.randrange(9)}" for _ in range(rng.randrange(3, 12))]
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(line) + 1)
                line[k:k + rng.randrange(2)] = [f"w{rng.randrange(9)}"] * rng.randrange(2)
            made.append(line)
            text.append(line)
        docs.append((i, text))
    df = spark.createDataFrame([(i, "\n".join(" ".join(x) for x in t)) for i, t in docs], "doc_id long, text string")
    places = [(i, n, x) for i, t in docs for n, x in enumerate(t) if len(x) >= 5]
    want = {}
    for k, (i, n, x) in enumerate(places):
        for j, m, y in places[:k]:
            if edit_distance(x, y) <= 1:
                want[i, n] = (j, m)
                break
    # A copy of a line follows that line's own earliest neighbour.
    got = {(r.doc_id, r.line): (r.first_doc, r.first_line) for r in lines.copies(df).collect()}
    assert got == want


def test_short_lines_are_copies_of_equal_ones(spark):
    docs = [(1, "All rights reserved.\nHome\none two three four"), (2, "All  rights\treserved.\none two three five\n"),
            (3, "Home\n \nseen once\none two three four five"), (4, "one two three four\none two three six five\nHome page")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in lines.all_copies(df).collect())
    assert got == [(2, 0, 1, 0, 0), (3, 0, 1, 1, 0), (4, 0, 1, 2, 0), (4, 1, 3, 3, 1)]
    kept = {r.doc_id: r.text for r in lines.deduplicated(df).collect()}
    assert kept == {1: docs[0][1], 2: "one two three five\n", 3: " \nseen once\none two three four five", 4: "Home page"}


def test_within_one():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(6))] for _ in range(2))
        assert lines.within_one(np.array(a, int), np.array(b, int)) == (edit_distance(a, b) <= 1)


def test_rule_measures_and_ablation(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["ab", "cd ", " ", "\n", "\t", "é$ ", "X! ", "a b c d e f ", "\x0b", "\x1f"]) for _ in range(rng.randrange(60))))
            for i in range(80)]

    def brute(t):
        w = WORD.findall(t)
        windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        worded = [x for x in t.split("\n") if WORD.search(x)]
        caps = sum(any(c.isupper() for c in x) and not any(c.islower() for c in x) for x in w)
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(worded), len(worded) - len(set(worded)),
                len(covered), caps)

    entries = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    got = entries.collect()
    assert {r.doc_id: tuple(r[1:8]) for r in got} == {i: brute(t) for i, t in rows}
    policy = rules.POLICIES["strict"]
    required, others = rules.bits(policy.required), rules.bits(policy.others)
    keeps = lambda f, gone=0: not f & required & ~gone and not f & others & ~gone
    for r in rules.ablate(entries, policy).collect():
        bit = rules.bits([r.rule])
        assert r.failed == sum(bool(x.failed & bit) for x in got)
        assert r.rejected == sum(bool(x.failed & bit) and not keeps(x.failed) for x in got)
        assert r.returned == sum(not keeps(x.failed) and keeps(x.failed, bit) for x in got)


def test_water_filling(spark):
    rng = random.Random(6)
    for _ in range(4):
        sizes = {f"s{i:02}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(rng.randrange(1, 12))}
        rows = [(s, n, rng.choice([1, 2, 5])) for s, n in sizes.items()]
        want, budget, free = {}, 1.5 * sum(sizes.values()), dict((s, (n, w)) for s, n, w in rows)
        while free:
            total = sum(w for _, w in free.values())
            over = [s for s, (n, w) in free.items() if budget * w / total >= 2 * n]
            if not over:
                want |= {s: budget * w / total for s, (n, w) in free.items()}
                break
            for s in over:
                want[s] = 2 * free.pop(s)[0]
            budget = 1.5 * sum(sizes.values()) - sum(want.values())
        df = spark.createDataFrame(rows, "source string, source_size long, weight int")
        got = {r.source: r.target for r in mixing.water_fill(df).collect()}
        assert got == pytest.approx(want)


@needs_tables
def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same = docs.limit(1).select(F.explode(F.sequence(F.lit(10_000), F.lit(10_400))).alias("doc_id"), *docs.columns[1:])
    got = sharding.assign(docs.union(same), 6).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 6 and by.max() - by.min() <= 2 * got[got.doc_id < 10_000]["size"].max()
    heavy = got[got.doc_id >= 10_000].text_crc32.iloc[0]
    light = got[got.text_crc32 != heavy].groupby("text_crc32").agg(n=("shard", "nunique"), b=("size", "sum"))
    assert (light.n[light.b < 0.02 * by.mean()] == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = sharding.assign(docs.union(same).repartition(7), 6).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, again[key].values.tolist())) == sorted(map(tuple, got[key].values.tolist()))


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in langid.init(3).items()}
    grid = np.random.default_rng(1).integers(97, 123, (langid.WINDOW, 5)).astype(np.uint8)
    y = np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(langid.probabilities(p, grid)[y, :, np.arange(5)]).mean()
    g = langid._gradients(p, grid, y)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        p[k][at] += 0.01
        high = loss()
        p[k][at] -= 0.02
        low = loss()
        p[k][at] += 0.01
        assert (high - low) / 0.02 == pytest.approx(g[k][at], rel=0.01)


@needs_tables
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    seen = queries.QUERIES["op1_language_id"](spark, d).where("held_out").join(docs, "doc_id").toPandas()
    assert len(seen) > 200 and (seen.lang == seen.lang_pred).mean() > 0.95
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    seen = queries.QUERIES["op5_quality_classifier"](spark, d).where("held_out").join(labels, "doc_id").toPandas()
    assert len(seen) > 80 and (seen.quality == seen.predicted).mean() > 0.95


def test_decoding_is_best():
    rng = random.Random(8)
    for _ in range(40):
        n = rng.randrange(2, 11)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        score = [rng.uniform(-3, 3) for _ in range(n)]
        value = lambda keep: sum(s if k else -s for s, k in zip(score, keep))
        best = max((k for k in itertools.product([True, False], repeat=n) if k[0] and all(
            k[parent[i]] or not k[i] for i in range(1, n))), key=value)
        assert value(html.decode(parent, score)) == pytest.approx(value(best))


@needs_tables
def test_main_text(spark):
    got = {r.page_id: r for r in queries.QUERIES["op8_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?!br)[a-z][^>]*>", "", x))).split())
                 for x in re.split(r"</?(?:p|h1|div)[^>]*>", article)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    rule = lambda t: (lambda p: p.text(html.weak_labels(p)))(html.Page(t))
    assert rule('<body><button class="x">Menu<article><p>Text</p></article>') == "Text"
    assert rule("<body><button>Menu<article><p>One</p><button>Share</button><p>Two</p></article></body>") == "One\nTwo"
    assert rule("<article><p>One</p><object data=x><p>Two</p><svg><text>no</text></svg><p>Three</p></article>") == "One\nTwo\nThree"
    assert rule("<article><p>One<select><option>a<option>b</select> two</p><template><p>no</p></template><p>Three</p></article>") == "One two\nThree"
    assert rule("<article><p>One</p><script>var a = '<p>no</p>'</article>") == "One"
    page = html.Page('<body><div class="cookie-notice"><p>We use</p></div><main><p>Text</p><section class="comments">no</section></main>')
    assert page.text(html.weak_labels(page)) == "Text"


@needs_tables
def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, folder = docs, new_folder(spark, "test")
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
        seen[name] = (before.toPandas(), docs.toPandas())
        assert docs.columns == before.columns + (["shard", "slot"] if name == "sharding" else [])
    a, b = seen["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    judged = a[a.doc_id.isin(labels.index)]
    assert (judged.doc_id.isin(b.doc_id) == (judged.doc_id.map(labels) == 1)).mean() > 0.95
    a, b = seen["jaccard_join"]
    a = a.sort_values("doc_id").reset_index(drop=True)
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    roots = brute_groups([shingles(WORD.findall(lower(t))) for t in a.text])
    assert sorted(b.doc_id) == sorted(a.doc_id[i] for i in set(roots))
    a, b = seen["decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text
    plain = lambda t: [x for x in (re.sub(r"[\W_]+", "", w.lower()) for w in WORD.findall(t)) if x]
    windows = defaultdict(list)
    grams = lambda w: [w[i:i + 12] for i in range(len(w) - 11)]
    for w in (w for t in items for w in grams(plain(t))):
        for i in (0, 4, 8):  # two misses leave one of three runs of four words whole
            windows[i, tuple(w[i:i + 4])].append(w)
    leaks = {i for i, t in zip(a.doc_id, a.text) if any(
        sum(x != y for x, y in zip(w, u)) <= 2 for w in grams(plain(t)) for k in (0, 4, 8) for u in windows[k, tuple(w[k:k + 4])])}
    assert set(a.doc_id) - set(b.doc_id) == leaks
    a, b = seen["mix_sources"]
    plan = mixing.mix(spark.createDataFrame(a)).toPandas().set_index("doc_id").times
    assert b.doc_id.value_counts().to_dict() == plan[plan > 0].to_dict()
    a, b = seen["sharding"]
    assert sorted(a.doc_id) == sorted(b.doc_id)
    size = b.assign(size=b.text.str.encode("utf-8").str.len() + 8).groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() - size.min() <= 2 * (a.text.str.len().max() + 8)
