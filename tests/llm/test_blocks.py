"""Blocks of the Jaccard join that shared passages chain together, and what a stored table leaves on disk."""

import random
import time

from watchline.llm import jaccard, tables


def test_chained_blocks_are_not_sent_everywhere(spark, monkeypatch):
    rng = random.Random(8)

    def words(n):
        return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]

    clusters = 40
    passages = [words(60) for _ in range(clusters + 1)]
    rows = []
    for i in range(clusters):  # each shares a passage with the next, too little to be linked
        own = passages[i] + words(40) + passages[i + 1]
        for copy in range(3):
            rows.append((10 * i + copy, " ".join(own[:-copy or None])))
    sent = []
    links = jaccard.block_links
    monkeypatch.setattr(jaccard, "PIECE", 2000)
    monkeypatch.setattr(jaccard, "block_links", lambda rows, tasks: sent.append(rows.count()) or links(rows, tasks))
    docs = spark.createDataFrame([*rows, (7777, None), (None, rows[0][1])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.groups(docs).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows} | {7777: 7777, None: 0}
    assert sent[0] <= 3 * len(rows)  # ten pieces took each set before


def test_shuffle_files_go_with_the_write(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {f for i in range(found.size()) if (f := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    kept = tables.stored(spark.range(20_000).repartition(3, "id").groupBy("id").count(), "kept")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == 20_000 and spark.conf.get(tables.CLEANUP) == "false"
