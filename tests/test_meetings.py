"""Signatures met in tiles, and promotion from counts: both against plain loops."""

import random

import pytest

from watchline.operators import immune, meetings
from watchline.plans.queries import QUERIES


def pools(seed, dim, antigens=90, detectors=50):
    rng = random.Random(seed)

    def draw(share):
        return [b for b in range(dim) if rng.random() < share]

    a = [(i, draw(rng.choice([0.3, 0.8]))) for i in range(antigens)] + [(500, []), (501, None), (None, list(range(dim)))]
    a += [(i + 1000, b) for i, b in a[:20] if b] + a[:5] + [(i, list(range(dim - 1))) for i in range(700, 720)]
    d = [(f"d{i}", draw(0.3)) for i in range(detectors)] + [("zero", []), ("none", None)]
    d += [(f"e{i}", b) for i, (_, b) in enumerate(d[:9])] + d[:6] + [("d1", d[9][1]), (None, d[3][1])]
    return a, d


def share(gene, bits):
    return len(set(gene) & set(bits)) / len(gene) if gene and bits else 0


def key(r):
    return (r[0] is None, r[0] or 0, str(r[1]), r[2])


@pytest.mark.parametrize("seen", [0, 1e9])  # the join, the tiles
@pytest.mark.parametrize("dim", [40, 300])
def test_tiles_and_join_find_the_same(spark, monkeypatch, seen, dim):
    for name, value in (("SIDE", 24), ("GENES", 7), ("ANTIGENS", 5)):
        monkeypatch.setattr(meetings, name, value)
    monkeypatch.setattr(immune, "SEEN", seen)
    monkeypatch.setattr(immune, "CHUNK", 3)
    antigens, detectors = pools(dim, dim)
    a = spark.createDataFrame(antigens, "antigen_id long, bits array<int>").repartition(3)
    d = spark.createDataFrame(detectors, "detector_id string, bits array<int>").repartition(2)
    want = [(x, y, share(g, b)) for x, b in antigens for y, g in detectors if share(g, b) >= 0.65]
    pairs = immune.immune_screen(a, d, dim, 0.65)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert ("bit_count" in plan) == (not seen)  # pairs leave the tiles as rows
    got = [tuple(r) for r in pairs.collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and want
    genes = {tuple(g) for _, g in detectors if g}
    sums = {}
    for x, b in antigens:
        found = [share(g, b) for _, g in detectors if share(g, b) >= 0.65]
        if found:
            sums.setdefault(x, []).append((len(found), max(found)))
    per = {}
    for r in immune.immune_totals(a, d, dim, 0.65).collect():
        per.setdefault(r.antigen_id, []).append((r.matches, r.best))
    assert {k: sorted(v) for k, v in per.items()} == {k: sorted(v) for k, v in sums.items()} and len(genes) > 20
    lists = {}
    for x, y, _ in want:
        lists.setdefault(y, []).append((x is not None, x or 0))
    counted = immune.immune_screen(a, d, dim, 0.65, lowest=4).collect()
    assert {r.detector_id: (r.matches, r.lowest) for r in counted} == {
        y: (len(v), [x if some else None for some, x in sorted(v)[:4]]) for y, v in lists.items()}


def test_promotion_from_counts_and_from_pairs(spark):
    antigens, detectors = pools(3, 40)
    a = spark.createDataFrame(antigens, "antigen_id long, bits array<int>")
    d = spark.createDataFrame([(y, f"l{len(y or '')}", g) for y, g in detectors], "detector_id string, label string, bits array<int>")
    one, other = (sorted(map(tuple, immune.promote(hits, d, a).select(
        "detector_id", "activation_count", "promoted_by", "label").collect()), key=str)
        for hits in (immune.immune_screen(a, d, 40, 0.65), immune.immune_screen(a, d, 40, 0.65, lowest=3)))
    assert one == other and one


def test_promotion_lists_no_pairs(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], i % 10) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = QUERIES["immune_promotion"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "bit_count" not in plan  # dense sets are counted in tiles; no join on their rare bits


def test_needed_bits_are_those_of_the_share():
    import numpy as np
    assert meetings.needed(np.array([1, 4, 20, 3]), 0.65).tolist() == [1, 3, 13, 2]
    assert meetings.needed(np.array([4]), 1.5).tolist() == [5] and meetings.needed(np.array([4]), 0.0).tolist() == [1]
