"""Cooldown scans against a plain loop, with slices far shorter than the state they carry."""

from dataclasses import replace

import pytest

from conftest import SECOND, by_key, random_keys
from watchline.config import DEFAULTS
from watchline.operators import cooldown

SCHEMA = "source_ip string, event_id long, ts_us long"


def loop_first(rows, window, inclusive):
    out = set()
    for _, group in by_key(rows).items():
        anchor = None
        for _, i, ts in group:
            if anchor is None or (ts - anchor > window if inclusive else ts - anchor >= window):
                anchor = ts
                out.add(i)
    return out


@pytest.mark.parametrize("slice_s", [0.5, 7, 120, 3600])
@pytest.mark.parametrize("inclusive", [True, False])
def test_first_per_window(spark, slice_s, inclusive):
    rows = random_keys(60, 60, 900, 7, boundaries=(30,))
    df = spark.createDataFrame(rows, SCHEMA)
    got = cooldown.first_per_window(df, ["source_ip"], 30 * SECOND, inclusive, slice_us=int(slice_s * SECOND))
    assert {r.event_id for r in got.collect()} == loop_first(rows, 30 * SECOND, inclusive)


def test_exact_boundary(spark):
    rows = [("a", 0, 0), ("a", 1, 120 * SECOND), ("a", 2, 120 * SECOND + 1), ("a", 3, 240 * SECOND + 1),
            ("a", 4, 240 * SECOND + 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = cooldown.first_per_window(df, ["source_ip"], 120 * SECOND, inclusive=True)
    assert sorted(r.event_id for r in got.collect()) == [0, 2, 4]


def test_null_and_many_keys(spark):
    rows = [(None, 0, 0), (None, 1, 200 * SECOND), (None, 2, 201 * SECOND)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = cooldown.first_per_window(df, ["source_ip"], 100 * SECOND, inclusive=False, slice_us=SECOND)
    assert sorted(r.event_id for r in got.collect()) == [0, 1]


def loop_flood(rows, need, window, quiet):
    out = {}
    for _, group in by_key(rows).items():
        until, recent = None, []
        for _, i, ts in group:
            if until is not None and ts < until:
                out[i] = "dos_flood_ongoing"
                continue
            recent = [t for t in recent if ts - t <= window] + [ts]
            if len(recent) >= need:
                out[i] = "dos_flood_detected"
                until = ts + quiet
    return out


@pytest.mark.parametrize("slice_s", [5, 11, 60])
def test_flood(spark, slice_s):
    rows = random_keys(50, 120, 200, 11, boundaries=(5, 30))
    cfg = replace(DEFAULTS, flood_rate=1.0)
    got = cooldown.flood(spark.createDataFrame(rows, SCHEMA), cfg=cfg, slice_us=slice_s * SECOND)
    want = loop_flood(rows, 5, 5 * SECOND, 30 * SECOND)
    assert {r.event_id: r.flag for r in got.collect()} == want
    assert "dos_flood_detected" in want.values() and "dos_flood_ongoing" in want.values()


def test_one_hot_key_is_spread(spark):
    """A third of all rows under one key: its slices are separate groups, the result is exact."""
    rows = [("hot", i, 1_000_000_000 + i * 90_000) for i in range(20_000)]
    rows += [(f"k{i % 300}", 100_000 + i, 1_000_000_000 + i * 45_000) for i in range(40_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = cooldown.first_per_window(df, ["source_ip"], 30 * SECOND, inclusive=False)
    assert {r.event_id for r in got.collect()} == loop_first(rows, 30 * SECOND, False)
