"""Window counts of the stateful streams against plain counts, and profiles chained behind windowed counts."""

import random
from dataclasses import replace

import numpy as np

from conftest import SECOND
from test_streaming import BASE, drain, far_future, files
from watchline.config import DEFAULTS
from watchline.operators import profiler, routing
from watchline.streaming import stateful, windows


def test_window_counts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(0, 30))
        hits = np.sort(rng.integers(0, 40, n))
        values = rng.integers(0, 5, n)
        now = np.sort(rng.integers(0, 50, 20))
        inside = [(hits >= t - 7) & (hits <= t) for t in now]
        assert stateful.in_window(now, hits, np.ones(n, int), 7).tolist() == [int(x.sum()) for x in inside]
        if n:
            assert stateful.distinct_in_window(now, hits, values, 7).tolist() == [len(set(values[x])) for x in inside]


def test_profiles_behind_windows(spark, tmp_path):
    rng = random.Random(7)
    rows, i = [], 0
    for node in range(4):
        for tick in range(90):
            for _ in range(rng.randrange(1, 9)):
                rows.append((f"n{node}", i, (tick * 60 + rng.randrange(60)) * SECOND))
                i += 1
    stream, batch = files(spark, tmp_path, far_future(rows, ()), BASE, parts=4)
    cfg = replace(DEFAULTS, amof_threshold=0.3)
    got = drain(spark, tmp_path, windows.amof(stream, 60.0, cfg=cfg, delay="0 seconds"))
    counts = routing.forward_ticks(batch.filter("source_ip <> 'zz-end'").selectExpr("*", "'' as message"), 60 * SECOND)
    want = profiler.amof(counts, "source_ip", cfg).collect()
    pick = lambda rows: {(r.source_ip, r.tick, round(r.slope, 9) + 0.0, r.first_anomalous_tick) for r in rows}
    assert pick(got) == pick(want) and len(want) > 50
