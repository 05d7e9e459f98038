"""Trust, automata and gateway tests split over many slices, against plain loops."""

import random

import pytest

from conftest import SECOND, by_key, random_keys
from watchline.config import DEFAULTS
from watchline.operators import gateway, protocol, trust

LABELS = ["benign", "benign", "suspicious", "malicious"]


def detections(seed=1, keys=30, rows=150):
    rng = random.Random(seed)
    return [(k, i, ts, rng.choice(LABELS)) for k, i, ts in random_keys(keys, rows, 2000, seed)]


DET = "source_ip string, event_id long, ts_us long, predicted_label string"


def loop_scores(rows):
    path, final = {}, {}
    for key, group in by_key(rows).items():
        score = 0.7
        for r in group:
            score += {"malicious": -0.25, "suspicious": -0.10}.get(r[3], 0.02)
            score = max(0.0, min(1.0, score))
            path[r[1]] = score
        final[key] = score
    return path, final


def test_trust_scores_and_path(spark):
    rows = detections()
    path, final = loop_scores(rows)
    df = spark.createDataFrame(rows, DET)
    got = {r.source_ip: r.score for r in trust.trust_scores(df).collect()}
    assert got == pytest.approx(final, abs=1e-9)
    for slice_s in (3, 60, 10_000):
        got = {r.event_id: r.score for r in trust.trust_path(df, slice_us=slice_s * SECOND).collect()}
        assert got == pytest.approx(path, abs=1e-9)


class TrustLoop:
    def __init__(self, edges, strategy, clusters=None):
        self.score, self.near, self.strategy, self.clusters = {}, {}, strategy, clusters or {}
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                self.near.setdefault(x, set()).add(y)
                self.score.setdefault(x, 0.7)

    def see(self, ip, label):
        s = self.score.get(ip, 0.7) + {"malicious": -0.25, "suspicious": -0.10}.get(label, 0.02)
        self.score[ip] = s = max(0.0, min(1.0, s))
        gap = max(0.0, 0.7 - s)
        for n in self.near.get(ip, ()):
            same = self.clusters.get(ip) and self.clusters.get(ip) == self.clusters.get(n)
            weight = 0.3 if self.strategy == "nbtd" else 0.4 if same else 0.1
            if gap:
                self.score[n] = max(0.0, self.score[n] - gap * weight)


@pytest.mark.parametrize("strategy", ["nbtd", "cntd"])
def test_trust_rounds_equal_loop_when_one_event_per_tick(spark, strategy):
    rng = random.Random(4)
    ips = list("abcdef")
    edges = [("a", "b"), ("b", "c"), ("d", "e"), ("a", "e")]
    clusters = {"a": "x", "b": "x", "c": "y", "e": "x"}
    rows = [(rng.choice(ips), i, i * SECOND, rng.choice(LABELS)) for i in range(8)]
    loop = TrustLoop(edges, strategy, clusters)
    for ip, _, _, label in rows:
        loop.see(ip, label)
    got = trust.trust_rounds(
        spark.createDataFrame(rows, DET), trust.both_ways(spark.createDataFrame(edges, "src string, dst string")),
        SECOND, strategy, clusters=spark.createDataFrame(list(clusters.items()), "ip string, cluster_id string"))
    assert {r.ip: r.score for r in got.collect()} == pytest.approx(loop.score, abs=1e-9)


def test_multiplier_bounds_and_unknown(spark):
    scores = spark.createDataFrame([("a", 0.29), ("b", 0.3), ("c", 0.7), ("d", 0.71)], "source_ip string, score double")
    rows = spark.createDataFrame([(x,) for x in "abcde"], "source_ip string")
    got = {r.source_ip: r.multiplier for r in trust.severity_multipliers(rows, scores).collect()}
    assert got == {"a": 1.5, "b": 1.0, "c": 1.0, "d": 0.8, "e": 1.0}


STATES = {"coap": ["con", "ack", "rst", "terminal", "odd"], "tcp": ["closed", "syn_sent", "syn_rcvd", "established"],
          "mqtt": ["open", "shut"]}


@pytest.mark.parametrize("slice_s", [2, 60, 10_000])
def test_protocol_violations(spark, slice_s):
    rng = random.Random(9)
    rows = []
    for k, i, ts in random_keys(25, 100, 600, 9):
        proto = rng.choice(list(STATES))
        rows.append((k, i, ts, proto, rng.choice(STATES[proto]), rng.choice(STATES[proto] + [None])))
    edges = {}
    for p, a, b in protocol.DEFAULT_TRANSITIONS:
        edges.setdefault(p, set()).add((a, b))
    want, known = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        key, cur, nxt = (r[0], r[3]), r[4].upper(), r[5] and r[5].upper()
        if nxt is None:
            known[key] = cur
            continue
        source = known.get(key) or cur
        if r[3] in edges and (source, nxt) not in edges[r[3]]:
            want[r[1]] = (source, nxt)
        else:
            known[key] = nxt
    df = spark.createDataFrame(rows, "source_ip string, event_id long, ts_us long, protocol string, event_state string, next_state string")
    got = {r.event_id: (r.from_state, r.to_state) for r in protocol.protocol_violations(df, slice_us=slice_s * SECOND).collect()}
    assert got == want and want


def loop_gateway(rows):
    out = []
    low, high = gateway.boundaries()
    per_drop, per_forward = gateway.weights()
    for key, group in by_key(rows).items():
        s, last, n = 0.0, None, 0
        for _, i, ts, f, d in group:
            n += 1
            s += d * per_drop + f * per_forward
            if s <= low:
                s = 0.0
            if s >= high and n >= 20 and (last is None or ts - last > 120 * SECOND):
                out.append((key, i, round(s, 6)))
                s, last = 0.0, ts
    return set(out)


@pytest.mark.parametrize("chunk_rows", [13, 10_000])
def test_gateway_alerts(spark, chunk_rows):
    rng = random.Random(21)
    rows = []
    for k, i, ts in random_keys(6, 400, 30_000, 21, boundaries=(120,)):
        bad = int(k[1:]) % 2 == 0
        rows.append((k, i, ts, rng.randrange(0, 6), rng.randrange(0, 4) if bad else int(rng.random() < 0.02)))
    df = spark.createDataFrame(rows, "gateway_id string, event_id long, ts_us long, forwarded long, dropped long")
    got = gateway.gateway_alerts(df, chunk_rows=chunk_rows).collect()
    assert {(r.gateway_id, r.event_id, round(r.sprt_statistic, 6)) for r in got} == loop_gateway(rows)
    assert got and "(normal=1.0%, attack=15.0%)" in got[0].message and "%" in got[0].message.split(" exceeds")[0]
    assert DEFAULTS.sprt_p0 == 0.01


def test_gateway_rounds_move_no_rows(spark):
    rows = [(f"g{i % 2}", i, i * 20 * SECOND, 1, i % 3 * 4) for i in range(600)]
    df = spark.createDataFrame(rows, "gateway_id string, event_id long, ts_us long, forwarded long, dropped long")
    plan = gateway.gateway_alerts(df, chunk_rows=10)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("BroadcastExchange" in line for line in exchanges)
    got = gateway.gateway_alerts(df, chunk_rows=10).collect()
    assert {(r.gateway_id, r.event_id, round(r.sprt_statistic, 6)) for r in got} == loop_gateway(rows) and got


def test_protocol_slices_are_worked_on_in_bounded_runs():
    import numpy as np

    lengths = np.array([3, 0, 4, 9, 1, 1, 5], np.int64)
    assert list(protocol.bounded(lengths, 7)) == [(0, 3), (3, 4), (4, 7)]
    assert list(protocol.bounded(lengths[:0], 7)) == [(0, 0)]
