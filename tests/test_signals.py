"""Routing, profiling, voting and fusion on small hand-made inputs."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SECOND
from watchline.config import DEFAULTS
from watchline.operators import alerts, fusion, profiler, routing, votes
from watchline.plans.queries import QUERIES


def test_wormhole_needs_the_reverse_claim_first(spark):
    rows = [("a", 0, 0, "rpl_parent=b"), ("b", 1, 1, "rpl_parent=A"), ("a", 2, 2, "x rpl_parent=b y"), ("c", 3, 3, "rpl_parent=c"),
            ("d", 4, 4, "rpl_parent=a")]
    df = spark.createDataFrame(rows, "source_ip string, event_id long, ts_us long, message string")
    assert {r.event_id for r in routing.wormhole_claims(df).collect()} == {1, 2, 3}


def test_forward_count_sets_then_counts_on(spark):
    rows = [("a", 0, 0, "x"), ("a", 1, 1, "fwd_count=7"), ("a", 2, 2, "y"), ("a", 3, 3, "z"),
            ("a", 4, 61 * SECOND, "x"), ("a", 5, 62 * SECOND, "y"), ("a", 6, 63 * SECOND, "fwd_count=0")]
    df = spark.createDataFrame(rows, "source_ip string, event_id long, ts_us long, message string")
    got = {r.tick: r.packet_count for r in routing.forward_ticks(df, 60 * SECOND).collect()}
    assert got == {0: 9, 1: 0}


def slope(ys):
    n = len(ys)
    if n < 2:
        return 0.0
    mx, my = (n - 1) / 2, sum(ys) / n
    return sum((i - mx) * (y - my) for i, y in enumerate(ys)) / sum((i - mx) ** 2 for i in range(n))


def test_profiler_and_blackhole_match_loops(spark):
    rng = random.Random(5)
    rows = [(f"n{n}", t, rng.randrange(0, 6 + 30 * (n == 3))) for n in range(6) for t in range(90)]
    df = spark.createDataFrame(rows, "node string, tick long, packet_count long")
    anomalies, states, holes = set(), {}, set()
    for n in range(6):
        counts, last, total, slopes = [], 0.0, 0.0, []
        for t, c in [(t, c) for k, t, c in rows if k == f"n{n}"]:
            past = counts[-60:]
            if len(past) >= 5:
                mean = sum(past) / len(past)
                std = (sum((x - mean) ** 2 for x in past) / (len(past) - 1)) ** 0.5
                if std > 0 and c < mean - 1.2 * std:
                    holes.add((f"n{n}", t))
            counts.append(c)
            if len(counts) < 6:
                continue
            s = slope(counts[-60:])
            slopes.append(s)
            if len(slopes) > 1:
                total += abs(s - last)
            last = s
            if total >= 1.0:
                anomalies.add((f"n{n}", t))
            else:
                total *= 0.8
        states[f"n{n}"] = (round(total, 4), round(last, 4), min(len(counts), 60), [round(x, 4) for x in slopes[-10:]])
    cfg = replace(DEFAULTS, amof_threshold=1.0, blackhole_sigma=1.2)
    assert {(r.node, r.tick) for r in profiler.amof(df, "node", cfg).collect()} == anomalies and anomalies
    for r in profiler.amof_state(df, "node", cfg).collect():
        a, s, n, hist = states[r.node]
        assert (r.accumulated_fluctuation, r.last_slope) == pytest.approx((a, s), abs=1e-4)
        assert r.count_history_len == n and list(r.slope_history) == pytest.approx(hist, abs=1e-4)
    assert {(r.node, r.tick) for r in routing.blackhole(df, "node", cfg).collect()} == holes and holes


def test_consensus_and_threats(spark):
    rows = [(i, ip, s, label, conf, ts * SECOND) for i, (ip, s, label, conf, ts) in enumerate([
        ("a", "s1", "malicious", 0.9, 1000), ("a", "s2", "suspicious", 0.8, 1000), ("a", "s1", "suspicious", 0.8, 1001),
        ("b", "s1", "malicious", 0.74, 1000), ("b", "s2", "suspicious", 0.75, 1000), ("b", "s3", "benign", 0.99, 1000),
        ("c", "s1", "malicious", 0.9, 699), ("c", "s2", "suspicious", 0.9, 1000),
        ("d", "s1", "malicious", 0.9, 700), ("d", "s2", "malicious", 0.9, 1000)])]
    df = spark.createDataFrame(rows, "event_id long, source_ip string, sniffer_id string, predicted_label string, confidence double, ts_us long")
    now = 1000 * SECOND
    got = {r.source_ip: (r.verdict, r.sniffer_count, r.cci_count, r.latest_ts_us // SECOND)
           for r in votes.active_threats(df, now=F.lit(now)).collect()}
    assert got == {"a": ("suspicious", 2, 3, 1001), "b": ("suspicious", 1, 1, 1000), "c": ("suspicious", 2, 1, 1000),
                   "d": ("malicious", 2, 2, 1000)}
    known = df.select("sniffer_id")
    strict = {r.source_ip: r.verdict for r in votes.consensus(votes.sniffer_votes(df, F.lit(now)), known).collect()}
    assert strict == {"a": "suspicious", "b": None, "c": None, "d": "malicious"}


def test_active_threats_can_be_written(spark, tmp_path):
    rows = [(i, 1_704_067_200 + i, i % 3, "error", 1.0, '{"k": 12}') for i in range(25, 50)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "cast(timestamp_seconds(s) as timestamp_ntz) as ts", "user_id * 5 as user_id", "event_type", "value", "props").write.parquet(
        str(tmp_path / "events.parquet"))
    QUERIES["active_threats"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    got = {r.source_ip: (r.verdict, r.sniffer_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {f"10.0.0.{u}": ("suspicious", 1) for u in (0, 5, 10)}


def test_vote_depth(spark):
    rows = [(i, "a", "s", "malicious" if i == 0 else "suspicious", 0.9, i * SECOND) for i in range(51)]
    df = spark.createDataFrame(rows, "event_id long, source_ip string, sniffer_id string, predicted_label string, confidence double, ts_us long")
    vote, = votes.sniffer_votes(df).collect()
    assert vote.vote == "malicious"
    vote, = votes.sniffer_votes(df, cfg=replace(DEFAULTS, vote_depth=50)).collect()
    assert vote.vote == "suspicious"


def test_fusion(spark):
    det = [(i, ts * SECOND, "1.2.3.4", "h", label, sev, 0.9) for i, (ts, label, sev) in enumerate([
        (100, "malicious", "high"), (130, "suspicious", "high"), (131, "suspicious", "medium"), (99, "malicious", "critical"),
        (110, "benign", "low"), (400, "suspicious", "medium"), (500, "malicious", "critical")])]
    df = spark.createDataFrame(det, "event_id long, ts_us long, source_ip string, hostname string, predicted_label string, severity string, confidence double")
    motion = spark.createDataFrame([(0, 100 * SECOND), (1, 100 * SECOND)], "event_id long, ts_us long")
    fused = fusion.fuse(df, motion).cache()
    got = {r.event_id: (r.effective_severity, r.physical_motion_detected, r.camera_recording_started, r.gsm_alert_sent)
           for r in fused.collect()}
    assert got == {0: ("critical", True, True, True), 1: ("critical", True, True, True), 2: ("medium", False, False, False),
                   3: ("critical", False, True, False), 4: ("low", False, False, False), 5: ("medium", False, False, False),
                   6: ("critical", False, True, False)}
    assert {r.sms for r in fusion.notices(fused).filter("event_id = 0").collect()} == {
        "[IDS CRITICAL] MALICIOUS from 1.2.3.4 on h. Physical motion also detected. Conf=0.90"}
    sessions = sorted((r.start_us // SECOND, r.end_us // SECOND, r.starts) for r in fusion.recording_sessions(fused).collect())
    assert sessions == [(99, 430, 3), (500, 800, 1)]


def test_sessions_merge_at_exactly_the_gap(spark):
    rows = [(i, ts * SECOND, True) for i, ts in enumerate([0, 300, 601, 850, 1150, 1451])]
    df = spark.createDataFrame(rows, "event_id long, ts_us long, camera_recording_started boolean")
    got = sorted((r.start_us // SECOND, r.end_us // SECOND) for r in fusion.recording_sessions(df).collect())
    assert got == [(0, 600), (601, 1450), (1451, 1751)]


def test_eviction(spark):
    df = spark.createDataFrame([("a", 0), ("a", 500), ("b", 100)], "source_ip string, sec long").withColumn("ts_us", F.col("sec") * SECOND)
    assert {r.source_ip for r in alerts.evict_idle(df, "source_ip", "ts_us", 1100 * SECOND, 600.0).collect()} == {"a"}
    assert alerts.evict_idle(df, "source_ip", "ts_us", 1101 * SECOND, 600.0).count() == 0


def test_alerts_page_limit(spark):
    df = spark.range(5).withColumnRenamed("id", "event_id")
    with pytest.raises(ValueError):
        alerts.alerts_page(df, limit=501)
    assert [r.event_id for r in alerts.alerts_page(df, limit=2, offset=1).collect()] == [3, 2]
