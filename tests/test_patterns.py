"""Sliding counts and event patterns against a per-key loop over the raw events."""

import random

from pyspark.sql import functions as F

from conftest import SECOND, random_keys
from watchline.config import micros
from watchline.operators import patterns as P
from watchline.operators.sliding import Sliding, sliding_counts

SCHEMA = "source_ip string, event_id long, ts_us long, hostname string, service string, message string"
MESSAGES = (
    [("ssh", "Failed password for root"), ("ssh", "authentication failure"), ("ssh", "Accepted password for bob"),
     ("web", "nothing to see"), ("udp", "bytes=12"), ("tcp", "payload=x"), ("ssh", "payload=x"), ("tcp", "dst_ip=abc")]
    + [("tcp", f"dst_ip=10.0.0.{i} dst_port={20 + i}") for i in range(7)])


def events(seed=3, keys=40, rows=90, span=240):
    rng = random.Random(seed)
    out = []
    for key, i, ts in random_keys(keys, rows, span, seed, boundaries=(5, 10, 30, 60, 120)):
        pool = MESSAGES if rng.random() < 0.7 else MESSAGES[:3]
        service, message = rng.choice(pool)
        out.append((key, i, ts, "h", service, message))
    return out


def grouped(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        groups.setdefault(r[0], []).append(r)
    return groups


def token(message, name):
    for part in message.split():
        if part.startswith(name + "="):
            return part[len(name) + 1:]
    return None


def failed(r):
    return "failed password" in r[5].lower() or "authentication failure" in r[5].lower()


def login(r):
    return "accepted password" in r[5].lower()


def count(group, now, window, pred, value=None):
    found = [r for r in group if 0 <= now - r[2] <= window * SECOND and pred(r)]
    return len(found) if value is None else len({value(r) for r in found})


def to_host(r):
    t = token(r[5], "dst_ip")
    return t is not None and t[0].isdigit()


RULES = {
    "brute_force": (lambda g, now: count(g, now, 60, failed), 5),
    "port_scan": (lambda g, now: count(g, now, 10, lambda r: token(r[5], "dst_port"), lambda r: token(r[5], "dst_port")), 5),
    "lateral_movement": (lambda g, now: count(g, now, 30, to_host, lambda r: token(r[5], "dst_ip")), 4),
    "login_after_scan": (lambda g, now: count(g, now, 120, login), 1),
    "data_exfil_burst": (lambda g, now: count(g, now, 5, lambda r: r[4] in ("tcp", "udp") and (
        "payload=" in r[5] or "bytes=" in r[5])), 20),
}


def loop_alerts(rows, rules=RULES):
    out = set()
    for key, group in grouped(rows).items():
        last = {}
        for r in group:
            now = r[2]
            for name, (n_of, least) in rules.items():
                if name in last and now - last[name] < 30 * SECOND:
                    continue
                if name == "login_after_scan" and not ("port_scan" in last and now - last["port_scan"] <= 120 * SECOND):
                    continue
                n = n_of(group, now)
                if n >= least:
                    last[name] = now
                    out.add((key, name, r[1], n))
    return out


def test_alerts_match_loop(spark):
    rows = events()
    got = P.PatternSet().alerts(spark.createDataFrame(rows, SCHEMA))
    want = loop_alerts(rows)
    assert {(r.source_ip, r.pattern_name, r.event_id, r.matched_count) for r in got.collect()} == want
    assert len({w[1] for w in want}) >= 4


def test_sliding_counts_small_buckets(spark):
    rows = events(seed=5, keys=20)
    m = F.col("message")
    from watchline.functions import text as X
    for bucket in (10, 60, 600):
        got = sliding_counts(spark.createDataFrame(rows, SCHEMA), {
            "fails": Sliding(X.is_failed_login(m), micros(10)),
            "hosts": Sliding(X.has_dst_ip(m), micros(10), X.dst_host(m))}, bucket_us=bucket * SECOND).collect()
        want = {}
        for _, group in grouped(rows).items():
            for r in group:
                want[r[1]] = (count(group, r[2], 10, failed), count(group, r[2], 10, to_host, lambda x: token(x[5], "dst_ip")))
        assert {r.event_id: (r.fails, r.hosts) for r in got} == want


def test_register_and_unregister(spark):
    rows = [("a", i, i * SECOND, "h", "web", "nmap scan") for i in range(4)]
    custom = P.Pattern("recon", F.col("message").contains("nmap"), 20.0, 3, "medium", "recon burst")
    found = P.PatternSet().register(custom)
    for name in list(found.names()):
        if name != "recon":
            found.unregister(name)
    assert found.names() == ["recon"]
    alert, = found.alerts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (alert.event_id, alert.matched_count, alert.severity, alert.window_seconds) == (2, 3, "medium", 20.0)


def test_custom_sequence_and_udf_candidate(spark):
    @F.udf("boolean")
    def odd(message):
        return message.endswith("1")

    rows = [("a", 0, 0, "h", "web", "x1"), ("a", 1, SECOND, "h", "web", "y"), ("b", 2, 0, "h", "web", "y")]
    first = P.Pattern("first", odd(F.col("message")), 10.0, 1)
    then = P.Pattern("then", F.col("message") == "y", 10.0, 1, requires=("first",))
    got = P.PatternSet([first, then]).alerts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.source_ip, r.pattern_name, r.event_id) for r in got} == {("a", "first", 0), ("a", "then", 1)}


def test_strict_order_against_a_loop(spark):
    """Three steps in order, each after the one before and all inside the window, on random alerts with ties."""
    rng = random.Random(11)
    rows = [(f"s{rng.randrange(6)}", i, rng.randrange(0, 400) * SECOND, "h", "web", rng.choice("abcxyz")) for i in range(700)]
    m = F.col("message")
    steps = [P.Pattern(n, m == n, 5.0, 1) for n in "abc"]
    last = P.Pattern("last", m == "x", 60.0, 1, requires=("a", "b", "c"), strict_order=True)
    free = P.Pattern("free", m == "x", 60.0, 1, requires=("a", "b", "c"))
    got = P.PatternSet([*steps, last, free]).alerts(spark.createDataFrame(rows, SCHEMA)).collect()
    fired = {(r.source_ip, r.pattern_name): [] for r in got}
    for r in got:
        fired[r.source_ip, r.pattern_name].append(r.ts_us)
    want = set()
    for source in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == source), key=lambda r: (r[2], r[1]))
        until = None
        for r in mine:
            now, width = r[2], 60 * SECOND
            a, b, c = (fired.get((source, n), []) for n in "abc")
            chain = any(x < y < z < now and now - x <= width for x in a for y in b for z in c)
            recent = any(q[5] == "x" and now - width <= q[2] <= now for q in mine)
            if chain and recent and (until is None or now >= until):
                want.add((source, r[1]))
                until = now + 30 * SECOND
    assert {(r.source_ip, r.event_id) for r in got if r.pattern_name == "last"} == want and want
    assert sum(r.pattern_name == "free" for r in got) > len(want)


def test_recent_matches_keeps_last_ten(spark):
    rows = [("a", i, i * SECOND, "h", "ssh", "Failed password for root") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    brute = P.builtin_patterns()[0]
    got = {r.alert_id: [m.event_id for m in r.matched_events]
           for r in P.recent_matches(df, P.PatternSet([brute]).alerts(df), brute).collect()}
    assert got == {4: [0, 1, 2, 3, 4], 34: list(range(25, 35))}
