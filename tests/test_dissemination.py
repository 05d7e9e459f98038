"""Trust with neighbours against one loop over all events, and connected components."""

import random

import pytest

from watchline.config import DEFAULTS
from watchline.operators import dissemination, graph


def loop(events, edges, weight):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = {ip: DEFAULTS.trust_initial for ip in near}
    path = {}
    for ts, event_id, ip, label in sorted(events):
        move = {"malicious": DEFAULTS.trust_malicious, "suspicious": DEFAULTS.trust_suspicious}.get(label, DEFAULTS.trust_benign)
        x = min(1.0, max(0.0, score.get(ip, DEFAULTS.trust_initial) + move))
        score[ip] = path[event_id] = x
        if x < DEFAULTS.trust_initial:
            for n in near.get(ip, ()):
                score[n] = max(0.0, score[n] - (DEFAULTS.trust_initial - x) * weight(ip, n))
    return score, path


@pytest.mark.parametrize("strategy,each,benign", [("nbtd", 7, 0.8), ("cntd", 40, 0.97), ("nbtd", 10**6, 0.95), ("cntd", 15, 0.5)])
def test_scores_are_those_of_one_loop(spark, strategy, each, benign):
    """A star, a chain, a ring, two loose nodes and an edge without events, with ties and a hot hub."""
    rng = random.Random(each)
    ips = [f"n{i:02d}" for i in range(24)]
    edges = [("n00", f"n{i:02d}") for i in range(1, 8)] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(8, 13)]
    edges += [("n14", "n15"), ("n15", "n16"), ("n16", "n14"), ("x1", "x2"), ("n00", "n01")]
    clusters = {ip: rng.choice(["c1", "c2", ""]) for ip in ips if rng.random() < 0.9}
    events = []
    for i in range(900):
        ip = "n00" if rng.random() < 0.3 else rng.choice(ips)
        label = "benign" if rng.random() < benign else rng.choice(["malicious", "suspicious"])
        events.append((rng.randrange(0, 120) * 1_000_000, i, ip, label))

    def weight(a, b):
        if strategy == "nbtd":
            return DEFAULTS.trust_neighbour_weight
        same = clusters.get(a) and clusters.get(a) == clusters.get(b)
        return DEFAULTS.trust_cluster_weight if same else DEFAULTS.trust_outside_weight

    score, path = loop(events, edges, weight)
    df = spark.createDataFrame(events, "ts_us long, event_id long, source_ip string, predicted_label string").repartition(3)
    links = spark.createDataFrame(edges, "src string, dst string")
    groups = spark.createDataFrame(list(clusters.items()), "ip string, cluster_id string")
    how = dict(strategy=strategy, clusters=groups, events_each=each, slice_us=2_000_000)
    assert {r.ip: r.score for r in dissemination.trust_with_neighbours(df, links, **how).collect()} == score
    got = dissemination.trust_path_with_neighbours(df, links, **how).collect()
    assert {r.event_id: r.score for r in got} == path and len(got) == len(events)


@pytest.mark.parametrize("logged,strategy", [(0, "nbtd"), (2, "cntd"), (4, "nbtd")])
def test_a_dense_slice_is_cut_and_hubs_log_their_pushes(spark, monkeypatch, logged, strategy):
    """All events in one time slice, three hubs that share neighbours, a node that is its own neighbour."""
    monkeypatch.setattr(dissemination, "LOGGED", logged)
    rng = random.Random(logged)
    edges = [(f"h{h}", f"n{i:02d}") for h in range(3) for i in range(h, 20, h + 1)] + [("h0", "h1"), ("n00", "n00"), ("h2", "h2")]
    events = []
    for i in range(1200):
        ip = rng.choice(["h0", "h1", "h2"]) if rng.random() < 0.3 else f"n{rng.randrange(20):02d}"
        events.append((rng.randrange(500), i, ip, rng.choices(["benign", "suspicious", "malicious"], [0.96, 0.03, 0.01])[0]))
    weight = DEFAULTS.trust_neighbour_weight if strategy == "nbtd" else DEFAULTS.trust_outside_weight
    score, path = loop(events, edges, lambda a, b: weight)
    df = spark.createDataFrame(events, "ts_us long, event_id long, source_ip string, predicted_label string")
    links = spark.createDataFrame(edges, "src string, dst string")
    how = dict(strategy=strategy, events_each=100, slice_us=1_000_000)
    assert {r.ip: r.score for r in dissemination.trust_with_neighbours(df, links, **how).collect()} == score
    got = dissemination.trust_path_with_neighbours(df, links, **how).collect()
    assert {r.event_id: r.score for r in got} == path and len(got) == len(events)
    cut = dissemination._stretches(df.selectExpr("'r' as root", "ts_us", "event_id"), 100, 1_000_000)
    assert cut.groupBy("stretch").count().agg({"count": "max"}).first()[0] < 250


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(40)] + [("z", "z")]
    edges += [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    rng.shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert graph.components(spark.createDataFrame([], "src string, dst string")).count() == 0
