"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULTS, micros
from ..functions import text as X, verdicts as V
from ..operators import alerts as A, cooldown, detect, patterns as P, sliding
from .views import table, view

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def scored(spark, d):
    """The detections view with a boolean allowlist column."""
    return view(spark, d, "detections").withColumn("allowlisted", F.col("allowlisted") == 1)


def joined(col):
    return F.array_join(col, ",")


# ---- text, labels, severity -------------------------------------------------------------------

@query
def alert_severity_counts(spark, d):
    det = detect.with_severity(detect.with_flags(scored(spark, d)))
    return A.alert_counts(det)


@query
def rule_flags(spark, d):
    ev = detect.with_flags(view(spark, d, "log_events"))
    return ev.select("event_id", joined("rule_flags").alias("flags"))


@query
def event_text(spark, d):
    ev = detect.with_flags(view(spark, d, "log_events"))
    return ev.select("event_id", X.event_text(*[F.col(c) for c in (
        "service", "hostname", "source_ip", "message", "rule_flags")]).alias("text"))


@query
def extract_fields(spark, d):
    m = F.col("message")
    return view(spark, d, "log_events").select(
        "event_id", X.dst_port(m).alias("dst_port"), X.dst_host(m).alias("dst_host"),
        X.rpl_parent(m).alias("rpl_parent"), X.forward_count(m).alias("fwd_count"))


@query
def pattern_predicates(spark, d):
    m = F.col("message")
    return view(spark, d, "log_events").select(
        "event_id", X.is_failed_login(m).alias("failed_login"), X.is_successful_login(m).alias("login"),
        X.has_dst_port(m).alias("to_port"), X.has_dst_ip(m).alias("to_host"),
        X.is_high_volume(F.col("service"), m).alias("high_volume"))


@query
def allowlisted(spark, d):
    ev = detect.mark_allowlisted(view(spark, d, "log_events"))
    return ev.filter("allowlisted").select("event_id", "source_ip")


@query
def normalize_label(spark, d):
    return view(spark, d, "raw_labels").select("event_id", V.normalize_label(F.col("raw_label")).alias("label"))


@query
def escalated_severity(spark, d):
    det = detect.with_severity(detect.with_flags(scored(spark, d)))
    return det.groupBy("severity", V.escalate(F.col("severity")).alias("escalated")).agg(F.count(F.lit(1)).alias("n"))


@query
def explanations(spark, d):
    det = detect.with_flags(scored(spark, d))
    return det.select("event_id", V.explanation(
        F.col("predicted_label"), F.col("confidence"), F.col("rule_flags"), F.col("allowlisted")).alias("explanation"))


# ---- detection pipeline and alert table -------------------------------------------------------

@query
def dedup_anchors(spark, d):
    return detect.dedup_anchors(scored(spark, d).filter("not allowlisted")).select("event_id", "ts_us")


@query
def predict_events(spark, d):
    det = detect.detect(scored(spark, d))
    return det.select("event_id", "predicted_label", "severity", joined("rule_flags").alias("flags"),
                      "deduplicated", "explanation")


def _alerts(spark, d):
    det = A.storable(detect.detect(scored(spark, d)))
    return det.withColumn("honeypot_sent", F.col("predicted_label").isin(*DEFAULTS.forward_labels))


@query
def stored_alerts(spark, d):
    return _alerts(spark, d).select("event_id", "severity", "honeypot_sent")


@query
def alert_stats(spark, d):
    return A.alert_stats(_alerts(spark, d))


@query
def forwardable(spark, d):
    return A.forwardable(scored(spark, d)).select("event_id", "source_ip", "honeypot_sent")


@query
def alerts_page(spark, d):
    det = detect.with_severity(detect.with_flags(scored(spark, d)))
    page = A.alerts_page(det.filter("predicted_label <> 'benign'"), limit=50, offset=10)
    return page.select("event_id", "source_ip", "predicted_label", "severity")


@query
def alerts_page_filtered(spark, d):
    det = detect.with_severity(detect.with_flags(scored(spark, d)))
    page = A.alerts_page(det, limit=20, label="malicious", severity="critical")
    return page.select("event_id", "source_ip", "predicted_label", "severity")


# ---- sliding windows and patterns -------------------------------------------------------------

@query
def sliding_counts(spark, d):
    m = F.col("message")
    out = sliding.sliding_counts(view(spark, d, "log_events"), {
        "failed_60s": sliding.Sliding(X.is_failed_login(m), micros(60)),
        "ports_10s": sliding.Sliding(X.has_dst_port(m), micros(10), X.dst_port(m)),
        "hosts_30s": sliding.Sliding(X.has_dst_ip(m), micros(30), X.dst_host(m))})
    return out.drop("ts_us")


@query
def event_rate(spark, d):
    out = sliding.rate_per_second(view(spark, d, "log_events"), micros(5))
    return out.select("event_id", F.round("rate", 6).alias("rate"))


def _pattern_alerts(spark, d, name):
    wanted = [p for p in P.builtin_patterns() if p.name == name or (
        name == "login_after_scan" and p.name == "port_scan")]
    found = P.PatternSet(wanted).alerts(view(spark, d, "log_events"))
    return found.filter(F.col("pattern_name") == name).select("source_ip", "event_id", "ts_us", "matched_count")


def _register_pattern(query_name, pattern_name):
    QUERIES[query_name] = lambda spark, d: _pattern_alerts(spark, d, pattern_name)


_register_pattern("cep_brute_force", "brute_force")
_register_pattern("cep_port_scan", "port_scan")
_register_pattern("cep_lateral", "lateral_movement")
_register_pattern("cep_login_after_scan", "login_after_scan")
_register_pattern("cep_exfil", "data_exfil_burst")


@query
def cep_all_patterns(spark, d):
    found = P.PatternSet().alerts(view(spark, d, "log_events"))
    return found.groupBy("pattern_name", "severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.countDistinct("source_ip").alias("sources"),
        F.max("matched_count").alias("largest"))


def recon_burst():
    cond = F.array_contains(X.rule_flags(F.col("message")), "recon_tool")
    return P.Pattern("recon_burst", cond, 20.0, 3, "medium", "3+ recon tool messages within 20 seconds")


@query
def custom_pattern(spark, d):
    found = P.PatternSet([]).register(recon_burst()).alerts(view(spark, d, "log_events"))
    return found.select("source_ip", "event_id", "matched_count", "severity", "description")


@query
def strict_sequence(spark, d):
    """Logins after a port scan and then lateral movement, in this order, within five minutes."""
    scan, move = (p for p in P.builtin_patterns() if p.name in ("port_scan", "lateral_movement"))
    taken = P.Pattern("takeover", X.is_successful_login(F.col("message")), 300.0, 1, "critical",
                      requires=("port_scan", "lateral_movement"), strict_order=True)
    found = P.PatternSet([scan, move, taken]).alerts(view(spark, d, "log_events"))
    return found.filter("pattern_name = 'takeover'").select("source_ip", "event_id", "ts_us", "matched_count")


@query
def recent_matches(spark, d):
    ev = view(spark, d, "log_events")
    brute = P.builtin_patterns()[0]
    out = P.recent_matches(ev, P.PatternSet([brute]).alerts(ev), brute)
    return out.select("alert_id", F.size("matched_events").alias("n"),
                      F.array_join(F.transform("matched_events.event_id", lambda x: x.cast("string")), ",").alias("ids"))


@query
def pattern_window_stats(spark, d):
    ev = view(spark, d, "log_events")
    pair = [p for p in P.builtin_patterns() if p.name in ("brute_force", "port_scan")]
    out = P.pattern_window_stats(ev, P.PatternSet(pair).alerts(ev))
    return out.select("source_ip", F.col("buffered_events").cast("long").alias("buffered_events"),
                      F.element_at("fired_patterns", "brute_force").alias("brute_force"),
                      F.element_at("fired_patterns", "port_scan").alias("port_scan"))


@query
def dos_flood(spark, d):
    out = cooldown.flood(view(spark, d, "log_events"), cfg=replace(DEFAULTS, flood_rate=1.6))
    return out.select("source_ip", "event_id", "flag")


# ---- routing, profiling, gateways -------------------------------------------------------------

from ..operators import (balance, catalog, classify, dissemination, fusion, gateway, hybrid, immune, metrics,  # noqa: E402
                         online, profiler, protocol, routing, trust, votes)
from ..sources import csv as csv_sources, events as event_sources  # noqa: E402
from ..storage import new_folder, written  # noqa: E402


@query
def label_distribution(spark, d):
    return catalog.label_distribution(view(spark, d, "raw_labels"), F.col("raw_label"))


@query
def wormhole_pairs(spark, d):
    return routing.wormhole_claims(view(spark, d, "log_events")).select("source_ip", "parent", "event_id")


@query
def forward_ticks(spark, d):
    return routing.forward_ticks(view(spark, d, "log_events"), micros(60))


@query
def rolling_baseline(spark, d):
    out = routing.rolling_baseline(view(spark, d, "node_ticks"), "node")
    return out.select("node", "tick", "points", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def blackhole(spark, d):
    out = routing.blackhole(view(spark, d, "node_ticks"), "node", replace(DEFAULTS, blackhole_sigma=1.0))
    return out.select("node", "tick", "packet_count", F.round("threshold", 6).alias("threshold"))


@query
def amof_slopes(spark, d):
    out = profiler.slopes(view(spark, d, "node_ticks"), "node")
    return out.select("node", "tick", (F.round("slope", 6) + 0.0).alias("slope"),
                      F.round("fluctuation", 6).alias("fluctuation"))


AMOF = replace(DEFAULTS, amof_threshold=0.25)


@query
def amof(spark, d):
    out = profiler.amof(view(spark, d, "node_ticks"), "node", AMOF)
    return out.select("node", "tick", "first_anomalous_tick")


@query
def amof_state(spark, d):
    out = profiler.amof_state(view(spark, d, "node_ticks"), "node", AMOF)
    return out.select("node", "accumulated_fluctuation", (F.col("last_slope") + 0.0).alias("last_slope"),
                      F.col("count_history_len").cast("long").alias("count_history_len"),
                      F.size("slope_history").cast("long").alias("slopes"))


@query
def gateway_sprt(spark, d):
    out = gateway.gateway_alerts(view(spark, d, "gateway_obs"), chunk_rows=2_000)
    return out.select("gateway_id", "event_id", F.round("sprt_statistic", 6).alias("sprt_statistic"),
                      F.round("estimated_pdp", 6).alias("estimated_pdp"),
                      F.col("observation_count").cast("long").alias("observation_count"))


@query
def gateway_status(spark, d):
    return gateway.gateway_status(view(spark, d, "gateway_obs"))


# ---- trust and protocols ----------------------------------------------------------------------

def _user_ips(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id")
    return view(spark, d, "log_events").select("event_id", "source_ip").join(ev, "event_id").select(
        "user_id", "source_ip").distinct()


def _edges(spark, d):
    users = _user_ips(spark, d)
    other = users.select((F.col("user_id").bitwiseXOR(F.lit(1))).alias("user_id"), F.col("source_ip").alias("dst"))
    pairs = users.join(other, "user_id").select(F.col("source_ip").alias("src"), "dst").filter("src <> dst")
    return trust.both_ways(pairs)


def _clusters(spark, d):
    return _user_ips(spark, d).groupBy(F.col("source_ip").alias("ip")).agg(
        F.concat(F.lit("c"), (F.min("user_id") % 5).cast("string")).alias("cluster_id"))


@query
def trust_scores(spark, d):
    return trust.trust_scores(view(spark, d, "detections")).withColumn("score", F.round("score", 6))


@query
def trust_path(spark, d):
    out = trust.trust_path(view(spark, d, "detections"))
    return out.select("source_ip", "event_id", F.round("score", 6).alias("score"))


def _nodes(spark, d):
    scores = trust.trust_scores(view(spark, d, "detections")).withColumnRenamed("source_ip", "ip")
    return scores.join(_clusters(spark, d), "ip")


@query
def trust_round(spark, d):
    out = trust.disseminate(_nodes(spark, d), _edges(spark, d))
    return out.select("ip", F.round("score", 6).alias("score"))


@query
def trust_cluster_round(spark, d):
    out = trust.disseminate(_nodes(spark, d), _edges(spark, d), "cntd")
    return out.select("ip", F.round("score", 6).alias("score"))


@query
def trust_rounds(spark, d):
    """Direct updates and dissemination in five-minute rounds."""
    out = trust.trust_rounds(view(spark, d, "detections"), _edges(spark, d), micros(300), "cntd", clusters=_clusters(spark, d))
    return out.select("ip", F.round("score", 6).alias("score"))


@query
def trust_neighbours(spark, d):
    """Every event pushes at once; scores after the last one."""
    out = dissemination.trust_with_neighbours(view(spark, d, "detections"), _edges(spark, d))
    return out.select("ip", F.round("score", 6).alias("score"))


@query
def trust_neighbours_path(spark, d):
    """Every event pushes at once, more inside a cluster; the score of its source after each event."""
    out = dissemination.trust_path_with_neighbours(view(spark, d, "detections"), _edges(spark, d), "cntd", _clusters(spark, d))
    return out.select("source_ip", "event_id", F.round("score", 6).alias("score"))


@query
def severity_multiplier(spark, d):
    det = view(spark, d, "detections")
    out = trust.severity_multipliers(det, trust.trust_scores(det))
    return out.select("event_id", "multiplier")


@query
def trust_snapshot(spark, d):
    clusters = _clusters(spark, d)
    return trust.trust_snapshot(view(spark, d, "detections"), clusters)


@query
def live_trust_records(spark, d):
    det = view(spark, d, "detections")
    now = 1720000800000000 + micros(5118.5)
    return trust.live_records(det, now).select("source_ip", "score")


@query
def protocol_violations(spark, d):
    out = protocol.protocol_violations(view(spark, d, "protocol_messages"))
    return out.select("source_ip", "protocol", "event_id", "from_state", "to_state", "message")


# ---- votes and fusion -------------------------------------------------------------------------

@query
def sniffer_votes(spark, d):
    return votes.sniffer_votes(view(spark, d, "detections"))


@query
def sniffer_consensus(spark, d):
    return votes.consensus(votes.sniffer_votes(view(spark, d, "detections")))


@query
def registered_consensus(spark, d):
    det = view(spark, d, "detections")
    return votes.consensus(votes.sniffer_votes(det), det.select("sniffer_id")).drop("malicious_votes", "suspicious_votes")


@query
def active_threats(spark, d):
    return votes.active_threats(view(spark, d, "detections"))


def _fused(spark, d):
    det = detect.with_severity(detect.with_flags(scored(spark, d)))
    return fusion.fuse(det, view(spark, d, "motion"))


@query
def motion_fusion(spark, d):
    return _fused(spark, d).select(
        "event_id", "motion_ts_us", "physical_motion_detected", "effective_severity", "camera_recording_started",
        "gsm_alert_sent", joined("extra_flags").alias("extra_flags"))


@query
def motion_notices(spark, d):
    return fusion.notices(_fused(spark, d))


@query
def recording_sessions(spark, d):
    return fusion.recording_sessions(_fused(spark, d), replace(DEFAULTS, recording_gap_s=120.0))


# ---- learned signatures -----------------------------------------------------------------------

DIM = 64


def _bits(spark, d, attack):
    kind = F.col("label") >= 5 if attack else F.col("label") < 5
    return table(spark, d, "embeddings").filter(kind).select(
        "vec_id", "label", immune.vector_bits(F.col("embedding")).alias("bits"))


def _detectors(spark, d):
    return _bits(spark, d, True).select(F.col("vec_id").cast("string").alias("detector_id"), "label", "bits")


def _antigens(spark, d, attack):
    return _bits(spark, d, attack).select(F.col("vec_id").alias("antigen_id"), "bits")


@query
def antigen_bits(spark, d):
    text = immune.antigen_text(*[F.col(c) for c in ("service", "hostname", "source_ip", "message")])
    bits = immune.antigen_bits(text)
    return view(spark, d, "log_events").select("event_id", F.size(bits).alias("set_bits"),
                                               F.array_join(bits.cast("array<string>"), ",").alias("bits"))


@query
def immune_screen(spark, d):
    out = immune.immune_screen(_antigens(spark, d, False), _detectors(spark, d), DIM, 0.65)
    return out.select("antigen_id", "detector_id", F.round("affinity", 6).alias("affinity"))


@query
def immune_screen_events(spark, d):
    """Signatures learned from the malicious messages, matched against every event."""
    text = immune.antigen_text(*[F.col(c) for c in ("service", "hostname", "source_ip", "message")])
    ev = view(spark, d, "detections").select("event_id", "predicted_label", text.alias("text"))
    # Words are taken and hashed once for each distinct text, after the shuffle that finds them. Written, so that the sets are
    # made once and no filter on them moves before that shuffle, where it would hash the words of every event.
    texts = ev.groupBy("text").agg(F.bool_or(F.col("predicted_label") == "malicious").alias("bad"))
    sets = written(texts.select(F.col("text").alias("antigen_id"), "bad", immune.antigen_bits(F.col("text"), 512).alias("bits")), "sets")
    learned = sets.filter("bad").select("bits").distinct().select(F.lit("learned").alias("detector_id"), "bits")
    totals = immune.immune_totals(sets.select("antigen_id", "bits"), learned, 512)
    out = ev.join(totals, F.col("text") == F.col("antigen_id")).select(
        F.col("event_id").alias("antigen_id"), "matches", "best")
    return rounded(out, "best")


def _survivors(spark, d):
    return immune.negative_selection(_detectors(spark, d), _antigens(spark, d, False), DIM, 0.75)


@query
def negative_selection(spark, d):
    return _survivors(spark, d).select("detector_id", "label")


def _memory(spark, d):
    hits = immune.immune_screen(_antigens(spark, d, True), _detectors(spark, d), DIM, 0.75, lowest=DEFAULTS.clone_threshold)
    return immune.promote(hits, _detectors(spark, d), _antigens(spark, d, True))


@query
def immune_promotion(spark, d):
    return _memory(spark, d)


@query
def immune_stats(spark, d):
    return immune.immune_stats(_antigens(spark, d, False), _detectors(spark, d), _memory(spark, d))


def _generated(spark, d):
    seeds = _bits(spark, d, True).select(F.col("vec_id").alias("seed_id"), "label", "bits")
    return immune.generate_detectors(seeds, 3, DIM, density=0.25)


@query
def detector_generation(spark, d):
    return _generated(spark, d).select("seed_id", "variant", "detector_id", F.size("bits").cast("long").alias("set_bits"))


@query
def learned_detectors(spark, d):
    kept = immune.negative_selection(_generated(spark, d), _antigens(spark, d, False), DIM, 0.75)
    return kept.select("seed_id", "variant", "detector_id")


# ---- evaluation -------------------------------------------------------------------------------

def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query
def confusion(spark, d):
    return metrics.confusion_matrix(view(spark, d, "eval_pairs")).select("y_true", "y_pred", "n")


@query
def class_metrics(spark, d):
    return rounded(metrics.class_metrics(view(spark, d, "eval_pairs")), "precision", "recall", "f1", "fpr", "fnr")


@query
def overall_metrics(spark, d):
    return rounded(metrics.overall_metrics(view(spark, d, "eval_pairs")), "accuracy", "macro_f1", "weighted_f1")


@query
def latency(spark, d):
    return rounded(metrics.latency_summary(table(spark, d, "events"), "value"), "mean_ms", "p95_ms", "p99_ms", "max_ms")


@query
def interaction(spark, d):
    out = metrics.interaction_ability(view(spark, d, "log_events"))
    return out.select("interaction_ability_score", F.array_join(F.col("layers_observed").cast("array<string>"), ",").alias("layers"))


# ---- class balance, hybrid model --------------------------------------------------------------

def _vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "benign").otherwise("malicious").alias("label"),
        F.col("label").cast("long").alias("group"), F.col("embedding").cast("array<double>").alias("vector"))


def _placed(spark, d):
    rows = _vectors(spark, d)
    centers = [(r.cluster, r.center) for r in hybrid.mean_centroids(rows, "group", "vector").orderBy("cluster").collect()]
    return hybrid.assign_clusters(rows, centers, "vector")


ZONES = replace(DEFAULTS, safe_zone_purity=0.55)


@query
def safe_zones(spark, d):
    out = hybrid.safe_zones(_placed(spark, d), cfg=ZONES)
    return rounded(out, "benign_fraction")


@query
def hybrid_stage1(spark, d):
    placed = _placed(spark, d)
    zones = [r.cluster for r in hybrid.safe_zones(placed, cfg=ZONES).select("cluster").collect()]
    out = hybrid.stage_one(placed, zones)
    return rounded(out.select("id", "cluster", "predicted_label", "confidence"), "confidence")


def _unbalanced(spark, d):
    return _vectors(spark, d).select("id", F.when(F.col("group") < 6, "benign").when(
        F.col("group") < 9, "suspicious").otherwise("malicious").alias("label"), "vector")


@query
def smote_plan(spark, d):
    return balance.oversample_plan(_unbalanced(spark, d))


@query
def nearest_same_class(spark, d):
    out = balance.knn_same_class(_unbalanced(spark, d), 3)
    return out.select("id", "neighbour_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query
def smote_rows(spark, d):
    out = balance.oversample(_unbalanced(spark, d))
    return out.select("label", "base_id", "neighbour_id", "copy", F.round("u", 6).alias("u"),
                      F.round(F.element_at("vector", 1), 6).alias("first"),
                      F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# ---- sources ----------------------------------------------------------------------------------

@query
def text_log_events(spark, d):
    lines = view(spark, d, "log_events").select("event_id", F.concat(F.lit("  "), "message", F.lit(" \t")).alias("value"))
    return event_sources.log_lines_to_events(lines).drop("timestamp")


def _packets(spark, d):
    m = F.col("message")
    return view(spark, d, "log_events").select(
        "event_id", F.col("timestamp").alias("ts"), F.col("source_ip").alias("src"), X.dst_host(m).alias("dst"),
        X.token(m, r"ip_proto=(\d+)").cast("int").alias("ip_proto"), F.col("service").alias("l4"),
        X.token(m, r"src_port=(\d+)").cast("int").alias("sport"), X.dst_port(m).cast("int").alias("dport"),
        X.token(m, r"tcp_flags=(\S+)").alias("tcp_flags"), F.concat(F.repeat(F.lit("filler "), 40), X.token(m, r"payload=(.+)")).cast("binary").alias("payload"))


@query
def packets_to_events(spark, d):
    out = event_sources.packets_to_events(_packets(spark, d))
    return out.select("event_id", "source_ip", "hostname", "service", "message")


@query
def ingest_events(spark, d):
    cols = ("timestamp", "source_ip", "hostname", "service", "message")
    sent = view(spark, d, "log_events").select("event_id", F.to_json(F.struct(*cols)).alias("value"))
    return rounded(event_sources.parse_ingest(sent), "timestamp")


@query
def paired_rows(spark, d):
    """Two column sets of one table, numbered apart and put together again by row position."""
    ev = table(spark, d, "events")
    left = csv_sources.with_row_index(ev, ["event_id", "event_type"])
    right = csv_sources.with_row_index(ev, ["user_id"])
    return csv_sources.pair_by_row_index(left, right)


def _csv_parts(spark, rows, folder, suffix):
    """One CSV file with header for each value of `part`, rows by event_id: folder/s<part><suffix>.csv."""
    made = new_folder(spark, "parts")
    (rows.repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part")
     .option("header", True).option("escape", '"').csv(made))
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fs = path(folder).getFileSystem(conf)
    fs.mkdirs(path(folder))
    for found in fs.globStatus(path(f"{made}/part=*/part-*.csv")):
        part = found.getPath().getParent().getName().split("=")[1]
        fs.rename(found.getPath(), path(f"{folder}/s{part}{suffix}.csv"))


def _csv_events(spark, d):
    """Labelled events whose messages hold newlines, quotes and commas, dealt to as many parts as shuffles have."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    message = F.concat("message", F.lit('\n"'), "hostname", F.lit('", '), "service")
    return view(spark, d, "detections").select(
        "event_id", "source_ip", "hostname", "service", message.alias("message"), F.col("predicted_label").alias("label"),
        F.pmod(F.hash("event_id"), F.lit(parts)).alias("part"))


@query
def labeled_csv(spark, d):
    """Events written as CSV files and read as training rows."""
    folder = new_folder(spark, "csv")
    _csv_parts(spark, _csv_events(spark, d), folder, "")
    return csv_sources.read_labeled_csv(spark, folder)


def _csv_pairs(spark, d, folder):
    rows = _csv_events(spark, d)
    _csv_parts(spark, rows.select("event_id", "part", F.col("event_id").alias("number"), "source_ip", F.col("message").alias("note")),
               folder, "_dataset")
    marks = F.when(F.col("label") == "benign", "0").otherwise("1").alias("x")
    _csv_parts(spark, rows.select("event_id", "part", F.col("event_id").alias("Unnamed: 0"), marks), folder, "_labels")


@query
def paired_csv(spark, d):
    """Feature files beside label files, put together by row over all files."""
    folder = new_folder(spark, "csv")
    _csv_pairs(spark, d, folder)
    return csv_sources.read_paired_csv(spark, f"{folder}/s*_dataset.csv", f"{folder}/s*_labels.csv")


@query
def training_sources(spark, d):
    """All sources of a folder: pairs, single files, a file without labels and one with a broken record."""
    folder = new_folder(spark, "csv")
    _csv_pairs(spark, d, f"{folder}/pairs")
    rows = _csv_events(spark, d)
    _csv_parts(spark, rows, f"{folder}/single", "")
    _csv_parts(spark, rows.drop("label"), f"{folder}/unlabelled", "")
    broken = rows.select("event_id", "part", F.concat("message", F.lit(",x\n,y,")).alias("message,label"))
    _csv_parts(spark, broken.where(F.col("part") == 0), f"{folder}/broken", "")
    out, skipped = csv_sources.read_training_sources(spark, folder)
    return out


@query
def live_sources(spark, d):
    ev = view(spark, d, "log_events")
    live = A.evict_idle(ev, "source_ip", "ts_us", 1720000800000000 + micros(1520), 1.5)
    return live.groupBy("source_ip").agg(F.count(F.lit(1)).alias("events"))


def _labelled(spark, d):
    marks = view(spark, d, "eval_pairs").select("doc_id", F.col("y_true").alias("label"))
    return table(spark, d, "documents").join(marks, "doc_id").select("text", "label", "source", "lang")


@query
def training_rows(spark, d):
    return csv_sources.normalize_training(_labelled(spark, d))


@query
def row_text(spark, d):
    rows = csv_sources.normalize_training(_labelled(spark, d))
    return rows.select("label", X.row_text(rows).alias("text"))


@query
def class_distribution(spark, d):
    return balance.class_distribution(csv_sources.normalize_training(_labelled(spark, d)))


@query
def dataset_profile(spark, d):
    marks = view(spark, d, "eval_pairs").select("doc_id", F.col("y_true").alias("label"))
    docs = table(spark, d, "documents").join(marks, "doc_id", "left")
    out = catalog.profile(docs, "source", "doc_id", F.col("label"), ["text", "lang", "n_chars"])
    dist = F.array_join(F.transform(F.map_entries("label_distribution"), lambda e: F.concat_ws(
        "=", e["key"], e["value"].cast("string"))), ",")
    return out.select("source", "rows", F.size("columns").cast("long").alias("n_columns"), dist.alias("labels"),
                      F.size("sample_rows").cast("long").alias("samples"),
                      F.get_json_object(F.element_at("sample_rows", 1), "$.text").alias("first_text"),
                      F.get_json_object(F.element_at("sample_rows", -1), "$.n_chars").alias("last_n_chars"))


# ---- models -----------------------------------------------------------------------------------

@query
def text_classifier(spark, d):
    rows = csv_sources.normalize_training(_labelled(spark, d))
    return rounded(classify.holdout_report(rows), "value")


@query
def online_classifier(spark, d):
    """Held-out scores of the classifier that learns in batches."""
    train, test = classify.holdout_split(csv_sources.normalize_training(_labelled(spark, d)))
    model = online.learn_in_batches(train, 4)
    pairs = online.predict(classify.training_text(test), model).select(
        F.col("label").alias("y_true"), F.col("predicted_label").alias("y_pred"))
    return rounded(metrics.model_report(pairs), "value")


def _event_training(spark, d):
    return view(spark, d, "detections").select("event_id", "source_ip", "hostname", "service", "message",
                                               F.col("predicted_label").alias("label"))


@query
def model_detections(spark, d):
    """Detection with a model trained on the labelled events."""
    model = classify.train_text_classifier(_event_training(spark, d))
    det = detect.detect_with_model(view(spark, d, "log_events"), model)
    return det.groupBy("predicted_label", "severity", "deduplicated").agg(F.count(F.lit(1)).alias("n"))


@query
def hybrid_model(spark, d):
    """Both stages with all hashed features and trees of full depth."""
    rows = _event_training(spark, d)
    out = hybrid.hybrid_predict(classify.training_text(rows), hybrid.hybrid_fit(rows))
    return out.groupBy("stage", "label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


@query
def hybrid_eval(spark, d):
    """Scores of the two-stage model on all rows held out of its fit."""
    train, test = classify.holdout_split(_event_training(spark, d))
    return rounded(hybrid.hybrid_eval(test, hybrid.hybrid_fit(train)), "value")


@query
def hybrid_oversampled(spark, d):
    """The same with the small classes filled up by synthetic rows before the fit."""
    train, test = classify.holdout_split(_event_training(spark, d))
    return rounded(hybrid.hybrid_eval(test, hybrid.hybrid_fit(train, oversampled=True)), "value")


# ---- streams: a table replayed as files in time order, and what the stream wrote ----------------

from ..sources import sinks  # noqa: E402
from ..streaming import alerting, folds, late, windows  # noqa: E402

END = "end-of-replay"


def replay(spark, rows, start, parts=3, closing=None):
    """Append the rows in `parts` stretches of time to a folder, and run the stream to its end after each.

    start(stream) starts the query; its checkpoint carries the state from one stretch to the next. `closing` makes one last
    row of any row, a day later, so that every window closes; its values mark it for removal.
    """
    folder = new_folder(spark, "replay")
    rows = written(rows, "replayed")  # made once, not for each stretch
    low, high = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    part = F.floor((F.col("ts_us") - F.lit(low)) * parts / F.lit(high - low + 1))
    stretches = [rows.filter(part == i) for i in range(parts)]
    if closing is not None:
        last = rows.limit(1).withColumn("ts_us", F.lit(high + micros(86400)))
        stretches.append(last.withColumns({c: F.lit(v).cast(rows.schema[c].dataType) for c, v in closing.items()}))
    for stretch in stretches:
        stretch.write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()
    return folder


def drained(spark, rows, build, **how):
    """Everything that the stream built over the replayed rows wrote."""
    out, schema = new_folder(spark, "stream"), []

    def start(stream):
        made = build(stream)
        schema[:] = [made.schema]
        return (made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/_checkpoint")
                .trigger(availableNow=True).start(f"{out}/rows"))

    replay(spark, rows, start, **how)
    return spark.read.schema(schema[0]).parquet(f"{out}/rows")


@query
def stream_dedup(spark, d):
    rows = view(spark, d, "detections").filter("allowlisted = 0")
    return drained(spark, rows, folds.dedup).filter("not deduplicated").select("event_id", "ts_us")


def _pattern_stream(spark, d, *names):
    wanted = [p for p in P.builtin_patterns() if p.name in names]
    out = drained(spark, view(spark, d, "log_events"), lambda s: folds.patterns(s, wanted))
    return out.filter(F.col("pattern_name") == names[-1]).select("source_ip", "event_id", "ts_us", "matched_count")


@query
def stream_brute_force(spark, d):
    return _pattern_stream(spark, d, "brute_force")


@query
def stream_port_scan(spark, d):
    return _pattern_stream(spark, d, "port_scan")


@query
def stream_lateral(spark, d):
    return _pattern_stream(spark, d, "lateral_movement")


@query
def stream_exfil(spark, d):
    return _pattern_stream(spark, d, "data_exfil_burst")


@query
def stream_login_after_scan(spark, d):
    return _pattern_stream(spark, d, "port_scan", "login_after_scan")


@query
def stream_flood(spark, d):
    out = drained(spark, view(spark, d, "log_events"), lambda s: folds.flood(s, cfg=replace(DEFAULTS, flood_rate=1.6)))
    return out.select("source_ip", "event_id", "flag")


@query
def stream_gateway_sprt(spark, d):
    out = drained(spark, view(spark, d, "gateway_obs"), folds.gateway_sprt)
    return rounded(out.drop("ts_us"), "sprt_statistic", "estimated_pdp")


@query
def stream_trust_path(spark, d):
    return rounded(drained(spark, view(spark, d, "detections"), folds.trust_path).drop("ts_us"), "score")


@query
def stream_protocol_violations(spark, d):
    out = drained(spark, view(spark, d, "protocol_messages"), folds.protocol_violations)
    return out.select("source_ip", "protocol", "event_id", "from_state", "to_state")


@query
def stream_motion(spark, d):
    moved = view(spark, d, "motion").select("event_id", F.lit(True).alias("moved"))
    both = view(spark, d, "log_events").join(moved, "event_id", "left").select("event_id", "ts_us", "moved")
    out = drained(spark, both, lambda s: folds.with_last_motion(s, s.filter("moved")), closing={"event_id": -1, "moved": True})
    return out.where("event_id >= 0").select("event_id", "motion_ts_us")


#: Short ticks have simple fractions as slopes; no sum of them is near this threshold.
STREAM_AMOF = replace(DEFAULTS, amof_threshold=0.2537)


@query
def stream_amof(spark, d):
    """Profiles of a stream's ticks, chained behind the windowed count."""
    out = drained(spark, view(spark, d, "log_events"), lambda s: windows.amof(s, 5.0, cfg=STREAM_AMOF, delay="0 seconds"),
                  closing={"source_ip": END})
    return out.where(F.col("source_ip") != END).select("source_ip", "tick", "first_anomalous_tick")


@query
def stream_late_rows(spark, d):
    """Every fiftieth event comes after all others; how many of those each of two operators is too late for."""
    rows = view(spark, d, "log_events").select("event_id", "ts_us", "source_ip")
    delayed = F.col("event_id") % 50 == 0
    path = new_folder(spark, "late")

    def start(stream):
        sides = [late.dead_letters(stream, path, name, delay).trigger(availableNow=True).start()
                 for name, delay in (("patterns", 600.0), ("ticks", 0.0))]
        for side in sides[1:]:
            side.awaitTermination()
        return sides[0]

    folder = replay(spark, rows.where(~delayed), start)
    rows.where(delayed).write.mode("append").parquet(folder)
    start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()
    return late.late_counts(spark, path, rows)


@query
def stream_ticks(spark, d):
    """One-minute ticks of every source."""
    out = drained(spark, view(spark, d, "log_events"), lambda s: windows.tick_counts(s, 60.0, delay="0 seconds"),
                  closing={"source_ip": END})
    return out.filter(F.col("source_ip") != END).select("source_ip", "tick", "packet_count")


@query
def stream_blackhole(spark, d):
    """The drop detector on closed ticks, batch by batch."""
    out = new_folder(spark, "blackhole")
    body = windows.blackhole_on_ticks(out, cfg=replace(DEFAULTS, blackhole_sigma=1.0))

    def start(stream):
        ticks = windows.tick_counts(stream, 60.0, delay="0 seconds")
        return (ticks.writeStream.option("checkpointLocation", f"{out}/_checkpoint").foreachBatch(body)
                .trigger(availableNow=True).start())

    replay(spark, view(spark, d, "log_events"), start, closing={"source_ip": END})
    found = spark.read.parquet(f"{out}/alerts").filter(F.col("source_ip") != END)
    return found.select("source_ip", "tick", "packet_count", F.round("threshold", 6).alias("threshold"))


@query
def stream_consensus(spark, d):
    """Votes in windows of 300 s that start every 30 s."""
    out = drained(spark, view(spark, d, "detections"), lambda s: windows.consensus(s, delay="0 seconds"),
                  closing={"source_ip": END, "predicted_label": "malicious", "confidence": 1.0})
    return out.filter(F.col("source_ip") != END).select(
        F.unix_micros("w.start").alias("start_us"), "source_ip", "malicious_votes", "suspicious_votes", "verdict")


@query
def stream_sessions(spark, d):
    starts = _fused(spark, d).filter("camera_recording_started").select("event_id", "ts_us", F.lit("yard").alias("camera"))
    cfg = replace(DEFAULTS, recording_gap_s=120.0)
    out = drained(spark, starts, lambda s: windows.recording_sessions(s, cfg=cfg, delay="0 seconds"), closing={"camera": END})
    return out.filter(F.col("camera") != END).drop("camera")


@query
def stream_alerts(spark, d):
    """Scored events classified, marked and stored as alerts, batch by batch."""
    out = new_folder(spark, "alerts")
    replay(spark, scored(spark, d), lambda s: alerting.run_alerts(
        alerting.detections_stream(s), f"{out}/alerts", f"{out}/_checkpoint", available_now=True))
    return sinks.read_alerts(spark, f"{out}/alerts").select("event_id", "severity", "honeypot_sent")
