"""Time the headline queries: one JSON line with seconds per query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (comma-separated names).
Each query is run to a no-op sink, so every row and column is computed; the first query also pays for start-up work,
so an untimed scan goes first.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from watchline.plans.queries import QUERIES

HEADLINE = [
    "alert_severity_counts", "rule_flags", "event_text", "normalize_label", "dedup_anchors", "predict_events",
    "alert_stats", "alerts_page", "sliding_counts", "cep_brute_force", "cep_port_scan", "cep_login_after_scan",
    "cep_all_patterns", "recent_matches", "dos_flood", "wormhole_pairs", "blackhole", "amof", "gateway_sprt",
    "trust_scores", "trust_path", "trust_round", "protocol_violations", "sniffer_consensus", "active_threats",
    "motion_fusion", "recording_sessions", "immune_screen", "immune_screen_events", "negative_selection",
    "immune_promotion", "class_metrics", "latency", "hybrid_stage1", "nearest_same_class", "smote_rows",
    "packets_to_events", "ingest_events", "training_rows", "dataset_profile",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("watchline-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in only or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
