"""Throughput on generated events with one hot source: python tools/scale.py [rows] [name ...].

A third of all rows share one source. Rows come from spark.range, so nothing is read from or written to disk.
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, functions as F

from watchline.operators import cooldown, detect, patterns as P, profiler, protocol, routing, sliding, trust, votes
from watchline.functions import text as X


def events(spark, n):
    h = F.xxhash64("id")
    pick = F.pmod(h, F.lit(100))
    ip = F.when(pick < 33, "10.9.9.9").otherwise(F.concat(F.lit("10.0."), F.pmod(F.shiftright(h, 8), F.lit(40)).cast("string"),
                                                          F.lit("."), F.pmod(F.shiftright(h, 16), F.lit(250)).cast("string")))
    kind = F.pmod(F.shiftright(h, 24), F.lit(6))
    port = F.pmod(F.shiftright(h, 32), F.lit(40)).cast("string")
    message = (F.when(kind == 0, "Failed password for root").when(kind == 1, F.concat(F.lit("dst_ip=10.1.0."), port, F.lit(" dst_port="), port))
               .when(kind == 2, "session opened for user root").when(kind == 3, F.concat(F.lit("bytes="), port))
               .when(kind == 4, F.concat(F.lit("rpl_parent=10.0.1."), port)).otherwise("User john logged in"))
    # Two hours of traffic whatever the number of rows.
    ts = F.lit(1_710_789_000_000_000) + F.floor(F.col("id") * (7200 * 1_000_000 / n)).cast("long")
    label = F.when(kind == 0, "suspicious").when(kind == 3, "malicious").otherwise("benign")
    return spark.range(0, n, 1, 16).select(
        F.col("id").alias("event_id"), ts.alias("ts_us"), ip.alias("source_ip"), F.concat(F.lit("h"), F.pmod(h, F.lit(3))).alias("hostname"),
        F.when(kind == 3, "udp").otherwise("tcp").alias("service"), message.alias("message"), label.alias("predicted_label"),
        (F.pmod(h, F.lit(50)) / 100 + 0.5).alias("confidence"), F.concat(F.lit("h"), F.pmod(h, F.lit(3))).alias("sniffer_id"),
        F.lit(False).alias("allowlisted"))


def jobs(ev):
    m = F.col("message")
    proto = ev.select("source_ip", "event_id", "ts_us", F.lit("coap").alias("protocol"), F.lit("con").alias("event_state"),
                      F.when(F.col("event_id") % 3 == 0, "ack").when(F.col("event_id") % 3 == 1, "terminal").alias("next_state"))
    return {
        "flags": lambda: detect.with_flags(ev),
        "dedup": lambda: detect.dedup_anchors(ev),
        "detect": lambda: detect.detect(ev),
        "sliding": lambda: sliding.sliding_counts(ev, {"f": sliding.Sliding(X.is_failed_login(m), 60_000_000),
                                                       "p": sliding.Sliding(X.has_dst_port(m), 10_000_000, X.dst_port(m))}),
        "patterns": lambda: P.PatternSet().alerts(ev),
        "flood": lambda: cooldown.flood(ev),
        "wormhole": lambda: routing.wormhole_claims(ev),
        "blackhole": lambda: routing.blackhole_events(ev),
        "amof": lambda: profiler.amof(routing.forward_ticks(ev, 30_000_000), "source_ip"),
        "trust": lambda: trust.trust_scores(ev),
        "trust_path": lambda: trust.trust_path(ev),
        "protocol": lambda: protocol.protocol_violations(proto),
        "votes": lambda: votes.active_threats(ev),
    }


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 2_000_000
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "32").config("spark.driver.memory", "20g")
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    for name, build in jobs(events(spark, n)).items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        build().write.format("noop").mode("overwrite").save()
        took = time.time() - start
        print(f"{name:12s} {took:7.1f}s {n / took / 1000:9.0f}k rows/s", flush=True)


main()
