"""The driver contract: entry runs, and registered queries agree with their SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")
# One query per family; tools/check.py runs them all.
CHECKED = ["alert_severity_counts", "predict_events", "cep_login_after_scan", "dos_flood", "amof", "gateway_sprt",
           "trust_round", "protocol_violations", "active_threats", "motion_fusion", "learned_detectors", "smote_rows",
           "dataset_profile", "stream_brute_force"]


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"severity", "predicted_label", "events", "distinct_events"}
    assert sum(r.events for r in rows) == 1000


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), names)
