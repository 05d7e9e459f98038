"""Operators that run Python work when only the driver's sys.path knows the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from watchline.operators import cooldown, protocol
df = spark.createDataFrame([("a", 0, 0), ("a", 1, 10)], "source_ip string, event_id long, ts_us long")
print("fired", cooldown.first_per_window(df, ["source_ip"], 100, True, slice_us=5).count())
"""


def test_package_is_shipped(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fired 1" in done.stdout, done.stderr[-2000:]
