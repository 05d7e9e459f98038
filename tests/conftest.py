import os
import random
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("watchline-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


SECOND = 1_000_000


def random_keys(keys, rows, span_s, seed, boundaries=()):
    """(key, event_id, ts_us) lists: many random keys, with ties and exact boundary ages."""
    rng = random.Random(seed)
    out, next_id = [], 0
    for k in range(keys):
        ts = 1_710_789_000 * SECOND + rng.randrange(0, 100) * SECOND
        start = ts
        for _ in range(rng.randrange(1, rows)):
            out.append((f"k{k}", next_id, ts))
            next_id += 1
            kind = rng.random()
            if kind < 0.1:
                step = 0
            elif kind < 0.3 and boundaries:
                step = rng.choice(boundaries) * SECOND + rng.choice([-1, 0, 1])
            else:
                step = rng.randrange(1, max(2, int(span_s * SECOND / rows)))
            ts += max(0, step)
            if ts - start > span_s * SECOND:
                ts = start + span_s * SECOND
    return out


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        groups.setdefault(r[0], []).append(r)
    return groups
