"""The dead-letter side of streams against what the operators say they dropped."""

import random

from conftest import SECOND
from test_streaming import BASE
from watchline.streaming import late, windows


def test_late_rows_are_those_that_the_operator_dropped(spark, tmp_path):
    rng = random.Random(3)
    source, path = str(tmp_path / "in"), str(tmp_path / "late")
    dropped = {"ticks": 0, "slow": 0}
    delays = {"ticks": 30.0, "slow": 300.0}
    kept, i = [], 0
    top = None
    want = {"ticks": set(), "slow": set()}
    for part in range(4):
        rows = []
        for _ in range(60):
            late_by = rng.choice([0, 0, 0, 40, 200, 400]) if part else 0
            rows.append((f"n{i % 3}", i, (part * 300 + rng.randrange(300) - late_by) * SECOND + rng.randrange(SECOND)))
            i += 1
        for name, delay in delays.items():
            if top is not None:
                want[name] |= {r[1] for r in rows if r[2] <= late.watermark_us(top, delay)}
        top = max([r[2] for r in rows] + ([top] if top else []))
        kept += rows
        spark.createDataFrame(rows, BASE).coalesce(1).write.mode("append").parquet(source)
        for name, delay in delays.items():
            stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
            side = late.dead_letters(stream, path, name, delay).trigger(availableNow=True).start()
            side.awaitTermination(300)
            out = windows.tick_counts(stream, 60.0, delay=f"{delay:g} seconds")
            q = (out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c-{name}"))
                 .trigger(availableNow=True).start(str(tmp_path / f"o-{name}")))
            q.awaitTermination(300)
            dropped[name] += sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    like = spark.createDataFrame(kept, BASE)
    got = late.late_rows(spark, path, like).collect()
    assert {n: {r.event_id for r in got if r.operator == n} for n in delays} == want and want["slow"] < want["ticks"]
    counts = {r.operator: r.late for r in late.late_counts(spark, path, like).collect()}
    assert counts == {n: len(x) for n, x in want.items()} and len(got) == sum(counts.values())
    # The operator counts groups that partial aggregation has combined, so it may count fewer, never more.
    assert all(0 < dropped[n] <= counts[n] for n in delays)
    assert late.late_rows(spark, str(tmp_path / "none"), like).count() == 0
