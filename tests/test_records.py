"""Cutting CSV files into records over byte ranges, against the csv module."""

import csv as plain
import io
import random

import pytest

from watchline.sources import csv, records


def rows_of(text):
    return [[f or None for f in r] for r in plain.reader(io.StringIO(text, newline="")) if r]


def random_csv(seed, rows):
    rng = random.Random(seed)
    alphabet = ["a", "bc", ",", '""', "\n", "\r\n", " ", "é", "\n\n", '"",""', "x" * 50]
    out = ["h1,h2,h3"]
    for _ in range(rows):
        fields = []
        for _ in range(3):
            if rng.random() < 0.4:
                fields.append('"' + "".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) + '"')
            else:
                fields.append(rng.choice(["", "v", 'in"ch', "5'", "plain text", 'a""b', "tail\""]))
        out.append(",".join(fields) if any(fields) else "z,,")
    return "\n".join(out) + rng.choice(["", "\n", "\n\n"])


def test_line_states():
    for line, n, q in [(b"a,b", False, True), (b'a,"b', True, False), (b'"a""b",c', False, False), (b'in"ch,x', False, False),
                       (b'x",y', False, False), (b'x,"y","z', True, True), (b'""', False, True), (b'"""', True, False), (b'a"",b', False, True)]:
        assert records.ends_in_quotes(line, False) is n, line
        assert records.ends_in_quotes(line, True) is q, line


@pytest.mark.parametrize("seed,size,sent", [(1, 64, 10**6), (2, 300, 10**6), (3, 50_000, 10**6), (4, 100, 0)])
def test_records_of_any_ranges_are_those_of_the_csv_module(spark, tmp_path, monkeypatch, seed, size, sent):
    monkeypatch.setattr(records, "RANGES_SENT", sent)
    texts = {f"f{k}.csv": random_csv(seed * 10 + k, 60) for k in range(3)}
    texts["one.csv"] = 'h\n"' + "line\n" * 300 + '"\nlast'  # a record over many ranges
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = records.csv_records(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        mine = {r.record: list(r.fields) for r in got if r.file.endswith("/" + name)}
        assert [mine[i] for i in range(len(mine))] == rows_of(text)


def test_sources_of_many_shapes_in_one_plan(spark, tmp_path):
    (tmp_path / "a.csv").write_text('message,label,src\n"two\nlines, quoted",attack,1.1.1.1\n,0,\nplain,weird,x\n')
    (tmp_path / "b.csv").write_text("﻿f1,Class,f2\n1,attack,\n2,0,y\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/K_dataset.csv").write_text("p,q\n" + "".join(f"{i},v{i}\n" for i in range(50)))
    (tmp_path / "sub/k_labels.csv").write_text(",x\n" + "".join(f"{i},{i % 2}\n" for i in range(50)))
    (tmp_path / "ragged.csv").write_text("message,label\na,attack\nb,more,attack\n")
    (tmp_path / "nolabel.csv").write_text("foo,bar\n1,2\n")
    (tmp_path / "other").mkdir()
    (tmp_path / "other/S_dataset.csv").write_text("p\n1\n2\n")
    (tmp_path / "other/S_labels.csv").write_text("x\n1\n")
    (tmp_path / "empty.csv").write_text("")
    rows, skipped = csv.read_training_sources(spark, str(tmp_path))
    got = sorted(tuple(r) for r in rows.collect())
    want = [("two\nlines, quoted", "malicious", "1.1.1.1", "unknown", "unknown"), ("", "benign", "unknown", "unknown", "unknown"),
            ("f1=1 f2=", "malicious", "unknown", "unknown", "unknown"), ("f1=2 f2=y", "benign", "unknown", "unknown", "unknown")]
    want += [(f"p={i} q=v{i}", "malicious" if i % 2 else "benign", "unknown", "unknown", "unknown") for i in range(50)]
    assert got == sorted(want)
    assert [s.rsplit("/", 1)[1].split(":")[0] for s in skipped] == ["nolabel.csv", "S_dataset.csv", "ragged.csv"]
    with pytest.raises(ValueError, match="no usable"):
        csv.read_training_sources(spark, str(tmp_path / "other"))


def test_rows_of_pairs_are_never_broadcast(spark, tmp_path):
    (tmp_path / "k_dataset.csv").write_text("p,q\n" + "".join(f"{i},v{i}\n" for i in range(50)))
    (tmp_path / "k_labels.csv").write_text("x\n" + "".join(f"{i % 2}\n" for i in range(50)))
    sources, _ = csv.read_training_sources(spark, str(tmp_path))
    paired = csv.read_paired_csv(spark, str(tmp_path / "*_dataset.csv"), str(tmp_path / "*_labels.csv"))
    for rows, key in ((sources, "file#"), (paired, "row_idx#")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert any("SortMergeJoin" in line and key in line for line in plan.splitlines())
        assert rows.count() == 50
