"""Files under exact names: all of a job's files or none."""

from __future__ import annotations

import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.sources import committed, tables


def found(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.startswith("."))


def test_files_keep_their_names_and_neighbours(spark, tmp_path):
    root = tmp_path / "out"
    rows = spark.range(0, 40, 1, 4).select(
        F.format_string("p%d/iter-%d/data.json", F.col("id") % 3, F.col("id")).alias("path"),
        F.col("id").cast("string").alias("content"),
    )
    committed.write_files(rows, str(root))
    committed.write_files(spark.createDataFrame([("p0/iter-0/data.json", None), ("p0/other", "é")], "path string, content string"), f"file:{root}")
    assert len(found(root)) == 41 and not [p for p in root.iterdir() if p.name.startswith("_")]
    assert (root / "p1/iter-7/data.json").read_text() == "7"
    assert (root / "p0/iter-0/data.json").read_text() == "" and (root / "p0/other").read_text() == "é"


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    root = tmp_path / "out"
    failing = F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise("x").alias("content")
    rows = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("path"), failing)
    with pytest.raises(Exception, match="lost"):
        committed.write_files(rows, str(root))
    assert not root.exists() or list(root.iterdir()) == []


@pytest.mark.parametrize("names", [["a", "b", "a"], ["a", None]])
def test_scattered_rows_and_nameless_files_are_errors(spark, tmp_path, names):
    rows = spark.createDataFrame([(n, "x") for n in names], "path string, content string").coalesce(1)
    with pytest.raises(Exception, match="together|no path"):
        committed.write_files(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or found(tmp_path / "out") == []


def test_csv_parts_and_no_rows(spark, tmp_path):
    df = spark.range(0, 100, 1, 5).select("id", F.lit('say "a, b"').alias("text"))
    committed.write_csv_parts(df, str(tmp_path / "csv"), "t")
    assert found(tmp_path / "csv") == [f"t-{i:05d}.csv" for i in range(5)]
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv"))
    assert back.columns == ["id", "text"] and back.count() == 100
    assert back.select("text").distinct().collect() == [('say "a, b"',)]
    committed.write_csv_parts(df.where("id < 0"), str(tmp_path / "none"), "t")
    assert found(tmp_path / "none") == []


def test_summary_under_its_name(spark, tmp_path):
    tables.write_summary(spark, str(tmp_path), "results.json", small=spark.range(2), none=spark.range(0))
    assert json.loads((tmp_path / "results.json").read_text()) == {"small": [{"id": 0}, {"id": 1}], "none": []}
    with pytest.raises(Exception, match="more than"):
        spark.range(1).select(tables.summary_document(most=3, big=spark.range(4))).collect()


def test_contents_are_not_copied_beside_their_batch(tmp_path):
    texts = [chr(97 + i) * 1_000_000 + "é\n" for i in range(20)] + [None, ""]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([f"d/{i}.txt" for i in range(len(texts))]), pa.array(texts)], ["path", "content"]
    )
    writer = committed._named_files()({"root": f"file://{tmp_path}/out"}).writer(None, False)
    tracemalloc.start()
    staged = writer.write(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    writer.commit([staged])
    assert [(tmp_path / f"out/d/{i}.txt").read_text() for i in range(len(texts))] == [t or "" for t in texts]
    assert peak < 1_000_000
