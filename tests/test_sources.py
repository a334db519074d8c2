"""The native directory layout, written by hand in a temporary folder."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import names, units
from spanloom.operators import bookkeeping, telemetry
from spanloom.sources import runs, tables


def document(n: int, **summary):
    function = {
        "function_name": " main ", "duration_ns": 5150000, "self_time_ns": 41000, "thread_id": "777",
        "entry_id": "0_1714979289123456789", "start_time": "2024-05-06T07:08:09.123456789",
        "end_time": "2024-05-06T07:08:09.128606789",
    }
    path = {
        "rank": 1, "thread_id": "777", "critical_duration_ns": n, "critical_duration_formatted": "5.2ms",
        "total_duration_ns": 5150000, "path_length": 2,
        "functions": [function, {**function, "function_name": "Work"}],
        "bottlenecks": [{"function": "Work", "total_duration_ns": n, "self_time_ns": 1, "percentage_of_path": 100.0}],
    }
    return {
        "summary": {"num_paths_requested": 10, "num_paths_found": 1, "num_threads": 1, "total_function_calls": 2, **summary},
        "top_k_critical_paths": [path], "executed_functions": ["main", "Work", "idle"],
    }


SERIES = {
    "time_series": {"timestamps_ns": [1, 2, 3], "cpu_usage": [0.0, 50.0, 70.0], "memory_usage": [1e6, 2e6, 4e6], "disk_usage": [0.0, 0.0, 0.0]},
    "aggregated_metrics": {"CPU Usage": {"peak": 70.0, "average": 60.0, "median": 60.0}},
    "trace_start_ns": 1, "trace_end_ns": 3,
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("critical-paths")

    def put(program, run, iteration, name, text):
        folder = base / program / "analysis" / f"{program}_analysis_itself_{run}" / f"iter-{iteration}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    for iteration in range(2):
        put("alpha", "input7", iteration, "critical_paths.json", json.dumps(document(100 + iteration), indent=4))
        put("alpha", "input7", iteration, "kernel_data.json", json.dumps(SERIES, indent=4))
    put("alpha", "input8", 0, "critical_paths.json", '{"summary": {"num_paths')
    put("alpha", "input9", 0, "critical_paths.json", json.dumps({"summary": {}}))
    put("alpha", "input9", 0, "kernel_data.json", json.dumps(SERIES))
    put("sqlite", "input1", 2, "critical_paths.json", json.dumps(document(1)))
    put("sqlite", "input1", 2, "critical_paths_with_functions.json", json.dumps(document(2)))
    put("alpha", "input7", 0, "function_stats.csv", "function_name,thread_id,duration_ns,self_time_ns,num_children\nmain,777,5150000,41000,4\nwork,777,2000,2000,0\n")
    put("alpha", "regression_3", 0, "critical_paths.json", json.dumps(document(900, _regression_type="cpu", _archetype=4)))
    put("alpha", "regression_4", 0, "critical_paths.json", json.dumps(document(901)))
    put("alpha", "regression_5", 1, "critical_paths.json", json.dumps(document(902)))
    put("alpha", "regression_x", 0, "critical_paths.json", json.dumps(document(903)))
    return str(base)


def test_runs(spark, root):
    documents = runs.read_critical_paths(spark, root).cache()
    found = {(r["program"], r["input_id"], r["iteration"]) for r in documents.collect()}
    assert found == {("alpha", 7, 0), ("alpha", 7, 1), ("alpha", 9, 0), ("sqlite", 1, 2)}
    paths = runs.path_rows(documents).cache()
    durations = {(r["program"], r["iteration"]): r["critical_duration_ns"] for r in paths.collect()}
    assert durations == {("alpha", 0): 100, ("alpha", 1): 101, ("sqlite", 2): 2}
    functions = runs.path_function_rows(paths, lower=True).where("program = 'alpha' and iteration = 0")
    rows = sorted(functions.collect(), key=lambda r: r["pos"])
    assert [r["function_name"] for r in rows] == ["main", "work"]
    assert rows[0]["start_ns"] == 1714979289123456789 and rows[0]["end_ns"] == 1714979289128606789
    assert {r["function_name"] for r in runs.path_bottleneck_rows(paths).collect()} == {"Work"}
    assert runs.executed_rows(documents).distinct().where("program = 'alpha'").count() == 6

    series = runs.read_telemetry(spark, root)
    complete = bookkeeping.complete_runs(documents, series)
    assert {(r["input_id"], r["iteration"]) for r in complete.collect()} == {(7, 0), (7, 1)}
    missing = bookkeeping.missing_iterations(documents, documents).where("program = 'alpha'")
    assert {(r["input_id"], r["iteration"]) for r in missing.collect()} == {(7, 2), (9, 1), (9, 2)}


def test_telemetry(spark, root):
    samples = runs.telemetry_rows(runs.read_telemetry(spark, root)).where("input_id = 7 and iteration = 0")
    assert [tuple(r[-4:]) for r in sorted(samples.collect())] == [(1, 0.0, 1e6, 0.0), (2, 50.0, 2e6, 0.0), (3, 70.0, 4e6, 0.0)]
    stats = {r["metric"]: (r["peak"], r["average"], r["median"]) for r in telemetry.telemetry_aggregates(samples, ["program"]).collect()}
    assert stats == {"cpu": (70.0, 60.0, 60.0), "mem": (4e6, pytest.approx(7e6 / 3), 2e6), "disk": (-1.0, -1.0, -1.0)}


def test_calls_and_regressions(spark, root):
    calls = runs.read_call_stats(spark, root).collect()
    assert {(r["function_name"], r["input_id"], r["self_time_ns"], r["num_children"]) for r in calls} == {("main", 7, 41000, 4), ("work", 7, 2000, 0)}
    injected = runs.read_regressions(spark, root).collect()
    assert {(r["input_id"], r["regression_type"], r["own_archetype"]) for r in injected} == {(3, "cpu", 4), (4, "unknown", None)}


def test_sizes(spark, root):
    files = runs.list_files(spark, f"{root}/alpha/analysis/*input7/iter-*/*.json")
    rows = files.withColumn("run", F.regexp_extract("path", r"(iter-\d+)", 1))
    assert rows.count() == 4
    assert bookkeeping.size_gate(rows, ["run"], 1).count() == 0
    assert bookkeeping.size_gate(rows, ["run"]).count() == 2


def test_static_metrics_last_entry_counts(spark, tmp_path):
    def function(name, loc, **more):
        return {"name": name, "line_of_codes": loc, **more}

    data = [
        {"file": "a.c", "functions": [function("f", 1), function("g", 2, has_io=True), function("f", 3)]},
        {"file": "b.c", "functions": [function(" g ", 4, number_of_branches={"number_of_if": 5})]},
    ]
    path = tmp_path / "metrics.json"
    path.write_text(json.dumps(data, indent=4))
    flat = tables.flatten_static_metrics(tables.read_static_metrics(spark, str(path)))
    got = {r["function_name"]: (r["loc"], r["ifs"], r["has_io"], r["function_type"]) for r in flat.collect()}
    assert got == {"f": (3, 0, False, "Unknown"), "g": (4, 5, False, "Unknown")}


def test_trace_events(spark, tmp_path):
    folder = tmp_path / "run-1"
    folder.mkdir()
    lines = [
        {"ph": "B", "ts": 1.5, "pid": 3, "tid": 4, "name": "f", "args": {"x": 1}},
        {"ph": "E", "ts": 2.5, "pid": 3, "name": "f"},
        {"ph": "M", "ts": 0, "pid": 3, "name": "meta"},
    ]
    (folder / "events.json").write_text("\n".join(json.dumps(line) for line in lines))
    from spanloom.operators.calls import clean_events

    got = clean_events(tables.read_trace_events(spark, str(folder))).collect()
    assert {(r["run"], r["ph"], r["ts"], r["tid"]) for r in got} == {("run-1", "B", 1.5, 4), ("run-1", "E", 2.5, 3)}


def test_summary_document(spark, tmp_path):
    small = spark.createDataFrame([("p", 1)], "program string, n long")
    summary = spark.range(1).select(tables.summary_document(counts=small, again=small).alias("results"))
    tables.write_table(summary, str(tmp_path / "summary"))
    row = spark.read.json(str(tmp_path / "summary")).head()
    assert row["results"]["counts"][0]["n"] == 1


def test_names(spark):
    simple = {
        "int main(int a)": "main", "std::vector<T>::push_back": "push_back", "char **get (void)": "get",
        "  &ref": "ref", "a::b::": "", "": "", "operator()": "operator", "x": "x",
    }
    df = spark.createDataFrame([(s,) for s in simple], "s string")
    got = {r["s"]: r["n"] for r in df.withColumn("n", names.simple_function_name(F.col("s"))).collect()}
    assert got == simple
    blanks = ["\t a\n b  c  ", "\x1c x 　", "no"]
    df = spark.createDataFrame([(s,) for s in blanks], "s string")
    row = df.select("s", names.strip(F.col("s")).alias("a"), names.squash_whitespace(F.col("s")).alias("b")).collect()
    assert {r["s"]: r["a"] for r in row} == {s: s.strip() for s in blanks}
    assert {r["s"]: r["b"] for r in row}[blanks[0]] == "a b c"
    assert len(names.IO_CALLS) == len(set(names.IO_CALLS)) == 82


def test_units(spark):
    sizes = {
        0: "0B", 1: "1.0 B", 1023: "1023.0 B", 1024: "1.0 KB", 1152: "1.12 KB", 1536: "1.5 KB",
        1048576: "1.0 MB", 5368709197: "5.0 GB", 3298534883328: "3.0 TB",
    }
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert {r["n"]: r["t"] for r in df.withColumn("t", units.human_size(F.col("n"))).collect()} == sizes
    stamps = {"2025-01-02T03:04:05.123456789": 1735787045123456789, "2025-01-02T03:04:05.5": 1735787045500000000, "2025-01-02T03:04:05": 1735787045000000000}
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        back = df.withColumn("ns", units.iso_to_ns(F.col("s"))).withColumn("again", units.iso_format(F.col("ns"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r["s"]: r["ns"] for r in back} == stamps
    assert {r["again"] for r in back} == {"2025-01-02T03:04:05.123456789", "2025-01-02T03:04:05.500000", "2025-01-02T03:04:05"}
