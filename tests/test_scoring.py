"""Every rung of the scoring ladders, and the evaluation formulas."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import baseline, calls, evaluation, scoring

RUN_SCHEMA = "program string, input_id long, iteration int, is_regression boolean"


def runs(spark, values, columns: str):
    return spark.createDataFrame(
        [("p", i, 0, True, *v) for i, v in enumerate(values)], f"{RUN_SCHEMA}, {columns}"
    )


def scores(df, name):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["input_id"])]


def test_bounds_ladder_by_mean(spark):
    model = spark.createDataFrame(
        [("p", 100.0, 0.0, 0.0, 1e9, 1e9, 0.0, 100.0, 0.0, 1000, 1)],
        "program string, duration_mean double, duration_std double, duration_median double, "
        "duration_p95 double, duration_p99 double, duration_iqr double, length_mean double, "
        "length_std double, length_max long, length_min long",
    )
    cases = [(120, 0.0), (121, 0.3), (130, 0.3), (131, 0.5), (151, 0.7), (171, 0.8), (200, 0.8), (201, 0.9), (250, 0.9), (251, 1.0)]
    df = runs(spark, [(d, 100) for d, _ in cases], "path_duration_ns long, path_length long")
    assert scores(scoring.score_bounds(df, model), "bounds_score") == [s for _, s in cases]
    lengths = [(130, 0.0), (131, 0.3), (150, 0.3), (151, 0.5), (1000, 0.5), (1001, 0.7)]
    df = runs(spark, [(1, n) for n, _ in lengths], "path_duration_ns long, path_length long")
    assert scores(scoring.score_bounds(df, model), "bounds_score") == [s for _, s in lengths]


@pytest.mark.parametrize(
    "change, cases",
    [
        ({"duration_median": 100.0}, [(150, 0.0), (151, 0.6), (181, 0.7), (250, 0.7), (251, 0.9)]),
        ({"duration_p95": 50.0, "duration_p99": 90.0}, [(50, 0.0), (51, 0.7), (90, 0.7), (91, 0.9)]),
        ({"duration_mean": 100.0, "duration_std": 4.0}, [(106, 0.0), (107, 0.5), (108, 0.5), (109, 0.7), (112, 0.7), (113, 0.9)]),
        # The limit is median + 1.5 IQR; the median's own rungs stay out of reach.
        ({"duration_median": 100.0, "duration_iqr": 20.0}, [(130, 0.0), (131, 0.7), (151, 0.7)]),
    ],
)
def test_bounds_ladder_by_level(spark, change, cases):
    base = {
        "duration_mean": 0.0, "duration_std": 0.0, "duration_median": 0.0, "duration_p95": 1e9,
        "duration_p99": 1e9, "duration_iqr": 0.0, "length_mean": 10.0, "length_max": 10, "length_min": 1,
    }
    model = spark.createDataFrame([{"program": "p", **base, **change}])
    df = runs(spark, [(d, 1) for d, _ in cases], "path_duration_ns long, path_length long")
    assert scores(scoring.score_bounds(df, model), "bounds_score") == [s for _, s in cases]


def test_resource_ladder(spark):
    model = spark.createDataFrame(
        [("p", r, 100.0, 10.0, 1e9, 1e9) for r in ("cpu", "memory", "io")],
        "program string, resource string, mean double, std double, p95 double, p99 double",
    )
    cases = [
        ((110.0, 100.0, 100.0), 0.0), ((111.0, 100.0, 100.0), 0.3), ((100.0, 84.0, 100.0), 0.6),
        ((100.0, 100.0, 121.0), 0.8), ((130.0, 100.0, 100.0), 0.8), ((131.0, 100.0, 100.0), 1.0),
        ((0.0, 100.0, 100.0), 0.0), ((None, 100.0, 121.0), 0.8), ((None, None, None), 0.0),
    ]
    columns = "cpu_avg double, memory_avg double, io_avg double"
    df = runs(spark, [c for c, _ in cases], columns)
    assert scores(scoring.score_resource(df, model), "resource_score") == [s for _, s in cases]
    tails = model.withColumns({"p95": F.lit(101.0), "p99": F.lit(105.0)})
    df = runs(spark, [(101.0,) * 3, (101.5, 100.0, 100.0), (106.0, 100.0, 100.0)], columns)
    assert scores(scoring.score_resource(df, tails), "resource_score") == [0.0, 0.6, 0.9]


def test_archetype_ladder(spark):
    def model(counts):
        rows = [("p", i, None, i2) for i, n in enumerate(counts) for i2 in range(n)]
        df = spark.createDataFrame(rows, "program string, archetype int, x string, y int")
        return baseline.archetype_model(df)

    # 4 %, 9 %, 14 % and 73 %, and one archetype never seen.
    df = runs(spark, [(0,), (1,), (2,), (3,), (9,)], "archetype int")
    assert scores(scoring.score_archetype(df, model([4, 9, 14, 73])), "archetype_score") == [0.7, 0.6, 0.5, 0.0, 1.0]
    # 2 archetypes: 34 % is 0.68 of uniform and 0.515 of the commonest.
    assert scores(scoring.score_archetype(df.where("archetype < 2"), model([34, 66])), "archetype_score") == [0.4, 0.0]


def test_path_score(spark):
    columns = "path_length long"
    df = runs(spark, [(4,), (4,), (40,)], columns)
    functions = spark.createDataFrame(
        [("p", 0, 0, True, i, f) for i, f in enumerate(["a", "b", "a", "b"])]
        + [("p", 1, 0, True, i, f) for i, f in enumerate(["a", "new", "rare", "b"])]
        + [("p", 2, 0, True, i, f) for i, f in enumerate(["a", "b"])],
        f"{RUN_SCHEMA}, pos int, function_name string",
    )
    frequencies = spark.createDataFrame(
        [("p", "a", 9), ("p", "b", 3), ("p", "rare", 2)], "program string, function_name string, frequency long"
    )
    grams = spark.createDataFrame([("p", "a->b"), ("p", "b->a")], "program string, ngram string")
    lengths = spark.createDataFrame(
        [("p", 4.0, 9.0)], "program string, path_length_mean double, path_length_std double"
    )
    got = scores(scoring.score_path(df, functions, frequencies, grams, lengths), "path_score")
    # Run 1: unseen 1 + rare 0.5 + three unseen bigrams 3/5, over three items.
    # Run 2: length is 4 deviations away, min(4/3, 1) over one item.
    assert got == [0.0, pytest.approx(2.1 / 3), 1.0]


def test_detection_needs_more_than_one_weak_signal(spark):
    values = [(0.92, 0, 0, 0), (0.93, 0, 0, 0), (0.65, 0.65, 0.65, 0.65), (0.7, 0.7, 0.7, 0.7)]
    df = runs(spark, [(None,)] * 4, "regression_type string")
    parts = [
        runs(spark, [(float(v[i]),) for v in values], f"{name}_score double")
        for i, name in enumerate(scoring.SIGNALS)
    ]
    out = scoring.combine_signals(df, parts)
    assert scores(out, "detected") == [False, True, False, True]
    everything = scoring.without_signals(out).where(F.col("excluded_signal") == "none")
    assert scores(everything, "detected") == [False, True, False, True]


def test_rates_and_auc(spark):
    rng = random.Random(4)
    data = [(rng.random() < 0.4, rng.randrange(5) / 4) for _ in range(90)]
    df = spark.createDataFrame(data, "is_regression boolean, combined_score double")
    wins = [(p > n) + (p == n) / 2 for t, p in data if t for u, n in data if not u]
    for cut in (None, 1):
        got = evaluation.roc_auc(df, slices=cut).head()["auc"]
        assert got == pytest.approx(sum(wins) / len(wins))
    assert evaluation.roc_auc(df.where("is_regression")).head()["auc"] == 0.0
    flagged = df.withColumn("detected", F.lit(False))
    row = evaluation.precision_recall_f1(evaluation.confusion_matrix(flagged)).head()
    assert (row["precision"], row["recall"], row["f1_score"]) == (0.0, 0.0, 0.0)


def test_few_runs_are_all_baseline(spark):
    few = [("few", i, 0, False) for i in range(9)]
    many = [("many", i // 2, i % 2, False) for i in range(20)]
    df = spark.createDataFrame(few + many, RUN_SCHEMA)
    for cut in (None, 2):
        rows = baseline.split_by_input(df, slices=cut).collect()
        assert all(r["is_baseline"] for r in rows if r["program"] == "few")
        assert {r["input_id"] for r in rows if r["program"] == "many" and r["is_baseline"]} == set(range(7))


def test_weighted_duration(spark):
    rows = [
        ("p", 1, 0, False, 10, 1, 1000), ("p", 1, 0, False, 11, 2, 400), ("p", 1, 0, False, 12, 3, 1000),
        ("p", 1, 0, False, 13, 4, 0), ("p", 2, 0, False, 20, 1, 77), ("p", 3, 0, True, 30, 1, 50),
        ("p", 3, 0, True, 31, 2, 10), ("p", 4, 0, False, 40, 1, 0), ("p", 4, 0, False, 41, 2, 9),
    ]
    df = spark.createDataFrame(rows, f"{RUN_SCHEMA}, path_id long, path_rank int, critical_duration_ns long")
    got = {r["input_id"]: r["path_duration_ns"] for r in baseline.weighted_path_duration(df).collect()}
    assert got == {1: int((1000 + 200) / 1.5), 2: 77, 3: 50, 4: 0}
    shaken = {r["input_id"]: r["weighted_duration_ns"] for r in baseline.weighted_path_duration(df, jitter=0.1).collect()}
    assert 720 <= shaken[1] <= 880 and shaken[2] == 77 and shaken[3] == 50


def test_sentinel_is_not_scored(spark):
    rows = [("p", 1, 0, False, "cpu", 50.0, 20.0), ("p", 1, 0, False, "mem", -1.0, -1.0), ("p", 1, 0, False, "disk", 4e6, 2e6)]
    df = spark.createDataFrame(rows, f"{RUN_SCHEMA}, metric string, peak double, average double")
    row = baseline.run_telemetry(df).head()
    assert (row["cpu_avg"], row["memory_avg"], row["memory_peak"], row["io_peak"]) == (20.0, None, None, 4.0)


def test_recorded_and_derived_bottlenecks_agree(spark):
    paths = spark.createDataFrame([("p", 1, 0, False, 10, 1, 0), ("p", 1, 0, False, 11, 2, 5)], f"{RUN_SCHEMA}, path_id long, path_rank int, critical_duration_ns long")
    rows = [("p", 1, 0, False, 10, i, f, d) for i, (f, d) in enumerate([("main", 90), ("a", 30), ("b", 60), ("c", 60)])]
    functions = spark.createDataFrame(rows, f"{RUN_SCHEMA}, path_id long, pos long, function_name string, duration_ns long")
    telemetry = spark.createDataFrame([("p", 1, 0, False, 1.0)], f"{RUN_SCHEMA}, cpu_avg double")
    slow = calls.path_bottlenecks(functions, ["path_id"], "duration_ns")
    derived, recorded = (
        baseline.run_features(paths, functions, b, telemetry).head().asDict() for b in (None, slow)
    )
    assert derived == recorded
    assert (derived["bottleneck_function"], derived["bottleneck_percentage"]) == ("b", 40.0)
    assert (derived["path_length"], derived["path_duration_ns"]) == (4, 90)
