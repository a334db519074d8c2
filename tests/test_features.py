from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spanloom.operators import archetypes, elements, features, ranking, telemetry, vectors
from spanloom.operators.grouping import chunked_lists

KEY = ["path"]
SCHEMA = "program string, path string, pos long, function_name string, duration_ns long, self_time_ns long, start_ns long, end_ns long, function_type string"


@pytest.fixture(scope="module")
def functions(spark):
    one = [("p", "one", 0, "main", 10, 10, 0, 10, None)]
    four = [
        ("p", "four", i, n, d, s, 100 * i, 100 * i + 50, k)
        for i, (n, d, s, k) in enumerate(
            [("main", 40, 0, "I/O-bound"), ("a_x", 40, 10, "CPU-bound"), ("a_y", 15, 5, "Memory-bound"), ("longname", 5, 5, "I/O-bound")]
        )
    ]
    return spark.createDataFrame(one + four, SCHEMA).cache()


def test_temporal(functions):
    got = {r["path"]: r for r in features.temporal_features(functions, KEY).collect()}
    four = got["four"]
    values = sorted([40, 40, 15, 5])
    gini = 2 * sum(i * v for i, v in enumerate(values, 1)) / (4 * 100) - 5 / 4
    assert four["time_gini"] == pytest.approx(gini)
    assert four["max_duration_ratio"] == 0.4 and four["top3_duration_ratio"] == 0.95
    assert four["self_time_ratio"] == 0.2 and four["peak_position"] == 0.0
    assert (got["one"]["time_gini"], got["one"]["top3_duration_ratio"]) == (0.0, 1.0)


def test_structural(spark, functions):
    static = spark.createDataFrame(
        [("p", "a_x", 10, 1, 0, 5)], "program string, function_name string, loc int, loops int, nested_loops int, calls int"
    )
    got = {r["path"]: r for r in features.structural_features(functions, KEY, static, ["program", "function_name"]).collect()}
    cx = [0.0, 4.3, 0.0, 0.0]
    assert got["four"]["unique_prefixes"] == 3
    assert got["four"]["complexity_mean"] == pytest.approx(4.3 / 4)
    slope = sum((i - 1.5) * c for i, c in enumerate(cx)) / 5
    assert got["four"]["complexity_gradient"] == pytest.approx(slope)
    assert got["one"]["complexity_gradient"] == 0.0


def test_transitions(functions):
    got = {r["path"]: r for r in features.transition_features(functions, KEY).collect()}
    four = got["four"]
    assert four["transition_entropy"] == pytest.approx(math.log2(3))
    assert (four["io_to_cpu"], four["cpu_to_mem"], four["mem_to_io"], four["io_ratio"]) == (1, 1, 1, 0.5)
    assert got["one"]["transition_entropy"] == 0.0


def test_resources_fall_back_to_the_run(spark, functions):
    series = spark.createDataFrame(
        [("p", 0, 10.0, 1e6, 0.0), ("p", 100, 50.0, 4e6, 2e6), ("p", 200, 30.0, 5e6, 0.0), ("p", 1000, 0.0, 1e6, 0.0)],
        "program string, ts long, cpu double, mem double, disk double",
    )
    intervals = spark.createDataFrame(
        [("p", "in", 0, 200), ("p", "out", 300, 400), ("q", "none", 0, 9)], "program string, path string, start_ns long, end_ns long"
    )
    for width in (7, 64, 100_000):
        rows = telemetry.resource_features(intervals, series, ["program"], ["path"], width=width).collect()
        got = {r["path"]: r for r in rows}
        inside = got["in"]
        assert (inside["cpu_mean"], inside["cpu_max"], inside["memory_growth"]) == (30.0, 50.0, 4.0)
        assert inside["memory_volatility"] == pytest.approx(1.0)
        assert got["out"]["cpu_mean"] == 22.5 and got["out"]["memory_growth"] == 0.0
        assert all(got["none"][n] == 0.0 for n in telemetry.RESOURCE_FEATURES)
    phases = {r["path"]: r for r in features.phase_features(functions, series, ["program"], ["program", "path"], width=64).collect()}
    # One sample in each of the first three phases; the last falls back to the run.
    assert phases["four"]["cpu_phases"] == 1 and phases["four"]["memory_monotonic"] == 0
    assert phases["one"]["phase_distance"] == 0.0 and phases["one"]["memory_monotonic"] == 0


def test_long_intervals_over_fine_samples(spark):
    """An hour over 10 us leaves: few pieces, and the same features as over all samples."""
    import random

    rng = random.Random(7)
    hour, run = 3_600_000_000_000, ["program"]
    times = sorted(rng.sample(range(0, 2 * hour, 10_000_000), 3000))
    rows = [("p", ts, rng.choice([None, float("nan"), 1e6 + rng.random() * 50]), 1e9 + rng.random(), rng.random() * 1e9) for ts in times]
    rows += [("hole", ts, 5.0, float(ts), 0.0) for ts in (0, 10 * hour)]
    series = spark.createDataFrame(rows, "program string, ts long, cpu double, mem double, disk double").cache()
    spans = [(0, hour), (5, 5), (times[10], times[10]), (times[3] + 1, times[2990]), (hour // 3, 2 * hour), (-hour, 5 * hour), (times[7], times[8])]
    made = [("p", i, a, b) for i, (a, b) in enumerate(spans)] + [("hole", 90, 1, 11 * hour), ("hole", 91, 1, 9 * hour)]
    intervals = spark.createDataFrame(made, "program string, id int, start_ns long, end_ns long")
    cut = telemetry._pieces(intervals, telemetry._spans(series, run, 10_000), run, 10_000, "start_ns", "end_ns").collect()
    assert max(len(r["_inner"]) + len(r["_edges"]) for r in cut) <= 64
    features_of = {r["id"]: r for r in telemetry.resource_features(intervals, series, run, ["id"], width=10_000).collect()}
    counts = {r["id"]: r for r in telemetry.samples_or_run(intervals, series, run, ["id"], width=10_000).collect()}
    met = {r["id"]: r["n"] for r in telemetry.interval_join(intervals, series, run, width=10_000).groupBy("id").agg(F.count("ts").alias("n")).collect()}
    for program, i, low, high in made:
        every = [r for r in rows if r[0] == program]
        mine = [r for r in every if low <= r[1] <= high]
        assert met.get(i, 0) == len(mine)
        assert (counts[i]["samples"], counts[i]["whole_run"]) == (len(mine or every), not mine)
        mine = mine or every
        cpu = [r[2] for r in mine if r[2] is not None and r[2] == r[2]]
        steps = [b[3] - a[3] for a, b in zip(mine, mine[1:])]
        disk = [r[4] for r in mine]

        def mean(x):
            return math.fsum(x) / len(x)

        def std(x):
            return math.sqrt(mean([(v - mean(x)) ** 2 for v in x]))

        want = [
            mean(cpu) if cpu else 0, std(cpu) if cpu else 0, max(cpu, default=0), (mine[-1][3] - mine[0][3]) / 1e6, mean([r[3] for r in mine]) / 1e6,
            std(steps) / 1e6 if steps else 0, mean(disk) / 1e6, std(disk) / 1e6 if mean(disk) > 0 else 0, max(disk) / 1e6,
        ]
        assert [features_of[i][n] for n in telemetry.RESOURCE_FEATURES] == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block", [3, 40])
def test_intervals_over_many_blocks(spark, block):
    """Intervals that begin, end or lie in other blocks than their samples, against all samples in one block."""
    import random

    rng = random.Random(9)
    rows = [(f"p{i % 2}" if i < 200 else "r", rng.randrange(10**6), rng.choice([None, 5.0, 70.0]), rng.choice([None, 1e6, 3e6]), rng.random()) for i in range(300)]
    rows = list({r[:2]: r for r in rows}.values()) + [(None, 5, 1.0, 1.0, 1.0)]
    series = spark.createDataFrame(rows, "program string, ts long, cpu double, mem double, disk double").cache()
    made = []
    for i in range(60):
        low = rng.randrange(-1000, 10**6)
        made.append((rng.choice(["p0", "p1", "r", "none", None]), i, low, low + rng.choice([-1, 0, 500, 40_000, 2 * 10**6])))
    made += [(r[0], 100 + i, r[1], r[1]) for i, r in enumerate(rows[:5])]
    intervals = spark.createDataFrame(made, "program string, id int, start_ns long, end_ns long").cache()

    def features_of(**how):
        got = telemetry.resource_features(intervals, series, ["program"], ["id"], width=64, **how).collect()
        return {r["id"]: [r[n] for n in telemetry.RESOURCE_FEATURES] for r in got}

    whole, cut = features_of(slices=1), features_of(slices=4, block=block)
    assert len(whole) == len(made)
    for program, i, low, high in made:
        assert cut[i] == pytest.approx(whole[i], rel=1e-9, abs=1e-9)
        mine = [r for r in rows if r[0] == program and program and low <= r[1] <= high]
        mine = mine or [r for r in rows if r[0] == program and program]
        assert whole[i][6] == pytest.approx(sum(r[4] for r in mine) / max(len(mine), 1) / 1e6)


def test_complexity_of_a_stub(spark):
    """Published value for one line, one call, no branches, no I/O."""
    df = spark.createDataFrame([(1, 0, 0, 0, 0, 1, False), (-1, 0, 0, 0, 0, 1, False)], "loc int, ifs int, switches int, loops int, nested_loops int, calls int, has_io boolean")
    got = [r["c"] for r in df.withColumn("c", ranking.static_complexity()).collect()]
    assert got[0] == pytest.approx(0.6852030263919617, rel=1e-15)
    assert got[1] == pytest.approx(got[0] - 0.2 * math.log(2))


def test_impact_is_criticality_over_complexity(spark):
    static = spark.createDataFrame([("p", f"f{i}", float(i), 11 - i) for i in range(1, 11)], "program string, function_name string, complexity double, static_rank long")
    dynamic = spark.createDataFrame([("p", f"f{i}", 10.0 * i, i) for i in range(1, 11)], "program string, function_name string, criticality double, dynamic_rank long")
    rows = ranking.hidden_bottlenecks(static, dynamic, top=4).collect()
    assert {r["function_name"]: r["impact_score"] for r in rows} == {f"f{i}": 10.0 for i in range(1, 5)}


def test_too_few_common_functions(spark):
    static = spark.createDataFrame([("p", f"f{i}", i) for i in range(1, 10)], "program string, function_name string, static_rank long")
    dynamic = static.withColumnRenamed("static_rank", "dynamic_rank")
    assert ranking.percentile_ranks(static, dynamic).isEmpty()
    normed = ranking.percentile_ranks(static, dynamic, at_least=9).collect()
    assert sorted(r["static_norm"] for r in normed) == [pytest.approx(i / 9) for i in range(1, 10)]


def test_interpretation_rungs(spark):
    base = {n: 0.0 for n in features.FEATURES}
    rows = [
        {"archetype": 0, **base, "path_depth": 33.0, "time_gini": 0.71, "cpu_mean": 51.0},
        {"archetype": 1, **base, "path_depth": 34.0, "time_gini": 0.5, "memory_growth": -11.0, "cpu_ratio": 0.51, "cpu_phases": 2.1},
        {"archetype": 2, **base, "path_depth": 67.0, "time_gini": 0.29, "io_ratio": 0.6, "memory_monotonic": 0.6},
    ]
    means = spark.createDataFrame(rows)
    limits = spark.createDataFrame(
        [(60.0, 50.0, 20.0, 10.0, 3.0, 1.0, 100)],
        "cpu_high double, cpu_medium double, memory_high double, memory_medium double, io_high double, io_medium double, max_path_depth int",
    )
    got = {r["archetype"]: tuple(r)[1:] for r in archetypes.interpret_archetypes(means, limits).collect()}
    assert got[0] == ("SHALLOW, CONCENTRATED", "CPU_MODERATE", "MIXED", "STABLE", "VOLATILE")
    assert got[1] == ("MEDIUM_DEPTH", "MEMORY_MODERATE", "CPU_BOUND", "PHASED", "VOLATILE")
    assert got[2] == ("DEEP, BALANCED", "LIGHTWEIGHT", "IO_BOUND", "STABLE", "MONOTONIC_GROWTH")
    fixed = {r["archetype"]: tuple(r)[1:3] for r in archetypes.interpret_archetypes(means).collect()}
    assert fixed[0] == ("DEEP, CONCENTRATED", "CPU_INTENSIVE") and fixed[1][1] == "MEMORY_GROWING"


def test_clusters(spark):
    points = [(i, [float(10 * (i % 3)) + (i // 3) * 0.01, float(i % 2)]) for i in range(60)]
    df = spark.createDataFrame(points, "i int, z array<double>").cache()
    centers = vectors.fit_centers(df, 3, starts=3)
    assert [r["size"] for r in centers.orderBy("id").collect()] == [20, 20, 20]
    labelled = vectors.assign_nearest(df, centers)
    sizes = {r["archetype"]: r["count"] for r in labelled.groupBy("archetype").count().collect()}
    assert sizes == {0: 20, 1: 20, 2: 20}
    tie = spark.createDataFrame([(7, [0.0]), (3, [2.0])], "id int, center array<double>")
    middle = spark.createDataFrame([([1.0],)], "z array<double>")
    assert vectors.assign_nearest(middle, tie).head()["archetype"] == 3
    table = {r["k"]: r["chosen"] for r in vectors.choose_k(df, 2, starts=2, largest=6).collect()}
    assert table == {2: False, 3: True, 4: False, 5: False}
    few = {r["k"]: r["silhouette_sq"] for r in vectors.choose_k(df.limit(9), 2).collect()}
    assert few == {2: None}


def test_nested_loops(spark):
    chain = [("f", i, i - 1 if i else None, tag) for i, tag in enumerate(["for", "block", "while", "if", "do", "block"])]
    flat = [("g", i, None, "for") for i in range(3)]
    df = spark.createDataFrame(chain + flat, "function_id string, element_id int, parent_id int, tag string")
    got = {r["function_id"]: r["nested_loops"] for r in elements.nested_loop_pairs(df).collect()}
    assert got == {"f": 3, "g": 0}


def test_lists_have_bounded_length(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id").alias("x"))
    rows = chunked_lists(df, ["g"], "x", "xs", per_row=100).collect()
    assert len(rows) == 50 and max(len(r["xs"]) for r in rows) < 200
    assert sorted(x for r in rows for x in r["xs"]) == list(range(5000))


def test_starting_centers_come_from_all_rows(spark):
    """Vectors that thousands of rows share, and a cluster of three rows."""
    hot = spark.range(15_000).select(F.when(F.col("id") < 3, F.array(F.lit(90.0), F.col("id") / 10)).otherwise(
        F.array((F.col("id") % 3).cast("double") * 10, F.lit(0.0))).alias("z"))
    found = vectors.fit_centers(hot, 4, starts=2).collect()
    assert sorted(r["size"] for r in found) == [3, 4999, 4999, 4999]
    drawn = vectors._starting_centers(hot, "z", 4, seed=1, starts=6)
    again = vectors._starting_centers(hot.repartition(5), "z", 4, seed=1, starts=6)
    assert [c.tolist() for c in drawn] == [c.tolist() for c in again]
    assert len({tuple(c[0]) for c in drawn}) > 1
