from __future__ import annotations

from itertools import product

import pytest
from pyspark.sql import functions as F

from spanloom.operators import bookkeeping, calls, ranking


def test_all_combinations_once(spark):
    """The permutation is one to one, whatever the sizes."""
    for sizes in ((3, 5), (1, 7, 2), (4,), (2, 3, 1, 5)):
        options = {f"p{i}": spark.range(s).select(F.col("id").alias("v")) for i, s in enumerate(sizes)}
        rows = bookkeeping.sample_combinations(options, 10_000).collect()
        assert sorted(tuple(r)[1:] for r in rows) == sorted(product(*map(range, sizes)))
        assert sorted(r["draw"] for r in rows) == list(range(len(rows)))
    few = {"a": spark.range(3), "b": spark.range(0)}
    assert bookkeeping.sample_combinations(few, 5).isEmpty()


def test_a_grid_of_a_trillion(spark):
    options = {f"p{i}": spark.range(1000).select(F.col("id").cast("string").alias("v")) for i in range(4)}
    rows = bookkeeping.sample_combinations(options, 400).collect()
    assert len({tuple(r)[1:] for r in rows}) == 400
    # draws spread over every list
    assert all(len({r[f"p{i}"] for r in rows}) > 250 for i in range(4))
    again = bookkeeping.sample_combinations(options, 400).collect()
    other = bookkeeping.sample_combinations(options, 400, seed=7).collect()
    assert sorted(rows) == sorted(again) != sorted(other)
    with pytest.raises(ValueError):
        bookkeeping.sample_combinations({f"p{i}": options["p0"] for i in range(7)}, 1)


def test_sums_beyond_64_bits(spark):
    """Two durations of 5e18 ns."""
    big = 5 * 10**18
    stats = spark.createDataFrame([("f", big, big), ("f", big, big), ("g", 1, 1)], "function_name string, duration long, self_time long")
    f, g = calls.hotspots(stats).collect()
    assert (f["total_duration"], f["total_self_time"], f["avg_duration"]) == (2 * big, 2 * big, float(big))
    assert f["self_share"] == pytest.approx(1.0) and g["function_name"] == "g"
    functions = spark.createDataFrame([("p", "f", big, big, 1)] * 2, "program string, function_name string, duration_ns long, self_time_ns long, path_rank long")
    paths = spark.createDataFrame([("p",)], "program string")
    found = ranking.dynamic_stats(functions, functions.limit(1).select("program", "function_name"), paths)
    assert found.first()["total_duration_ns"] == 2 * big
    assert ranking.dynamic_criticality(found).first()["avg_duration_ns"] == float(big)
