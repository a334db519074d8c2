from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from spanloom.operators import baseline, increments
from spanloom.operators.baseline import RUN
from spanloom.operators.increments import ModelStore

RUNS = (
    "program string, input_id long, iteration int, is_regression boolean, path_length long, path_duration_ns long, "
    "bottleneck_function string, cpu_avg double, memory_avg double, io_avg double, archetype int"
)
FUNCTIONS = "program string, input_id long, iteration int, is_regression boolean, pos long, function_name string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    runs, functions = [], []
    for program in ("p", "q"):
        for input_id in range(9):
            for iteration in range(3):
                key = (program, input_id, iteration, False)
                names = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
                functions += [(*key, pos, name) for pos, name in enumerate(names)]
                slow = names[-1] if len(names) > 1 else None
                load = [None if rng.random() < 0.2 else rng.randrange(8) / 4 for _ in range(3)]
                runs.append((*key, len(names), 10**15 + rng.randrange(50), slow, *load, rng.randrange(3)))
    return spark.createDataFrame(runs, RUNS).cache(), spark.createDataFrame(functions, FUNCTIONS).cache()


def rows(df, columns):
    return sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in df.select(*columns).collect()),
        key=repr,
    )


def same(mine, full):
    assert rows(mine, full.columns) == rows(full, full.columns)


def test_batches_equal_one_build(spark, tables, tmp_path):
    runs, functions = tables
    store = ModelStore(spark, str(tmp_path / "models"))
    assert store.manifest.isEmpty() and store.ngram_model().isEmpty()
    # iterations of an input arrive in different batches, and the last call brings all
    for upto in (0, 1, 2):
        assert store.add(runs.where(F.col("iteration") <= upto), functions) == upto + 1
    assert store.add(runs, functions) is None
    assert store.manifest.count() == runs.count()
    same(store.function_frequency_model(), baseline.function_frequency_model(functions))
    same(store.ngram_model(), baseline.ngram_model(functions, RUN))
    same(store.bottleneck_model(), baseline.bottleneck_model(runs))
    same(store.length_model(), baseline.length_model(runs))
    same(store.resource_model(), baseline.resource_model(runs))
    same(store.archetype_model(), baseline.archetype_model(runs))
    same(store.archetype_transitions(), baseline.archetype_transitions(runs))
    # Sums of durations about 1e15 lose their last digits in a plain average: held against exact ones.
    got = {r["program"]: r for r in store.bounds_model().collect()}
    full = baseline.bounds_model(runs)
    exact = [c for c in full.columns if c not in ("duration_mean", "duration_std")]
    assert rows(store.bounds_model(), exact) == rows(full, exact)
    for program in got:
        took = [r[0] for r in runs.where(F.col("program") == program).select("path_duration_ns").collect()]
        assert got[program]["duration_mean"] == pytest.approx(float(statistics.fmean(took)), rel=1e-15)
        assert got[program]["duration_std"] == pytest.approx(float(statistics.pstdev(took)), rel=1e-9)


def test_failed_batch_does_not_count(spark, tables, tmp_path, monkeypatch):
    runs, functions = tables
    store = ModelStore(spark, str(tmp_path / "models"))
    first, rest = runs.where("input_id < 5"), runs.where("input_id >= 5")
    store.add(first, functions)
    before = rows(store.ngram_model(), ["program", "ngram", "frequency"])

    whole = increments.partial_states

    def failing(*args):
        states = whole(*args)
        broken = states["values"].withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
        return {**states, "values": broken}

    monkeypatch.setattr(increments, "partial_states", failing)
    with pytest.raises(Exception, match="lost"):
        store.add(rest, functions)
    assert rows(store.ngram_model(), ["program", "ngram", "frequency"]) == before
    assert store.pending(runs).count() == rest.count()

    monkeypatch.setattr(increments, "partial_states", whole)
    assert store.add(rest, functions) == 2
    same(store.ngram_model(), baseline.ngram_model(functions, RUN))
    same(store.resource_model(), baseline.resource_model(runs))


def test_repeated_runs_count_once(spark, tables, tmp_path):
    runs, functions = tables
    store = ModelStore(spark, str(tmp_path / "models"))
    store.add(runs.union(runs), functions)
    same(store.length_model(), baseline.length_model(runs))
    assert store.add(runs.limit(0), functions.limit(0)) is None
