from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import detectors, evaluation

SCHEMA = "program string, input_id long, iteration int, is_regression boolean, a double, b double"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(8)
    base = [("p", i, 0, False, rng.gauss(0, 1), rng.gauss(5, 2)) for i in range(600)]
    base += [("tiny", i, 0, False, 0.0, float(i)) for i in range(9)]
    judged = [("p", 1000 + i, 0, True, rng.gauss(0, 1), rng.gauss(5, 2)) for i in range(200)]
    judged += [("p", 2000, 0, True, 30.0, 80.0), ("tiny", 5000, 0, True, 99.0, 99.0)]
    return spark.createDataFrame(base, SCHEMA).cache(), spark.createDataFrame(judged, SCHEMA).cache()


@pytest.mark.parametrize("block", [7, 50])
def test_isolation_forest(data, block):
    base, judged = data
    flags = detectors.isolation_forest(base, judged, ["a", "b"], "f", trees=40, sample=64, block=block)
    got = {r["input_id"]: r["flagged"] for r in flags.collect()}
    assert len(got) == 202 and got[2000] and not got[5000]
    assert 0.04 < sum(got.values()) / 200 < 0.2


def test_blocks_do_not_change_scores(data):
    base, judged = data
    few, many = (
        {
            r["input_id"]: r["flagged"]
            for r in detectors.isolation_forest(
                base, judged, ["a", "b"], "f", trees=20, sample=32, block=block
            ).collect()
        }
        for block in (3, 20)
    )
    assert few == many


def test_trees_split_as_a_walk_over_their_rows_says(spark):
    rng = random.Random(5)
    rows = [("p", t, 20, [float(rng.randint(0, 6)), 3.0, rng.random()]) for t in range(3) for _ in range(20)]
    rows += [("q", 0, 2, [1.0, 1.0, 1.0])] * 2
    samples = spark.createDataFrame(rows, "program string, tree int, rows long, x array<double>")
    grown = {}
    for r in detectors.grow_trees(samples, 3, levels=5).collect():
        grown[r["program"], r["tree"], r["node"]] = (r["feature"], r["cut"])

    def depth(n):
        return 2 * (math.log(n - 1) + detectors.EULER_GAMMA) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def walk(program, tree, node, level, part):
        feature, cut = grown.pop((program, tree, node))
        varied = [i for i in range(3) if len({x[i] for x in part}) > 1]
        if level == 5 or 2**level >= len([r for r in rows if r[:2] == (program, tree)]) or not varied:
            assert (feature, cut) == (-1, round((level + depth(len(part))) * 1e6))
            return
        assert feature in varied and min(x[feature] for x in part) <= cut < max(x[feature] for x in part)
        walk(program, tree, 2 * node, level + 1, [x for x in part if x[feature] <= cut])
        walk(program, tree, 2 * node + 1, level + 1, [x for x in part if x[feature] > cut])

    for program, tree in (("p", 0), ("p", 1), ("p", 2), ("q", 0)):
        walk(program, tree, 1, 0, [r[3] for r in rows if r[:2] == (program, tree)])
    assert not grown


def test_trees_grow_in_one_shuffle(spark):
    samples = spark.createDataFrame([("p", 0, 2, [1.0])], "program string, tree int, rows long, x array<double>")
    plan = detectors.grow_trees(samples, 1, levels=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_one_class(data):
    base, judged = data
    flags = detectors.one_class_kernel(base, judged, ["a", "b"], "o", frequencies=64)
    got = {r["input_id"]: r["flagged"] for r in flags.collect()}
    assert len(got) == 202 and got[2000] and not got[5000]
    assert 0.03 < sum(got.values()) / 200 < 0.25


def test_frequencies_average_to_the_kernel():
    waves = detectors.kernel_frequencies(3, 20_000)
    for delta in ([0.1, 0.2, 0.0], [1.0, -1.0, 0.5]):
        mean = sum(math.cos(sum(w * d for w, d in zip(wave, delta))) for wave in waves) / len(waves)
        assert mean == pytest.approx(math.exp(-sum(d * d for d in delta) / 3), abs=0.02)


def test_comparison_table(spark):
    rows = [("p", i, 0, i % 2 == 0, name, (i % 4 == 0) if name == "threshold" else i < 3)
            for i in range(8) for name in ("threshold", "resource_only_threshold")]
    flags = spark.createDataFrame(rows, "program string, input_id long, iteration int, is_regression boolean, detector string, flagged boolean")
    table = evaluation.compare_detectors(flags)
    got = {r["detector"]: r for r in table.collect()}
    first = got["threshold"]
    assert (first["precision"], first["recall"], first["num_features"]) == (1.0, 0.5, 1)
    assert first["auc"] == 0.75 and first["uses_critical_paths"]
    own = spark.createDataFrame([(1.0, 1.0, 1.0)], "precision double, recall double, f1_score double")
    gains = {r["rival"]: r for r in evaluation.path_benefit(own, table).collect()}
    assert gains["best_path_based"]["recall_gain_pct"] == pytest.approx(100.0)
    assert gains["best_resource_only"]["detector"] == "resource_only_threshold"


def test_kernel_model_is_built_once_and_scores_as_a_kernel_mean(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    x[30:] += 6
    rows = [("p", i, 0, False, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "program string, input_id long, iteration int, is_regression boolean, a double, b double")
    names = []
    whole = detectors.written
    monkeypatch.setattr(detectors, "written", lambda df, name: names.append(name) or whole(df, name))
    flags = detectors.one_class_kernel(df.where("input_id < 30"), df, ["a", "b"], "one", frequencies=8)
    waves = np.array(detectors.kernel_frequencies(2, 8))
    base = x[:30]
    turned = (x - base.mean(axis=0)) / base.std(axis=0) @ waves.T
    scores = (np.cos(turned) * np.cos(turned[:30]).mean(axis=0) + np.sin(turned) * np.sin(turned[:30]).mean(axis=0)).mean(axis=1)
    cut = np.quantile(scores[:30], 0.1)
    found = {r["input_id"]: r["flagged"] for r in flags.collect()}
    assert found == {i: bool(s < cut) for i, s in enumerate(scores)}
    assert names == ["kernel-model", "kernel-scores"]


def test_runs_stream_past_their_forest(spark):
    """Depths as by walking each tree; every run once, not once for each block of trees."""
    # heap numbers 0..7: a split at 1, a leaf at 2, a split at 3, leaves at 6 and 7
    feature = [None, 0, -1, 1, None, None, -1, -1]
    cut = [None, 1.0, 1e6, 5.0, None, None, 2e6, 3e6]
    trees = [("p", 8, feature, cut), ("p", 8, feature, [None, 4.0, 1e6, 2.0, None, None, 2e6, 7e6])]
    forest = spark.createDataFrame(trees, "program string, rows long, _feature array<int>, _cut array<double>")
    runs = [("p", i, i % 2, False, [float(i % 7), float(i % 9)], i % 3 == 0) for i in range(50)]
    runs += [("q", 1, 1, False, [0.0, 0.0], True), (None, 2, 1, False, [0.0, 0.0], True)]
    everything = spark.createDataFrame(runs, "program string, input_id long, iteration int, is_regression boolean, x array<double>, _base boolean")

    def depth(x, cuts):
        node = 1
        while feature[node] >= 0:
            node = 2 * node + (x[feature[node]] > cuts[node])
        return cuts[node]

    got = detectors._fallen(everything, forest, 2, 3).collect()
    assert len(got) == 50 and {r["program"] for r in got} == {"p"} and {r["rows"] for r in got} == {8}
    depths = {r["input_id"]: r["_depth"] for r in got}
    assert depths == {i: sum(depth(x, c) for _, _, _, c in trees) for p, i, _, _, x, _ in runs if p == "p"}
