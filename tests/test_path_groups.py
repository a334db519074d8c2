"""From features to groups, their descriptions and the models built on them."""

from __future__ import annotations

import random

import pytest
from compare import DATA
from pyspark.sql import functions as F

from spanloom.operators import baseline, telemetry
from spanloom.operators.features import FEATURES
from spanloom.plans.bindings import Tables
from spanloom.plans.path_groups import DIM, PathGroups
from spanloom.plans.queries_traces import event_path_features
from spanloom.sources import tables


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(2)
    rows = []
    for i in range(90):
        kind = 0 if i < 45 else 1 if i < 75 else 2
        rows.append((f"p{i % 2}", i // 2, i % 3, 1000 + i, 5 + kind, kind, [rng.gauss(40 * kind, 1) for _ in range(DIM)]))
    frame = spark.createDataFrame(
        rows, "program string, input_id long, iteration int, path_duration_ns long, path_length int, kind int, features array<double>"
    )
    named = [F.get("features", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)]
    return PathGroups(frame.select("*", *named).cache(), starts=4)


def test_groups_are_the_planted_ones(groups):
    assert groups.chosen_k == 3
    pairs = {(r["kind"], r["archetype"]): r["count"] for r in groups.assigned.groupBy("kind", "archetype").count().collect()}
    # numbered by size, largest first
    assert pairs == {(0, 0): 45, (1, 1): 30, (2, 2): 15}


def test_profile_and_description_cover_every_group(groups):
    assert {r["archetype"]: r["size"] for r in groups.profile.collect()} == {0: 45, 1: 30, 2: 15}
    described = {r["archetype"]: r for r in groups.interpreted.collect()}
    assert sorted(described) == [0, 1, 2]
    assert "DEEP" in described[2]["primary_traits"] and "SHALLOW" in described[0]["primary_traits"]


def test_assignments_reach_the_models_through_their_file(spark, groups, tmp_path):
    path = str(tmp_path / "assignments")
    tables.write_assignments(groups.assigned.withColumn("path_rank", F.lit(1)), path)
    lookup = tables.archetype_lookup(tables.read_assignments(spark, path))
    runs = groups.assigned.select("program", "input_id", "iteration", F.col("archetype").alias("own"))
    known = baseline.attach_archetype(runs, lookup)
    assert known.where("archetype = own").count() == 90
    model = {(r["program"], r["archetype"]): r["count"] for r in baseline.archetype_model(known).collect()}
    assert sum(model.values()) == 90 and sorted({a for _, a in model}) == [0, 1, 2]


def test_telemetry_is_folded_once_for_paths_and_phases(spark, monkeypatch):
    folds = []
    fold = telemetry._node_states
    monkeypatch.setattr(telemetry, "_node_states", lambda *a: folds.append(a) or fold(*a))
    event_path_features(Tables(spark, f"{DATA}/sf0.001"))
    assert len(folds) == 1


def test_states_of_a_null_key_merge_in_one_shuffle(spark):
    rows = [(None, 0, 1.0), (None, 1, 5.0), ("r", 0, 2.0)]
    series = spark.createDataFrame([(r, t, v, v, v) for r, t, v in rows], "run string, ts long, cpu double, mem double, disk double")
    states = telemetry.FoldedTelemetry(series, ["run"], 10).samples
    whole = telemetry._merged(states, ["run"], None)
    assert {r["run"]: (r["cpu_mean"], r["cpu_square"], r["step_mean"]) for r in whole.collect()} == {None: (3.0, 8.0, 4.0), "r": (2.0, 0.0, None)}
