"""Euclidean means from projections against all pairs of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from spanloom.operators import archetypes, vectors

DIM = 12
SCHEMA = "row long, archetype int, z array<double>"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    sizes = {0: 150, 1: 60, 2: 30, 7: 1}
    x = np.concatenate([rng.normal(3 * c, 1 + c, (n, DIM)) for c, n in sizes.items()])
    labels = np.repeat(list(sizes), list(sizes.values()))
    x[5] = x[6]  # rows alike
    rows = [(i, int(c), [float(v) for v in p]) for i, (c, p) in enumerate(zip(labels, x))]
    rows += [(900, None, [0.0] * DIM), (901, 1, None)]
    return spark.createDataFrame(rows, SCHEMA).cache(), x, labels


@pytest.mark.parametrize("slices", [None, 5])
def test_distances_along_the_directions_are_exact(points, slices):
    df, x, labels = points
    got = vectors.cluster_distances(df, DIM, ["row"], count=24, slices=slices).collect()
    shadows = x @ np.array(vectors.directions(DIM, 24)).T
    assert len(got) == len(x)
    for r in got:
        apart = np.abs(shadows - shadows[r["row"]]).sum(axis=1) / (24 * vectors.mean_projection(DIM))
        for c in r["distances"]:
            assert c["n"] == (labels == c["id"]).sum()
            assert c["total"] == pytest.approx(apart[labels == c["id"]].sum(), abs=1e-6)


def test_means_come_near_those_of_all_pairs(points):
    df, x, labels = points
    table = vectors.cluster_distances(df, DIM, ["row"], count=240).cache()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    scores = []
    for i, c in enumerate(labels):
        n = (labels == c).sum()
        a = d[i, labels == c].sum() / max(n - 1, 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {c})
        scores.append((b - a) / max(a, b) if n > 1 else 0.0)
    got = vectors.silhouette_euclidean(table).head()
    assert got["n"] == len(x) and got["silhouette"] == pytest.approx(np.mean(scores), rel=0.02)
    overall = d.sum() / (len(x) * (len(x) - 1))
    for r in archetypes.purity_euclidean(table).collect():
        n = r["size"]
        mask = labels == r["archetype"]
        assert n == mask.sum()
        inner = d[np.ix_(mask, mask)].sum() / max(n * (n - 1), 1)
        assert 1 - r["purity"] == pytest.approx(inner / overall if n > 1 else 0.0, rel=0.02)


def test_one_cluster_and_no_rows(spark, points):
    df, _, _ = points
    one = vectors.cluster_distances(df.where("archetype = 0"), DIM, ["row"])
    assert vectors.silhouette_euclidean(one).head()["silhouette"] == 0.0
    assert archetypes.purity_euclidean(one).head()["purity"] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        vectors.cluster_distances(spark.range(65).selectExpr("id AS row", "id AS archetype", "array(1D) AS z"), 1, ["row"])
    assert vectors.silhouette_euclidean(
        vectors.cluster_distances(df.where("row < 0"), DIM, ["row"])
    ).head()["n"] == 0


def test_kmeans_step_compares_sets_of_one_size_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(700, 5))
    sets = [rng.normal(size=(k, 5)) for k in (2, 4, 2, 3)]
    df = spark.createDataFrame([(p.tolist(),) for p in points], "z array<double>")
    for (new, sizes, cost), own in zip(vectors._step(df, "z", sets), sets):
        far = ((points[:, None] - own) ** 2).sum(axis=2)
        label = far.argmin(axis=1)
        assert np.allclose(new, [points[label == j].mean(axis=0) for j in range(len(own))])
        assert sizes.tolist() == np.bincount(label, minlength=len(own)).tolist()
        assert np.isclose(cost, far.min(axis=1).sum())
    many = [rng.normal(size=(2, 5)) for _ in range(30)]
    task = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: task.append(f) or self.sparkSession.createDataFrame([], schema))
    vectors._step(df, "z", many)
    products = []
    whole = vectors._far
    monkeypatch.setattr(vectors, "_far", lambda x, own: products.append(own.shape) or whole(x, own))
    batch = pa.RecordBatch.from_arrays([pa.array(points[:512].tolist(), pa.list_(pa.float64()))], ["z"])
    assert next(task[0](iter([batch]))).num_rows == 60
    assert products == [(30, 2, 5)]


def test_kmeans_passes_read_packed_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(700, 5)), rng.normal(size=(500, 5)) + 9])
    df = spark.createDataFrame([(p.tolist(),) for p in points], "z array<double>").repartition(3)
    sets = [rng.normal(size=(k, 5)) for k in (2, 3)]
    plain, packed = vectors._step(df, "z", sets), vectors._step(vectors._packed(df, "z"), "z", sets)
    for (new, sizes, cost), (other, same, again) in zip(plain, packed):
        assert np.allclose(new, other) and sizes.tolist() == same.tolist() and np.isclose(cost, again)
    kinds = []
    step = vectors._step
    monkeypatch.setattr(vectors, "_step", lambda rows, column, centers: kinds.append(dict(rows.dtypes)[column]) or step(rows, column, centers))
    assert sorted(r["size"] for r in vectors.fit_centers(df, 2, starts=3).collect()) == [500, 700]
    assert set(kinds) == {"binary"}


def test_candidates_are_scored_together(spark, monkeypatch):
    """One pass for the clusters and one for the scores, whatever the number of candidates."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(40, 3)) + 5, np.zeros((20, 3))])
    df = spark.createDataFrame([(p.tolist(),) for p in points], "z array<double>").repartition(3)
    sets = [points[rng.choice(120, k, replace=False)] for k in (2, 3, 7)] + [np.zeros((2, 3)), np.array([[0.0] * 3, [99.0] * 3])]
    sets[2][3] = sets[2][4]  # of equal centres the first counts
    alone = []
    for own in sets:
        centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(own)], "id int, center array<double>")
        alone.append(vectors.silhouette(vectors.assign_nearest(df, centers), 3).head()["silhouette_sq"])
    assert vectors._silhouettes(df, "z", sets) == [None if s is None else pytest.approx(s, rel=1e-9) for s in alone]
    scored, passes = [], []
    monkeypatch.setattr(vectors, "assign_nearest", lambda *a, **k: passes.append(a))
    together = vectors._silhouettes
    monkeypatch.setattr(vectors, "_silhouettes", lambda rows, column, own: scored.append(len(own)) or together(rows, column, own))
    vectors.choose_k(df, 3, starts=2, largest=6)
    assert scored == [4] and not passes
