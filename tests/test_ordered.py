"""Sliced scans against plain Python, with cuts every few rows and a hot group."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import ordered

CUTS = [1, 3, 100, None]


def rows(seed: int, n: int = 400) -> list[tuple[str, int, int, int | None]]:
    """Group a holds most rows; times repeat, ``seq`` is unique."""
    rng = random.Random(seed)
    return [
        (rng.choice("aaaab"), rng.randrange(60), seq, rng.choice([None, 1, 2, 3, 5, 8]))
        for seq in range(n)
    ]


@pytest.fixture(scope="module", params=[1])
def table(spark, request):
    data = rows(request.param)
    return spark.createDataFrame(data, "g string, t int, seq int, v int").cache(), data


def by_group(data):
    groups = defaultdict(list)
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        groups[row[0]].append(row)
    return groups


@pytest.mark.parametrize("cut", CUTS)
def test_running_sum_and_rank(table, cut):
    df, data = table
    out = ordered.running_sum(df, ["g"], ["t", "seq"], F.coalesce("v", F.lit(0)), "s", slices=cut)
    out = ordered.ranked(out, ["g"], ["t", "seq"], "r", slices=cut)
    expected = {}
    for group in by_group(data).values():
        total = 0
        for place, row in enumerate(group, 1):
            total += row[3] or 0
            expected[row[2]] = (total, place)
    assert {r["seq"]: (r["s"], r["r"]) for r in out.collect()} == expected


@pytest.mark.parametrize("cut", CUTS)
def test_descending_rank_without_groups(table, cut):
    df, data = table
    out = ordered.ranked_descending(df, [], ["t", "seq"], "r", slices=cut)
    ranked = sorted(data, key=lambda r: (r[1], r[2]), reverse=True)
    assert {r["seq"]: r["r"] for r in out.collect()} == {row[2]: i for i, row in enumerate(ranked, 1)}


@pytest.mark.parametrize("cut", CUTS)
def test_previous_and_fill_forward(table, cut):
    df, data = table
    out = ordered.with_previous(df, ["g"], ["t", "seq"], ["seq"], "p", slices=cut)
    filled = ordered.fill_forward(df, ["g"], ["t", "seq"], ["v"], slices=cut)
    previous, last = {}, {}
    for group in by_group(data).values():
        before, known = None, None
        for row in group:
            known = row[3] if row[3] is not None else known
            previous[row[2]], last[row[2]] = before, known
            before = row[2]
    assert {r["seq"]: r["p"] and r["p"]["seq"] for r in out.collect()} == previous
    assert {r["seq"]: r["v"] for r in filled.collect()} == last


@pytest.mark.parametrize("cut", CUTS)
def test_latest_before(table, cut):
    df, data = table
    states = df.where(F.col("seq") % 5 == 0)
    probes = df.where(F.col("seq") % 5 != 0)
    out = ordered.latest_before(probes, states, ["g"], ["t"], ["t"], "s", slices=cut)
    expected = {
        p[2]: max((s[1] for s in data if s[2] % 5 == 0 and s[0] == p[0] and s[1] <= p[1]), default=None)
        for p in data
        if p[2] % 5
    }
    assert {r["seq"]: r["s"] and r["s"]["t"] for r in out.collect()} == expected


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_following(spark, block):
    data = [("a", i, f"f{i}") for i in range(11)] + [("b", 0, "x")]
    df = spark.createDataFrame(data, "g string, pos int, f string")
    out = ordered.with_following(df, ["g"], "pos", ["f"], steps=2, block=block)
    names = {(g, p): f for g, p, f in data}
    got = {(r["g"], r["pos"]): (r["next1_f"], r["next2_f"]) for r in out.collect()}
    assert got == {(g, p): (names.get((g, p + 1)), names.get((g, p + 2))) for g, p in names}


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("by", [["g"], []])
def test_percentiles(table, cut, by):
    df, data = table
    probabilities = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p95": 0.95, "p100": 1.0}
    out = ordered.percentiles(df, by, "v", probabilities, slices=cut).collect()
    groups = defaultdict(list)
    for row in data:
        if row[3] is not None:
            groups[row[0] if by else None].append(row[3])
    for r in out:
        values = groups.pop(r["g"] if by else None)
        for name, p in probabilities.items():
            assert r[name] == pytest.approx(np.percentile(values, 100 * p))
    assert not groups


@pytest.mark.parametrize("count", [1, 3, 500])
@pytest.mark.parametrize("by", [["g"], []])
def test_one_group_in_many_slices(table, count, by):
    df, data = table
    alone = df.withColumn("g", F.lit("a"))
    out = ordered.ranked(alone, by, ["t", "seq"], "r", slices=count)
    ordered_rows = sorted(data, key=lambda r: (r[1], r[2]))
    assert {r["seq"]: r["r"] for r in out.collect()} == {row[2]: i for i, row in enumerate(ordered_rows, 1)}
    found = ordered._sliced(alone, by, ["t", "seq"], count)
    assert found.select("_slice").distinct().count() > min(count, 100) * 0.9


def test_null_groups_are_groups(spark):
    rows = [(None, i, i) for i in range(30)] + [("a", i, 100 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, t int, seq int")
    out = ordered.ranked(df, ["g"], ["t"], "r", slices=7)
    assert {r["seq"]: r["r"] for r in out.collect()} == {seq: t + 1 for _, t, seq in rows}


@pytest.mark.parametrize("share", [0.9, 0.5, 1 / 256])
def test_numbered_with_large_groups(table, share):
    df, data = table
    placed = ordered.numbered(df, ["g"], ["t", "seq"], "place", share=share, slices=7)
    expected = {r[2]: i for rows in by_group(data).values() for i, r in enumerate(rows, 1)}
    assert {r["seq"]: r["place"] for r in placed.collect()} == expected


def test_numbered_sends_small_groups_through_one_window(spark, monkeypatch):
    seen = []
    whole = ordered.ranked
    monkeypatch.setattr(ordered, "ranked", lambda df, *a, **k: seen.append({r["g"] for r in df.collect()}) or whole(df, *a, **k))
    data = [(None, i) for i in range(300)] + [(g, i) for g in range(1000) for i in range(2)]
    df = spark.createDataFrame(data, "g int, t int")
    placed = ordered.numbered(df, ["g"], ["t"], "place", share=0.1)
    assert all(r["place"] == r["t"] + 1 for r in placed.collect()) and placed.count() == len(data)
    assert seen == [{None}]
