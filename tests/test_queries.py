"""Every registered query on the smallest tables, against DuckDB where SQL exists."""

from __future__ import annotations

import pytest
from compare import DATA, difference

from spanloom.plans import (
    catalog,
    queries_groups,
    queries_increments,
    queries_ranking,
    queries_regression,
    queries_runs,
    queries_sources,
    queries_traces,
)


@pytest.fixture(scope="module", autouse=True)
def shared_steps():
    """Queries of one family share their written steps here, to save test time."""
    patch = pytest.MonkeyPatch()

    def once(build):
        kept = []

        def shared(t):
            if not kept:
                kept.append(build(t))
            return kept[0]

        return shared

    ranking = once(queries_ranking.analysis)
    regression = once(queries_regression.analysis)
    patch.setattr(queries_ranking, "analysis", ranking)
    patch.setattr(queries_sources, "ranking_analysis", ranking)
    patch.setattr(queries_regression, "analysis", regression)
    patch.setattr(queries_runs, "regression_analysis", regression)
    patch.setattr(queries_increments, "store", once(queries_increments.store))
    patch.setattr(queries_traces, "analysis", once(queries_traces.analysis))
    features = once(queries_traces.event_path_features)
    patch.setattr(queries_traces, "event_path_features", features)
    patch.setattr(queries_groups, "event_path_features", features)
    patch.setattr(queries_groups, "assigned", once(queries_groups.assigned))
    yield
    patch.undo()


SPARK_TO_DUCK = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    described = duck.execute(f"DESCRIBE {catalog.ORACLES[name]}").fetchall()
    expected = {row[0]: str(row[1]) for row in described}
    assert {c: SPARK_TO_DUCK[t] for c, t in df.dtypes} == expected
    assert difference(df, duck, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert not catalog.QUERIES[name](spark, f"{DATA}/sf0.001").isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
