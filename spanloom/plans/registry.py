"""Named queries over the driver's tables, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bindings import Tables
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Body = Callable[[Tables], DataFrame]

# Decimals a marked double is rounded to.
DIGITS = {"~": 6, "^": 10}


def _shaped(token: str) -> tuple[str, str]:
    """Split a column token into its mark and name."""
    return (token[0], token[1:]) if token[0] in "~^#" else ("", token)


def _column(token: str) -> Column:
    mark, name = _shaped(token)
    if mark in DIGITS:
        return (F.round(F.col(name).cast("double"), DIGITS[mark]) + F.lit(0.0)).alias(name)
    return F.col(name).cast("bigint").alias(name) if mark == "#" else F.col(name)


def _sql_column(token: str) -> str:
    mark, name = _shaped(token)
    quoted = f'"{name}"'
    if mark in DIGITS:
        return f"round(CAST({quoted} AS DOUBLE), {DIGITS[mark]}) + 0.0 AS {quoted}"
    return f"CAST({quoted} AS BIGINT) AS {quoted}" if mark == "#" else quoted


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Body], Body]:
    """Register a query returning ``columns``; ``sql`` is its FROM clause or statement.

    Marks fix how both sides present a column: ``~x`` a double to six decimals,
    ``^x`` to ten (where six would cut exact halves), ``#x`` a 64-bit integer,
    ``x`` as it is.
    """
    tokens = columns.split()

    def register(body: Body) -> Body:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return body(Tables(spark, sf_dir)).select(*[_column(t) for t in tokens])

        QUERIES[name] = run
        if sql is not None:
            source = f"({sql.strip()})" if sql.strip().upper().startswith(("SELECT", "WITH")) else sql
            ORACLES[name] = with_views(
                f"SELECT {', '.join(_sql_column(t) for t in tokens)} FROM {source} AS answer"
            )
        return body

    return register
