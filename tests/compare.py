"""Run registered queries against DuckDB.

    python tests/compare.py [sf] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = "/root/testdata"


def make_spark(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_duck(sf: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{sf}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value if value is None else str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree in columns, types of value and rows."""
    mine = rows_of(df.columns, df.collect())
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    theirs = rows_of(names, done.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; {mine[:2]} / {theirs[:2]}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} of {len(mine)} rows differ: {wrong[:2]}" if wrong else None


def main() -> None:
    args = sys.argv[1:]
    from spanloom.plans import catalog

    sf = args[0] if args else "sf0.01"
    wanted = args[1:]
    spark, con = make_spark(), make_duck(sf)
    bad = 0
    for name, run in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, f"{DATA}/{sf}")
            if name in catalog.ORACLES:
                problem = difference(df, con, catalog.ORACLES[name])
                state = "ok" if problem is None else f"WRONG {problem}"
                if problem is None and df.limit(1).isEmpty():
                    state = "ok (EMPTY)"
            else:
                rows = df.collect()
                state = f"rows={len(rows)} {rows[:2]}"
        except Exception as error:  # noqa: BLE001
            state = f"ERROR {str(error)[:700]}"
        bad += state.startswith(("WRONG", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.2f}s  {state}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
