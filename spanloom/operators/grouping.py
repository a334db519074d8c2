"""Nested lists of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def chunked_lists(
    df: DataFrame, by: list[str], item: str, out: str, *, per_row: int = 1000
) -> DataFrame:
    """Collect ``item`` per group into arrays of about ``per_row`` entries.

    A large group becomes several rows, told apart by ``part``; no row grows
    with its group. Parts are cut by a hash of the item, so they are stable.
    """
    sizes = df.groupBy(*by).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(per_row)).cast("int").alias("_parts")
    )
    return (
        df.join(sizes, by)
        .withColumn("part", F.pmod(F.xxhash64(*by, item), F.col("_parts")).cast("int"))
        .groupBy(*by, "part")
        .agg(F.array_sort(F.collect_list(item)).alias(out))
    )
