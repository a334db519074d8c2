"""What several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import filterfalse
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.storage import written

#: Rows of an Arrow batch: a batch of texts or blocks stays at some tens of MB.
BATCH_ROWS = 256

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Python tasks of this subpackage get batches of ``BATCH_ROWS`` rows.

    They also look for the package where the driver found it, if it is there.
    """
    place = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if place not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, place]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: ``bytes.split`` cuts at ASCII white space only."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def joined_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join where null keys equal each other; keys come from ``left``."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = None
    for k in keys:
        one = same(left[k], renamed[f"_r_{k}"])
        on = one if on is None else on & one
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str, name: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same ``by``.

    Rows are dealt by range of ``(by, order)`` and written once, so the slice of
    a row is fixed and a group of any size spreads over slices. A window runs
    inside each slice; the totals of earlier slices, one row per group and
    slice, are added. Rows that tie in ``order`` take places in any order.
    """
    spark = df.sparkSession
    keys = [*by, *order]
    sliced = written(
        df.repartitionByRange(shuffle_width(spark), *keys).withColumn(
            "_slice", F.spark_partition_id()
        ),
        name,
    )
    totals = sliced.groupBy(*by, "_slice").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    inside = (
        Window.partitionBy("_slice", *by)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sliced.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        joined_null_safe(placed, totals, [*by, "_slice"])
        .withColumn(out, F.col("_own") + F.col("_base"))
        .drop("_own", "_base", "_slice")
    )


class Remembered(dict):
    """What a task has computed per word: two generations of at most ``most`` words each.

    The dict itself holds the newer one. Words asked for again move into it, so
    common words stay and rare ones go.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.older: dict = {}

    def missing(self, words: set) -> list:
        """Those of ``words`` that are not known; the others are in the dict afterwards."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        out = list(filterfalse(self.__contains__, words))
        older = self.older
        if not older:
            return out
        back = list(filter(older.__contains__, out))
        self.update(zip(back, map(older.__getitem__, back)))
        return list(filterfalse(self.__contains__, out)) if back else out
