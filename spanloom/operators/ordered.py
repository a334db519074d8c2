"""Ordered scans over groups of any size.

A plain window puts a whole group into one task. Here rows are dealt by range of
group and sort key and written once; the slice of a row is the partition it fell
into, fixed from then on. A window runs inside each slice, and what earlier
slices of a group contribute is carried over: only the first group of a slice
can have begun before it, so at most one row per slice is carried, and that
table is broadcast. Slices follow the data: their number is that of a shuffle's
partitions, which adaptive execution merges where they are small. Every input
takes this path, whatever its size, and results are exact for any slices.

``slices`` fixes their number, for tests and for known sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import written


def _column(name_or_column: str | Column) -> Column:
    return F.col(name_or_column) if isinstance(name_or_column, str) else name_or_column


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(name) for name in order])


def _sliced(
    df: DataFrame, by: Sequence[str], order: Sequence[str], slices: int | None
) -> DataFrame:
    """Add ``_slice``: slices are ranges of ``(by, order)``, ascending by number."""
    keys = [*by, *order]
    dealt = df.repartitionByRange(*keys) if slices is None else df.repartitionByRange(slices, *keys)
    return written(dealt.withColumn("_slice", F.spark_partition_id()), "slices")


def _earlier(by: Sequence[str]) -> Window:
    """Slices of a group before the current one; one row per group and slice."""
    return Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def _carried(local: DataFrame, per_slice: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join what earlier slices of its group contribute to each row.

    ``per_slice`` holds only groups that began in an earlier slice: one row per
    slice at most, which bounds the broadcast.
    """
    keys = [*by, "_slice"]
    renamed = per_slice.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = [local[k].eqNullSafe(renamed[f"_on_{k}"]) for k in keys]
    return local.join(F.broadcast(renamed), same, "left").drop(*[f"_on_{k}" for k in keys])


def sliced_running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str | Column,
    out: str,
    *,
    slices: int | None = None,
) -> DataFrame:
    """``running_sum`` that keeps ``_slice`` for further windows.

    A window by ``[*by, "_slice", ...]`` after it needs no other shuffle.
    """
    sliced = _sliced(df.withColumn("_value", _column(value)), by, order, slices)
    before = (
        sliced.groupBy(*by, "_slice")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_before", F.sum("_total").over(_earlier(by)))
        .drop("_total")
        .where(F.col("_before").isNotNull())
    )
    within = Window.partitionBy(*by, "_slice").orderBy(*order)
    local = sliced.withColumn(
        "_local", F.sum("_value").over(within.rowsBetween(Window.unboundedPreceding, 0))
    )
    total = F.col("_local") + F.col("_before")
    return _carried(local, before, by).select(
        *df.columns, "_slice", F.coalesce(total, F.col("_local"), F.col("_before")).alias(out)
    )


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str | Column,
    out: str,
    *,
    slices: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` per group, in ascending ``order``.

    ``order`` must be unique within a group for a deterministic result.
    """
    return sliced_running_sum(
        df, by, order, value, out, slices=slices
    ).drop("_slice")


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    *,
    slices: int | None = None,
) -> DataFrame:
    """Several inclusive running sums in one ordered scan; values must not be null."""
    names = list(values)
    dealt = df.withColumns({f"_value_{n}": c for n, c in values.items()})
    sliced = _sliced(dealt, by, order, slices)
    before = (
        sliced.groupBy(*by, "_slice")
        .agg(*[F.sum(f"_value_{n}").alias(f"_total_{n}") for n in names])
        .select(*by, "_slice", *[F.sum(f"_total_{n}").over(_earlier(by)).alias(f"_before_{n}") for n in names])
        .where(F.col(f"_before_{names[0]}").isNotNull())
    )
    within = Window.partitionBy(*by, "_slice").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select(
        *df.columns, "_slice", *[F.sum(f"_value_{n}").over(upto).alias(f"_local_{n}") for n in names]
    )
    totals = [
        (F.col(f"_local_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in names
    ]
    return _carried(local, before, by).select(*df.columns, *totals)


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str,
    *,
    slices: int | None = None,
) -> DataFrame:
    """1-based row number per group in ascending ``order``."""
    return running_sum(
        df, by, order, F.lit(1).cast("long"), out, slices=slices
    )


def numbered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str,
    *,
    share: float = 1 / 256,
    slices: int | None = None,
) -> DataFrame:
    """``ranked`` for groups most of which are small; ``by`` must be columns of a table.

    Groups that hold more than ``share`` of all rows are found exactly (frequent
    items, then counted) and take the sliced path; the others are too small to
    weigh on a task and are numbered by a plain window: one shuffle, not written.
    """
    group = F.xxhash64(*by)
    keyed = df.select(group.alias("_group"))
    found = keyed.freqItems(["_group"], share).head()[0] or []
    if found:
        candidates = keyed.where(F.col("_group").isin(found)).groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
        least = keyed.count() * share
        found = [r["_group"] for r in candidates.where(F.col("n") > least).collect()]
    within = Window.partitionBy(*by).orderBy(*order)
    place = F.row_number().over(within).cast("long").alias(out)
    if not found:
        return df.select("*", place)
    large = group.isin(found)
    return df.where(~large).select("*", place).unionByName(ranked(df.where(large), by, order, out, slices=slices))


def ranked_descending(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str,
    *,
    slices: int | None = None,
) -> DataFrame:
    """1-based row number per group with every column of ``order`` descending."""
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    up = ranked(df, by, order, "_up", slices=slices)
    sized = up.join(size, list(by)) if by else up.withColumn("_size", size.scalar())
    return sized.select(
        *df.columns, (F.col("_size") + 1 - F.col("_up")).alias(out)
    )


def with_previous(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    out: str,
    *,
    slices: int | None = None,
) -> DataFrame:
    """Add ``out``: a struct of ``columns`` of the row before, null on the first."""
    payload = F.struct(*columns)
    sliced = _sliced(df, by, order, slices)
    tails = (
        sliced.groupBy(*by, "_slice")
        .agg(F.max_by(payload, _order_key(order)).alias("_tail"))
        .withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*by).orderBy("_slice")))
        .where(F.col("_tail").isNotNull())
    )
    within = Window.partitionBy(*by, "_slice").orderBy(*order)
    local = sliced.withColumn("_local", F.lag(payload).over(within))
    return _carried(local, tails, by).select(
        *df.columns, F.coalesce(F.col("_local"), F.col("_tail")).alias(out)
    )


def latest_before(
    probes: DataFrame,
    states: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    out: str,
    *,
    slices: int | None = None,
) -> DataFrame:
    """As-of join: for each probe the last state at or before it, else null.

    Both sides carry ``by`` and ``order``; ``out`` is a struct of the state's
    ``columns``. States sort before probes with an equal ``order``.
    """
    keys = [*by, *order]
    payload = F.struct(*columns)
    state_rows = states.select(*keys, F.lit(0).alias("_kind"), payload.alias("_state"))
    probe_rows = probes.select(
        *keys, F.lit(1).alias("_kind"), F.struct(*probes.columns).alias("_probe")
    )
    scan_order = [*order, "_kind"]
    merged = state_rows.unionByName(probe_rows, allowMissingColumns=True)
    sliced = _sliced(merged, by, scan_order, slices)
    carried = (
        sliced.groupBy(*by, "_slice")
        .agg(
            F.max_by(
                "_state", F.when(F.col("_state").isNotNull(), _order_key(scan_order))
            ).alias("_carry")
        )
        .withColumn("_carry", F.last("_carry", ignorenulls=True).over(_earlier(by)))
        .where(F.col("_carry").isNotNull())
    )
    within = Window.partitionBy(*by, "_slice").orderBy(*scan_order)
    local = sliced.withColumn(
        "_local",
        F.last("_state", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)),
    ).where(F.col("_probe").isNotNull())
    return _carried(local, carried, by).select(
        "_probe.*", F.coalesce(F.col("_local"), F.col("_carry")).alias(out)
    )


def fill_forward(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    *,
    slices: int | None = None,
) -> DataFrame:
    """Replace nulls in ``columns`` by the last earlier value of the group."""
    key = _order_key(order)
    sliced = _sliced(df, by, order, slices)
    carried = (
        sliced.groupBy(*by, "_slice")
        .agg(
            *[
                F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_carry_{c}")
                for c in columns
            ]
        )
        .withColumns(
            {
                f"_carry_{c}": F.last(f"_carry_{c}", ignorenulls=True).over(_earlier(by))
                for c in columns
            }
        )
        .where(reduce(or_, [F.col(f"_carry_{c}").isNotNull() for c in columns]))
    )
    within = (
        Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = sliced.withColumns({c: F.last(c, ignorenulls=True).over(within) for c in columns})
    return (
        _carried(local, carried, by)
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in columns})
        .select(*df.columns)
    )


def with_following(
    df: DataFrame,
    by: Sequence[str],
    position: str,
    columns: Sequence[str],
    *,
    steps: int = 1,
    block: int = 4096,
) -> DataFrame:
    """Add ``next<i>_<column>`` for i = 1..steps along a gap-free 0-based position.

    Positions are cut into blocks; the first ``steps`` rows of a block are also
    sent to the block before it as look-ahead and dropped afterwards, so one
    shuffle serves a group of any size.
    """
    own = F.floor(F.col(position) / F.lit(block)).cast("long")
    ahead = (F.col(position) % F.lit(block) < steps) & (own > 0)
    spread = df.withColumn(
        "_block", F.explode(F.when(ahead, F.array(own, own - 1)).otherwise(F.array(own)))
    )
    within = Window.partitionBy(*by, "_block").orderBy(position)
    nexts = [
        F.lead(name, step).over(within).alias(f"next{step}_{name}")
        for step in range(1, steps + 1)
        for name in columns
    ]
    return spread.select("*", *nexts).where(F.col("_block") == own).drop("_block")


def percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    *,
    weight: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group.

    Equal values are counted first; a running count then locates the two order
    statistics each percentile lies between. Nothing is buffered per group.
    Nulls are ignored. ``weight`` names how often a row's value occurs.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_x"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_count"))
    )
    sizes = counts.groupBy(*by).agg(F.sum("_count").alias("_n"))
    upto = running_sum(counts, by, ["_x"], "_count", "_upto", slices=slices)
    located = upto.join(sizes, list(by)) if by else upto.withColumn("_n", sizes.scalar())
    first = F.col("_upto") - F.col("_count")
    aggregates = []
    for name, probability in probabilities.items():
        place = F.lit(float(probability)) * (F.col("_n") - 1)
        for side, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            covers = (first <= index) & (index < F.col("_upto"))
            aggregates.append(F.max(F.when(covers, F.col("_x"))).alias(f"_{name}_{side}"))
    picked = located.groupBy(*by, "_n").agg(*aggregates)
    outputs = []
    for name, probability in probabilities.items():
        place = F.lit(float(probability)) * (F.col("_n") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outputs.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select(*by, *outputs)
