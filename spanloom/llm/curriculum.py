"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1. The integral of a
schedule is the source's share; shares that would repeat a source more than
``max_epochs`` times stop there and the excess is shared again by weight. The
documents of a source are laid end to end in hash order, once per epoch; a
document's place in that line is its cumulative demand, and the inverse of the
integrated schedule turns demand into a training position. Sorting by position
mixes the sources as the schedules ask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, free_name, joined_null_safe, running_total


@dataclass(frozen=True)
class Ramp:
    """A weight that moves on a line from ``first`` at time 0 to ``last`` at time 1."""

    first: float
    last: float

    @property
    def integral(self) -> float:
        return (self.first + self.last) / 2

    def position(self, share: Column) -> Column:
        """Time at which ``share`` of the integrated weight is spent."""
        slope = self.last - self.first
        area = share * F.lit(self.integral)
        return 2 * area / (F.lit(self.first) + F.sqrt(self.first * self.first + 2 * slope * area))


#: Integrals 5, 2 and 1, repeated over the sources in order: steady, rising, falling.
SCHEDULES = (Ramp(5.0, 5.0), Ramp(1.0, 3.0), Ramp(1.5, 0.5))


def word_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, schedules: tuple[Ramp, ...] = SCHEDULES, max_epochs: int = 3
) -> DataFrame:
    """Per source its size, schedule number and target.

    ``sizes`` has ``source`` and ``source_size``, one row per source. Sources in
    code-point order, null last, take the schedules in turn. A source stops at
    ``max_epochs`` times its size. Sorted by cap per weight, the sources that
    stop come first, so two running sums find the level all others share.
    """
    placed = running_total(
        sizes.withColumn("_last", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long")),
        [],
        ["_last", "source"],
        "_one",
        "_place",
        "mix-sources",
    ).drop("_last", "_one")
    number = F.pmod(F.col("_place"), F.lit(len(schedules))).cast("int")
    weight = F.lit(schedules[-1].integral)
    for i, ramp in enumerate(schedules[:-1]):
        weight = F.when(number == i, F.lit(ramp.integral)).otherwise(weight)
    capped = (
        placed.withColumn("schedule", number)
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    )
    total, weights = capped.agg(F.sum("source_size"), F.sum("_weight")).first()  # one row
    line = running_total(capped, [], ["_ratio", "_place"], "_cap", "_caps", "mix-caps")
    line = running_total(line, [], ["_ratio", "_place"], "_weight", "_passed", "mix-weights")
    line = (
        line.withColumn("_rest", F.lit(total or 0) - F.col("_caps"))
        .withColumn("_open", F.lit(weights or 0.0) - F.col("_passed"))
        .withColumn("_stops", F.col("_cap") * F.col("_open") <= F.col("_weight") * F.col("_rest"))
    )
    level = (
        line.where(~F.col("_stops"))
        .agg(F.min_by(F.struct("_rest", "_open"), F.struct("_ratio", "_place")).alias("level"))
        .first()
        .level
    )  # one row; null if every source stops, as in an empty table
    target = F.col("_cap").cast("double")
    if level is not None:
        shared = F.col("_weight") * F.lit(float(level._rest)) / F.lit(float(level._open))
        target = F.when(F.col("_stops"), target).otherwise(shared)
    return line.withColumn("target", target).select("source", "source_size", "schedule", "target")


def mixed(
    docs: DataFrame,
    *,
    schedules: tuple[Ramp, ...] = SCHEDULES,
    max_epochs: int = 3,
) -> DataFrame:
    """One row per document: its share of the mix and first training position.

    ``docs`` has ``doc_id``, ``source`` and ``text``; other columns are ignored.
    Columns out: ``doc_id, source, fingerprint`` (of source and text), ``size``
    (words), ``source_size``, ``target``, ``taken`` (words the mix takes,
    repeats counted), ``copies`` (how often it starts), ``position`` (of its
    first copy, null if none is taken).

    Epoch ``e`` of a source covers demand ``[e S, (e + 1) S)`` and the mix takes
    demand up to the target, so at most one document per source is cut and a
    source's taken words miss its target by less than one word. Null text and
    empty text have size 0 and are never taken; null source is a source of its
    own, after all others; repeated rows take places of their own; equal
    positions are ordered by document. An empty table gives an empty result.
    The order is a hash of the id, so reruns agree. Every step is a shuffle of
    thin rows; a source of any size spreads over range slices.
    """
    thin = docs.select(
        "doc_id",
        "source",
        F.xxhash64("source", "text").alias("fingerprint"),
        word_count(F.col("text")).alias("size"),
        F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("_order"),
    )
    line = running_total(
        thin, ["source"], ["_order", "doc_id", "fingerprint"], "size", "_start", "mix-documents"
    )
    sizes = line.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, schedules, max_epochs)
    line = joined_null_safe(line, targets, ["source"])
    cut = F.floor("target").cast("long")
    taken = F.lit(0).cast("long")
    copies = F.lit(0)
    for epoch in range(max_epochs):
        left = cut - F.lit(epoch) * F.col("source_size") - F.col("_start")
        here = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
        taken = taken + here
        copies = copies + (here > 0).cast("int")
    line = line.withColumn("taken", taken).withColumn("copies", copies)
    return line.withColumn("position", _position(F.col("_start"), schedules)).select(
        "doc_id", "source", "fingerprint", "size", "source_size", "target", "taken", "copies",
        F.when(F.col("taken") > 0, F.col("position")).alias("position"),
        "_start", "schedule",
    )


def _position(demand: Column, schedules: tuple[Ramp, ...]) -> Column:
    share = demand / F.col("target")
    position = schedules[-1].position(share)
    for i, ramp in enumerate(schedules[:-1]):
        position = F.when(F.col("schedule") == i, ramp.position(share)).otherwise(position)
    return position


def training_order(
    docs: DataFrame,
    *,
    schedules: tuple[Ramp, ...] = SCHEDULES,
    max_epochs: int = 3,
) -> DataFrame:
    """The documents in training order, whole, once for every copy that starts.

    Columns as in ``docs``. A document of which the mix takes nothing is left
    out. Rows alike in id, source and text share one entry of the plan, so none
    is multiplied; of their other columns the first row's stay.
    """
    columns = docs.columns
    mark, place = free_name(docs, "_fingerprint"), free_name(docs, "_position")
    key = ["doc_id", mark]
    plan = mixed(docs, schedules=schedules, max_epochs=max_epochs).where(F.col("copies") > 0)
    copies = plan.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_copy")
    )
    demand = F.col("_start") + F.col("_copy") * F.col("source_size")
    placed = copies.select(
        "doc_id", F.col("fingerprint").alias(mark), _position(demand, schedules).alias(place)
    )
    own = docs.withColumn(mark, F.xxhash64("source", "text")).dropDuplicates(key)
    return joined_null_safe(own, placed, key).orderBy(place, *key).select(*columns)
