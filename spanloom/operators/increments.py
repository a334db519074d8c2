"""Baseline models kept as mergeable partial states, one batch of runs at a time.

A batch adds counts, sums and exact value histograms; a model is finished from
the sum of all batches, so increments equal one build over all runs. Batches are
only ever added: their states are written first and the manifest of their runs
last, and a batch counts once its manifest is there. What a failed attempt left
carries the number the next attempt overwrites. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import baseline
from .baseline import RESOURCES, RUN
from .ordered import percentiles

#: Columns of a state table: its keys, then what is summed over batches.
STATES = {
    "functions": (["program", "function_name"], {"frequency": "long", "position_sum": "double"}),
    "ngrams": (["program", "ngram"], {"frequency": "long"}),
    "bottlenecks": (["program", "bottleneck_function"], {"frequency": "long"}),
    "values": (["program", "measure", "value"], {"n": "long"}),
}
TEXT = {"program", "function_name", "ngram", "bottleneck_function", "measure"}
MANIFEST = "program string, input_id long, iteration long, is_regression boolean, archetype long, batch long"
MEASURES = ("path_length", "path_duration_ns", *[f"{r}_avg" for r in RESOURCES])


def partial_states(runs: DataFrame, functions: DataFrame) -> dict[str, DataFrame]:
    """What a batch of runs and the functions of their first paths add to each state."""
    lengths = functions.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_n"))
    measures = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in MEASURES]
    )
    return {
        "functions": functions.join(lengths, RUN)
        .groupBy("program", "function_name")
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            F.sum(F.col("pos") / F.col("_n")).alias("position_sum"),
        ),
        "ngrams": baseline.ngram_model(functions, RUN),
        "bottlenecks": baseline.bottleneck_model(runs),
        "values": runs.select("program", F.inline(measures))
        .where(F.col("value").isNotNull())
        .groupBy("program", "measure", "value")
        .agg(F.count(F.lit(1)).alias("n")),
    }


def moments(values: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, population deviation, least and greatest of a value histogram.

    Squares are taken about the mean, which this second pass corrects for what
    its own sum lost: small spreads of large values keep their digits.
    """
    total = F.sum("n")
    first = values.groupBy(*by).agg(
        total.alias("rows"),
        (F.sum(F.col("value") * F.col("n")) / total).alias("_about"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
    )
    apart = F.col("value") - F.col("_about")
    second = (
        values.join(first.select(*by, "_about"), by)
        .groupBy(*by)
        .agg(
            (F.sum(apart * F.col("n")) / total).alias("_off"),
            (F.sum(apart * apart * F.col("n")) / total).alias("_square"),
        )
    )
    variance = F.greatest(F.lit(0.0), F.col("_square") - F.col("_off") * F.col("_off"))
    return first.join(second, by).select(
        *by,
        "rows",
        (F.col("_about") + F.col("_off")).alias("mean"),
        F.sqrt(variance).alias("std"),
        "least",
        "greatest",
    )


@dataclass
class ModelStore:
    """Model states of normal runs below ``root``, a folder all executors reach."""

    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def manifest(self) -> DataFrame:
        """Runs already in, with the number of their batch."""
        return self._read("manifest", MANIFEST)

    def pending(self, runs: DataFrame) -> DataFrame:
        """Runs that no batch holds yet."""
        return runs.join(self.manifest.select(*RUN), RUN, "left_anti")

    def add(self, runs: DataFrame, functions: DataFrame) -> int | None:
        """Fold runs that are not in yet, as the next batch; None if there are none.

        ``runs`` are run features with ``archetype``, one row per run;
        ``functions`` those of first paths. Functions of other runs, those of
        earlier batches among them, are passed over; repeated run rows count once.
        """
        fresh = self.pending(runs).dropDuplicates(RUN)
        if fresh.isEmpty():
            return None
        batch = (self.manifest.agg(F.max("batch")).head()[0] or 0) + 1
        folder = f"batch={batch}"
        mine = functions.join(fresh.select(*RUN), RUN, "left_semi")
        for name, state in partial_states(fresh, mine).items():
            state.write.mode("overwrite").parquet(f"{self.root}/{name}/{folder}")
        # The manifest last: with it the batch counts.
        fresh.select(
            "program",
            *[F.col(c).cast("long").alias(c) for c in ("input_id", "iteration")],
            "is_regression",
            F.col("archetype").cast("long").alias("archetype"),
        ).write.mode("overwrite").parquet(f"{self.root}/manifest/{folder}")
        return batch

    def state(self, name: str, measures: Iterable[str] = ()) -> DataFrame:
        """A state summed over the batches that count; of ``values`` some measures only."""
        keys, sums = STATES[name]
        columns = [f"{k} {'string' if k in TEXT else 'double'}" for k in keys]
        schema = ", ".join([*columns, *[f"{k} {kind}" for k, kind in sums.items()], "batch long"])
        rows = self._read(name, schema)
        if measures:
            rows = rows.where(F.col("measure").isin(*measures))
        whole = self.manifest.select("batch").distinct()
        return (
            rows.join(whole, "batch", "left_semi")
            .groupBy(*keys)
            .agg(*[F.sum(k).alias(k) for k in sums])
        )

    def function_frequency_model(self) -> DataFrame:
        return self.state("functions").select(
            "program",
            "function_name",
            "frequency",
            (F.col("position_sum") / F.col("frequency")).alias("mean_position"),
        )

    def ngram_model(self) -> DataFrame:
        return self.state("ngrams")

    def bottleneck_model(self) -> DataFrame:
        return self.state("bottlenecks")

    def length_model(self) -> DataFrame:
        return moments(self.state("values", ["path_length"]), ["program"]).select(
            "program",
            F.col("mean").alias("path_length_mean"),
            F.col("std").alias("path_length_std"),
            F.col("rows").alias("total_paths"),
        )

    def resource_model(self) -> DataFrame:
        """Mean, population deviation, p95 and p99 per program and resource."""
        named = self.state("values", [f"{r}_avg" for r in RESOURCES]).withColumn(
            "resource", F.regexp_replace("measure", "_avg$", "")
        )
        keys = ["program", "resource"]
        tails = percentiles(named, keys, "value", {"p95": 0.95, "p99": 0.99}, weight="n")
        return moments(named, keys).select(*keys, "mean", "std").join(tails, keys)

    def archetype_model(self) -> DataFrame:
        return baseline.archetype_model(self.manifest)

    def archetype_transitions(self) -> DataFrame:
        """Successive iterations may lie in different batches: the manifest has them all."""
        return baseline.archetype_transitions(self.manifest)

    def bounds_model(self) -> DataFrame:
        """Duration and length statistics per program."""
        durations = self.state("values", ["path_duration_ns"])
        points = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
        levels = percentiles(
            durations, ["program"], "value", {f"duration_{k}": p for k, p in points.items()}, weight="n"
        )
        spans = moments(durations, ["program"]).select(
            "program", F.col("mean").alias("duration_mean"), F.col("std").alias("duration_std")
        )
        sizes = moments(self.state("values", ["path_length"]), ["program"]).select(
            "program",
            F.col("mean").alias("length_mean"),
            F.col("std").alias("length_std"),
            F.col("greatest").cast("long").alias("length_max"),
            F.col("least").cast("long").alias("length_min"),
        )
        return (
            spans.join(sizes, "program")
            .join(levels, "program")
            .withColumn("duration_iqr", F.col("duration_p75") - F.col("duration_p25"))
            .drop("duration_p25", "duration_p75")
        )
