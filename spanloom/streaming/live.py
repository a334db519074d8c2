"""Telemetry windows and run scoring on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring
from ..operators.baseline import RESOURCES, RUN
from ..operators.storage import written


def stream_telemetry(
    samples: DataFrame,
    by: list[str],
    values: list[str],
    *,
    width: str = "1 hour",
    lateness: str = "10 minutes",
    ts: str = "ts",
) -> DataFrame:
    """Count, mean and peak per group and time window, with late samples dropped.

    State is one row per group and open window; the watermark closes windows.
    """
    return (
        samples.withWatermark(ts, lateness)
        .groupBy(*by, F.window(ts, width).alias("_window"))
        .agg(
            F.count(F.lit(1)).alias("samples"),
            *[F.avg(v).alias(f"{v}_avg") for v in values],
            *[F.max(v).alias(f"{v}_peak") for v in values],
        )
        .withColumn("window_start", F.col("_window.start"))
        .drop("_window")
    )


def stream_scores(
    runs: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score each micro-batch of runs against static models, exactly once.

    ``score`` maps a batch frame to detections by joins with model tables. It reads
    the batch many times, so the batch is written first: a stream's joins and state
    run once. Each batch overwrites its own folder, so a retried batch leaves one
    result.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        score(written(batch, "arrived-runs")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        runs.writeStream.foreachBatch(emit)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


#: Tables that a run is scored with.
MODELS = ("frequencies", "grams", "lengths", "resources", "archetypes", "bounds")


def save_models(models: dict[str, DataFrame], folder: str, version: str) -> None:
    """Write the model tables as one version; an existing version is never changed."""
    for name in MODELS:
        models[name].write.parquet(f"{folder}/{version}/{name}")


def load_models(spark: SparkSession, folder: str, version: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{version}/{name}") for name in MODELS}


def run_arrivals(
    paths: DataFrame, telemetry: DataFrame, *, lateness: str = "10 minutes", apart: str = "10 minutes"
) -> DataFrame:
    """Runs whose paths and telemetry arrive apart, joined as streams.

    Both carry the run's key and ``arrived``. Telemetry counts if it arrives within
    ``apart`` of the paths; once the watermark is past that, a run without it is
    handed on with null resources. Rows later than ``lateness`` are dropped, so
    state is bounded by these two times.
    """
    left = paths.withWatermark("arrived", lateness)
    renamed = {c: f"_{c}" for c in [*RUN, "arrived"]}
    right = telemetry.withColumnsRenamed(renamed).withWatermark("_arrived", lateness)
    same = F.expr(" AND ".join(f"{k} = _{k}" for k in RUN))
    near = F.expr(f"_arrived BETWEEN arrived - INTERVAL {apart} AND arrived + INTERVAL {apart}")
    return left.join(right, same & near, "left_outer").drop(*renamed.values())


def detections(runs: DataFrame, models: dict[str, DataFrame], version: str) -> DataFrame:
    """All four signals of each run and the decision, with the version of the models.

    ``runs`` has the run's features and ``names``, the functions of its first path
    in order. Without telemetry the resource signal is 0.
    """
    functions = runs.select(*RUN, F.posexplode("names").alias("pos", "function_name"))
    signals = [
        scoring.score_path(runs, functions, models["frequencies"], models["grams"], models["lengths"]),
        scoring.score_resource(runs, models["resources"]),
        scoring.score_archetype(runs, models["archetypes"]),
        scoring.score_bounds(runs, models["bounds"]),
    ]
    return scoring.combine_signals(runs, signals).withColumn("model_version", F.lit(version))


def telemetry_columns() -> list[str]:
    """What the telemetry of a run adds to its features."""
    return [f"{r}_avg" for r in RESOURCES]
