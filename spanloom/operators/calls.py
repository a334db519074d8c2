"""Begin/end events to calls, call statistics and critical paths.

All scans run in event order ``(ts, seq)``, never by interval containment:
rounded time stamps may let a child appear to outlive its parent. ``seq`` is
unique within a thread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ordered import running_sum
from .storage import written

THREAD = ["run", "tid"]


def clean_events(events: DataFrame) -> DataFrame:
    """Keep begin and end events; thread defaults to process; time as a number.

    Input ``run, ph, ts, pid, tid, name`` and whatever else the file carries.
    """
    return events.where(F.col("ph").isin("B", "E")).select(
        "run",
        "ph",
        F.col("ts").cast("double").alias("ts"),
        "pid",
        F.coalesce("tid", "pid").alias("tid"),
        "name",
    )


def unmatched_events(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Per thread, how many begins and ends belong to no call."""
    seen = events.groupBy(*THREAD).agg(
        F.count_if(F.col("ph") == "B").alias("begins"), F.count_if(F.col("ph") == "E").alias("ends")
    )
    used = calls.groupBy(*THREAD).agg(F.count(F.lit(1)).alias("_calls"))
    matched = F.coalesce(F.col("_calls"), F.lit(0))
    return seen.join(used, THREAD, "left").select(
        *THREAD,
        (F.col("begins") - matched).alias("open_begins"),
        (F.col("ends") - matched).alias("stray_ends"),
    )


def call_stats(calls: DataFrame) -> DataFrame:
    """Self time (never below zero) and number of children per call."""
    children = (
        calls.where(F.col("parent_id").isNotNull())
        .groupBy(*THREAD, F.col("parent_id").alias("call_id"))
        .agg(F.sum("duration").alias("_inner"), F.count(F.lit(1)).alias("num_children"))
    )
    inner = F.coalesce(F.col("_inner"), F.lit(0))
    return (
        calls.join(children, [*THREAD, "call_id"], "left")
        .withColumn("self_time", F.greatest(F.lit(0), F.col("duration") - inner))
        .withColumn("num_children", F.coalesce("num_children", F.lit(0).cast("long")))
        .drop("_inner")
    )


def hotspots(
    stats: DataFrame, n: int = 100, *, duration: str = "duration", self_time: str = "self_time"
) -> DataFrame:
    """The ``n`` functions with most self time, with their share of all of it."""
    # sums of nanoseconds exceed 64 bits
    longs = [F.sum(F.col(c).cast("decimal(20,0)")) for c in (duration, self_time)]
    per_function = stats.groupBy("function_name").agg(
        F.count(F.lit(1)).alias("calls"),
        longs[0].alias("total_duration"),
        longs[1].alias("total_self_time"),
    )
    everything = per_function.agg(F.sum("total_self_time").cast("double")).scalar()
    top = per_function.orderBy(F.desc("total_self_time"), "function_name").limit(n)
    return top.select(
        "*",
        (F.col("total_duration").cast("double") / F.col("calls")).alias("avg_duration"),
        F.when(everything > 0, F.col("total_self_time").cast("double") / everything)
        .otherwise(F.lit(0.0))
        .alias("self_share"),
    )


def chain_scores(calls: DataFrame, *, slices: int | None = None) -> DataFrame:
    """Add ``score``: summed durations from below the root down to the call.

    While a call is open its duration is counted, so a running sum over begins
    (+duration) and ends (-duration) is the sum over the open chain, at any
    depth, without walking the tree.
    """
    counted = F.when(F.col("level") > 1, F.col("duration")).otherwise(F.lit(0))
    edges = calls.select(
        *THREAD,
        F.inline(
            F.array(
                F.struct(
                    F.col("start_ts").alias("ts"),
                    F.col("call_id").alias("seq"),
                    counted.alias("_delta"),
                    F.struct(*[c for c in calls.columns if c not in THREAD]).alias("_call"),
                ),
                F.struct(
                    F.col("end_ts").alias("ts"),
                    F.col("end_seq").alias("seq"),
                    (-counted).alias("_delta"),
                    F.lit(None).alias("_call"),
                ),
            )
        ),
    )
    summed = running_sum(
        edges, THREAD, ["ts", "seq"], "_delta", "score", slices=slices
    )
    return summed.where(F.col("_call").isNotNull()).select(*THREAD, "_call.*", "score")


def critical_paths(stats: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` heaviest root-to-leaf chains per run, one row per function.

    Takes calls with ``score``. Ties go to the earlier leaf, then thread, then
    call id. The row-number filter lets each task keep only its ``k`` best before
    the shuffle; the few leaves that remain are written out, and the calls around
    them are their chains.
    """
    best = Window.partitionBy("run").orderBy(F.desc("score"), "start_ts", "tid", "call_id")
    leaves = (
        stats.where(F.col("num_children") == 0)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(
            *[F.col(c).alias(f"_{c}") for c in THREAD],
            F.struct("start_ts", "call_id").alias("_begin"),
            F.struct("end_ts", "end_seq").alias("_end"),
            "rank",
            F.col("score").alias("_score"),
        )
    )
    around = (
        F.col("run").eqNullSafe(F.col("_run"))
        & F.col("tid").eqNullSafe(F.col("_tid"))
        & (F.struct("start_ts", "call_id") <= F.col("_begin"))
        & (F.struct("end_ts", "end_seq") >= F.col("_end"))
    )
    return stats.join(written(leaves, "leaves"), around).select(
        *["run", "rank", "tid", F.col("_score").alias("score"), (F.col("level") - 1).alias("pos")],
        *["call_id", "function_name", "duration", "self_time", "start_ts", "end_ts"],
    )


def path_durations(functions: DataFrame, by: list[str], duration: str = "duration") -> DataFrame:
    """Critical (largest non-root), total (root) duration and length per path."""
    return functions.groupBy(*by).agg(
        F.coalesce(F.max(F.when(F.col("pos") > 0, F.col(duration))), F.lit(0)).alias(
            "critical_duration"
        ),
        F.max(F.when(F.col("pos") == 0, F.col(duration))).alias("total_duration"),
        F.count(F.lit(1)).alias("path_length"),
    )


def path_bottlenecks(
    functions: DataFrame,
    by: list[str],
    duration: str = "duration",
    *,
    slices: int | None = None,
) -> DataFrame:
    """Non-root functions, longest first, with their percentage of the path."""
    inner = functions.where(F.col("pos") > 0)
    totals = inner.groupBy(*by).agg(F.sum(duration).alias("_total"))
    # Longest first with ties in path order: rank ascending on the negated duration.
    ordered = running_sum(
        inner.withColumn("_neg", -F.col(duration)),
        by,
        ["_neg", "pos"],
        F.lit(1).cast("long"),
        "bottleneck_rank",
        slices=slices,
    )
    return (
        ordered.join(totals, by)
        .withColumn(
            "percentage_of_path",
            F.when(F.col("_total") > 0, F.lit(100.0) * F.col(duration) / F.col("_total")).otherwise(
                F.lit(0.0)
            ),
        )
        .drop("_neg", "_total")
    )


def executed_functions(calls: DataFrame) -> DataFrame:
    """Distinct function names per run."""
    return calls.select("run", "function_name").distinct()


def run_summary(calls: DataFrame, paths: DataFrame, requested: int = 10) -> DataFrame:
    """Per run: paths asked for and found, threads, and calls."""
    counted = calls.groupBy("run").agg(
        F.count_distinct("tid").alias("num_threads"),
        F.count(F.lit(1)).alias("total_function_calls"),
    )
    found = paths.groupBy("run").agg(F.count_distinct("rank").alias("_found"))
    return counted.join(found, "run", "left").select(
        "run",
        F.lit(requested).alias("num_paths_requested"),
        F.coalesce("_found", F.lit(0).cast("long")).alias("num_paths_found"),
        "num_threads",
        "total_function_calls",
    )
