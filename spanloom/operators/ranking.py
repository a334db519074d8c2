"""Static complexity against dynamic criticality, function by function.

Everything is reduced to one row per (program, function) before any ranking.
Scores are ranked as rounded to nine decimals, so the last bits of a logarithm
cannot reorder functions whose scores are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import ranked, ranked_descending

FUNCTION = ["program", "function_name"]


def static_complexity() -> Column:
    """Composite complexity from size, branching, nesting, calls and I/O."""
    cyclomatic = F.col("ifs") + F.col("switches") + F.col("loops") + 1
    return (
        0.2 * F.log1p(F.greatest(F.col("loc"), F.lit(0)))
        + 0.3 * F.log1p(cyclomatic)
        + 0.2 * (1 + F.col("nested_loops") * 0.5)
        + 0.2 * F.log1p("calls")
        + 0.1 * F.when(F.col("has_io"), 1).otherwise(0)
    )


def _score_rank(df: DataFrame, score: str, out: str, slices: int | None) -> DataFrame:
    keyed = df.withColumn("_score", F.round(score, 9))
    return ranked_descending(
        keyed, ["program"], ["_score", "function_name"], out, slices=slices
    ).drop("_score")


def static_rank(static: DataFrame, *, slices: int | None = None) -> DataFrame:
    """Rank functions by complexity, then name, both descending."""
    scored = static.withColumn("complexity", static_complexity())
    return _score_rank(scored, "complexity", "static_rank", slices)


def dynamic_stats(functions: DataFrame, bottlenecks: DataFrame, paths: DataFrame) -> DataFrame:
    """Per function over all paths: appearances, durations, ranks, bottlenecks.

    ``functions`` has one row per function on a path (a recursive function
    counts each time), ``bottlenecks`` one per bottleneck entry, ``paths`` one
    per path. A function seen only as a bottleneck is kept with no appearances.
    """
    on_paths = functions.groupBy(*FUNCTION).agg(
        F.count(F.lit(1)).alias("appearances"),
        # sums of nanoseconds exceed 64 bits
        F.sum(F.col("duration_ns").cast("decimal(20,0)")).alias("total_duration_ns"),
        F.sum(F.col("self_time_ns").cast("decimal(20,0)")).alias("total_self_time_ns"),
        F.sum("path_rank").alias("rank_sum"),
    )
    slow = bottlenecks.groupBy(*FUNCTION).agg(F.count(F.lit(1)).alias("bottleneck_count"))
    totals = paths.groupBy("program").agg(F.count(F.lit(1)).alias("total_paths"))
    counts = ["appearances", "total_duration_ns", "total_self_time_ns", "rank_sum", "bottleneck_count"]
    return (
        on_paths.join(slow, FUNCTION, "full")
        .join(totals, "program")
        .select(
            *FUNCTION,
            *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts],
            "total_paths",
        )
    )


def dynamic_criticality(stats: DataFrame) -> DataFrame:
    """Criticality of functions that appear on at least one path."""
    apps = F.col("appearances")
    seen = stats.where(apps > 0).select(
        *FUNCTION,
        "appearances",
        (F.col("total_duration_ns").cast("double") / apps).alias("avg_duration_ns"),
        (F.col("total_self_time_ns").cast("double") / apps).alias("avg_self_time_ns"),
        (apps / F.col("total_paths") * 100).alias("appearance_rate"),
        (F.col("rank_sum") / apps).alias("avg_rank"),
        (apps / F.col("total_paths")).alias("_rate"),
        (F.col("bottleneck_count") / apps).alias("_bottleneck_rate"),
    )
    return seen.select(
        *FUNCTION,
        (
            0.3 * (1 / F.col("avg_rank"))
            + 0.3 * F.col("_rate")
            + 0.2 * F.log1p("avg_duration_ns")
            + 0.2 * F.col("_bottleneck_rate")
        ).alias("criticality"),
        "appearances",
        "avg_duration_ns",
        "avg_self_time_ns",
        "appearance_rate",
        "avg_rank",
        F.lit(True).alias("in_critical_paths"),
    )


def executed_not_critical(
    executed: DataFrame,
    stats: DataFrame,
    critical: DataFrame,
    *,
    slices: int | None = None,
) -> DataFrame:
    """Functions that ran but are neither on a path nor a bottleneck.

    Criticality zero; their average rank continues from the worst one, in name
    order.
    """
    quiet = executed.select(*FUNCTION).distinct().join(stats.select(*FUNCTION), FUNCTION, "left_anti")
    worst = critical.groupBy("program").agg(F.max("avg_rank").alias("_worst"))
    fallback = stats.groupBy("program").agg((F.max("total_paths") + 1.0).alias("_fallback"))
    placed = ranked(quiet, ["program"], ["function_name"], "_place", slices=slices)
    base = F.coalesce("_worst", "_fallback", F.lit(1.0))
    return (
        placed.join(worst, "program", "left")
        .join(fallback, "program", "left")
        .select(
            *FUNCTION,
            F.lit(0.0).alias("criticality"),
            F.lit(0).cast("long").alias("appearances"),
            F.lit(0.0).alias("avg_duration_ns"),
            F.lit(0.0).alias("avg_self_time_ns"),
            F.lit(0.0).alias("appearance_rate"),
            (base + F.col("_place") - 1).alias("avg_rank"),
            F.lit(False).alias("in_critical_paths"),
        )
    )


def dynamic_rank(scores: DataFrame, *, slices: int | None = None) -> DataFrame:
    """Rank functions by criticality, then name, both descending."""
    return _score_rank(scores, "criticality", "dynamic_rank", slices)


def percentile_ranks(
    static_ranked: DataFrame,
    dynamic_ranked: DataFrame,
    *,
    at_least: int = 10,
    slices: int | None = None,
) -> DataFrame:
    """Functions with both ranks, each re-ranked to (0, 1] within its program.

    Programs with fewer than ``at_least`` common functions are left out.
    """
    common = static_ranked.join(dynamic_ranked, FUNCTION)
    sizes = common.groupBy("program").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    for side in ("static", "dynamic"):
        common = ranked(
            common, ["program"], [f"{side}_rank"], f"_{side}_place", slices=slices
        )
    return (
        common.join(sizes, "program")
        .withColumns(
            {f"{side}_norm": F.col(f"_{side}_place") / F.col("n") for side in ("static", "dynamic")}
        )
        .withColumn("rank_difference", F.col("static_norm") - F.col("dynamic_norm"))
        .drop("_static_place", "_dynamic_place")
    )


def standardized_difference(normed: DataFrame) -> DataFrame:
    """Rank difference in sample standard deviations from the program's mean."""
    spread = normed.groupBy("program").agg(
        F.avg("rank_difference").alias("_mean"), F.stddev_samp("rank_difference").alias("_std")
    )
    effect = F.when(
        F.col("_std") > 0, (F.col("rank_difference") - F.col("_mean")) / F.col("_std")
    ).otherwise(F.lit(0.0))
    return normed.join(spread, "program").withColumn("effect_size", effect).drop("_mean", "_std")


def classify_paradox(
    normed: DataFrame, *, threshold: float = 25, min_difference: float = 0.3
) -> DataFrame:
    """Label functions simple_but_critical, complex_but_irrelevant or matched.

    The normalised ranks of a program are exactly 1/n .. n/n, so the percentile
    limits follow from n: the value at place p(n-1) of that sequence.
    """

    def limit(percent: float) -> Column:
        return (F.lit(percent / 100) * (F.col("n") - 1) + 1) / F.col("n")

    low, high = limit(threshold), limit(100 - threshold)
    static, dynamic = F.col("static_norm"), F.col("dynamic_norm")
    difference = F.col("rank_difference")
    simple = (static >= high) & (dynamic <= low) & (difference >= min_difference)
    complex_ = (static <= low) & (dynamic >= high) & (difference <= -min_difference)
    return normed.withColumn(
        "category",
        F.when(simple, "simple_but_critical")
        .when(complex_, "complex_but_irrelevant")
        .otherwise("matched"),
    )


def paradox_counts(classified: DataFrame) -> DataFrame:
    """Functions per category and in total, one row per program."""
    kinds = ("simple_but_critical", "complex_but_irrelevant", "matched")
    return classified.groupBy("program").agg(
        *[F.count_if(F.col("category") == kind).alias(kind) for kind in kinds],
        F.count(F.lit(1)).alias("total_functions"),
    )


def hidden_bottlenecks(static_ranked: DataFrame, dynamic_ranked: DataFrame, top: int = 20) -> DataFrame:
    """Simple functions among the ``top`` most critical, with their impact."""
    sizes = static_ranked.groupBy("program").agg(F.count(F.lit(1)).alias("_functions"))
    return (
        dynamic_ranked.where(F.col("dynamic_rank") <= top)
        .join(static_ranked, FUNCTION)
        .join(sizes, "program")
        .where(F.col("static_rank") > F.col("_functions") / 2)
        .withColumn("impact_score", F.col("criticality") / F.col("complexity"))
        .drop("_functions")
    )


def quadrant_coordinates(classified: DataFrame) -> DataFrame:
    """Both ranks scaled to [0, 1] with the best rank at 1; 0.5 if all are equal."""
    sides = ("static", "dynamic")
    limits = classified.groupBy("program").agg(
        *[f(f"{s}_rank").alias(f"_{s}_{n}") for s in sides for n, f in (("min", F.min), ("max", F.max))]
    )

    def scaled(side: str) -> Column:
        low, high = F.col(f"_{side}_min"), F.col(f"_{side}_max")
        return F.when(high > low, (high - F.col(f"{side}_rank")) / (high - low)).otherwise(F.lit(0.5))

    return classified.join(limits, "program").select(
        *FUNCTION, scaled("static").alias("x"), scaled("dynamic").alias("y"), "category"
    )


def coverage_sets(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Each function of either side as static_only, dynamic_only or common."""
    left = static.select(*FUNCTION).distinct().withColumn("_static", F.lit(True))
    right = dynamic.select(*FUNCTION).distinct().withColumn("_dynamic", F.lit(True))
    return left.join(right, FUNCTION, "full").select(
        *FUNCTION,
        F.when(F.col("_dynamic").isNull(), "static_only")
        .when(F.col("_static").isNull(), "dynamic_only")
        .otherwise("common")
        .alias("coverage"),
    )
