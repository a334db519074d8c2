"""What the path clusters look like and where they occur.

Input rows: ``program, input_id, iteration, path_rank, path_idx, archetype``
and, where needed, feature columns or a vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .features import FEATURES
from .vectors import cluster_spread, mean_vector, squared_distance, std_vector


def archetype_profile(
    df: DataFrame, dim: int, *, features: str = "features", scaled: str = "z", label: str = "archetype"
) -> DataFrame:
    """Size, share, programs, duration, length, raw means and scaled spreads."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("size"),
        (F.count(F.lit(1)) / total * 100).alias("percentage"),
        F.count_distinct("program").alias("programs"),
        F.abs(F.avg("path_duration_ns") / 1e6).alias("avg_duration_ms"),
        F.avg("path_length").alias("avg_path_length"),
        mean_vector(features, dim).alias("feature_means"),
        std_vector(scaled, dim).alias("feature_stds"),
    )


def program_distribution(df: DataFrame, label: str = "archetype") -> DataFrame:
    """Paths per archetype and program."""
    return df.groupBy(label, "program").agg(F.count(F.lit(1)).alias("paths"))


def named_means(profile: DataFrame, label: str = "archetype") -> DataFrame:
    """Spread the 33 feature means into named columns."""
    return profile.select(
        label, *[F.get("feature_means", F.lit(i)).alias(name) for i, name in enumerate(FEATURES)]
    )


def interpret_archetypes(
    means: DataFrame, thresholds: DataFrame | None = None, label: str = "archetype"
) -> DataFrame:
    """Readable labels from feature means.

    ``thresholds`` is the one-row result of ``resource_thresholds``; without it
    fixed limits apply and only the highest level of a resource is named.
    """
    names = ("cpu", "memory", "io")
    levels = {"cpu": F.col("cpu_mean"), "memory": F.abs("memory_growth"), "io": F.col("io_intensity")}
    strong = {"cpu": "CPU_INTENSIVE", "memory": "MEMORY_GROWING", "io": "IO_HEAVY"}
    mild = {"cpu": "CPU_MODERATE", "memory": "MEMORY_MODERATE", "io": "IO_MODERATE"}
    fixed = {"cpu": 50, "memory": 10, "io": 5}
    depth = F.col("path_depth")
    if thresholds is None:
        depth_label = (
            F.when(depth < 5, "SHALLOW").when(depth < 15, "MEDIUM_DEPTH").otherwise("DEEP")
        )
        profile = [F.when(levels[r] > fixed[r], strong[r]) for r in names]
    else:
        limit = thresholds.select(F.struct(*thresholds.columns)).scalar()
        deepest = limit.getField("max_path_depth")
        depth_label = (
            F.when(depth <= deepest * 0.33, "SHALLOW")
            .when(depth <= deepest * 0.66, "MEDIUM_DEPTH")
            .otherwise("DEEP")
        )
        profile = [
            F.when(levels[r] > limit.getField(f"{r}_high"), strong[r]).when(
                levels[r] > limit.getField(f"{r}_medium"), mild[r]
            )
            for r in names
        ]
    gini = F.col("time_gini")
    time_label = F.when(gini > 0.7, "CONCENTRATED").when(gini < 0.3, "BALANCED")
    resources = F.concat_ws(", ", *profile)
    return means.select(
        label,
        F.concat_ws(", ", depth_label, time_label).alias("primary_traits"),
        F.when(resources == "", "LIGHTWEIGHT").otherwise(resources).alias("resource_profile"),
        F.when(F.col("cpu_ratio") > 0.5, "CPU_BOUND")
        .when(F.col("memory_ratio") > 0.5, "MEMORY_BOUND")
        .when(F.col("io_ratio") > 0.5, "IO_BOUND")
        .otherwise("MIXED")
        .alias("dominant_type"),
        F.when(F.col("cpu_phases") > 2, "PHASED").otherwise("STABLE").alias("phase_behavior"),
        F.when(F.col("memory_monotonic") > 0.5, "MONOTONIC_GROWTH")
        .otherwise("VOLATILE")
        .alias("memory_pattern"),
    )


def representative_paths(
    df: DataFrame, key: list[str], n: int = 3, label: str = "archetype"
) -> DataFrame:
    """The ``n`` paths nearest to the centre of each archetype.

    The row-number filter keeps at most ``n`` rows per archetype and task
    before the shuffle.
    """
    nearest = Window.partitionBy(label).orderBy(F.round("distance_to_center", 9), *key)
    return (
        df.select(label, *key, "distance_to_center")
        .withColumn("place", F.row_number().over(nearest))
        .where(F.col("place") <= n)
    )


def iteration_stability(df: DataFrame, label: str = "archetype") -> DataFrame:
    """Share of inputs whose rank-1 paths all fall into one archetype."""
    per_input = (
        df.where(F.col("path_rank") == 1)
        .groupBy("program", "input_id")
        .agg(
            F.count(F.lit(1)).alias("_paths"),
            (F.min(label) == F.max(label)).cast("double").alias("_stable"),
        )
        .where(F.col("_paths") > 1)
    )
    return per_input.agg(
        F.coalesce(F.avg("_stable"), F.lit(0.0)).alias("iteration_stability"),
        F.count(F.lit(1)).alias("inputs"),
    )


def program_diversity(df: DataFrame, k: int, label: str = "archetype") -> DataFrame:
    """Distinct archetypes of the first path of each input, over k."""
    first = df.groupBy("program", "input_id").agg(
        F.min_by(label, F.struct("iteration", "path_idx")).alias("_first")
    )
    return first.groupBy("program").agg(
        F.count_distinct("_first").alias("unique_archetypes"),
        F.count(F.lit(1)).alias("total_inputs"),
        (F.count_distinct("_first") / F.lit(k)).alias("diversity_score"),
    )


def archetype_purity(
    df: DataFrame, dim: int, *, column: str = "z", label: str = "archetype"
) -> DataFrame:
    """1 - typical distance within the cluster / typical distance overall.

    "Typical" is the root mean square over all pairs, which follows exactly
    from the sums of squares around the means: 2 n / (n - 1) times the mean
    square. It covers every row in linear time; a plain mean of distances would
    need all pairs.
    """
    centred = df.withColumn("_centre", df.agg(mean_vector(column, dim)).scalar())
    overall = (
        centred.select(squared_distance(F.col(column), F.col("_centre")).alias("_sq"))
        .agg((2 * F.sum("_sq") / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("_o"))
        .scalar()
    )
    spread = cluster_spread(df, dim, column, label).withColumn("_all", overall)
    inner = 2 * F.col("within") / F.greatest(F.col("n") - 1, F.lit(1))
    return spread.select(
        F.col("id").alias(label),
        F.col("n").alias("size"),
        F.when(F.col("n") <= 1, F.lit(1.0))
        .when(F.col("_all") > 0, 1 - F.sqrt(inner / F.col("_all")))
        .otherwise(F.lit(0.0))
        .alias("purity_rms"),
    )


def purity_euclidean(distances: DataFrame, label: str = "archetype") -> DataFrame:
    """1 - mean Euclidean distance within the cluster / mean distance overall.

    From ``cluster_distances``: over all rows and all pairs, none of them formed.
    """
    total = F.aggregate("distances", F.lit(0.0), lambda t, c: t + c["total"])
    own = F.get(F.filter("distances", lambda c: c["id"] == F.col(label)), F.lit(0))
    pairs = F.count(F.lit(1)).cast("double") * F.greatest(F.count(F.lit(1)) - 1, F.lit(1))
    overall = distances.agg(F.sum(total) / pairs).scalar()
    return (
        distances.groupBy(label)
        .agg(F.count(F.lit(1)).alias("size"), (F.sum(own["total"]) / pairs).alias("_inner"))
        .withColumn("_all", overall)
        .select(
            label,
            "size",
            F.when(F.col("size") <= 1, F.lit(1.0))
            .when(F.col("_all") > 0, 1 - F.col("_inner") / F.col("_all"))
            .otherwise(F.lit(0.0))
            .alias("purity"),
        )
    )


def cross_program_archetypes(df: DataFrame, label: str = "archetype") -> DataFrame:
    """Archetypes in more than one program, with their share of all programs."""
    everyone = df.agg(F.count_distinct("program")).scalar()
    return (
        df.groupBy(label)
        .agg(
            F.concat_ws(",", F.array_sort(F.collect_set("program"))).alias("applications"),
            F.count_distinct("program").alias("_programs"),
            F.count(F.lit(1)).alias("total_instances"),
        )
        .where(F.col("_programs") > 1)
        .select(
            label,
            "applications",
            (F.col("_programs") / everyone).alias("universality"),
            "total_instances",
        )
    )


def universal_patterns(
    cross: DataFrame, interpreted: DataFrame, at_least: float = 0.5, label: str = "archetype"
) -> DataFrame:
    """Cross-program archetypes found in at least half of the programs."""
    return cross.where(F.col("universality") >= at_least).join(interpreted, label)


def program_signature(df: DataFrame, archetypes: list[int], label: str = "archetype") -> DataFrame:
    """Percentage of a program's paths per archetype, zero where there is none."""

    def share(archetype: int) -> Column:
        part = F.count_if(F.col(label) == archetype) / F.count(F.lit(1)) * 100
        return part.alias(f"archetype_{archetype}")

    return df.groupBy("program").agg(*[share(a) for a in archetypes])
