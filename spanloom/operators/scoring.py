"""Four anomaly signals per run and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .baseline import RESOURCES, RUN, ngrams

SIGNALS = ("path", "resource", "archetype", "bounds")

# Combined score above which a run counts as a regression, and
# the weight of the strongest signal on its own.
DETECTION_THRESHOLD = 0.65
MAX_SIGNAL_WEIGHT = 0.7


def ladder(value: Column, rungs: list[tuple[float, float]], *, below: bool = False) -> Column:
    """Score of the first rung ``value`` is strictly beyond, else 0."""
    score = None
    for limit, points in rungs:
        passed = value < limit if below else value > limit
        points_col = F.lit(float(points))
        score = F.when(passed, points_col) if score is None else score.when(passed, points_col)
    return score.otherwise(F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def score_path(
    runs: DataFrame,
    functions: DataFrame,
    frequencies: DataFrame,
    grams: DataFrame,
    lengths: DataFrame,
) -> DataFrame:
    """Unseen or rare functions, unusual length, unseen bigrams.

    The score is the mean over the items that contribute, at most 1. ``runs``
    and ``functions`` are the runs to score, the rest their baseline models.
    """
    per_function = (
        functions.select(*RUN, "function_name")
        .join(frequencies.select("program", "function_name", "frequency"), ["program", "function_name"], "left")
        .withColumn(
            "_points",
            F.when(F.col("frequency").isNull(), F.lit(1.0)).when(F.col("frequency") < 3, F.lit(0.5)),
        )
        .groupBy(*RUN)
        .agg(F.sum("_points").alias("_f_sum"), F.count("_points").alias("_f_count"))
    )
    seen = grams.select("program", "ngram", F.lit(True).alias("_seen"))
    unseen = (
        ngrams(functions, RUN, (2,))
        .join(seen, ["program", "ngram"], "left")
        .groupBy(*RUN)
        .agg(F.count_if(F.col("_seen").isNull()).alias("_unseen"))
    )
    joined = (
        runs.select(*RUN, "path_length")
        .join(lengths, "program", "left")
        .join(per_function, RUN, "left")
        .join(unseen, RUN, "left")
    )
    z = ratio(F.abs(F.col("path_length") - F.col("path_length_mean")), F.col("path_length_std"))
    odd_length = F.coalesce(z > 3, F.lit(False))
    odd_order = F.coalesce(F.col("_unseen") > 2, F.lit(False))
    total = (
        F.coalesce("_f_sum", F.lit(0.0))
        + F.when(odd_length, F.least(z / 3, F.lit(1.0))).otherwise(F.lit(0.0))
        + F.when(odd_order, F.least(F.col("_unseen") / 5, F.lit(1.0))).otherwise(F.lit(0.0))
    )
    items = F.coalesce("_f_count", F.lit(0)) + odd_length.cast("int") + odd_order.cast("int")
    score = F.least(total / F.greatest(items, F.lit(1)), F.lit(1.0))
    return joined.select(*RUN, score.alias("path_score"))


def widen_resource_model(model: DataFrame) -> DataFrame:
    """One row per program with a column per resource and statistic."""
    return model.groupBy("program").agg(
        *[
            F.max(F.when(F.col("resource") == r, F.col(stat))).alias(f"_{r}_{stat}")
            for r in RESOURCES
            for stat in ("mean", "std", "p95", "p99")
        ]
    )


def score_resource(runs: DataFrame, model: DataFrame) -> DataFrame:
    """Worst resource by distance from its mean and by its upper percentiles.

    A resource without a value, or at zero, is skipped.
    """

    def one(r: str) -> Column:
        value = F.col(f"{r}_avg")
        z = ratio(F.abs(value - F.col(f"_{r}_mean")), F.col(f"_{r}_std"))
        by_z = ladder(z, [(3, 1.0), (2, 0.8), (1.5, 0.6), (1.0, 0.3)])
        by_level = (
            F.when(value > F.col(f"_{r}_p99"), F.lit(0.9))
            .when(value > F.col(f"_{r}_p95"), F.lit(0.6))
            .otherwise(F.lit(0.0))
        )
        usable = value.isNotNull() & (value != 0) & F.col(f"_{r}_mean").isNotNull()
        return F.when(usable, F.greatest(by_z, by_level)).otherwise(F.lit(0.0))

    wide = widen_resource_model(model)
    return runs.join(wide, "program", "left").select(
        *RUN, F.greatest(*[one(r) for r in RESOURCES]).alias("resource_score")
    )


def score_archetype(runs: DataFrame, model: DataFrame) -> DataFrame:
    """How rare the run's archetype is in the baseline, by three yardsticks."""
    per_program = model.groupBy("program").agg(
        F.max("archetypes").alias("_archetypes"), F.max("max_frequency").alias("_most")
    )
    own = model.select("program", "archetype", F.col("frequency").alias("_own"))
    joined = runs.join(per_program, "program", "left").join(own, ["program", "archetype"], "left")
    actual = F.coalesce("_own", F.lit(0.0))
    rare = ladder(actual, [(0.05, 0.7), (0.10, 0.5), (0.15, 0.3)], below=True)
    expected = F.lit(1.0) / F.col("_archetypes")
    uniform = ladder(actual / expected, [(0.5, 0.6), (0.7, 0.4)], below=True)
    relative = ladder(actual / F.col("_most"), [(0.3, 0.5), (0.5, 0.3)], below=True)
    score = F.greatest(F.when(F.col("_own").isNull(), F.lit(1.0)).otherwise(rare), uniform, relative)
    known = F.col("_archetypes").isNotNull()
    return joined.select(*RUN, F.when(known, score).otherwise(F.lit(0.0)).alias("archetype_score"))


def score_bounds(runs: DataFrame, model: DataFrame) -> DataFrame:
    """Duration and length against the baseline's bounds."""
    duration = F.col("path_duration_ns")
    mean, std = F.col("duration_mean"), F.col("duration_std")
    median, iqr = F.col("duration_median"), F.col("duration_iqr")
    zero = F.lit(0.0)
    by_mean = ladder(
        ratio(duration, mean),
        [(2.5, 1.0), (2.0, 0.9), (1.7, 0.8), (1.5, 0.7), (1.3, 0.5), (1.2, 0.3)],
    )
    by_median = ladder(ratio(duration, median), [(2.5, 0.9), (1.8, 0.7), (1.5, 0.6)])
    by_level = (
        F.when(duration > F.col("duration_p99"), F.lit(0.9))
        .when(duration > F.col("duration_p95"), F.lit(0.7))
        .otherwise(zero)
    )
    by_iqr = F.when((iqr > 0) & (duration > median + 1.5 * iqr), F.lit(0.7)).otherwise(zero)
    by_z = ladder(ratio(duration - mean, std), [(3, 0.9), (2, 0.7), (1.5, 0.5)])
    length = F.col("path_length")
    by_length = F.when(length > F.col("length_max"), F.lit(0.7)).otherwise(
        ladder(ratio(length, F.col("length_mean")), [(1.5, 0.5), (1.3, 0.3)])
    )
    score = F.greatest(by_mean, by_median, by_level, by_iqr, by_z, by_length)
    return runs.join(model, "program", "left").select(*RUN, score.alias("bounds_score"))


def combined_score(present: list[Column], count: Column | int) -> tuple[Column, Column, Column]:
    """Equal-weight mean, maximum, and the larger of mean and 0.7 * maximum."""
    weighted = sum(present) / count
    strongest = F.greatest(*present)
    return weighted, strongest, F.greatest(weighted, MAX_SIGNAL_WEIGHT * strongest)


def combine_signals(runs: DataFrame, scores: list[DataFrame]) -> DataFrame:
    """Join the four signals and decide; threshold 0.65 on the combined score.

    Scores are compared as rounded to nine decimals: 0.65 itself is no detection.
    A signal without a baseline model scores 0; the run stays.
    """
    joined = runs.select(*RUN, "regression_type")
    for score in scores:
        joined = joined.join(score, RUN, "left")
    signals = [F.coalesce(F.col(f"{name}_score"), F.lit(0.0)) for name in SIGNALS]
    weighted, strongest, combined = combined_score(signals, 4)
    kept = [c for c in joined.columns if c not in {f"{name}_score" for name in SIGNALS}]
    return joined.select(
        *kept,
        *[s.alias(f"{name}_score") for s, name in zip(signals, SIGNALS)],
        weighted.alias("weighted_score"),
        strongest.alias("max_signal"),
        combined.alias("combined_score"),
        (F.round(combined, 9) > DETECTION_THRESHOLD).alias("detected"),
    )


def without_signals(scored: DataFrame) -> DataFrame:
    """Each run five times: all signals, then each one left out.

    The five variants are an array of literals exploded per row: one pass over
    the scored runs, no join.
    """
    variants = F.array(F.lit("none"), *[F.lit(name) for name in SIGNALS])
    masked = scored.withColumn("excluded_signal", F.explode(variants))
    kept = [
        F.when(F.col("excluded_signal") == name, F.lit(0.0)).otherwise(F.col(f"{name}_score"))
        for name in SIGNALS
    ]
    count = F.when(F.col("excluded_signal") == "none", F.lit(4)).otherwise(F.lit(3))
    _, _, combined = combined_score(kept, count)
    return masked.select(
        *RUN,
        "regression_type",
        "excluded_signal",
        combined.alias("combined_score"),
        (F.round(combined, 9) > DETECTION_THRESHOLD).alias("detected"),
    )
