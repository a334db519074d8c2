"""Correlations per group with p-values, and tests of normality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.inference import (
    correlation_tail,
    normal_quantile,
    normal_upper_tail,
    polynomial,
)
from .ordered import ranked, running_sum

# Royston's (1995) polynomials for the Shapiro-Wilk test,
# constant term first.
EXTREME_1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
EXTREME_2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_STD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_STD = (-0.4803, -0.082676, 0.0030302)
SMALL_GAMMA = (-2.273, 0.459)


def average_ranks(
    df: DataFrame, by: list[str], value: str, out: str, *, slices: int | None = None
) -> DataFrame:
    """1-based rank within the group; equal values share their mean rank."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_count"))
    upto = running_sum(counts, by, [value], "_count", "_upto", slices=slices)
    ranks = upto.select(*by, value, (F.col("_upto") - (F.col("_count") - 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def pearson(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson's r per group of more than two rows."""
    return (
        df.groupBy(*by)
        .agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 2)
    )


def spearman(
    df: DataFrame, by: list[str], a: str, b: str, *, slices: int | None = None
) -> DataFrame:
    """Spearman's rho per group of more than two rows, ties by mean rank."""
    ranks = average_ranks(df.select(*by, a, b), by, a, "_a", slices=slices)
    ranks = average_ranks(ranks, by, b, "_b", slices=slices)
    return pearson(ranks, by, "_a", "_b")


def t_statistic(r: Column, n: Column) -> Column:
    return F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))


def with_p_value(correlations: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Add Student's t and the two-sided p-value, on one row per group."""
    return correlations.withColumns(
        {
            "t": t_statistic(F.col(r), F.col(n)),
            "p_value": correlation_tail(F.col(r), F.col(n).cast("double")),
        }
    )


def dagostino(df: DataFrame, by: list[str], value: str, *, alpha: float = 0.05) -> DataFrame:
    """D'Agostino and Pearson's K2 from skewness and kurtosis, for n >= 8."""
    moments = (
        finite(df, value)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).cast("double").alias("_n"),
            F.skewness(value).alias("_skew"),
            (F.kurtosis(value) + 3).alias("_kurt"),
        )
        .where(F.col("_n") >= 8)
    )
    n = F.col("_n")
    y = F.col("_skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = (
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    )
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    scaled = y / F.sqrt(2 / (w2 - 1))
    skew_z = F.log(scaled + F.sqrt(scaled * scaled + 1)) / F.sqrt(0.5 * F.log(w2))

    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("_kurt") - expected) / F.sqrt(variance)
    beta1 = (
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6 + 8 / beta1 * (2 / beta1 + F.sqrt(1 + 4 / (beta1 * beta1)))
    denominator = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(denominator) * F.cbrt((1 - 2 / a) / F.abs(denominator))
    kurt_z = (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))

    return (
        moments.withColumn("k2", skew_z * skew_z + kurt_z * kurt_z)
        .withColumn("k2_p", F.exp(-F.col("k2") / 2))
        .select(
            *by, n.cast("long").alias("n"), "k2", "k2_p", (F.col("k2_p") > alpha).alias("k2_normal")
        )
    )


def finite(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is a finite number."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def shapiro_wilk(
    df: DataFrame,
    by: list[str],
    value: str,
    tie: str,
    *,
    alpha: float = 0.05,
    slices: int | None = None,
) -> DataFrame:
    """Shapiro-Wilk W and p by Royston's approximation, for n >= 3.

    ``tie`` makes the sort unique; equal values may take any order. Only the
    two largest and smallest order statistics need special weights, so W is a
    few sums over ranked rows.
    """
    data = finite(df.select(*by, value, tie), value)
    sizes = (
        data.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_n")).where(F.col("_n") >= 3)
    )
    placed = ranked(data, by, [value, tie], "_i", slices=slices).join(sizes, by)
    n, i, x = F.col("_n"), F.col("_i"), F.col(value).cast("double")
    m = normal_quantile((i - 0.375) / (n + 0.25))
    scored = placed.withColumn("_m", m)
    ends = F.when(n > 5, F.lit(2)).otherwise(F.lit(1))
    inner = (i > ends) & (i <= n - ends)

    def at(place: Column, name: str) -> Column:
        return F.max(F.when(i == place, x)).alias(name)

    sums = scored.groupBy(*by, "_n").agg(
        F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
        F.sum(F.when(inner, F.col("_m") * x).otherwise(F.lit(0.0))).alias("_mx"),
        (F.var_pop(x) * F.count(F.lit(1))).alias("_ss"),
        at(F.lit(1), "_x1"),
        at(F.lit(2), "_x2"),
        at(n - 1, "_xm"),
        at(n, "_xn"),
    )
    # Column by column, so that no expression is expanded more than once.
    mm, top, second = F.col("_mm"), F.col("_top"), F.col("_second")
    u, a1, a2 = 1 / F.sqrt(n), F.col("_a1"), F.col("_a2")
    weights = (
        sums.withColumn("_top", normal_quantile((n - 0.375) / (n + 0.25)))
        .withColumn("_second", normal_quantile((n - 1.375) / (n + 0.25)))
        .withColumn(
            "_a1",
            F.when(n == 3, F.lit(math.sqrt(0.5))).otherwise(
                top / F.sqrt(mm) + polynomial(u, EXTREME_1)
            ),
        )
        .withColumn("_a2", second / F.sqrt(mm) + polynomial(u, EXTREME_2))
    )
    phi_large = (mm - 2 * top * top - 2 * second * second) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    phi_small = (mm - 2 * top * top) / (1 - 2 * a1 * a1)
    weighted = (
        F.when(n == 3, F.lit(0.0))
        .when(n > 5, F.col("_mx") / F.sqrt(phi_large) + a2 * (F.col("_xm") - F.col("_x2")))
        .otherwise(F.col("_mx") / F.sqrt(phi_small))
        + a1 * (F.col("_xn") - F.col("_x1"))
    )
    squared = F.col("_weighted") * F.col("_weighted")
    w = F.when(F.col("_ss") > 0, F.least(squared / F.col("_ss"), F.lit(1.0))).otherwise(F.lit(1.0))
    scored_w = weights.withColumn("_weighted", weighted).withColumn("w", w)
    y = F.log(1 - F.col("w"))
    gamma = polynomial(n, SMALL_GAMMA)
    small_z = (-F.log(gamma - y) - polynomial(n, SMALL_MEAN)) / F.exp(polynomial(n, SMALL_LOG_STD))
    log_n = F.log(n)
    large_z = (y - polynomial(log_n, LARGE_MEAN)) / F.exp(polynomial(log_n, LARGE_LOG_STD))
    exact3 = F.greatest(
        F.lit(0.0), F.lit(6 / math.pi) * (F.asin(F.sqrt("w")) - F.lit(math.asin(math.sqrt(0.75))))
    )
    z = F.when(n <= 11, small_z).otherwise(large_z)
    p = (
        F.when(F.col("w") >= 1, F.lit(1.0))
        .when(n == 3, exact3)
        .when((n <= 11) & (y >= gamma), F.lit(0.0))
        .otherwise(F.col("_tail"))
    )
    return (
        scored_w.withColumn("_tail", normal_upper_tail(z))
        .withColumn("w_p", p)
        .select(
            *by, n.cast("long").alias("n"), "w", "w_p", (F.col("w_p") > alpha).alias("w_normal")
        )
    )


def normality_verdict(
    df: DataFrame,
    by: list[str],
    value: str,
    tie: str,
    *,
    alpha: float = 0.05,
    slices: int | None = None,
) -> DataFrame:
    """Both tests and their joint verdict; too few values are not normal."""
    sizes = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(
            F.col(value).isNotNull()
            & ~F.isnan(F.col(value).cast("double"))
            & (F.abs(F.col(value)) < float("inf"))
        ).alias("n"),
    )
    shapiro = shapiro_wilk(df, by, value, tie, alpha=alpha, slices=slices)
    omnibus = dagostino(df, by, value, alpha=alpha)
    reason = F.when(F.col("_rows") < 3, "insufficient_data").when(
        F.col("n") < 3, "insufficient_valid_data"
    )
    verdict = F.when(reason.isNotNull(), F.lit(False)).otherwise(
        F.col("w_normal") & F.coalesce("k2_normal", F.lit(True))
    )
    return (
        sizes.join(shapiro.drop("n"), by, "left")
        .join(omnibus.drop("n"), by, "left")
        .select(
            *by,
            "n",
            "w",
            "w_p",
            "w_normal",
            "k2",
            "k2_p",
            "k2_normal",
            verdict.alias("is_normal"),
            reason.alias("reason"),
        )
    )


def correlation_report(
    classified: DataFrame, *, alpha: float = 0.05, slices: int | None = None
) -> DataFrame:
    """Pearson on scores, Spearman on ranks, and whether Pearson is apt.

    Pearson counts as appropriate if either score passes as normal.
    """
    by = ["program"]
    scores = with_p_value(pearson(classified, by, "complexity", "criticality"))
    ranks = with_p_value(
        spearman(classified, by, "static_rank", "dynamic_rank", slices=slices)
    )
    verdicts = [
        normality_verdict(
            classified, by, value, "function_name", alpha=alpha, slices=slices
        ).select(*by, F.col("is_normal").alias(out))
        for value, out in (("complexity", "_static"), ("criticality", "_dynamic"))
    ]
    return (
        scores.select(*by, F.col("r").alias("pearson"), F.col("p_value").alias("pearson_p"), "n")
        .join(ranks.select(*by, F.col("r").alias("spearman"), F.col("p_value").alias("spearman_p")), by)
        .join(verdicts[0], by, "left")
        .join(verdicts[1], by, "left")
        .select(
            *by,
            "n",
            "pearson",
            "pearson_p",
            "spearman",
            "spearman_p",
            (F.coalesce("_static", F.lit(False)) | F.coalesce("_dynamic", F.lit(False))).alias(
                "pearson_appropriate"
            ),
        )
    )
