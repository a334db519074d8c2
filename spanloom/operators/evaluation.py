"""Quality of detections: confusion counts, rates, AUC, ablation, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import running_sum
from .scoring import without_signals

# How many features each comparison detector looks at, and
# whether it uses the path at all.
DETECTORS = {
    "threshold": (1, True),
    "isolation_forest": (5, True),
    "one_class": (5, True),
    "statistical_control": (1, True),
    "resource_only_threshold": (6, False),
    "resource_only_isolation_forest": (6, False),
    "resource_only_one_class": (6, False),
}


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def confusion_matrix(
    results: DataFrame, by: list[str] | None = None, flag: str = "detected", truth: str = "is_regression"
) -> DataFrame:
    """True and false positives and negatives, overall or per group."""
    t, p = F.col(truth), F.col(flag)
    return results.groupBy(*(by or [])).agg(
        F.count_if(t & p).alias("true_positives"),
        F.count_if(~t & p).alias("false_positives"),
        F.count_if(~t & ~p).alias("true_negatives"),
        F.count_if(t & ~p).alias("false_negatives"),
    )


def precision_recall_f1(confusion: DataFrame) -> DataFrame:
    """Add precision, recall and F1; a zero denominator gives 0."""
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return confusion.withColumns(
        {
            "precision": _safe(tp, tp + fp),
            "recall": _safe(tp, tp + fn),
            "f1_score": _safe(2 * tp, 2 * tp + fp + fn),
        }
    )


def roc_auc(
    results: DataFrame,
    by: list[str] | None = None,
    score: str = "combined_score",
    truth: str = "is_regression",
    *,
    slices: int | None = None,
) -> DataFrame:
    """Area under the ROC curve with half credit for ties; 0 with one class.

    Equal scores are counted first, so the ordered pass sees distinct scores.
    """
    by = by or []
    value = F.round(F.col(score).cast("double"), 9)
    counts = results.groupBy(*by, value.alias("_score")).agg(
        F.count_if(F.col(truth)).alias("_pos"), F.count_if(~F.col(truth)).alias("_neg")
    )
    upto = running_sum(counts, by, ["_score"], "_neg", "_upto", slices=slices)
    won = F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2)
    sums = upto.groupBy(*by).agg(
        F.sum(won).alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")
    )
    pairs = F.col("_p").cast("double") * F.col("_n")
    return sums.select(*by, _safe(F.col("_won"), pairs).alias("auc"))


def per_type_recall(results: DataFrame) -> DataFrame:
    """Detected share of each regression type."""
    return (
        results.where(F.col("is_regression"))
        .groupBy("regression_type")
        .agg(
            F.count(F.lit(1)).alias("runs"), F.avg(F.col("detected").cast("double")).alias("recall")
        )
    )


def ablation(scored: DataFrame) -> DataFrame:
    """Rates with all signals and without each, and what each removal costs."""
    rates = precision_recall_f1(confusion_matrix(without_signals(scored), ["excluded_signal"]))
    metrics = ("f1_score", "precision", "recall")
    full = (
        rates.where(F.col("excluded_signal") == "none").select(F.struct(*metrics)).scalar()
    )
    drops = {}
    for metric in metrics:
        name = metric.removesuffix("_score")
        before = full.getField(metric)
        drops[f"{name}_drop"] = before - F.col(metric)
        drops[f"{name}_drop_pct"] = F.when(
            before > 0, (before - F.col(metric)) / before * 100
        ).otherwise(F.lit(0.0))
    return rates.select("excluded_signal", *metrics, *[c.alias(n) for n, c in drops.items()])


def compare_detectors(flags: DataFrame, *, slices: int | None = None) -> DataFrame:
    """Rates and AUC per detector from rows ``(run, detector, flagged)``."""
    rates = precision_recall_f1(confusion_matrix(flags, ["detector"], "flagged"))
    areas = roc_auc(
        flags.withColumn("_flag", F.col("flagged").cast("int")),
        ["detector"],
        "_flag",
        slices=slices,
    )
    features = F.create_map(*[F.lit(v) for n, (c, _) in DETECTORS.items() for v in (n, c)])
    uses = F.create_map(*[F.lit(v) for n, (_, u) in DETECTORS.items() for v in (n, u)])
    return rates.join(areas, "detector").select(
        "detector",
        "precision",
        "recall",
        "f1_score",
        "auc",
        features[F.col("detector")].alias("num_features"),
        uses[F.col("detector")].alias("uses_critical_paths"),
    )


def path_benefit(own: DataFrame, comparison: DataFrame) -> DataFrame:
    """Our rates against the best resource-only and best path-based detector.

    ``own`` is the one-row result of ``precision_recall_f1``. The best detector
    has the highest F1, ties by name.
    """
    best = Window.partitionBy("uses_critical_paths").orderBy(F.desc(F.round("f1_score", 9)), "detector")
    champions = (
        comparison.withColumn("_place", F.row_number().over(best)).where(F.col("_place") == 1)
    )
    ours = own.select(F.struct("precision", "recall", "f1_score")).scalar()

    def gain(metric: str) -> Column:
        theirs = F.col(metric)
        return (
            F.when(theirs > 0, (ours.getField(metric) - theirs) / theirs * 100)
            .otherwise(F.lit(0.0))
            .alias(f"{metric}_gain_pct")
        )

    return champions.select(
        F.when(F.col("uses_critical_paths"), "best_path_based")
        .otherwise("best_resource_only")
        .alias("rival"),
        "detector",
        F.col("f1_score").alias("rival_f1"),
        ours.getField("f1_score").alias("own_f1"),
        *[gain(m) for m in ("f1_score", "precision", "recall")],
    )
