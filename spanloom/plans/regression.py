"""Regression detection against per-program baselines, end to end."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..operators import baseline, detectors, evaluation, scoring
from ..operators.baseline import RUN
from ..operators.storage import written


@dataclass
class Regression:
    """Models of normal runs, scores of the others, and their evaluation.

    ``runs`` holds one row per run (features, archetype, ``regression_type``),
    ``functions`` the functions of each run's first path. Both feed about ten
    consumers; pass them written out.
    """

    runs: DataFrame
    functions: DataFrame

    @cached_property
    def split(self) -> DataFrame:
        normal = self.runs.where(~F.col("is_regression"))
        return written(baseline.split_by_input(normal), "split-runs")

    @cached_property
    def base(self) -> DataFrame:
        return self.split.where("is_baseline").drop("is_baseline")

    @cached_property
    def judged(self) -> DataFrame:
        tests = self.split.where(~F.col("is_baseline")).drop("is_baseline")
        judged = baseline.label_union(tests, self.runs.where("is_regression"))
        # only a program without any baseline is skipped
        return judged.join(self.base.select("program").distinct(), "program", "left_semi")

    @cached_property
    def split_functions(self) -> DataFrame:
        """Functions of baseline and judged runs, dealt by run once for both."""
        sides = [r.select(*RUN, F.lit(base).alias("is_baseline")) for r, base in ((self.base, True), (self.judged, False))]
        return written(self.functions.join(sides[0].unionByName(sides[1]), RUN), "split-functions")

    @cached_property
    def base_functions(self) -> DataFrame:
        return self.split_functions.where("is_baseline").drop("is_baseline")

    @cached_property
    def judged_functions(self) -> DataFrame:
        return self.split_functions.where(~F.col("is_baseline")).drop("is_baseline")

    @cached_property
    def frequencies(self) -> DataFrame:
        return baseline.function_frequency_model(self.base_functions)

    @cached_property
    def grams(self) -> DataFrame:
        return baseline.ngram_model(self.base_functions, RUN)

    @cached_property
    def lengths(self) -> DataFrame:
        return baseline.length_model(self.base)

    @cached_property
    def resources(self) -> DataFrame:
        return baseline.resource_model(self.base)

    @cached_property
    def archetypes(self) -> DataFrame:
        return baseline.archetype_model(self.base)

    @cached_property
    def bounds(self) -> DataFrame:
        return baseline.bounds_model(self.base)

    @cached_property
    def path_scores(self) -> DataFrame:
        return scoring.score_path(
            self.judged, self.judged_functions, self.frequencies, self.grams, self.lengths
        )

    @cached_property
    def resource_scores(self) -> DataFrame:
        return scoring.score_resource(self.judged, self.resources)

    @cached_property
    def archetype_scores(self) -> DataFrame:
        return scoring.score_archetype(self.judged, self.archetypes)

    @cached_property
    def bounds_scores(self) -> DataFrame:
        return scoring.score_bounds(self.judged, self.bounds)

    @cached_property
    def scored(self) -> DataFrame:
        signals = [self.path_scores, self.resource_scores, self.archetype_scores, self.bounds_scores]
        return scoring.combine_signals(self.judged, signals)

    @cached_property
    def detections(self) -> DataFrame:
        return written(self.scored, "detections")

    @cached_property
    def exact_flags(self) -> DataFrame:
        """The comparison detectors without random trees, one row per run and detector."""
        flags = detectors.duration_threshold(self.judged, self.bounds)
        for part in (
            detectors.control_chart(self.judged, self.bounds),
            detectors.resource_threshold(self.judged, self.resources),
            self.one_class(detectors.PATH_FEATURES, "one_class"),
            self.one_class(detectors.RESOURCE_ONLY, "resource_only_one_class"),
        ):
            flags = flags.unionByName(part)
        return flags

    @cached_property
    def flags(self) -> DataFrame:
        """All comparison detectors, one row per run and detector."""
        return self.exact_flags.unionByName(
            self.forest(detectors.PATH_FEATURES, "isolation_forest")
        ).unionByName(self.forest(detectors.RESOURCE_ONLY, "resource_only_isolation_forest"))

    def one_class(self, columns: list[str], name: str) -> DataFrame:
        return detectors.one_class_kernel(
            self.base, self.judged, columns, name
        )

    def forest(self, columns: list[str], name: str) -> DataFrame:
        return detectors.isolation_forest(
            self.base, self.judged, columns, name
        )

    @cached_property
    def quality(self) -> DataFrame:
        return evaluation.precision_recall_f1(evaluation.confusion_matrix(self.detections))

    @cached_property
    def comparison(self) -> DataFrame:
        return evaluation.compare_detectors(written(self.flags, "flags"))

    @cached_property
    def benefit(self) -> DataFrame:
        return evaluation.path_benefit(self.quality, self.comparison)

    @cached_property
    def ablation(self) -> DataFrame:
        return evaluation.ablation(self.detections)
