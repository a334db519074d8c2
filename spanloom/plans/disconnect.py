"""Static complexity against dynamic criticality, end to end."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import correlation, ranking
from ..operators.storage import written


@dataclass
class StaticDynamic:
    """The ranking analysis over static metrics and path functions.

    The two ranked tables have one row per (program, function) and feed every
    later step, so each is written once to the shared folder.
    """

    static: DataFrame
    functions: DataFrame
    bottlenecks: DataFrame
    executed: DataFrame
    paths: DataFrame

    @cached_property
    def stats(self) -> DataFrame:
        return ranking.dynamic_stats(self.functions, self.bottlenecks, self.paths)

    @cached_property
    def criticality(self) -> DataFrame:
        return ranking.dynamic_criticality(self.stats)

    @cached_property
    def quiet(self) -> DataFrame:
        return ranking.executed_not_critical(self.executed, self.stats, self.criticality)

    @cached_property
    def dynamic_ranked(self) -> DataFrame:
        return ranking.dynamic_rank(self.criticality.unionByName(self.quiet))

    @cached_property
    def static_ranked(self) -> DataFrame:
        return ranking.static_rank(self.static)

    @cached_property
    def ranks(self) -> tuple[DataFrame, DataFrame]:
        return written(self.static_ranked, "static-ranks"), written(self.dynamic_ranked, "dynamic-ranks")

    @cached_property
    def normed(self) -> DataFrame:
        return written(ranking.percentile_ranks(*self.ranks), "normed-ranks")

    @cached_property
    def classified(self) -> DataFrame:
        return ranking.classify_paradox(ranking.standardized_difference(self.normed))

    @cached_property
    def hidden(self) -> DataFrame:
        return ranking.hidden_bottlenecks(*self.ranks)

    @cached_property
    def counts(self) -> DataFrame:
        return ranking.paradox_counts(self.classified)

    @cached_property
    def correlations(self) -> DataFrame:
        return correlation.correlation_report(
            self.classified
        )
