"""Path features, clustering and description of the clusters, end to end."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..operators import archetypes, features, vectors
from ..operators.storage import written

DIM = len(features.FEATURES)


def path_features(
    functions: DataFrame,
    static: DataFrame,
    telemetry: DataFrame,
    *,
    run: list[str],
    key: list[str],
    width: int,
    metadata: dict[str, str] | None = None,
) -> DataFrame:
    """The 33 features of every path, with run metadata and the vector.

    Functions feed several extractors and are written once; telemetry is folded
    once for paths and their phases together.
    """
    functions = written(functions, "path-functions")
    intervals = features.path_intervals(functions, key).withColumn("phase", F.lit(None).cast("int"))
    intervals = intervals.unionByName(features.phase_intervals(functions, key))
    measured = written(
        features.resource_features(intervals, written(telemetry, "telemetry"), run, [*key, "phase"], width=width),
        "measured",
    )
    parts = [
        features.structural_features(functions, key, static, ["program", "function_name"]),
        features.temporal_features(functions, key),
        measured.where(F.col("phase").isNull()).drop("phase"),
        features.transition_features(functions, key),
        features.phase_features(
            functions, telemetry, run, key, width=width, measured=measured.where(F.col("phase").isNotNull())
        ),
    ]
    about = features.path_metadata(functions, key, metadata or {})
    return features.assemble_features(parts, key, about)


@dataclass
class PathGroups:
    """Clusters of similar paths.

    The feature table and the labelled, scaled table each feed many consumers
    and are written once. ``starts`` and ``k`` (chosen if not given) drive the
    k-means fits.
    """

    paths: DataFrame
    k: int | None = None
    starts: int = 20
    seed: int = 42
    dim: int = DIM

    @cached_property
    def scales(self) -> DataFrame:
        return vectors.scaling(self.paths, self.dim)

    @cached_property
    def scaled(self) -> DataFrame:
        return written(vectors.standardize(self.paths, self.dim), "scaled-paths")

    @cached_property
    def chosen_k(self) -> int:
        if self.k is not None:
            return self.k
        table = vectors.choose_k(
            self.scaled, self.dim, seed=self.seed, starts=max(1, self.starts // 2)
        )
        return table.where("chosen").head()["k"]

    @cached_property
    def centers(self) -> DataFrame:
        return vectors.fit_centers(self.scaled, self.chosen_k, seed=self.seed, starts=self.starts)

    @cached_property
    def assigned(self) -> DataFrame:
        return written(vectors.assign_nearest(self.scaled, self.centers), "assigned-paths")

    @cached_property
    def profile(self) -> DataFrame:
        return archetypes.archetype_profile(self.assigned, self.dim)

    @cached_property
    def thresholds(self) -> DataFrame:
        return features.resource_thresholds(self.paths)

    @cached_property
    def interpreted(self) -> DataFrame:
        return archetypes.interpret_archetypes(archetypes.named_means(self.profile), self.thresholds)
