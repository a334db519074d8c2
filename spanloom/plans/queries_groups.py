"""Registered queries: path groups (family G).

Exact checks use fixed centres (the mean vector per label of ``embeddings``);
the fitted forms run on the event paths' feature vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import archetypes, baseline, scoring, vectors
from ..operators.features import FEATURES, resource_thresholds
from ..operators.storage import scratch_path, written
from ..sources import tables
from .bindings import EVENT_KEY, Tables
from .path_groups import PathGroups
from .queries_traces import event_path_features
from .registry import query
from .views import VIEWS

DIM = 64
VECTOR_KEY = ["program", "input_id", "iteration", "path_rank", "vec_id"]


def scaled(t: Tables) -> DataFrame:
    return vectors.standardize(t.vectors, DIM)


def centers(z: DataFrame) -> DataFrame:
    """Fixed centres: the mean scaled vector of each label."""
    return z.groupBy(F.col("label").alias("id")).agg(vectors.mean_vector("z", DIM).alias("center"))


def assigned(t: Tables) -> DataFrame:
    z = written(scaled(t), "scaled")
    return written(vectors.assign_nearest(z, centers(z)), "assigned")


def long(df: DataFrame, key: list[str], column: str, out: str = "x") -> DataFrame:
    return df.select(*key, F.posexplode(column).alias("i", out))


@query("g01_standardize", "#vec_id #i ~z", "SELECT vec_id, i, z FROM g_z")
def standardize(t: Tables) -> DataFrame:
    return long(scaled(t), ["vec_id"], "z", "z")


@query("g02_inverse_standardize", "#vec_id #i ~x", "SELECT vec_id, i, x FROM g_long")
def inverse_standardize(t: Tables) -> DataFrame:
    scales = vectors.scaling(t.vectors, DIM)
    restored = vectors.inverse_standardize(scaled(t), scales, "z", "restored")
    return long(restored, ["vec_id"], "restored")


@query("g03_choose_k", "#k ~silhouette_sq chosen")
def choose_k(t: Tables) -> DataFrame:
    groups = PathGroups(written(event_path_features(t), "features"))
    return vectors.choose_k(groups.scaled, len(FEATURES))


@query("g04_fit_archetypes", "#id #size")
def fit_archetypes(t: Tables) -> DataFrame:
    return PathGroups(written(event_path_features(t), "features")).centers


def fitted(t: Tables) -> PathGroups:
    return PathGroups(written(event_path_features(t), "features"))


@query("g10_fitted_archetypes", "#archetype #size ~percentage primary_traits resource_profile dominant_type phase_behavior memory_pattern")
def fitted_archetypes(t: Tables) -> DataFrame:
    """Fitted clusters of the 33 features, profiled and put into words."""
    groups = fitted(t)
    return groups.interpreted.join(groups.profile.select("archetype", "size", "percentage"), "archetype")


@query("h14_fitted_archetype_scores", "program #input_id #iteration #archetype ~archetype_score")
def fitted_archetype_scores(t: Tables) -> DataFrame:
    """Assignments handed over as a file; even weeks make the model, odd weeks are judged."""
    path = scratch_path(t.spark, "assignments")
    tables.write_assignments(fitted(t).assigned.withColumn("path_rank", F.lit(1)), path)
    lookup = tables.archetype_lookup(tables.read_assignments(t.spark, path))
    runs = t.event_functions.select(*EVENT_KEY).distinct().withColumn("is_regression", F.lit(False))
    known = written(baseline.attach_archetype(runs, lookup), "runs-with-archetype")
    model = baseline.archetype_model(known.where(F.col("iteration") % 2 == 0))
    judged = known.where(F.col("iteration") % 2 != 0)
    return scoring.score_archetype(judged, model).join(judged, baseline.RUN)


@query("g05_assign_archetypes", "#vec_id #archetype ~distance_to_center", "g_assigned")
def assign_archetypes(t: Tables) -> DataFrame:
    return assigned(t)


VIEWS["g_lists"] = """
SELECT vec_id, archetype, list(z ORDER BY i) AS v FROM g_az GROUP BY 1, 2"""
VIEWS["g_pairs"] = """
SELECT a.vec_id, a.archetype, b.archetype AS other, pow(list_distance(a.v, b.v), 2) AS d
FROM g_lists a JOIN g_lists b ON a.vec_id <> b.vec_id"""


@query(
    "g06_silhouette",
    "~silhouette_sq #n",
    """SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette_sq, count(*) AS n FROM
    (SELECT vec_id, max(d) FILTER (other = archetype) AS a, min(d) FILTER (other <> archetype) AS b FROM
      (SELECT vec_id, archetype, other, avg(d) AS d FROM g_pairs GROUP BY 1, 2, 3) m GROUP BY 1) s""",
)
def silhouette(t: Tables) -> DataFrame:
    return vectors.silhouette(assigned(t), DIM)


# Euclidean distance as mean projection on fixed directions: L1 distance of the projections.
VIEWS["g_axes"] = f"""
SELECT m, unnest(range(1, {DIM + 1})) AS i, unnest(w) AS w FROM
 (SELECT unnest(range({DIM})) AS m, unnest({vectors.directions(DIM, DIM)!r}) AS w) a"""
VIEWS["g_shadows"] = """
SELECT vec_id, archetype, list(p ORDER BY m) AS p FROM
 (SELECT vec_id, archetype, m, sum(z * w) AS p FROM g_az a JOIN g_axes x ON x.i = a.i + 1 GROUP BY 1, 2, 3) s GROUP BY 1, 2"""
VIEWS["g_apart"] = f"""
SELECT a.vec_id, a.archetype, b.archetype AS other,
  list_sum(list_transform(range(1, {DIM + 1}), lambda j: abs(a.p[j] - b.p[j]))) / ({DIM} * {vectors.mean_projection(DIM)!r}::DOUBLE) AS d
FROM g_shadows a JOIN g_shadows b ON a.vec_id <> b.vec_id"""


def apart(t: Tables) -> DataFrame:
    return vectors.cluster_distances(assigned(t), DIM, ["vec_id"])


@query(
    "g06_silhouette_euclidean",
    "~silhouette #n",
    """SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette, count(*) AS n FROM
    (SELECT vec_id, max(d) FILTER (other = archetype) AS a, min(d) FILTER (other <> archetype) AS b FROM
      (SELECT vec_id, archetype, other, avg(d) AS d FROM g_apart GROUP BY 1, 2, 3) m GROUP BY 1) s""",
)
def silhouette_euclidean(t: Tables) -> DataFrame:
    return vectors.silhouette_euclidean(apart(t))


@query(
    "g07_calinski_harabasz",
    "~calinski_harabasz #k #n",
    """SELECT (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz, k, n FROM
    (SELECT sum(n * d) AS b FROM (SELECT archetype, sum((c - g) * (c - g)) AS d FROM g_means JOIN
       (SELECT i, avg(z) AS g FROM g_az GROUP BY 1) o USING (i) GROUP BY 1) x JOIN g_spread USING (archetype)) bb,
    (SELECT sum(within) AS w, count(*) AS k, sum(n) AS n FROM g_spread) ww""",
)
def calinski_harabasz(t: Tables) -> DataFrame:
    return vectors.calinski_harabasz(assigned(t), DIM)


@query(
    "g08_davies_bouldin",
    "~davies_bouldin #k",
    """SELECT avg(worst) AS davies_bouldin, count(*) AS k FROM
    (SELECT p.a, max((sa.scatter + sb.scatter) / p.d) AS worst FROM
      (SELECT x.archetype AS a, y.archetype AS b, sqrt(sum((x.c - y.c) * (x.c - y.c))) AS d
       FROM g_means x JOIN g_means y ON x.i = y.i AND x.archetype <> y.archetype GROUP BY 1, 2) p
      JOIN g_spread sa ON sa.archetype = p.a JOIN g_spread sb ON sb.archetype = p.b GROUP BY 1) q""",
)
def davies_bouldin(t: Tables) -> DataFrame:
    return vectors.davies_bouldin(assigned(t), DIM)


@query(
    "g09_archetype_profile",
    "#archetype #size ~percentage #programs ~avg_duration_ms ~avg_path_length #i ~mean ~std",
    """SELECT * FROM (SELECT archetype, count(*) AS size, count(*) / (SELECT count(*) FROM g_assigned) * 100 AS percentage,
      count(DISTINCT program) AS programs, abs(avg(path_duration_ns) / 1e6) AS avg_duration_ms, avg(path_length) AS avg_path_length
      FROM g_assigned GROUP BY 1) p
    JOIN (SELECT archetype, i, avg(x) AS mean, stddev_pop(z) AS std FROM g_az GROUP BY 1, 2) f USING (archetype)""",
)
def archetype_profile(t: Tables) -> DataFrame:
    profile = archetypes.archetype_profile(assigned(t), DIM)
    cells = F.posexplode(F.arrays_zip(F.col("feature_means"), F.col("feature_stds"))).alias("i", "_c")
    return profile.select("*", cells).select(
        "*", F.col("_c.feature_means").alias("mean"), F.col("_c.feature_stds").alias("std")
    )


@query(
    "g09_program_distribution",
    "#archetype program #paths",
    "SELECT archetype, program, count(*) AS paths FROM g_assigned GROUP BY 1, 2",
)
def program_distribution(t: Tables) -> DataFrame:
    return archetypes.program_distribution(assigned(t))


# Paths grouped by the number of functions on them: fixed groups for G10.
VIEWS["g_grouped"] = "SELECT *, least(path_depth // 5, 3) AS archetype FROM e_features"
_group_means = ", ".join(f"avg({n}) AS {n}" for n in FEATURES)
VIEWS["g_group_means"] = f"SELECT archetype, {_group_means} FROM g_grouped GROUP BY 1"

_INTERPRETED_SQL = """SELECT archetype, concat_ws(', ', {depth},
      CASE WHEN time_gini > 0.7 THEN 'CONCENTRATED' WHEN time_gini < 0.3 THEN 'BALANCED' END) AS primary_traits,
    coalesce(nullif(concat_ws(', ', {cpu}, {memory}, {io}), ''), 'LIGHTWEIGHT') AS resource_profile,
    CASE WHEN cpu_ratio > 0.5 THEN 'CPU_BOUND' WHEN memory_ratio > 0.5 THEN 'MEMORY_BOUND' WHEN io_ratio > 0.5 THEN 'IO_BOUND' ELSE 'MIXED' END AS dominant_type,
    CASE WHEN cpu_phases > 2 THEN 'PHASED' ELSE 'STABLE' END AS phase_behavior,
    CASE WHEN memory_monotonic > 0.5 THEN 'MONOTONIC_GROWTH' ELSE 'VOLATILE' END AS memory_pattern
  FROM g_group_means, (SELECT quantile_cont(cpu_mean, 0.8) AS cpu_high, quantile_cont(cpu_mean, 0.4) AS cpu_medium,
    quantile_cont(abs(memory_growth), 0.8) AS memory_high, quantile_cont(abs(memory_growth), 0.4) AS memory_medium,
    quantile_cont(io_intensity, 0.8) AS io_high, quantile_cont(io_intensity, 0.4) AS io_medium, max(path_depth) AS deepest FROM e_features) q"""
_INTERPRETED = "#archetype primary_traits resource_profile dominant_type phase_behavior memory_pattern"


def grouped_means(paths: DataFrame) -> DataFrame:
    group = F.least(F.floor(F.col("path_depth") / 5), F.lit(3)).alias("archetype")
    return paths.groupBy(group).agg(*[F.avg(n).alias(n) for n in FEATURES])


@query(
    "g10_interpret_archetype",
    _INTERPRETED,
    _INTERPRETED_SQL.format(
        depth="CASE WHEN path_depth <= deepest * 0.33::DOUBLE THEN 'SHALLOW' WHEN path_depth <= deepest * 0.66::DOUBLE THEN 'MEDIUM_DEPTH' ELSE 'DEEP' END",
        cpu="CASE WHEN cpu_mean > cpu_high THEN 'CPU_INTENSIVE' WHEN cpu_mean > cpu_medium THEN 'CPU_MODERATE' END",
        memory="CASE WHEN abs(memory_growth) > memory_high THEN 'MEMORY_GROWING' WHEN abs(memory_growth) > memory_medium THEN 'MEMORY_MODERATE' END",
        io="CASE WHEN io_intensity > io_high THEN 'IO_HEAVY' WHEN io_intensity > io_medium THEN 'IO_MODERATE' END",
    ),
)
def interpret_archetype(t: Tables) -> DataFrame:
    paths = written(event_path_features(t), "features")
    return archetypes.interpret_archetypes(grouped_means(paths), resource_thresholds(paths))


@query(
    "g10_interpret_archetype_fixed",
    _INTERPRETED,
    _INTERPRETED_SQL.format(
        depth="CASE WHEN path_depth < 5 THEN 'SHALLOW' WHEN path_depth < 15 THEN 'MEDIUM_DEPTH' ELSE 'DEEP' END",
        cpu="CASE WHEN cpu_mean > 50 THEN 'CPU_INTENSIVE' END",
        memory="CASE WHEN abs(memory_growth) > 10 THEN 'MEMORY_GROWING' END",
        io="CASE WHEN io_intensity > 5 THEN 'IO_HEAVY' END",
    ),
)
def interpret_archetype_fixed(t: Tables) -> DataFrame:
    return archetypes.interpret_archetypes(grouped_means(event_path_features(t)))


@query(
    "g11_representative_paths",
    "#archetype #vec_id #place ~distance_to_center",
    """SELECT * FROM (SELECT archetype, vec_id, distance_to_center, row_number() OVER (PARTITION BY archetype
      ORDER BY round(distance_to_center, 9), program, input_id, iteration, path_rank, vec_id) AS place FROM g_assigned) r WHERE place <= 3""",
)
def representative_paths(t: Tables) -> DataFrame:
    return archetypes.representative_paths(assigned(t), VECTOR_KEY)


@query(
    "g12_iteration_stability",
    "~iteration_stability #inputs",
    """SELECT coalesce(avg(CAST(one AS INTEGER)), 0) AS iteration_stability, count(*) AS inputs FROM
    (SELECT program, input_id, count(DISTINCT archetype) = 1 AS one FROM g_assigned WHERE path_rank = 1 GROUP BY 1, 2 HAVING count(*) > 1) s""",
)
def iteration_stability(t: Tables) -> DataFrame:
    return archetypes.iteration_stability(assigned(t))


@query(
    "g13_program_diversity",
    "program #unique_archetypes #total_inputs ~diversity_score",
    """SELECT program, count(DISTINCT archetype) AS unique_archetypes, count(*) AS total_inputs, count(DISTINCT archetype) / 10 AS diversity_score FROM
    (SELECT *, row_number() OVER (PARTITION BY program, input_id ORDER BY iteration, path_idx) AS rn FROM g_assigned) a WHERE rn = 1 GROUP BY 1""",
)
def program_diversity(t: Tables) -> DataFrame:
    return archetypes.program_diversity(assigned(t), 10)


@query(
    "g14_archetype_purity",
    "#archetype #size ~purity_rms",
    """SELECT archetype, max(n) AS size, CASE WHEN max(n) <= 1 THEN 1 ELSE 1 - sqrt(avg(d) FILTER (other = archetype) / max(overall)) END AS purity_rms
    FROM g_pairs JOIN g_spread USING (archetype), (SELECT avg(d) AS overall FROM g_pairs) o GROUP BY 1""",
)
def archetype_purity(t: Tables) -> DataFrame:
    return archetypes.archetype_purity(assigned(t), DIM)


@query(
    "g14_archetype_purity_euclidean",
    "#archetype #size ~purity",
    """SELECT archetype, max(n) AS size, CASE WHEN max(n) <= 1 THEN 1 ELSE 1 - avg(d) FILTER (other = archetype) / max(overall) END AS purity
    FROM g_apart JOIN g_spread USING (archetype), (SELECT avg(d) AS overall FROM g_apart) o GROUP BY 1""",
)
def archetype_purity_euclidean(t: Tables) -> DataFrame:
    return archetypes.purity_euclidean(written(apart(t), "apart"))


_CROSS_SQL = """SELECT archetype, string_agg(DISTINCT program, ',' ORDER BY program) AS applications,
    count(DISTINCT program) / (SELECT count(DISTINCT program) FROM g_assigned) AS universality, count(*) AS total_instances
    FROM g_assigned GROUP BY 1 HAVING count(DISTINCT program) > 1"""


@query("g15_cross_program_archetypes", "#archetype applications ~universality #total_instances", _CROSS_SQL)
def cross_program_archetypes(t: Tables) -> DataFrame:
    return archetypes.cross_program_archetypes(assigned(t))


@query(
    "g16_universal_patterns",
    "#archetype ~universality #total_instances #size",
    f"""SELECT * FROM ({_CROSS_SQL}) c JOIN (SELECT archetype, count(*) AS size FROM g_assigned GROUP BY 1) p USING (archetype)
    WHERE universality >= 0.5""",
)
def universal_patterns(t: Tables) -> DataFrame:
    rows = assigned(t)
    about = rows.groupBy("archetype").agg(F.count(F.lit(1)).alias("size"))
    return archetypes.universal_patterns(archetypes.cross_program_archetypes(rows), about)


_SHARES = " ".join(f"~archetype_{i}" for i in range(10))
_SHARES_SQL = ", ".join(
    f"count(*) FILTER (archetype = {i}) / count(*) * 100 AS archetype_{i}" for i in range(10)
)


@query(
    "g17_program_signature",
    f"program {_SHARES}",
    f"SELECT program, {_SHARES_SQL} FROM g_assigned GROUP BY 1",
)
def program_signature(t: Tables) -> DataFrame:
    return archetypes.program_signature(assigned(t), list(range(10)))
