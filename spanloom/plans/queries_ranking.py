"""Registered queries: static against dynamic ranking (family F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import inference
from ..operators import correlation, ranking
from .bindings import Tables
from .disconnect import StaticDynamic
from .registry import query
from .views import VIEWS

FN = "program function_name"


def analysis(t: Tables) -> StaticDynamic:
    return StaticDynamic(
        static=t.static,
        functions=t.calls.where("on_path"),
        bottlenecks=t.calls.where("is_bottleneck"),
        executed=t.calls,
        paths=t.paths,
    )


@query("f01_static_complexity", f"{FN} ~complexity", "f_static")
def static_complexity(t: Tables) -> DataFrame:
    return t.static.withColumn("complexity", ranking.static_complexity())


@query("f02_static_rank", f"{FN} ~complexity #static_rank", "f_static_ranked")
def static_rank(t: Tables) -> DataFrame:
    return ranking.static_rank(t.static)


@query(
    "f03_dynamic_stats",
    f"{FN} #appearances #total_duration_ns #total_self_time_ns #rank_sum #bottleneck_count #total_paths",
    "f_stats",
)
def dynamic_stats(t: Tables) -> DataFrame:
    return analysis(t).stats


SCORES = "~criticality #appearances ~avg_duration_ns ~avg_self_time_ns ~appearance_rate ~avg_rank in_critical_paths"


@query("f04_dynamic_criticality", f"{FN} {SCORES}", "f_critical")
def dynamic_criticality(t: Tables) -> DataFrame:
    return analysis(t).criticality


@query("f05_executed_not_critical", f"{FN} {SCORES}", "f_quiet")
def executed_not_critical(t: Tables) -> DataFrame:
    return analysis(t).quiet


@query("f06_dynamic_rank", f"{FN} ~criticality #dynamic_rank", "f_dynamic_ranked")
def dynamic_rank(t: Tables) -> DataFrame:
    return analysis(t).dynamic_ranked


@query(
    "f07_percentile_rank",
    f"{FN} #static_rank #dynamic_rank ~static_norm ~dynamic_norm ~rank_difference",
    "f_normed",
)
def percentile_rank(t: Tables) -> DataFrame:
    return analysis(t).normed


@query("f08_classify_paradox", f"{FN} #static_rank #dynamic_rank ~rank_difference category", "f_classified")
def classify_paradox(t: Tables) -> DataFrame:
    return analysis(t).classified


@query("f09_standardized_difference", f"{FN} ~rank_difference ~effect_size", "f_classified")
def standardized_difference(t: Tables) -> DataFrame:
    return ranking.standardized_difference(analysis(t).normed)


@query(
    "f10_paradox_counts",
    "program #simple_but_critical #complex_but_irrelevant #matched #total_functions",
    """SELECT program, count(*) FILTER (category = 'simple_but_critical') AS simple_but_critical,
    count(*) FILTER (category = 'complex_but_irrelevant') AS complex_but_irrelevant,
    count(*) FILTER (category = 'matched') AS matched, count(*) AS total_functions FROM f_classified GROUP BY 1""",
)
def paradox_counts(t: Tables) -> DataFrame:
    return analysis(t).counts


@query(
    "f11_hidden_bottlenecks",
    f"{FN} #dynamic_rank #static_rank ~criticality ~complexity ~appearance_rate #loc ~impact_score",
    """SELECT *, criticality / complexity AS impact_score FROM f_dynamic_ranked JOIN
    (SELECT *, count(*) OVER (PARTITION BY program) AS total FROM f_static_ranked) s USING (program, function_name)
    WHERE dynamic_rank <= 20 AND static_rank > total / 2""",
)
def hidden_bottlenecks(t: Tables) -> DataFrame:
    return analysis(t).hidden


@query(
    "f12_pearson",
    "program ~r #n",
    "SELECT program, corr(complexity, criticality) AS r, count(*) AS n FROM f_classified GROUP BY 1 HAVING count(*) > 2",
)
def pearson(t: Tables) -> DataFrame:
    return correlation.pearson(analysis(t).classified, ["program"], "complexity", "criticality")


@query(
    "f13_spearman",
    "program ~r #n",
    """SELECT program, corr(a, b) AS r, count(*) AS n FROM
    (SELECT program, rank() OVER (PARTITION BY program ORDER BY loc) + (count(*) OVER (PARTITION BY program, loc) - 1) / 2 AS a,
            rank() OVER (PARTITION BY program ORDER BY dynamic_rank) AS b FROM f_classified) x GROUP BY 1""",
)
def spearman(t: Tables) -> DataFrame:
    # Lines of code have many ties, so mean ranks matter here.
    flow = analysis(t)
    return correlation.spearman(
        flow.classified, ["program"], "loc", "dynamic_rank"
    )


T_SQL = """SELECT program, r, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM
    (SELECT program, corr(complexity, criticality) AS r, count(*) AS n FROM f_classified GROUP BY 1) x"""


@query("f14_correlation_t", "program ~r #n ~t", T_SQL)
def correlation_t(t: Tables) -> DataFrame:
    return correlation.with_p_value(pearson(t))


# The tail of Student's t as an integral over the angle whose sine is the correlation, by Simpson's rule.
STEPS = 20_000


def _tail_sql(r: str, n: str) -> str:
    weight = f"(CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"

    def area(start: str) -> str:
        angle = f"({start} + (pi() / 2 - {start}) * i / {STEPS}.0)"
        return f"(sum({weight} * pow(cos({angle}), {n} - 3)) * (pi() / 2 - {start}))"

    return f"(SELECT {area(f'asin(abs({r}))')} / {area('0')} FROM range(0, {STEPS + 1}) steps(i))"


@query(
    "f14_correlation_p_value",
    "program ~r #n ~p_value",
    f"SELECT program, r, n, {_tail_sql('r', 'n')} AS p_value FROM ({T_SQL}) x",
)
def correlation_p_value(t: Tables) -> DataFrame:
    return correlation.with_p_value(pearson(t))


OMNIBUS_SQL = """SELECT program, n, z1 * z1 + z2 * z2 AS k2, exp(-(z1 * z1 + z2 * z2) / 2) AS k2_p, exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS k2_normal FROM
    (SELECT *, ln(s + sqrt(s * s + 1)) / sqrt(0.5 * ln(w2)) AS z1,
            (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2
     FROM (SELECT *, y / sqrt(2 / (w2 - 1)) AS s, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a
      FROM (SELECT *, -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2,
                   g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
                   (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
                   6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1
       FROM (SELECT program, CAST(count(*) AS DOUBLE) AS n, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS g1,
                    avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) AS b2
        FROM (SELECT program, criticality AS v, avg(criticality) OVER (PARTITION BY program) AS m FROM f_classified) q GROUP BY 1) m1) m2) m3) m4"""


@query("f15_dagostino_normality", "program #n ~k2 ~k2_p k2_normal", OMNIBUS_SQL)
def dagostino_normality(t: Tables) -> DataFrame:
    return correlation.dagostino(analysis(t).classified, ["program"], "criticality")


def _poly_sql(x: str, coefficients: tuple[float, ...]) -> str:
    terms = " + ".join(f"({c!r}::DOUBLE) * pow({x}, {i})" for i, c in enumerate(coefficients))
    return f"({terms})"


def _quantile_sql(p: str) -> str:
    """The normal quantile by the same published approximation, power by power."""

    def ratio(x: str, region) -> str:
        return f"{_poly_sql(x, region[0])} / {_poly_sql(x, region[1])}"

    root = f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"""CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(f"(0.180625 - pow({p} - 0.5, 2))", inference.CENTRAL)}
        ELSE sign({p} - 0.5) * CASE WHEN {root} <= 5 THEN {ratio(f"({root} - 1.6)", inference.MIDDLE)} ELSE {ratio(f"({root} - 5)", inference.FAR)} END END"""


def _normal_tail_sql(z: str) -> str:
    """Simpson's rule over the density, from the middle out."""
    weight = f"(CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    far = f"least(abs({z}), 12)"
    area = f"(SELECT sum({weight} * exp(-pow({far} * i / {STEPS}.0, 2) / 2)) * {far} / {STEPS} / 3 / sqrt(2 * pi()) FROM range(0, {STEPS + 1}) steps(i))"
    return f"(0.5 - sign({z}) * {area})"


def _shapiro_view(value: str) -> str:
    """Royston's W and p per program, for samples of any size from 3 on."""
    c = correlation
    return f"""SELECT program, n, w, w_p, w_p > 0.05 AS w_normal FROM
    (SELECT *, CASE WHEN w >= 1 THEN 1.0 WHEN n = 3 THEN greatest(0, 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))))
                    WHEN n <= 11 AND ln(1 - w) >= gamma THEN 0 ELSE {_normal_tail_sql("z")} END AS w_p FROM
     (SELECT *, CASE WHEN n <= 11 THEN (-ln(gamma - ln(1 - w)) - {_poly_sql("n", c.SMALL_MEAN)}) / exp({_poly_sql("n", c.SMALL_LOG_STD)})
                     ELSE (ln(1 - w) - {_poly_sql("ln(n)", c.LARGE_MEAN)}) / exp({_poly_sql("ln(n)", c.LARGE_LOG_STD)}) END AS z FROM
      (SELECT *, {_poly_sql("n", c.SMALL_GAMMA)} AS gamma, CASE WHEN ss > 0 THEN least(pow(b, 2) / ss, 1) ELSE 1 END AS w FROM
       (SELECT program, any_value(n) AS n, sum(pow(x - mean, 2)) AS ss, sum(x *
          CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN n > 5 AND i = n - 1 THEN a2 WHEN n > 5 AND i = 2 THEN -a2
               WHEN n = 3 THEN 0 WHEN n > 5 THEN m / sqrt((mm - 2 * top * top - 2 * second * second) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
               ELSE m / sqrt((mm - 2 * top * top) / (1 - 2 * a1 * a1)) END) AS b FROM
        (SELECT *, CASE WHEN n = 3 THEN sqrt(0.5) ELSE top / sqrt(mm) + {_poly_sql("(1 / sqrt(n))", c.EXTREME_1)} END AS a1,
                second / sqrt(mm) + {_poly_sql("(1 / sqrt(n))", c.EXTREME_2)} AS a2 FROM
         (SELECT *, sum(m * m) OVER p AS mm, avg(x) OVER p AS mean, max(m) OVER p AS top, max(m) FILTER (i < n) OVER p AS second FROM
          (SELECT *, {_quantile_sql("((i - 0.375) / (n + 0.25))")} AS m FROM
           (SELECT program, {value} AS x, row_number() OVER (PARTITION BY program ORDER BY {value}, function_name)::DOUBLE AS i,
                   (count(*) OVER (PARTITION BY program))::DOUBLE AS n FROM f_classified) r1) r2
          WINDOW p AS (PARTITION BY program)) r3) r4 GROUP BY program) r5) r6) r7) r8 WHERE n >= 3"""


VIEWS["f_shapiro_static"], VIEWS["f_shapiro_dynamic"] = _shapiro_view("complexity"), _shapiro_view("criticality")
VIEWS["f_omnibus_dynamic"] = OMNIBUS_SQL
VIEWS["f_omnibus_static"] = OMNIBUS_SQL.replace("criticality", "complexity")


def _verdict_sql(which: str) -> str:
    return f"""SELECT program, n, w, w_p, k2, k2_p, coalesce(w_normal AND coalesce(k2_normal, true), false) AS is_normal
    FROM (SELECT program, count(*) AS n FROM f_classified GROUP BY 1) sizes
    LEFT JOIN (SELECT program, w, w_p, w_normal FROM f_shapiro_{which}) s USING (program)
    LEFT JOIN (SELECT program, k2, k2_p, k2_normal FROM f_omnibus_{which} WHERE n >= 8) o USING (program)"""


VIEWS["f_verdict_static"], VIEWS["f_verdict_dynamic"] = _verdict_sql("static"), _verdict_sql("dynamic")


@query("f16_shapiro_wilk", "program #n ~w ~w_p w_normal", "f_shapiro_static")
def shapiro_wilk(t: Tables) -> DataFrame:
    flow = analysis(t)
    return correlation.shapiro_wilk(
        flow.classified, ["program"], "complexity", "function_name"
    )


@query("f17_normality_verdict", "program #n ~w ~w_p ~k2 ~k2_p is_normal", "f_verdict_static")
def normality_verdict(t: Tables) -> DataFrame:
    flow = analysis(t)
    return correlation.normality_verdict(
        flow.classified, ["program"], "complexity", "function_name"
    )


@query(
    "f17_correlation_report",
    "program #n ~pearson ~pearson_p ~spearman ~spearman_p pearson_appropriate",
    f"""SELECT program, n, a AS pearson, {_tail_sql("a", "n")} AS pearson_p, b AS spearman, {_tail_sql("b", "n")} AS spearman_p,
    s.is_normal OR d.is_normal AS pearson_appropriate FROM
    (SELECT program, count(*) AS n, corr(complexity, criticality) AS a, corr(x, y) AS b FROM
     (SELECT *, rank() OVER (PARTITION BY program ORDER BY static_rank) AS x, rank() OVER (PARTITION BY program ORDER BY dynamic_rank) AS y FROM f_classified) r
     GROUP BY 1 HAVING count(*) > 2) c
    JOIN (SELECT program, is_normal FROM f_verdict_static) s USING (program) JOIN (SELECT program, is_normal FROM f_verdict_dynamic) d USING (program)""",
)
def correlation_report(t: Tables) -> DataFrame:
    return analysis(t).correlations


@query(
    "f18_quadrant_coordinates",
    f"{FN} ~x ~y category",
    """SELECT program, function_name, category, (max(static_rank) OVER p - static_rank) / (max(static_rank) OVER p - min(static_rank) OVER p) AS x,
    (max(dynamic_rank) OVER p - dynamic_rank) / (max(dynamic_rank) OVER p - min(dynamic_rank) OVER p) AS y
    FROM f_classified WINDOW p AS (PARTITION BY program)""",
)
def quadrant_coordinates(t: Tables) -> DataFrame:
    return ranking.quadrant_coordinates(analysis(t).classified)


@query(
    "f19_coverage_sets",
    f"{FN} coverage",
    """SELECT program, function_name, CASE WHEN d IS NULL THEN 'static_only' WHEN s IS NULL THEN 'dynamic_only' ELSE 'common' END AS coverage
    FROM (SELECT DISTINCT program, function_name, 1 AS s FROM b_static) a
    FULL JOIN (SELECT DISTINCT program, function_name, 1 AS d FROM b_calls WHERE on_path) b USING (program, function_name)""",
)
def coverage_sets(t: Tables) -> DataFrame:
    return ranking.coverage_sets(t.static, t.calls.where("on_path"))
