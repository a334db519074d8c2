"""Registered queries: result files of the regression study (A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.storage import scratch_path
from ..sources import tables
from . import queries_regression as regression
from .bindings import Tables
from .registry import query

RATES = ["precision", "recall", "f1_score"]


@query(
    "a10_detection_csv",
    f"{regression.RUNS} exec_key {regression.SCORED}",
    "SELECT *, concat_ws('_', program, input_id, iteration, CASE WHEN is_regression THEN 'True' ELSE 'False' END) AS exec_key FROM s_scores",
)
def detection_csv(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "detections")
    tables.write_detections(regression.analysis(t).detections, root)
    return tables.read_detections(t.spark, root)


def _sections_sql() -> str:
    rates = ", ".join(f'"{r}"' for r in RATES)
    return f"""SELECT 'evaluation' AS section, 'own' AS name, {rates} FROM (SELECT {regression._RATES_SQL} FROM (SELECT {regression._DETECTED} FROM s_scores) c) o
    UNION ALL SELECT 'baseline_comparisons', detector, {rates} FROM ({regression._COMPARE_ALL_SQL}) b
    UNION ALL SELECT 'ablation_analysis', excluded_signal, {rates} FROM ({regression._ablation_sql()}) a"""


@query("a10_json_summary", "section name ~precision ~recall ~f1_score", _sections_sql())
def json_summary(t: Tables) -> DataFrame:
    flow = regression.analysis(t)
    root = scratch_path(t.spark, "summary")
    sections = {
        "evaluation": flow.quality.withColumn("name", F.lit("own")),
        "baseline_comparisons": flow.comparison.withColumnRenamed("detector", "name"),
        "ablation_analysis": flow.ablation.withColumnRenamed("excluded_signal", "name"),
    }
    tables.write_summary(t.spark, root, "rq3_results.json", **sections)
    row = "array<struct<name:string,precision:double,recall:double,f1_score:double>>"
    schema = ", ".join(f"{s} {row}" for s in sections)
    read = t.spark.read.schema(schema).json(f"{root}/rq3_results.json")
    rows = F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in sections]), F.array(*sections)))
    return read.select(rows.alias("section", "rows")).select("section", F.inline("rows"))
