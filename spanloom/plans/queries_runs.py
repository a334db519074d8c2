"""Registered queries: parsed elements (I), run bookkeeping (J), streams (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import IO_CALLS
from ..operators import bookkeeping, elements as ops, scoring
from ..operators.baseline import RUN
from ..operators.storage import scratch_path, written
from ..streaming import live
from ..streaming.live import stream_scores, stream_telemetry
from .bindings import Tables
from .queries_regression import analysis as regression_analysis
from .registry import query
from .views import VIEWS

_IO_LIST = ", ".join(f"'{n}'" for n in IO_CALLS)


_COUNTS_SQL = """SELECT function_id, count(*) FILTER (tag = 'parameter') AS parameters, count(*) FILTER (tag IN ('for', 'while', 'do')) AS loops,
    count(*) FILTER (tag = 'expr_stmt') AS expression_statements, count(*) FILTER (tag = 'decl_stmt') AS declaration_statements,
    count(*) FILTER (tag = 'empty_stmt') AS empty_statements, count(*) FILTER (tag IN ('if', 'else')) AS ifs,
    count(*) FILTER (tag = 'switch') AS switches, count(*) FILTER (tag IN ('if', 'else', 'elif')) AS all_branches FROM b_elements GROUP BY 1"""
_NESTED_SQL = """SELECT f.function_id, count(p.function_id) AS nested_loops FROM (SELECT DISTINCT function_id FROM b_elements) f LEFT JOIN
    (SELECT u.function_id FROM i_ancestors u JOIN b_elements i ON i.function_id = u.function_id AND i.element_id = u.element_id AND i.tag IN ('for', 'while', 'do')
     JOIN b_elements o ON o.function_id = u.function_id AND o.element_id = u.ancestor AND o.tag IN ('for', 'while', 'do')) p
    ON p.function_id = f.function_id GROUP BY 1"""
_LOC_SQL = """SELECT function_id, sum(CASE WHEN in_control THEN 0 ELSE length(text) - length(replace(text, ';', '')) END)
      + count(*) FILTER (tag = 'block') - 1 AS loc FROM b_elements GROUP BY 1"""
_CALLS_SQL = """SELECT function_id, count(*) FILTER (tag = 'call') AS calls,
    bool_or(tag = 'call' AND callee = concat('fn_', CAST(function_id % 400 AS VARCHAR))) AS is_recursive FROM b_elements GROUP BY 1"""
_HAS_IO_SQL = f"SELECT function_id, bool_or(tag = 'call' AND callee IN ({_IO_LIST})) AS has_io FROM b_elements GROUP BY 1"
_CALLERS_SQL = """SELECT function_id, function_name, coalesce(n, 0) AS callers FROM
    (SELECT DISTINCT function_id, function_name FROM b_elements) f
    LEFT JOIN (SELECT callee AS function_name, count(*) AS n FROM b_elements WHERE tag = 'call' GROUP BY 1) c USING (function_name)"""


@query(
    "i01_element_counts",
    "#function_id #parameters #loops #expression_statements #declaration_statements #empty_statements #ifs #switches #all_branches",
    _COUNTS_SQL,
)
def element_counts(t: Tables) -> DataFrame:
    return ops.element_counts(t.elements)


VIEWS["i_ancestors"] = """
WITH RECURSIVE up(function_id, element_id, ancestor) AS
 (SELECT function_id, element_id, parent_id FROM b_elements WHERE parent_id IS NOT NULL
  UNION ALL SELECT up.function_id, up.element_id, e.parent_id FROM up JOIN b_elements e
    ON e.function_id = up.function_id AND e.element_id = up.ancestor WHERE e.parent_id IS NOT NULL)
SELECT * FROM up"""


@query(
    "i02_nested_loop_pairs",
    "#function_id #nested_loops",
    _NESTED_SQL,
)
def nested_loop_pairs(t: Tables) -> DataFrame:
    return ops.nested_loop_pairs(t.elements)


@query(
    "i03_logical_loc",
    "#function_id #loc",
    _LOC_SQL,
)
def logical_loc(t: Tables) -> DataFrame:
    return ops.logical_loc(t.elements)


@query(
    "i04_has_io",
    "#function_id has_io",
    _HAS_IO_SQL,
)
def has_io(t: Tables) -> DataFrame:
    return ops.has_io(t.elements)


@query(
    "i05_call_counts",
    "#function_id #calls is_recursive",
    _CALLS_SQL,
)
def call_counts(t: Tables) -> DataFrame:
    return ops.call_counts(t.elements)


@query(
    "i06_caller_counts",
    "#function_id function_name #callers",
    _CALLERS_SQL,
)
def caller_counts(t: Tables) -> DataFrame:
    return ops.caller_counts(t.elements.select("function_id", "function_name").distinct(), t.elements)


@query(
    "i07_functions_by_file",
    "file #functions #first #last",
    """SELECT file, count(*) AS functions, min(function_id) AS first, max(function_id) AS last FROM
    (SELECT DISTINCT file, function_id FROM b_elements WHERE NOT ends_with(file, '.txt')) f GROUP BY 1""",
)
def functions_by_file(t: Tables) -> DataFrame:
    functions = t.elements.select("file", F.struct("function_id").alias("function")).distinct()
    nested = ops.functions_by_file(functions)
    return nested.groupBy("file").agg(
        F.sum(F.size("functions")).alias("functions"),
        F.min(F.array_min("functions.function_id")).alias("first"),
        F.max(F.array_max("functions.function_id")).alias("last"),
    )


@query(
    "i08_function_metrics",
    "#function_id simple_name #loops #nested_loops #loc has_io #calls is_recursive #callers",
    f"""SELECT * , function_name AS simple_name FROM ({_COUNTS_SQL}) JOIN ({_NESTED_SQL}) USING (function_id) JOIN ({_LOC_SQL}) USING (function_id)
    JOIN ({_HAS_IO_SQL}) USING (function_id) JOIN ({_CALLS_SQL}) USING (function_id) JOIN ({_CALLERS_SQL}) USING (function_id)""",
)
def function_metrics(t: Tables) -> DataFrame:
    return ops.function_metrics(written(t.elements, "elements"))


@query(
    "j01_execution_summary",
    "type range ~min_time ~max_time ~avg_time #total_success #total_failure ~success_rate",
    """SELECT type, "range", min(seconds) FILTER (success) AS min_time, max(seconds) FILTER (success) AS max_time,
    avg(seconds) FILTER (success) AS avg_time, (SELECT count(*) FROM b_executions WHERE success) AS total_success,
    (SELECT count(*) FROM b_executions WHERE NOT success) AS total_failure, (SELECT avg(CAST(success AS INTEGER)) FROM b_executions) AS success_rate
    FROM b_executions GROUP BY 1, 2""",
)
def execution_summary(t: Tables) -> DataFrame:
    return bookkeeping.execution_summary(t.executions)


@query(
    "j02_slice_inputs",
    "#o_orderkey #position",
    """SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders) o
    WHERE position > 1000 AND position <= 1500""",
)
def slice_inputs(t: Tables) -> DataFrame:
    # Range 2 of 500 inputs each.
    return bookkeeping.slice_inputs(t.table("orders"), ["o_orderdate", "o_orderkey"], 500, 2)


@query(
    "j03_failure_table",
    "type range #failed #first #last",
    """SELECT type, "range", count(*) AS failed, min(input) AS first, max(input) AS last FROM b_executions WHERE NOT success GROUP BY 1, 2""",
)
def failure_table(t: Tables) -> DataFrame:
    nested = bookkeeping.failure_table(t.executions)
    return nested.groupBy("type", "range").agg(
        F.sum(F.size("inputs")).alias("failed"),
        F.min(F.array_min("inputs")).alias("first"),
        F.max(F.array_max("inputs")).alias("last"),
    )


@query(
    "j04_sample_parameter_grid",
    "kind brand status",
    """SELECT kind, brand, status FROM (SELECT DISTINCT p_type AS kind FROM part) a, (SELECT DISTINCT p_brand AS brand FROM part) b,
    (SELECT DISTINCT o_orderstatus AS status FROM orders) c ORDER BY md5(concat_ws('|', '42', kind, brand, status)) LIMIT 100""",
)
def sample_parameter_grid(t: Tables) -> DataFrame:
    part = t.table("part")
    options = part.agg(
        F.collect_set("p_type").alias("kinds"), F.collect_set("p_brand").alias("brands")
    ).withColumn("statuses", t.table("orders").agg(F.collect_set("o_orderstatus")).scalar())
    grid = bookkeeping.parameter_grid(
        {"kind": F.col("kinds"), "brand": F.col("brands"), "status": F.col("statuses")}, options
    )
    return bookkeeping.sample_grid(grid, 100)


def _turn_sql(source: str, half: str, other: str, size: str, turn: int) -> str:
    keyed = f"('0x' || right(md5(concat_ws('|', '42', '{turn}', {other}::VARCHAR)), 15))::BIGINT"
    kept = f"{half}, {other}, draw, ks, bs, ss"
    return f"SELECT {kept.replace(half + ',', f'({half} + {keyed} % {size}) % {size} AS {half},', 1)} FROM ({source})"


_NUMBERS = """SELECT i // (bs * ss) AS a, i % (bs * ss) AS b, i AS draw, ks, bs, ss FROM range(0, 5000) r(i),
    (SELECT count(DISTINCT p_type) AS ks, count(DISTINCT p_brand) AS bs FROM part) p, (SELECT count(DISTINCT o_orderstatus) AS ss FROM orders) o
    WHERE i < ks * bs * ss"""
for _turn in range(bookkeeping.ROUNDS):
    _NUMBERS = _turn_sql(_NUMBERS, *(("a", "b", "ks") if _turn % 2 == 0 else ("b", "a", "(bs * ss)")), _turn)


def _values_sql(column: str, table: str) -> str:
    return f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT {column} AS v FROM {table}))"


@query(
    "j04_sample_combinations",
    "#draw kind brand status",
    f"""SELECT draw, k.v AS kind, x.v AS brand, s.v AS status FROM ({_NUMBERS}) n
    JOIN {_values_sql('p_type', 'part')} k ON k.i = a JOIN {_values_sql('p_brand', 'part')} x ON x.i = b // ss
    JOIN {_values_sql('o_orderstatus', 'orders')} s ON s.i = b % ss""",
)
def sample_combinations(t: Tables) -> DataFrame:
    """5,000 of the combinations, without making the others."""
    options = {
        "kind": t.table("part").select("p_type"),
        "brand": t.table("part").select("p_brand"),
        "status": t.table("orders").select("o_orderstatus"),
    }
    return bookkeeping.sample_combinations(options, 5000)


@query(
    "k01_stream_telemetry",
    "event_type #window_s #samples ~value_avg ~value_peak",
    """SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS window_s, count(*) AS samples, avg(value) AS value_avg, max(value) AS value_peak
    FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""",
)
def stream_telemetry_windows(t: Tables) -> DataFrame:
    """Events as a file stream in append mode: windows the watermark has closed."""
    schema = t.table("events").schema
    stream = (
        t.spark.readStream.schema(schema)
        .parquet(f"{t.sf_dir}/events*.parquet")
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    windows = stream_telemetry(stream, ["event_type"], ["value"])
    out, checkpoint = scratch_path(t.spark, "windows"), scratch_path(t.spark, "windows-state")
    started = (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    closed = t.spark.read.schema(windows.schema).parquet(out)
    return closed.withColumn("window_s", F.unix_timestamp("window_start"))


@query(
    "k02_stream_score",
    "program #input_id #iteration is_regression ~resource_score ~bounds_score",
    "SELECT * FROM s_resource JOIN s_bounds USING (program, input_id, iteration, is_regression)",
)
def stream_score(t: Tables) -> DataFrame:
    """Runs to judge as a file stream, scored against static model tables."""
    flow = regression_analysis(t)
    resources, bounds = written(flow.resources, "resources"), written(flow.bounds, "bounds")
    source = scratch_path(t.spark, "incoming-runs")
    flow.judged.write.parquet(source)

    def score(batch: DataFrame) -> DataFrame:
        return scoring.score_resource(batch, resources).join(scoring.score_bounds(batch, bounds), RUN)

    out = scratch_path(t.spark, "scores")
    stream = t.spark.readStream.schema(flow.judged.schema).parquet(source)
    stream_scores(stream, score, out, scratch_path(t.spark, "scores-state")).awaitTermination()
    return t.spark.read.parquet(out)


def run_records(flow) -> tuple[DataFrame, DataFrame]:
    """Paths and telemetry of the runs to judge, each with the time it arrived."""
    names = flow.judged_functions.groupBy(*RUN).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "function_name"))), lambda f: f["function_name"]).alias("names")
    )
    arrived = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("input_id") * 60 + F.col("iteration"))
    runs = flow.judged.join(names, RUN, "left").withColumn("arrived", arrived)
    sides = live.telemetry_columns()
    return runs.drop(*sides), flow.judged.select(*RUN, *sides, arrived.alias("arrived"))


@query(
    "k02_stream_detections",
    "program #input_id #iteration is_regression regression_type ~path_score ~resource_score ~archetype_score ~bounds_score "
    "~weighted_score ~max_signal ~combined_score detected model_version",
    "SELECT *, 'v1' AS model_version FROM s_scores",
)
def stream_detections(t: Tables) -> DataFrame:
    """Paths and telemetry as two file streams, joined and judged by all four signals."""
    flow = regression_analysis(t)
    folder, version = scratch_path(t.spark, "models"), "v1"
    live.save_models({name: getattr(flow, name) for name in live.MODELS}, folder, version)
    models = live.load_models(t.spark, folder, version)
    streams = []
    for name, side in zip(("paths", "telemetry"), run_records(flow)):
        source = scratch_path(t.spark, f"incoming-{name}")
        side.write.parquet(source)
        streams.append(t.spark.readStream.schema(side.schema).parquet(source))
    out = scratch_path(t.spark, "detections")
    arrivals = live.run_arrivals(*streams)
    stream_scores(arrivals, lambda batch: live.detections(batch, models, version), out, scratch_path(t.spark, "detections-state")).awaitTermination()
    return t.spark.read.parquet(out)
