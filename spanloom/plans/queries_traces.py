"""Registered queries: calls and paths (C), telemetry (D), path features (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import calls as ops, features, telemetry as series
from ..operators.storage import written
from ..operators.features import PHASE, STRUCTURAL, TEMPORAL, TRANSITION
from ..operators.telemetry import RESOURCE_FEATURES
from .bindings import EVENT_KEY, EVENT_RUN, HOUR_NS, Tables
from .path_groups import path_features
from .registry import query
from .traces import TraceAnalysis
from .views import VIEWS

BIN_NS = 24 * HOUR_NS
KEY = "program #input_id #iteration"
KEY_SQL = "program, input_id, iteration"


def doubles(names: tuple[str, ...]) -> str:
    return " ".join(f"~{n}" for n in names)


def analysis(t: Tables) -> TraceAnalysis:
    return TraceAnalysis(t.trace_events)


CALL = "#run #tid #call_id function_name #level #start_ts #end_ts #duration"


@query("c01_pair_calls", CALL, "c_calls")
def pair_calls(t: Tables) -> DataFrame:
    return analysis(t).calls


@query(
    "c01_unmatched_events",
    "#run #tid #open_begins #stray_ends",
    """SELECT run, tid, count(*) FILTER (ph = 'B') - max(n) AS open_begins, count(*) FILTER (ph = 'E') - max(n) AS stray_ends
    FROM b_trace_events JOIN (SELECT run, tid, count(*) AS n FROM c_calls GROUP BY 1, 2) k USING (run, tid) GROUP BY 1, 2""",
)
def unmatched_events(t: Tables) -> DataFrame:
    return ops.unmatched_events(t.trace_events, analysis(t).calls)


@query("c02_call_parents", f"{CALL} #parent_id", "c_parents")
def call_parents(t: Tables) -> DataFrame:
    return analysis(t).calls


@query("c03_call_stats", f"{CALL} #self_time #num_children", "c_stats")
def call_stats(t: Tables) -> DataFrame:
    return analysis(t).calls


@query(
    "c04_hotspots",
    "function_name #calls #total_duration #total_self_time ~avg_duration ~self_share",
    """SELECT function_name, count(*) AS calls, sum(duration) AS total_duration, sum(self_time) AS total_self_time,
    sum(duration) / count(*) AS avg_duration, sum(self_time) / (SELECT sum(self_time) FROM c_stats) AS self_share
    FROM c_stats GROUP BY 1 ORDER BY total_self_time DESC, function_name LIMIT 100""",
)
def hotspots(t: Tables) -> DataFrame:
    return ops.hotspots(analysis(t).calls)


@query(
    "c05_critical_paths",
    "#run #rank #tid #score #pos #call_id function_name #duration #self_time #start_ts #end_ts",
    "c_paths",
)
def critical_paths(t: Tables) -> DataFrame:
    return analysis(t).paths


@query(
    "c06_path_durations",
    "#path_id #critical_duration #total_duration #path_length",
    """SELECT path_id, coalesce(max(duration_ns) FILTER (pos > 0), 0) AS critical_duration, max(duration_ns) FILTER (pos = 0) AS total_duration,
    count(*) AS path_length FROM b_calls GROUP BY 1""",
)
def path_durations(t: Tables) -> DataFrame:
    return ops.path_durations(t.path_functions, ["path_id"], "duration_ns")


@query(
    "c07_path_bottlenecks",
    "#path_id #bottleneck_rank function_name #duration_ns ~percentage_of_path",
    "h_bottlenecks",
)
def path_bottlenecks(t: Tables) -> DataFrame:
    return ops.path_bottlenecks(t.path_functions, ["path_id"], "duration_ns")


@query("c08_executed_functions", "#run function_name", "SELECT DISTINCT run, function_name FROM c_calls")
def executed_functions(t: Tables) -> DataFrame:
    return ops.executed_functions(analysis(t).calls)


@query(
    "c09_run_summary",
    "#run #num_paths_requested #num_paths_found #num_threads #total_function_calls",
    """SELECT run, 10 AS num_paths_requested, max(n) AS num_paths_found, count(DISTINCT tid) AS num_threads, count(*) AS total_function_calls
    FROM c_calls JOIN (SELECT run, count(DISTINCT rank) AS n FROM c_paths GROUP BY 1) p USING (run) GROUP BY 1""",
)
def run_summary(t: Tables) -> DataFrame:
    return analysis(t).summary


# --- telemetry -----------------------------------------------------------------------


@query(
    "d01_resample",
    "program #input_id #ts ~cpu ~mem ~disk",
    f"""SELECT program, input_id, ts - ts % {6 * HOUR_NS} AS ts, avg(cpu) AS cpu, avg(mem) AS mem, avg(disk) AS disk
    FROM b_telemetry GROUP BY ALL""",
)
def resample(t: Tables) -> DataFrame:
    return series.resample(t.telemetry, EVENT_RUN, 6 * HOUR_NS, ["cpu", "mem", "disk"])


_COMBINED = f"""SELECT program, ts - ts % {HOUR_NS} AS ts, avg(value) FILTER (metric = 'cpu') AS cpu,
    avg(value) FILTER (metric = 'mem') AS mem, avg(value) FILTER (metric = 'disk') AS disk FROM b_long_series GROUP BY 1, 2"""


@query("d02_combine_series", "program #ts ~cpu ~mem ~disk", _COMBINED)
def combine_series(t: Tables) -> DataFrame:
    return series.combine_series(t.long_series, ["program"], HOUR_NS)


@query(
    "d02_combine_series_carried",
    "program #ts ~cpu ~mem ~disk",
    f"""SELECT program, ts, last_value(cpu IGNORE NULLS) OVER w AS cpu, last_value(mem IGNORE NULLS) OVER w AS mem,
    last_value(disk IGNORE NULLS) OVER w AS disk FROM ({_COMBINED}) c
    WINDOW w AS (PARTITION BY program ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)
def combine_series_carried(t: Tables) -> DataFrame:
    return series.combine_series(t.long_series, ["program"], HOUR_NS, carry=True)


@query(
    "d03_select_metrics",
    "program metric #samples",
    "SELECT program, metric, count(*) AS samples FROM b_long_series WHERE metric LIKE '%cpu%' OR metric LIKE '%dis%' GROUP BY 1, 2",
)
def select_metrics(t: Tables) -> DataFrame:
    chosen = series.select_metrics(t.long_series, ["CPU", "dis"])
    return chosen.groupBy("program", "metric").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "d04_telemetry_aggregates",
    "program metric ~peak ~average ~median",
    """SELECT program, metric, coalesce(max(value) FILTER (value > 0), -1) AS peak, coalesce(avg(value) FILTER (value > 0), -1) AS average,
    coalesce(median(value) FILTER (value > 0), -1) AS median
    FROM (SELECT program, unnest(['cpu', 'mem', 'disk']) AS metric, unnest([cpu, mem, disk]) AS value FROM b_telemetry) s GROUP BY 1, 2""",
)
def telemetry_aggregates(t: Tables) -> DataFrame:
    return series.telemetry_aggregates(t.telemetry, ["program"])


@query(
    "d05_trace_span",
    "program #input_id #trace_start_ns #trace_end_ns",
    "SELECT program, input_id, min(ts) AS trace_start_ns, max(ts) AS trace_end_ns FROM b_telemetry GROUP BY 1, 2",
)
def trace_span(t: Tables) -> DataFrame:
    return series.trace_span(t.telemetry, EVENT_RUN)


VIEWS["e_intervals"] = f"""
SELECT {KEY_SQL}, min_by(start_ns, pos) AS start_ns, max_by(end_ns, pos) AS end_ns FROM b_event_functions GROUP BY {KEY_SQL}"""
VIEWS["e_phases"] = f"""
SELECT {KEY_SQL}, phase, min_by(start_ns, pos) AS start_ns, max_by(end_ns, pos) AS end_ns FROM
 (SELECT *, CAST(pos >= n // 4 AS INTEGER) + CAST(pos >= n // 2 AS INTEGER) + CAST(pos >= 3 * n // 4 AS INTEGER) AS phase
  FROM (SELECT *, count(*) OVER (PARTITION BY {KEY_SQL}) AS n FROM b_event_functions) a) b GROUP BY {KEY_SQL}, phase"""
VIEWS["e_steps"] = """
SELECT *, lag(ts) OVER w AS before_ts, mem - lag(mem) OVER w AS step FROM b_telemetry
WINDOW w AS (PARTITION BY program, input_id ORDER BY ts)"""

_NINE = """avg(cpu) AS cpu_mean, stddev_pop(cpu) AS cpu_std, max(cpu) AS cpu_max, (max_by(mem, ts) - min_by(mem, ts)) / 1e6 AS memory_growth,
    avg(mem) / 1e6 AS memory_mean, coalesce(stddev_pop(step) FILTER ({inside}), 0) / 1e6 AS memory_volatility, avg(disk) / 1e6 AS io_intensity,
    CASE WHEN avg(disk) > 0 THEN stddev_pop(disk) / 1e6 ELSE 0 END AS io_burstiness, max(disk) / 1e6 AS io_peak"""
VIEWS["e_whole"] = (
    f"SELECT program, input_id, {_NINE.format(inside='true')} FROM e_steps GROUP BY 1, 2"
)


def _resource_view(intervals: str, key: str) -> str:
    picked = ", ".join(
        f"coalesce(CASE WHEN i.cpu_mean IS NOT NULL THEN i.{n} ELSE w.{n} END, 0) AS {n}" for n in RESOURCE_FEATURES
    )
    return f"""SELECT {key}, {picked} FROM {intervals}
    LEFT JOIN (SELECT {key}, {_NINE.format(inside='before_ts >= start_ns')} FROM {intervals} JOIN e_steps USING (program, input_id)
               WHERE ts >= start_ns AND ts <= end_ns GROUP BY {key}) i USING ({key})
    LEFT JOIN e_whole w USING (program, input_id)"""


VIEWS["e_resource"] = _resource_view("e_intervals", KEY_SQL)
VIEWS["e_phase_resource"] = _resource_view("e_phases", f"{KEY_SQL}, phase")


@query(
    "d06_interval_join",
    f"{KEY} #samples whole_run",
    f"""SELECT {KEY_SQL}, coalesce(n, whole, 0) AS samples, n IS NULL AS whole_run FROM e_intervals
    LEFT JOIN (SELECT {KEY_SQL}, count(*) AS n FROM e_intervals JOIN b_telemetry USING (program, input_id)
               WHERE ts >= start_ns AND ts <= end_ns GROUP BY {KEY_SQL}) i USING ({KEY_SQL})
    LEFT JOIN (SELECT program, input_id, count(*) AS whole FROM b_telemetry GROUP BY 1, 2) w USING (program, input_id)""",
)
def interval_join(t: Tables) -> DataFrame:
    intervals = features.path_intervals(t.event_functions, EVENT_KEY)
    return series.samples_or_run(intervals, t.telemetry, EVENT_RUN, EVENT_KEY, width=BIN_NS)


@query("d07_resource_features", f"{KEY} {doubles(RESOURCE_FEATURES)}", "e_resource")
def resource_features(t: Tables) -> DataFrame:
    intervals = features.path_intervals(t.event_functions, EVENT_KEY)
    return series.resource_features(intervals, t.telemetry, EVENT_RUN, EVENT_KEY, width=BIN_NS)


# --- path features -------------------------------------------------------------------

VIEWS["e_structural"] = f"""
SELECT {KEY_SQL}, count(*) AS path_depth, ln(1 + count(*)) AS log_depth, count(DISTINCT prefix) AS unique_prefixes, avg(cx) AS complexity_mean,
       stddev_pop(cx) AS complexity_std, CASE WHEN count(*) > 1 THEN regr_slope(cx, pos) ELSE 0 END AS complexity_gradient
FROM (SELECT f.*, coalesce(loc * 0.3::DOUBLE + loops * 0.3::DOUBLE + nested_loops * 0.2::DOUBLE + calls * 0.2::DOUBLE, 0) AS cx,
             CASE WHEN contains(function_name, '_') THEN split_part(function_name, '_', 1) ELSE substr(function_name, 1, 5) END AS prefix
      FROM b_event_functions f LEFT JOIN b_event_static s USING (program, function_name)) t GROUP BY {KEY_SQL}"""

VIEWS["e_temporal"] = f"""
SELECT {KEY_SQL}, ln(1 + sum(d)) AS log_total_duration,
       CASE WHEN count(*) >= 2 AND sum(d) <> 0 THEN 2 * sum(up * d::DOUBLE) / (count(*) * sum(d)::DOUBLE) - (count(*) + 1) / count(*) ELSE 0 END AS time_gini,
       CASE WHEN sum(d) > 0 THEN max(d) / sum(d) ELSE 0 END AS max_duration_ratio,
       CASE WHEN sum(d) > 0 THEN CASE WHEN count(*) >= 3 THEN sum(d) FILTER (down <= 3) ELSE max(d) END / sum(d) ELSE 0 END AS top3_duration_ratio,
       CASE WHEN sum(d) > 0 THEN sum(self_time_ns) / sum(d) ELSE 0 END AS self_time_ratio,
       min(pos) FILTER (d = biggest) / count(*) AS peak_position
FROM (SELECT *, duration_ns AS d, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY duration_ns) AS up,
             row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY duration_ns DESC) AS down,
             max(duration_ns) OVER (PARTITION BY {KEY_SQL}) AS biggest FROM b_event_functions) t GROUP BY {KEY_SQL}"""

VIEWS["e_moves"] = f"""
SELECT *, lead(function_type) OVER (PARTITION BY {KEY_SQL} ORDER BY pos) AS following FROM b_event_functions"""

VIEWS["e_transition"] = f"""
SELECT {KEY_SQL}, coalesce(e.transition_entropy, 0) AS transition_entropy, cpu_ratio, memory_ratio, io_ratio, io_to_cpu, cpu_to_mem, mem_to_io
FROM (SELECT {KEY_SQL}, count(*) FILTER (function_type = 'CPU-bound') / count(*) AS cpu_ratio,
             count(*) FILTER (function_type = 'Memory-bound') / count(*) AS memory_ratio,
             count(*) FILTER (function_type = 'I/O-bound') / count(*) AS io_ratio,
             count(*) FILTER (function_type = 'I/O-bound' AND following = 'CPU-bound') AS io_to_cpu,
             count(*) FILTER (function_type = 'CPU-bound' AND following = 'Memory-bound') AS cpu_to_mem,
             count(*) FILTER (function_type = 'Memory-bound' AND following = 'I/O-bound') AS mem_to_io
      FROM e_moves GROUP BY {KEY_SQL}) r
LEFT JOIN (SELECT {KEY_SQL}, -sum(p * log2(p)) AS transition_entropy FROM
            (SELECT *, c / sum(c) OVER (PARTITION BY {KEY_SQL}) AS p FROM
             (SELECT {KEY_SQL}, function_type, following, count(*) AS c FROM e_moves WHERE following IS NOT NULL GROUP BY ALL) a) b
           GROUP BY {KEY_SQL}) e USING ({KEY_SQL})"""

_spread = " + ".join(f"stddev_pop({n})" for n in RESOURCE_FEATURES)
_apart = " + ".join(f"(a.{n} - b.{n}) * (a.{n} - b.{n})" for n in RESOURCE_FEATURES)
VIEWS["e_phase"] = f"""
SELECT {KEY_SQL}, CASE WHEN n >= 2 THEN changes ELSE 0 END AS cpu_phases, CASE WHEN n >= 2 AND falls = 0 THEN 1 ELSE 0 END AS memory_monotonic,
       CASE WHEN n >= 2 AND io_max > 2 * io_mean THEN 1 ELSE 0 END AS io_concentrated, CASE WHEN n >= 2 THEN volatility ELSE 0 END AS resource_volatility,
       coalesce(d.phase_distance, 0) AS phase_distance
FROM (SELECT {KEY_SQL}, count(*) AS n, count(*) FILTER (abs(cpu_mean - cpu_before) > 20) AS changes,
             count(*) FILTER (memory_mean < mem_before) AS falls, max(io_intensity) AS io_max, avg(io_intensity) AS io_mean, ({_spread}) / 9 AS volatility
      FROM (SELECT *, lag(cpu_mean) OVER w AS cpu_before, lag(memory_mean) OVER w AS mem_before FROM e_phase_resource
            WINDOW w AS (PARTITION BY {KEY_SQL} ORDER BY phase)) q GROUP BY {KEY_SQL}) p
LEFT JOIN (SELECT {KEY_SQL}, avg(sqrt({_apart})) AS phase_distance FROM e_phase_resource a JOIN e_phase_resource b USING ({KEY_SQL})
           WHERE a.phase < b.phase GROUP BY {KEY_SQL}) d USING ({KEY_SQL})"""

VIEWS["e_features"] = f"""
SELECT * FROM e_structural JOIN e_temporal USING ({KEY_SQL}) JOIN e_resource USING ({KEY_SQL}) JOIN e_transition USING ({KEY_SQL})
JOIN e_phase USING ({KEY_SQL}) JOIN (SELECT {KEY_SQL}, end_ns - start_ns AS path_duration_ns FROM e_intervals) i USING ({KEY_SQL})"""


@query("e01_structural_features", f"{KEY} {doubles(STRUCTURAL)}", "e_structural")
def structural_features(t: Tables) -> DataFrame:
    return features.structural_features(
        t.event_functions, EVENT_KEY, t.event_static, ["program", "function_name"]
    )


@query("e02_temporal_features", f"{KEY} {doubles(TEMPORAL)}", "e_temporal")
def temporal_features(t: Tables) -> DataFrame:
    return features.temporal_features(t.event_functions, EVENT_KEY)


VIEWS["e_call_temporal"] = (
    VIEWS["e_temporal"].replace(KEY_SQL, "path_id").replace("b_event_functions", "b_calls")
)


@query("e02_temporal_features_of_calls", f"#path_id {doubles(TEMPORAL)}", "e_call_temporal")
def temporal_features_of_calls(t: Tables) -> DataFrame:
    return features.temporal_features(t.path_functions, ["path_id"])


@query("e03_path_resource_features", f"{KEY} #start_ns #end_ns {doubles(RESOURCE_FEATURES)}", f"SELECT * FROM e_intervals JOIN e_resource USING ({KEY_SQL})")
def path_resource_features(t: Tables) -> DataFrame:
    intervals = features.path_intervals(t.event_functions, EVENT_KEY)
    measured = series.resource_features(intervals, t.telemetry, EVENT_RUN, EVENT_KEY, width=BIN_NS)
    return intervals.join(measured, EVENT_KEY)


@query("e04_transition_features", f"{KEY} {doubles(TRANSITION)}", "e_transition")
def transition_features(t: Tables) -> DataFrame:
    return features.transition_features(t.event_functions, EVENT_KEY)


@query("e05_phase_features", f"{KEY} {doubles(PHASE)}", "e_phase")
def phase_features(t: Tables) -> DataFrame:
    return features.phase_features(t.event_functions, t.telemetry, EVENT_RUN, EVENT_KEY, width=BIN_NS)


def event_path_features(t: Tables) -> DataFrame:
    return path_features(
        t.event_functions,
        t.event_static,
        t.telemetry,
        run=EVENT_RUN,
        key=EVENT_KEY,
        width=BIN_NS,
    )


ALL_FEATURES = STRUCTURAL + TEMPORAL + RESOURCE_FEATURES + TRANSITION + PHASE


@query("e06_assemble_features", f"{KEY} #path_duration_ns {doubles(ALL_FEATURES)}", "e_features")
def assemble_features(t: Tables) -> DataFrame:
    return event_path_features(t)


_LEVELS = "~cpu_high ~cpu_medium ~memory_high ~memory_medium ~io_high ~io_medium #max_path_depth"


def _levels_sql(cpu: str, memory: str, io: str) -> str:
    cells = ", ".join(
        f"quantile_cont({source}, {p}) AS {name}_{level}"
        for name, source in (("cpu", cpu), ("memory", f"abs({memory})"), ("io", io))
        for level, p in (("high", 0.8), ("medium", 0.4))
    )
    return f"SELECT {cells}, max(path_depth) AS max_path_depth FROM e_features"


@query("e07_resource_thresholds", _LEVELS, _levels_sql("cpu_mean", "memory_growth", "io_intensity"))
def resource_thresholds(t: Tables) -> DataFrame:
    return features.resource_thresholds(written(event_path_features(t), "features"))


@query(
    "e07_resource_thresholds_compat",
    _LEVELS,
    _levels_sql("log_total_duration", "top3_duration_ratio", "cpu_mean"),
)
def resource_thresholds_compat(t: Tables) -> DataFrame:
    return features.resource_thresholds(written(event_path_features(t), "features"), compat=True)
