"""The bindings and shared steps again, as DuckDB SQL for checking results.

Written from the operators' definitions with plain windows and joins, not from
the Spark plans, so that both sides can disagree.
"""

from __future__ import annotations

import re

from ..operators.detectors import EULER_GAMMA, PATH_FEATURES, RESOURCE_ONLY, kernel_frequencies
from .bindings import HOUR_NS, PROGRAMS, REGRESSION_TYPES, SPAN, WEEK_NS

RUN = "program, input_id, iteration, is_regression"

_types = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(REGRESSION_TYPES))
_programs = ", ".join(f"('{p}')" for p in PROGRAMS)

VIEWS: dict[str, str] = {}

VIEWS["b_paths"] = f"""
SELECT c.c_mktsegment AS program, o.o_custkey AS input_id, CAST(o.o_orderkey % 3 AS INTEGER) AS iteration,
       o.o_orderstatus = 'P' AS is_regression,
       CASE WHEN o.o_orderstatus = 'P' THEN CASE o.o_custkey % 5 {_types} END END AS regression_type,
       o.o_orderkey AS path_id, CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS path_rank,
       CAST(round(o.o_totalprice * 100) AS BIGINT) AS critical_duration_ns,
       CAST(o.o_custkey % 7 AS INTEGER) AS archetype
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

VIEWS["b_calls"] = """
SELECT b.program, b.input_id, b.iteration, b.is_regression, b.path_id, b.path_rank,
       row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
                          l.l_extendedprice, l.l_quantity, l.l_shipdate) - 1 AS pos,
       concat(replace(p.p_name, ' ', '_'), '_', replace(p.p_brand, 'Brand#', '')) AS function_name,
       CAST(round(l.l_extendedprice * 100) AS BIGINT) AS duration_ns,
       CAST(round(l.l_extendedprice * 100) AS BIGINT) - 10 * CAST(round(l.l_tax * 100) AS BIGINT) AS self_time_ns,
       CAST(l.l_quantity AS BIGINT) AS cpu, CAST(round(l.l_discount * 100) AS BIGINT) AS io,
       l.l_returnflag = 'R' AS on_path, CAST(round(l.l_discount * 100) AS BIGINT) >= 9 AS is_bottleneck
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN b_paths b ON b.path_id = l.l_orderkey"""

VIEWS["b_static"] = f"""
SELECT pr.program, t.* EXCLUDE (rn) FROM
 (SELECT concat(replace(p_name, ' ', '_'), '_', replace(p_brand, 'Brand#', '')) AS function_name,
         p_size AS loc, p_size % 5 AS loops, p_size % 3 AS nested_loops, CAST(p_partkey % 20 AS INTEGER) AS calls,
         CAST(p_partkey % 7 AS INTEGER) AS ifs, CAST(p_partkey % 2 AS INTEGER) AS switches, p_type = 'PROMO' AS has_io,
         CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'CPU-bound' WHEN p_type IN ('MEDIUM', 'SMALL') THEN 'Memory-bound'
              WHEN p_type = 'LARGE' THEN 'I/O-bound' ELSE 'Unknown' END AS function_type,
         row_number() OVER (PARTITION BY concat(replace(p_name, ' ', '_'), '_', replace(p_brand, 'Brand#', ''))
                            ORDER BY p_partkey DESC) AS rn
  FROM part) t CROSS JOIN (VALUES {_programs}) pr(program) WHERE rn = 1"""

VIEWS["b_events"] = """SELECT *, epoch_us(ts) * 1000 AS ts_ns FROM events"""

VIEWS["b_event_functions"] = f"""
SELECT *, row_number() OVER (PARTITION BY program, input_id, iteration ORDER BY start_ns, event_id) - 1 AS pos,
       duration_ns - duration_ns // 4 AS self_time_ns, start_ns + duration_ns AS end_ns
FROM (SELECT concat('p', CAST(user_id % 4 AS VARCHAR)) AS program, user_id AS input_id,
             CAST(ts_ns // {WEEK_NS} AS INTEGER) AS iteration, event_id, event_type AS function_name,
             CAST(round(value * 100) AS BIGINT) * 10000000 AS duration_ns, ts_ns AS start_ns,
             CASE event_type WHEN 'click' THEN 'CPU-bound' WHEN 'view' THEN 'Memory-bound'
                  WHEN 'purchase' THEN 'I/O-bound' ELSE 'Unknown' END AS function_type
      FROM b_events) t"""

VIEWS["b_event_static"] = """
SELECT program, function_name, length(function_name) * 10 + n % 10 AS loc, length(function_name) % 4 AS loops,
       length(function_name) % 3 AS nested_loops, n % 5 AS calls
FROM (SELECT concat('p', CAST(user_id % 4 AS VARCHAR)) AS program, event_type AS function_name, count(*) AS n
      FROM b_events GROUP BY 1, 2) t WHERE function_name <> 'error'"""

VIEWS["b_telemetry"] = f"""
SELECT concat('p', CAST(user_id % 4 AS VARCHAR)) AS program, user_id AS input_id, ts_ns - ts_ns % {HOUR_NS} AS ts,
       coalesce(max(CASE WHEN event_type IN ('click', 'view') THEN CAST(round(value * 100) AS BIGINT) END), 0) / 100 AS cpu,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) * 10000 AS DOUBLE) AS mem,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) * 10000 AS DOUBLE) AS disk
FROM b_events GROUP BY 1, 2, 3"""

VIEWS["b_long_series"] = """
SELECT concat('p', CAST(user_id % 4 AS VARCHAR)) AS program, ts_ns AS ts,
       CASE WHEN event_type IN ('click', 'view') THEN 'cpu' WHEN event_type = 'purchase' THEN 'disk' ELSE 'mem' END AS metric,
       CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS value
FROM b_events"""

VIEWS["b_trace_events"] = f"""
WITH o AS (SELECT CAST(c.c_nationkey % 5 AS INTEGER) AS run, CAST(c.c_nationkey AS BIGINT) AS tid, c_custkey, o_orderkey,
                  c_custkey * {SPAN} AS base
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
     c AS (SELECT run, tid, c_custkey, base, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM o GROUP BY ALL),
     n AS (SELECT run, tid, min(base + 10 * lo) AS lo, max(base + 10 * hi) AS hi FROM c GROUP BY ALL),
     e AS (SELECT run, tid, 'B' AS ph, base + 10 * o_orderkey + 2 AS ts, concat('order_', CAST(o_orderkey % 50 AS VARCHAR)) AS name FROM o
           UNION ALL SELECT run, tid, 'E', base + 10 * o_orderkey + 3 + o_orderkey % 6, concat('order_', CAST(o_orderkey % 50 AS VARCHAR)) FROM o
           UNION ALL SELECT run, tid, 'B', base + 10 * lo + 1, concat('cust_', CAST(c_custkey % 20 AS VARCHAR)) FROM c
           UNION ALL SELECT run, tid, 'E', base + 10 * hi + 9, concat('cust_', CAST(c_custkey % 20 AS VARCHAR)) FROM c
           UNION ALL SELECT run, tid, 'B', lo, 'main' FROM n
           UNION ALL SELECT run, tid, 'E', hi + 10, 'main' FROM n)
SELECT *, ts AS seq, CAST(1 AS BIGINT) AS pid FROM e"""

VIEWS["c_depth"] = """
SELECT *, CASE WHEN ph = 'B' THEN o ELSE o + 1 END AS level
FROM (SELECT *, sum(CASE WHEN ph = 'B' THEN 1 ELSE -1 END) OVER (PARTITION BY run, tid ORDER BY ts, seq) AS o FROM b_trace_events) t"""

VIEWS["c_calls"] = """
SELECT b.run, b.tid, b.seq AS call_id, b.name AS function_name, CAST(b.level AS BIGINT) AS level, b.ts AS start_ts, e.ts AS end_ts,
       e.ts - b.ts AS duration
FROM (SELECT *, row_number() OVER (PARTITION BY run, tid, level ORDER BY ts, seq) AS k FROM c_depth WHERE ph = 'B') b
JOIN (SELECT *, row_number() OVER (PARTITION BY run, tid, level ORDER BY ts, seq) AS k FROM c_depth WHERE ph = 'E') e
  USING (run, tid, level, k)"""

VIEWS["c_parents"] = """
SELECT c.*, p.call_id AS parent_id
FROM c_calls c LEFT JOIN c_calls p ON p.run = c.run AND p.tid = c.tid AND p.level = c.level - 1
     AND p.start_ts <= c.start_ts AND p.end_ts >= c.end_ts"""

VIEWS["c_stats"] = """
SELECT c.*, greatest(0, c.duration - coalesce(k.inner_time, 0)) AS self_time, coalesce(k.n, 0) AS num_children
FROM c_parents c LEFT JOIN (SELECT run, tid, parent_id, CAST(sum(duration) AS BIGINT) AS inner_time, count(*) AS n FROM c_parents
                            WHERE parent_id IS NOT NULL GROUP BY ALL) k
     ON k.run = c.run AND k.tid = c.tid AND k.parent_id = c.call_id"""

VIEWS["c_chain"] = """
SELECT leaf.run, leaf.tid, leaf.call_id AS leaf_id, leaf.start_ts AS leaf_start, a.level - 1 AS pos, a.call_id, a.function_name,
       a.duration, a.self_time, a.start_ts, a.end_ts
FROM (SELECT * FROM c_stats WHERE num_children = 0) leaf
JOIN c_stats a ON a.run = leaf.run AND a.tid = leaf.tid AND a.start_ts <= leaf.start_ts AND a.end_ts >= leaf.end_ts"""

VIEWS["c_ranked"] = """
SELECT run, tid, leaf_id, CAST(sum(CASE WHEN pos > 0 THEN duration ELSE 0 END) AS BIGINT) AS score,
       row_number() OVER (PARTITION BY run ORDER BY sum(CASE WHEN pos > 0 THEN duration ELSE 0 END) DESC, leaf_start, tid, leaf_id) AS rank
FROM c_chain GROUP BY run, tid, leaf_id, leaf_start"""

VIEWS["c_paths"] = """
SELECT ch.run, CAST(r.rank AS INTEGER) AS rank, ch.tid, r.score, ch.pos, ch.call_id, ch.function_name, ch.duration, ch.self_time,
       ch.start_ts, ch.end_ts
FROM c_ranked r JOIN c_chain ch USING (run, tid, leaf_id) WHERE r.rank <= 10"""

VIEWS["b_elements"] = """
SELECT concat('src/f', CAST(input_id AS VARCHAR), CASE input_id % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.h' WHEN 2 THEN '.cpp' ELSE '.txt' END) AS file,
       path_id AS function_id, concat('fn_', CAST(path_id % 400 AS VARCHAR)) AS function_name, pos AS element_id,
       CASE WHEN pos > 0 THEN (pos - 1) // 2 END AS parent_id,
       CASE duration_ns % 8 WHEN 0 THEN 'for' WHEN 1 THEN 'while' WHEN 2 THEN 'if' WHEN 3 THEN 'else' WHEN 4 THEN 'call'
            WHEN 5 THEN 'block' WHEN 6 THEN 'expr_stmt' ELSE 'switch' END AS tag,
       CASE WHEN duration_ns % 5 = 0 THEN CASE self_time_ns % 3 WHEN 0 THEN 'printf' WHEN 1 THEN 'fopen' ELSE 'helper' END
            ELSE concat('fn_', CAST(duration_ns % 400 AS VARCHAR)) END AS callee,
       CASE WHEN duration_ns % 3 = 0 THEN ';' ELSE '' END AS text, self_time_ns % 4 = 0 AS in_control
FROM b_calls"""

VIEWS["b_executions"] = """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'regression' ELSE 'analysis' END AS type, concat('range-', substr(o_orderpriority, 1, 1)) AS "range",
       o_orderkey AS input, CAST(round(o_totalprice * 100) AS BIGINT) / 100 AS seconds, o_orderkey % 11 <> 0 AS success
FROM orders"""

# --- static against dynamic ranking -------------------------------------------------

VIEWS["f_static"] = """
SELECT *, 0.2::DOUBLE * ln(1 + greatest(loc, 0)) + 0.3::DOUBLE * ln(1 + (ifs + switches + loops + 1)) + 0.2::DOUBLE * (1 + nested_loops * 0.5::DOUBLE)
          + 0.2::DOUBLE * ln(1 + calls) + 0.1::DOUBLE * CASE WHEN has_io THEN 1 ELSE 0 END AS complexity
FROM b_static"""

VIEWS["f_static_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY program ORDER BY round(complexity, 9) DESC, function_name DESC) AS static_rank FROM f_static"""

VIEWS["f_stats"] = """
SELECT program, function_name, coalesce(appearances, 0) AS appearances, coalesce(total_duration_ns, 0) AS total_duration_ns,
       coalesce(total_self_time_ns, 0) AS total_self_time_ns, coalesce(rank_sum, 0) AS rank_sum,
       coalesce(bottleneck_count, 0) AS bottleneck_count, total_paths
FROM (SELECT program, function_name, count(*) AS appearances, CAST(sum(duration_ns) AS BIGINT) AS total_duration_ns,
             CAST(sum(self_time_ns) AS BIGINT) AS total_self_time_ns, CAST(sum(path_rank) AS BIGINT) AS rank_sum
      FROM b_calls WHERE on_path GROUP BY 1, 2) a
FULL JOIN (SELECT program, function_name, count(*) AS bottleneck_count FROM b_calls WHERE is_bottleneck GROUP BY 1, 2) b
     USING (program, function_name)
JOIN (SELECT program, count(*) AS total_paths FROM b_paths GROUP BY 1) t USING (program)"""

VIEWS["f_critical"] = """
SELECT program, function_name,
       0.3::DOUBLE * (1 / (rank_sum / appearances)) + 0.3::DOUBLE * (appearances / total_paths) + 0.2::DOUBLE * ln(1 + total_duration_ns / appearances)
         + 0.2::DOUBLE * (bottleneck_count / appearances) AS criticality,
       appearances, total_duration_ns / appearances AS avg_duration_ns, total_self_time_ns / appearances AS avg_self_time_ns,
       appearances / total_paths * 100 AS appearance_rate, rank_sum / appearances AS avg_rank, true AS in_critical_paths
FROM f_stats WHERE appearances > 0"""

VIEWS["f_quiet"] = """
SELECT q.program, q.function_name, 0.0::DOUBLE AS criticality, CAST(0 AS BIGINT) AS appearances, 0.0::DOUBLE AS avg_duration_ns,
       0.0::DOUBLE AS avg_self_time_ns, 0.0::DOUBLE AS appearance_rate,
       coalesce(w.worst, t.total_paths + 1.0) + row_number() OVER (PARTITION BY q.program ORDER BY q.function_name) - 1 AS avg_rank,
       false AS in_critical_paths
FROM (SELECT DISTINCT program, function_name FROM b_calls) q
ANTI JOIN f_stats s ON s.program = q.program AND s.function_name = q.function_name
LEFT JOIN (SELECT program, max(avg_rank) AS worst FROM f_critical GROUP BY 1) w ON w.program = q.program
LEFT JOIN (SELECT program, max(total_paths) AS total_paths FROM f_stats GROUP BY 1) t ON t.program = q.program"""

VIEWS["f_dynamic_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY program ORDER BY round(criticality, 9) DESC, function_name DESC) AS dynamic_rank
FROM (SELECT * FROM f_critical UNION ALL BY NAME SELECT * FROM f_quiet) t"""

VIEWS["f_normed"] = """
SELECT *, static_norm - dynamic_norm AS rank_difference FROM
 (SELECT *, row_number() OVER (PARTITION BY program ORDER BY static_rank) / n AS static_norm,
         row_number() OVER (PARTITION BY program ORDER BY dynamic_rank) / n AS dynamic_norm
  FROM (SELECT *, count(*) OVER (PARTITION BY program) AS n
        FROM f_static_ranked JOIN f_dynamic_ranked USING (program, function_name)) a WHERE n >= 10) b"""

VIEWS["f_classified"] = """
SELECT x.*, (rank_difference - m) / s AS effect_size,
       CASE WHEN static_norm >= s75 AND dynamic_norm <= d25 AND rank_difference >= 0.3::DOUBLE THEN 'simple_but_critical'
            WHEN static_norm <= s25 AND dynamic_norm >= d75 AND rank_difference <= -0.3::DOUBLE THEN 'complex_but_irrelevant'
            ELSE 'matched' END AS category
FROM f_normed x JOIN (SELECT program, avg(rank_difference) AS m, stddev_samp(rank_difference) AS s,
                             quantile_cont(static_norm, 0.75) AS s75, quantile_cont(static_norm, 0.25) AS s25,
                             quantile_cont(dynamic_norm, 0.75) AS d75, quantile_cont(dynamic_norm, 0.25) AS d25
                      FROM f_normed GROUP BY 1) g USING (program)"""

# --- runs, baseline models and scores ------------------------------------------------

VIEWS["h_first"] = f"""
SELECT {RUN}, path_id, critical_duration_ns AS lead FROM
 (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY path_rank, path_id) AS rn FROM b_paths) t WHERE rn = 1"""

VIEWS["h_durations"] = f"""
SELECT {RUN}, round(CASE WHEN is_regression OR max(f.lead) <= 0 OR count(*) = 1 THEN max(f.lead)
       ELSE (max(f.lead) + coalesce(sum(p.critical_duration_ns * (1.0::DOUBLE / p.place)) FILTER (p.place > 1 AND p.critical_duration_ns > 0 AND p.critical_duration_ns <> f.lead), 0))
            / (1 + coalesce(sum(1.0::DOUBLE / p.place) FILTER (p.place > 1 AND p.critical_duration_ns > 0 AND p.critical_duration_ns <> f.lead), 0)) END, 3) AS weighted_duration_ns
FROM (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY path_rank, path_id) AS place FROM b_paths) p JOIN h_first f USING ({RUN}) GROUP BY {RUN}"""

VIEWS["h_functions"] = f"""
SELECT c.* REPLACE (lower(c.function_name) AS function_name) FROM b_calls c JOIN h_first f USING ({RUN}, path_id)"""

VIEWS["h_telemetry"] = f"""
SELECT {RUN}, avg(cpu) AS cpu_avg, CAST(max(cpu) AS DOUBLE) AS cpu_peak, CAST(sum(self_time_ns) AS BIGINT) / count(*) / 1e6 AS memory_avg,
       max(self_time_ns) / 1e6 AS memory_peak, avg(io) AS io_avg, CAST(max(io) AS DOUBLE) AS io_peak
FROM b_calls GROUP BY {RUN}"""

VIEWS["h_bottlenecks"] = f"""
SELECT *, 100.0 * duration_ns / total AS percentage_of_path,
       row_number() OVER (PARTITION BY path_id ORDER BY duration_ns DESC, pos) AS bottleneck_rank
FROM (SELECT *, sum(duration_ns) OVER (PARTITION BY path_id) AS total FROM b_calls WHERE pos > 0) t"""

VIEWS["h_runs"] = f"""
SELECT d.program, d.input_id, d.iteration, d.is_regression, t.regression_type, coalesce(l.path_length, 0) AS path_length,
       CASE WHEN floor(d.weighted_duration_ns) > 0 THEN CAST(floor(d.weighted_duration_ns) AS BIGINT) ELSE coalesce(l.longest, 0) END AS path_duration_ns,
       w.function_name AS bottleneck_function, coalesce(w.percentage_of_path, 0) AS bottleneck_percentage,
       m.cpu_avg, m.cpu_peak, m.memory_avg, m.memory_peak, m.io_avg, m.io_peak, t.archetype
FROM h_durations d
JOIN (SELECT {RUN}, max(regression_type) AS regression_type, max(archetype) AS archetype FROM b_paths GROUP BY ALL) t USING ({RUN})
LEFT JOIN (SELECT {RUN}, count(*) AS path_length, max(duration_ns) AS longest FROM h_functions GROUP BY {RUN}) l USING ({RUN})
LEFT JOIN (SELECT b.* FROM h_bottlenecks b JOIN h_first f USING ({RUN}, path_id) WHERE bottleneck_rank = 1) w USING ({RUN})
LEFT JOIN h_telemetry m USING ({RUN})"""

VIEWS["h_split"] = """
SELECT r.*, r2.runs < 10 OR dense_rank() OVER (PARTITION BY program ORDER BY input_id) <= floor(r2.inputs * 0.7::DOUBLE) AS is_baseline
FROM (SELECT * FROM h_runs WHERE NOT is_regression) r
JOIN (SELECT program, count(*) AS runs, count(DISTINCT input_id) AS inputs FROM h_runs WHERE NOT is_regression GROUP BY 1) r2 USING (program)"""

VIEWS["h_base"] = "SELECT * EXCLUDE (is_baseline) FROM h_split WHERE is_baseline"
VIEWS["h_judged"] = """
SELECT * EXCLUDE (is_baseline) REPLACE (CAST(NULL AS VARCHAR) AS regression_type) FROM h_split WHERE NOT is_baseline
UNION ALL BY NAME
SELECT * REPLACE (coalesce(regression_type, 'unknown') AS regression_type) FROM h_runs WHERE is_regression AND iteration = 0"""

VIEWS["h_base_functions"] = f"SELECT f.* FROM h_functions f JOIN h_base b USING ({RUN})"

VIEWS["m_frequency"] = f"""
SELECT program, function_name, count(*) AS frequency, avg(pos / n) AS mean_position
FROM (SELECT *, count(*) OVER (PARTITION BY {RUN}) AS n FROM h_base_functions) t GROUP BY 1, 2"""

VIEWS["h_grams"] = f"""
SELECT *, lead(function_name, 1) OVER w AS n1, lead(function_name, 2) OVER w AS n2 FROM h_functions
WINDOW w AS (PARTITION BY {RUN} ORDER BY pos)"""

VIEWS["m_ngrams"] = f"""
SELECT program, ngram, count(*) AS frequency FROM
 (SELECT g.program, function_name || '->' || n1 AS ngram FROM h_grams g JOIN h_base USING ({RUN}) WHERE n1 IS NOT NULL
  UNION ALL
  SELECT g.program, function_name || '->' || n1 || '->' || n2 FROM h_grams g JOIN h_base USING ({RUN}) WHERE n2 IS NOT NULL) t
GROUP BY 1, 2"""

VIEWS["m_resource"] = """
SELECT program, resource, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99
FROM (SELECT program, 'cpu' AS resource, cpu_avg AS v FROM h_base UNION ALL SELECT program, 'memory', memory_avg FROM h_base
      UNION ALL SELECT program, 'io', io_avg FROM h_base) t WHERE v IS NOT NULL GROUP BY 1, 2"""

VIEWS["m_archetype"] = """
SELECT program, archetype, n AS count, n / sum(n) OVER p AS frequency, count(*) OVER p AS archetypes,
       max(n) OVER p / sum(n) OVER p AS max_frequency
FROM (SELECT program, archetype, count(*) AS n FROM h_base GROUP BY 1, 2) t WINDOW p AS (PARTITION BY program)"""

VIEWS["m_bounds"] = """
SELECT program, avg(path_duration_ns) AS duration_mean, stddev_pop(path_duration_ns) AS duration_std,
       avg(path_length) AS length_mean, stddev_pop(path_length) AS length_std, max(path_length) AS length_max, min(path_length) AS length_min,
       quantile_cont(path_duration_ns::DOUBLE, 0.5) AS duration_median, quantile_cont(path_duration_ns::DOUBLE, 0.95) AS duration_p95,
       quantile_cont(path_duration_ns::DOUBLE, 0.99) AS duration_p99,
       quantile_cont(path_duration_ns::DOUBLE, 0.75) - quantile_cont(path_duration_ns::DOUBLE, 0.25) AS duration_iqr
FROM h_base GROUP BY 1"""

VIEWS["s_path"] = f"""
SELECT {RUN}, least((coalesce(fs, 0) + CASE WHEN z > 3 THEN least(z / 3, 1) ELSE 0 END + CASE WHEN unseen > 2 THEN least(unseen / 5, 1) ELSE 0 END)
       / greatest(coalesce(fc, 0) + CASE WHEN z > 3 THEN 1 ELSE 0 END + CASE WHEN unseen > 2 THEN 1 ELSE 0 END, 1), 1) AS path_score
FROM (SELECT {RUN}, CASE WHEN l.s > 0 THEN abs(path_length - l.m) / l.s ELSE 0 END AS z
      FROM h_judged JOIN (SELECT program, avg(path_length) AS m, stddev_pop(path_length) AS s FROM h_base GROUP BY 1) l USING (program)) r
LEFT JOIN (SELECT {RUN}, sum(CASE WHEN frequency IS NULL THEN 1.0 WHEN frequency < 3 THEN 0.5 END) AS fs,
                  count(CASE WHEN frequency IS NULL THEN 1.0 WHEN frequency < 3 THEN 0.5 END) AS fc
           FROM h_functions LEFT JOIN m_frequency USING (program, function_name) GROUP BY {RUN}) f USING ({RUN})
LEFT JOIN (SELECT {RUN}, count(*) FILTER (frequency IS NULL) AS unseen
           FROM (SELECT *, function_name || '->' || n1 AS ngram FROM h_grams WHERE n1 IS NOT NULL) g LEFT JOIN m_ngrams USING (program, ngram)
           GROUP BY {RUN}) u USING ({RUN})"""


def _resource_case(value: str, r: str) -> str:
    z = f"abs({value} - {r}_mean) / nullif({r}_std, 0)"
    return (
        f"CASE WHEN {value} IS NULL OR {value} = 0 THEN 0 ELSE greatest("
        f"CASE WHEN {z} > 3 THEN 1.0 WHEN {z} > 2 THEN 0.8 WHEN {z} > 1.5 THEN 0.6 WHEN {z} > 1 THEN 0.3 ELSE 0 END, "
        f"CASE WHEN {value} > {r}_p99 THEN 0.9 WHEN {value} > {r}_p95 THEN 0.6 ELSE 0 END) END"
    )


_wide = ", ".join(
    f"max({s}) FILTER (resource = '{r}') AS {r}_{s}" for r in ("cpu", "memory", "io") for s in ("mean", "std", "p95", "p99")
)
VIEWS["m_resource_wide"] = f"SELECT program, {_wide} FROM m_resource GROUP BY 1"

VIEWS["s_resource"] = f"""
SELECT {RUN}, CAST(greatest({_resource_case('cpu_avg', 'cpu')}, {_resource_case('memory_avg', 'memory')},
       {_resource_case('io_avg', 'io')}) AS DOUBLE) AS resource_score
FROM h_judged JOIN m_resource_wide USING (program)"""

VIEWS["s_archetype"] = f"""
SELECT {RUN}, CAST(greatest(
   CASE WHEN f IS NULL THEN 1.0 WHEN f < 0.05::DOUBLE THEN 0.7 WHEN f < 0.10::DOUBLE THEN 0.5 WHEN f < 0.15::DOUBLE THEN 0.3 ELSE 0 END,
   CASE WHEN coalesce(f, 0) / (1.0::DOUBLE / k) < 0.5 THEN 0.6 WHEN coalesce(f, 0) / (1.0::DOUBLE / k) < 0.7::DOUBLE THEN 0.4 ELSE 0 END,
   CASE WHEN coalesce(f, 0) / most < 0.3::DOUBLE THEN 0.5 WHEN coalesce(f, 0) / most < 0.5 THEN 0.3 ELSE 0 END) AS DOUBLE) AS archetype_score
FROM (SELECT j.*, a.frequency AS f, g.k, g.most FROM h_judged j
      JOIN (SELECT program, max(archetypes) AS k, max(max_frequency) AS most FROM m_archetype GROUP BY 1) g USING (program)
      LEFT JOIN m_archetype a USING (program, archetype)) t"""

VIEWS["s_bounds"] = f"""
SELECT {RUN}, CAST(greatest(
   CASE WHEN d / duration_mean > 2.5 THEN 1.0 WHEN d / duration_mean > 2.0 THEN 0.9 WHEN d / duration_mean > 1.7::DOUBLE THEN 0.8
        WHEN d / duration_mean > 1.5 THEN 0.7 WHEN d / duration_mean > 1.3::DOUBLE THEN 0.5 WHEN d / duration_mean > 1.2::DOUBLE THEN 0.3 ELSE 0 END,
   CASE WHEN d / duration_median > 2.5 THEN 0.9 WHEN d / duration_median > 1.8::DOUBLE THEN 0.7 WHEN d / duration_median > 1.5 THEN 0.6 ELSE 0 END,
   CASE WHEN d > duration_p99 THEN 0.9 WHEN d > duration_p95 THEN 0.7 ELSE 0 END,
   CASE WHEN duration_iqr > 0 AND d > duration_median + 1.5 * duration_iqr THEN 0.7 ELSE 0 END,
   CASE WHEN duration_std > 0 THEN CASE WHEN (d - duration_mean) / duration_std > 3 THEN 0.9 WHEN (d - duration_mean) / duration_std > 2 THEN 0.7
        WHEN (d - duration_mean) / duration_std > 1.5 THEN 0.5 ELSE 0 END ELSE 0 END,
   CASE WHEN path_length > length_max THEN 0.7 WHEN path_length / length_mean > 1.5 THEN 0.5 WHEN path_length / length_mean > 1.3::DOUBLE THEN 0.3 ELSE 0 END) AS DOUBLE) AS bounds_score
FROM (SELECT *, path_duration_ns AS d FROM h_judged JOIN m_bounds USING (program)) t"""

VIEWS["s_scores"] = f"""
SELECT *, greatest(weighted_score, 0.7::DOUBLE * max_signal) AS combined_score,
       round(greatest(weighted_score, 0.7::DOUBLE * max_signal), 9) > 0.65::DOUBLE AS detected
FROM (SELECT {RUN}, regression_type, path_score, resource_score, archetype_score, bounds_score,
             (path_score + resource_score + archetype_score + bounds_score) / 4 AS weighted_score,
             greatest(path_score, resource_score, archetype_score, bounds_score) AS max_signal
      FROM h_judged JOIN s_path USING ({RUN}) JOIN s_resource USING ({RUN}) JOIN s_archetype USING ({RUN}) JOIN s_bounds USING ({RUN})) t"""

VIEWS["d_plain"] = f"""
SELECT {RUN}, 'threshold' AS detector, path_duration_ns > duration_p95 AS flagged FROM h_judged JOIN m_bounds USING (program)
UNION ALL SELECT {RUN}, 'statistical_control', abs(path_duration_ns - duration_mean) > 3 * duration_std FROM h_judged JOIN m_bounds USING (program)
UNION ALL SELECT {RUN}, 'resource_only_threshold', coalesce(cpu_avg > cpu_p95, false) OR coalesce(memory_avg > memory_p95, false) OR coalesce(io_avg > io_p95, false)
FROM h_judged JOIN m_resource_wide USING (program)"""


def _kernel_views(prefix: str, columns: list[str], frequencies: int = 32) -> None:
    dim = len(columns)
    stats = ", ".join(
        f"avg(coalesce({c}, 0)::DOUBLE) AS m{i}, stddev_pop(coalesce({c}, 0)::DOUBLE) AS s{i}" for i, c in enumerate(columns)
    )
    VIEWS[f"{prefix}_scale"] = f"SELECT program, {stats} FROM h_base GROUP BY program HAVING count(*) >= 10"
    scaled = ", ".join(
        f"CASE WHEN s{i} > 0 THEN (coalesce({c}, 0)::DOUBLE - m{i}) / s{i} ELSE 0 END AS x{i}" for i, c in enumerate(columns)
    )
    for side in ("base", "judged"):
        VIEWS[f"{prefix}_{side}"] = f"SELECT {RUN}, {scaled} FROM h_{side} JOIN {prefix}_scale USING (program)"
    waves = kernel_frequencies(dim, frequencies)
    angle = ["(" + " + ".join(f"x{i} * ({w[i]!r})::DOUBLE" for i in range(dim)) + ")" for w in waves]
    means = ", ".join(f"avg(cos({a})) AS c{j}, avg(sin({a})) AS d{j}" for j, a in enumerate(angle))
    VIEWS[f"{prefix}_model"] = f"SELECT program, {means} FROM {prefix}_base GROUP BY 1"
    terms = " + ".join(f"cos({a}) * c{j} + sin({a}) * d{j}" for j, a in enumerate(angle))
    for side in ("base", "judged"):
        VIEWS[f"{prefix}_{side}_score"] = (
            f"SELECT {RUN}, round(({terms}) / {frequencies}, 9) AS score FROM {prefix}_{side} JOIN {prefix}_model USING (program)"
        )
    VIEWS[f"{prefix}_flags"] = f"""
SELECT {RUN}, coalesce(score < round(cut, 9), false) AS flagged FROM h_judged LEFT JOIN {prefix}_judged_score USING ({RUN})
LEFT JOIN (SELECT program, quantile_cont(score, 0.1) AS cut FROM {prefix}_base_score GROUP BY 1) q USING (program)"""


_kernel_views("k5", PATH_FEATURES)
_kernel_views("k6", RESOURCE_ONLY)



def _forest_views(
    prefix: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42
) -> None:
    """Isolation trees, one view per level for their nodes and for the rows that fall."""
    key, tree = f"concat_ws('_', {RUN})", "program, tree, node"
    values = ", ".join(
        f"coalesce({c}, 0)::DOUBLE" if c.startswith("path_") else f"coalesce(round({c}::DOUBLE, 10), 0)" for c in columns
    )

    def unit(text: str) -> str:
        return f"(CAST('0x' || right(md5({text}), 8) AS BIGINT) / 4294967296.0::DOUBLE)"

    def draw(purpose: str) -> str:
        return unit(f"concat_ws('|', {seed}, {tree}, '{purpose}')")

    def depth(n: str) -> str:
        return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + {EULER_GAMMA}::DOUBLE) - 2 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1 ELSE 0 END"

    drawn = f"concat_ws('|', {seed}, {key})"
    VIEWS[f"{prefix}_pool"] = f"""
SELECT program, [{values}] AS x, row_number() OVER (PARTITION BY program ORDER BY md5({drawn})) - 1 AS r, count(*) OVER (PARTITION BY program) AS pool
FROM h_base JOIN (SELECT program, count(*) AS n FROM h_base GROUP BY 1 HAVING count(*) >= 10) s USING (program) WHERE {unit(drawn)} < {trees * sample}::DOUBLE / n"""
    VIEWS[f"{prefix}_grown0"] = f"""
SELECT program, x, least(pool, {sample}) AS rows, tree, 1 AS node FROM {prefix}_pool, (SELECT unnest(range({trees})) AS tree) t
WHERE ((r - tree * {sample}) % pool + pool) % pool < {sample}"""
    VIEWS[f"{prefix}_fallen0"] = f"""
SELECT {RUN}, base, x, tree, 1 AS node FROM (SELECT {RUN}, true AS base, [{values}] AS x FROM h_base
  UNION ALL SELECT {RUN}, false, [{values}] FROM h_judged) e, (SELECT unnest(range({trees})) AS tree) t"""
    levels = (sample - 1).bit_length()
    for level in range(levels):
        VIEWS[f"{prefix}_nodes{level}"] = f"""
SELECT {tree}, i AS feature, CASE WHEN low + (high - low) * {draw('cut')} < high THEN low + (high - low) * {draw('cut')} ELSE low END AS cut FROM
 (SELECT *, row_number() OVER (PARTITION BY {tree} ORDER BY i) - 1 AS place, count(*) OVER (PARTITION BY {tree}) AS varied FROM
   (SELECT {tree}, i, min(x[i]) AS low, max(x[i]) AS high FROM {prefix}_grown{level}, (SELECT unnest(range(1, {len(columns) + 1})) AS i) f
    WHERE {2**level} < rows GROUP BY {tree}, i HAVING max(x[i]) > min(x[i])) s) p WHERE place = floor({draw('feature')} * varied)"""
        for kind in ("grown", "fallen"):
            VIEWS[f"{prefix}_{kind}{level + 1}"] = f"""
SELECT r.* REPLACE (CASE WHEN cut IS NULL THEN node ELSE 2 * node + CAST(x[feature] > cut AS INTEGER) END AS node)
FROM {prefix}_{kind}{level} r LEFT JOIN {prefix}_nodes{level} USING ({tree})"""
    VIEWS[f"{prefix}_leaves"] = f"""
SELECT {tree}, max(rows) AS rows, round((length(bin(node)) - 1 + {depth('count(*)')}) * 1e6) AS depth FROM {prefix}_grown{levels} GROUP BY {tree}"""
    VIEWS[f"{prefix}_scores"] = f"""
SELECT {RUN}, base, round(pow(2, -(sum(depth) / {trees} / 1e6) / ({depth('max(rows)')})), 9) AS score FROM {prefix}_fallen{levels} JOIN {prefix}_leaves USING ({tree})
GROUP BY {RUN}, base"""
    VIEWS[f"{prefix}_flags"] = f"""
SELECT {RUN}, coalesce(score > round(edge, 9), false) AS flagged FROM h_judged LEFT JOIN (SELECT * FROM {prefix}_scores WHERE NOT base) s USING ({RUN})
LEFT JOIN (SELECT program, quantile_cont(score, 0.9) AS edge FROM {prefix}_scores WHERE base GROUP BY 1) q USING (program)"""


_forest_views("t5", PATH_FEATURES)
_forest_views("t6", RESOURCE_ONLY)

# --- vectors -------------------------------------------------------------------------

VIEWS["g_rows"] = """
SELECT vec_id, concat('p', CAST(vec_id % 4 AS VARCHAR)) AS program, vec_id // 24 AS input_id, CAST(vec_id // 8 % 3 AS INTEGER) AS iteration,
       CAST(vec_id // 4 % 2 + 1 AS INTEGER) AS path_rank, CAST(vec_id // 4 % 2 AS INTEGER) AS path_idx, label,
       vec_id * 1000000 + label * 7 AS path_duration_ns, label + 5 AS path_length
FROM embeddings"""

VIEWS["g_long"] = """
SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"""
VIEWS["g_scale"] = "SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM g_long GROUP BY 1"
VIEWS["g_z"] = "SELECT vec_id, label, i, x, CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END AS z FROM g_long JOIN g_scale USING (i)"
VIEWS["g_centers"] = "SELECT label AS id, i, avg(z) AS c FROM g_z GROUP BY 1, 2"
VIEWS["g_distances"] = """
SELECT vec_id, id, sum((z - c) * (z - c)) AS d FROM g_z JOIN g_centers USING (i) GROUP BY 1, 2"""
VIEWS["g_assigned"] = """
SELECT r.*, a.id AS archetype, sqrt(a.d) AS distance_to_center FROM g_rows r JOIN
 (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, id) AS rn FROM g_distances) a USING (vec_id) WHERE rn = 1"""
VIEWS["g_az"] = "SELECT z.vec_id, a.archetype, a.program, z.i, z.x, z.z FROM g_z z JOIN g_assigned a USING (vec_id)"
VIEWS["g_means"] = "SELECT archetype, i, avg(z) AS c FROM g_az GROUP BY 1, 2"
VIEWS["g_own"] = """
SELECT a.vec_id, a.archetype, sum((a.z - m.c) * (a.z - m.c)) AS sq FROM g_az a JOIN g_means m USING (archetype, i) GROUP BY 1, 2"""
VIEWS["g_spread"] = "SELECT archetype, count(*) AS n, avg(sqrt(sq)) AS scatter, sum(sq) AS within FROM g_own GROUP BY 1"


def with_views(body: str) -> str:
    """Prefix a statement with the views it mentions, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z]\w*_\w+\b", text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body.strip()
    # Shared steps are evaluated once.
    clauses = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in order)
    return f"WITH {clauses}\n{body.strip()}"
