"""Declared schemas of the native files."""

# Field names and types of the files.
CRITICAL_PATHS = (
    "summary struct<num_paths_requested: int, num_paths_found: int, num_threads: int, "
    "total_function_calls: long, _regression_type: string, _archetype: int>, "
    "top_k_critical_paths array<struct<rank: int, thread_id: string, critical_duration_ns: long, "
    "critical_duration_formatted: string, total_duration_ns: long, path_length: int, "
    "functions: array<struct<function_name: string, duration_ns: long, self_time_ns: long, "
    "thread_id: string, entry_id: string, start_time: string, end_time: string>>, "
    "bottlenecks: array<struct<`function`: string, total_duration_ns: long, self_time_ns: long, "
    "percentage_of_path: double>>>>, "
    "executed_functions array<string>"
)
CALL_STATS = (
    "function_name string, thread_id string, duration_ns long, self_time_ns long, num_children int"
)
TELEMETRY = (
    "time_series struct<timestamps_ns: array<long>, cpu_usage: array<double>, "
    "memory_usage: array<double>, disk_usage: array<double>>, "
    "aggregated_metrics map<string, struct<peak: double, average: double, median: double>>, "
    "trace_start_ns long, trace_end_ns long"
)
STATIC_METRICS = (
    "file string, functions array<struct<name: string, simple_name: string, "
    "number_of_parameters: int, line_of_codes: int, has_io: boolean, number_of_loops: int, "
    "number_of_nested_loops: int, number_of_calls: int, is_recursive: boolean, "
    "number_of_statements: struct<number_of_expression_statements: int, "
    "number_of_declaration_statements: int, number_of_empty_statements: int>, "
    "number_of_branches: struct<number_of_if: int, number_of_switch: int, "
    "number_of_preprocessor_if: int>, number_of_callers: int, function_type: string>>"
)
ASSIGNMENTS = "program string, input int, iteration int, path_rank int, archetype int"
TRACE_EVENT = "ph string, ts double, pid long, tid long, name string"
PARAMETERS = "program string, build string, parameters map<string, string>"
DETECTIONS = (
    "program string, input long, iteration int, is_regression boolean, regression_type string, "
    "exec_key string, path_score double, resource_score double, archetype_score double, "
    "bounds_score double, weighted_score double, max_signal double, combined_score double, "
    "detected boolean"
)
