"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (default 3); the
median is reported. Results go to a sink that discards them, so the whole query
is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

HEADLINES = (
    "f03_dynamic_stats",
    "f06_dynamic_rank",
    "f08_classify_paradox",
    "f12_pearson",
    "c01_pair_calls",
    "c03_call_stats",
    "c05_critical_paths",
    "d02_combine_series",
    "d04_telemetry_aggregates",
    "d07_resource_features",
    "e01_structural_features",
    "e02_temporal_features_of_calls",
    "e04_transition_features",
    "e06_assemble_features",
    "g05_assign_archetypes",
    "g06_silhouette",
    "g14_archetype_purity",
    "h02_run_features",
    "h06_ngram_model",
    "h16_combine_signals",
    "h21_ablation",
    "i02_nested_loop_pairs",
    "b05_squash_whitespace",
    "j02_slice_inputs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spanloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from spanloom.plans import catalog

    def once(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    seconds = {}
    for name in wanted:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
