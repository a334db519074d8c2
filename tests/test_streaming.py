from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators.storage import scratch_path
from spanloom.streaming import live

KEY = "program string, input_id long, iteration long, is_regression boolean"


def feed(spark, schema, parts):
    """A file stream that reads one file a batch, in order."""
    import time

    folder = scratch_path(spark, "fed")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in order of their time stamps
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_samples_are_dropped(spark):
    schema = "kind string, ts timestamp, value double"
    at = lambda minutes: F.timestamp_seconds(F.lit(minutes * 60))

    def rows(*minutes):
        return [tuple(r) for r in spark.createDataFrame([(m,) for m in minutes], "m long").select(
            F.lit("a"), at(F.col("m")), F.col("m").cast("double")).collect()]

    stream = feed(spark, schema, [rows(5, 30), rows(200), rows(205), rows(40, 210), rows(500)])
    windows = live.stream_telemetry(stream, ["kind"], ["value"])
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    started = windows.writeStream.format("parquet").outputMode("append").option("path", out)
    started.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = {r["window_start"].minute + 60 * r["window_start"].hour: r["samples"] for r in spark.read.parquet(out).collect()}
    # minute 40 came when the watermark of the batch before had passed its window: minutes 200, 205 and 210 count
    assert got == {0: 2, 180: 3}


def test_runs_join_their_telemetry(spark):
    second = lambda s: F.timestamp_seconds(F.lit(s))

    def stamped(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return [tuple(r) for r in df.withColumn("arrived", F.timestamp_seconds("arrived")).collect()]

    plain = f"{KEY}, path_length long, arrived"
    side = f"{KEY}, cpu_avg double, memory_avg double, io_avg double, arrived"
    run = lambda i: ("p", i, 0, False)
    paths = [
        stamped([(*run(1), 3, 1000), (*run(2), 3, 1010)], f"{plain} long"),
        stamped([(*run(9), 3, 90_000)], f"{plain} long"),
        stamped([(*run(11), 3, 90_100)], f"{plain} long"),
        stamped([(*run(4), 3, 1020)], f"{plain} long"),  # long after its time
        stamped([(*run(10), 3, 200_000)], f"{plain} long"),
    ]
    telemetry = [
        stamped([(*run(1), 5.0, 6.0, 7.0, 1300)], f"{side} long"),
        stamped([(*run(9), 1.0, 1.0, 1.0, 90_000)], f"{side} long"),
        stamped([(*run(2), 9.0, 9.0, 9.0, 95_000)], f"{side} long"),  # too far from its paths
        stamped([(*run(11), 2.0, 2.0, 2.0, 95_001), (*run(11), 3.0, 3.0, 3.0, 90_200)], f"{side} long"),
        stamped([(*run(10), 1.0, 1.0, 1.0, 200_000)], f"{side} long"),
    ]
    joined = live.run_arrivals(feed(spark, f"{plain} timestamp", paths), feed(spark, f"{side} timestamp", telemetry))
    out = scratch_path(spark, "joined")
    live.stream_scores(joined, lambda batch: batch, out, scratch_path(spark, "joined-state")).awaitTermination()
    got = {r["input_id"]: r["cpu_avg"] for r in spark.read.parquet(out).collect()}
    assert got == {1: 5.0, 2: None, 9: 1.0, 10: 1.0, 11: 3.0}


def test_detection_without_telemetry(spark):
    """The resource signal is 0; models without the program leave the run undetected."""
    runs = spark.createDataFrame(
        [("p", 1, 0, False, "none", 3, 5, 0, None, None, None, ["a", "b"])],
        f"{KEY}, regression_type string, path_length long, path_duration_ns long, archetype long, cpu_avg double, memory_avg double, io_avg double, names array<string>",
    )
    empty = {
        "frequencies": "program string, function_name string, frequency long",
        "grams": "program string, ngram string",
        "lengths": "program string, path_length_mean double, path_length_std double",
        "resources": "program string, resource string, mean double, std double, p95 double, p99 double",
    }
    models = {name: spark.createDataFrame([], schema) for name, schema in empty.items()}
    signal = live.scoring.score_resource(runs, models["resources"]).first()
    assert signal["resource_score"] == 0.0
    functions = runs.select(*live.RUN, F.posexplode("names").alias("pos", "function_name"))
    path = live.scoring.score_path(runs, functions, models["frequencies"], models["grams"], models["lengths"]).first()
    assert path["path_score"] == 1.0


def test_scores_read_a_written_batch_not_the_stream(spark, tmp_path):
    """Scoring reads a batch many times; joins and state of the stream must not run again."""
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source).dropDuplicates(["id"])
    plans = []

    def score(batch):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        return batch.unionByName(batch)

    live.stream_scores(stream, score, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert plans and all("FileScan parquet" in p for p in plans)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
