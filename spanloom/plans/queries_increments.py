"""Registered queries: baseline models built in two increments, as one full build."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.increments import ModelStore
from ..operators.storage import scratch_path
from . import queries_regression
from .bindings import Tables
from .registry import query


def store(t: Tables) -> ModelStore:
    """Runs of even inputs first; then all runs, of which only the rest is pending.

    Path length stands in for the archetype, which is constant per input here.
    """
    flow = queries_regression.analysis(t)
    base = flow.base.withColumn("archetype", F.col("path_length") % 4)
    models = ModelStore(t.spark, scratch_path(t.spark, "models"))
    models.add(base.where(F.col("input_id") % 2 == 0), flow.functions)
    models.add(base, flow.functions)
    return models


def half_built(t: Tables) -> tuple[ModelStore, DataFrame]:
    """A store that holds the runs of even inputs, and all normal runs."""
    flow = queries_regression.analysis(t)
    models = ModelStore(t.spark, scratch_path(t.spark, "models"))
    models.add(flow.base.where(F.col("input_id") % 2 == 0), flow.functions)
    return models, flow.base


@query(
    "a13_pending_model_runs",
    "program #input_id #iteration",
    "SELECT program, input_id, iteration FROM h_base WHERE input_id % 2 <> 0",
)
def pending_model_runs(t: Tables) -> DataFrame:
    models, runs = half_built(t)
    return models.pending(runs)


@query("h05_frequency_model_increments", "program function_name #frequency ~mean_position", "m_frequency")
def frequency_model(t: Tables) -> DataFrame:
    return store(t).function_frequency_model()


@query("h06_ngram_model_increments", "program ngram #frequency", "m_ngrams")
def ngram_model(t: Tables) -> DataFrame:
    return store(t).ngram_model()


@query(
    "h07_bottleneck_model_increments",
    "program bottleneck_function #frequency",
    "SELECT program, bottleneck_function, count(*) AS frequency FROM h_base WHERE bottleneck_function IS NOT NULL GROUP BY 1, 2",
)
def bottleneck_model(t: Tables) -> DataFrame:
    return store(t).bottleneck_model()


@query("h08_resource_model_increments", "program resource ~mean ~std ~p95 ~p99", "m_resource")
def resource_model(t: Tables) -> DataFrame:
    return store(t).resource_model()


@query(
    "h09_archetype_transitions_increments",
    "program transition #count",
    """SELECT program, concat(before, '->', archetype) AS transition, count(*) AS count FROM
    (SELECT program, archetype, lag(archetype) OVER (PARTITION BY program, input_id ORDER BY iteration) AS before
     FROM (SELECT program, input_id, iteration, (path_length % 4) AS archetype FROM h_base) r) t WHERE before IS NOT NULL GROUP BY 1, 2""",
)
def archetype_transitions(t: Tables) -> DataFrame:
    return store(t).archetype_transitions()


@query(
    "h10_bounds_model_increments",
    "program ~duration_mean ~duration_std ~duration_median ~duration_p95 ~duration_p99 ~duration_iqr ~length_mean ~length_std #length_max #length_min",
    "m_bounds",
)
def bounds_model(t: Tables) -> DataFrame:
    return store(t).bounds_model()
