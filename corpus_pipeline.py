"""Documents to training tokens: five stages, each written as Parquet and read again.

Quality rules and the quality classifier drop documents, the Jaccard join keeps
one of each group of near copies, the mix repeats and orders what is left by its
training position, and the last stage encodes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import curriculum, jaccard_join, ordinal, pieces, quality_rules
from spanloom.llm.common import small_batches, table
from spanloom.operators.storage import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted on labelled documents."""
    return quality_rules.accepted(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches the calibrated limit."""
    return ordinal.accepted(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 4-gram Jaccard of 0.85 or more."""
    return jaccard_join.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for every copy the mix starts."""
    return curriculum.training_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests that ``op6`` returns."""
    return pieces.encoded_digests(docs, pieces.model_path())


STAGES = [
    ("quality rules", quality),
    ("quality classifier", classified),
    ("n-gram Jaccard join", distinct),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", tokens),
]

#: Models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
