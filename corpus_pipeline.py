"""A training-data pipeline: classify, deduplicate, remove repeated passages, redact, pack.

Every stage takes (spark, docs, sf_dir) and all that the one before kept; all but the last return the columns of docs.
Nothing reads a label but to fit the classifier on its fold.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import packing, passages, pii, rules, simhash
from recollect.llm.common import discard, materialize, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """One session runs all stages, and its executors keep what memory any of them took: batches are kept small."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject."""
    return rules.accepted(docs, rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest doc_id."""
    return simhash.first_of_group(docs)


@_bounded
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of recurring 35-word windows; every document stays."""
    return _counted(passages.remove_passages(docs))


@_bounded
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(pii.redact(docs))


@_bounded
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir))
        discard(docs)  # a stage's table goes when the next one is written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fitted trees, iterated components and tokenizer merges aren't SQL; a test compares each stage with brute force.
ORACLE_SQL = None
