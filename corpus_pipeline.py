"""A corpus from raw documents to a training mix, as five stages.

Every stage works on all rows its predecessor kept and returns the columns of
``documents``; the last one adds ``epoch`` and ``position``. ``doc_id`` is expected
to be unique; rows without one are told apart by their text where a stage needs it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planar.llm import decontaminate, mixing, ngram_join, quality
from planar.llm.scratch import written
from planar.llm.secret_scan import mask_secrets
from planar.llm.ship import ship_code

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, the one with the smallest id."""
    ship_code(spark)
    return ngram_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is like a benchmark item."""
    ship_code(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    ship_code(spark)
    masked = docs.withColumn("text", mask_secrets("text"))
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("bigint")))


def training_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, a row for each time one is taken."""
    return mixing.in_order(mixing.mix(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scan", secrets),
    ("training mix", training_mix),
]

# MinHash, fingerprints and a tokenizer are not SQL; the tests compare every stage
# with a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
