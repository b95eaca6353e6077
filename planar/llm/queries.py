"""The registered queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planar.llm import (
    alignment, decontaminate, lm_score, merkle, mixing, ngram_join, packing, pii, quality, secret_scan, sql,
    substring_dedup, url_rules, warc,
)
from planar.llm.scratch import written
from planar.llm.ship import ship_code
from planar.llm.spans import n_spans, of_kinds, spans_text

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_join.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "class_id", "n_links", "n_copies")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    mixed = written(spark, mixed.withColumn("at", F.monotonically_increasing_id()), "mixed")
    # The documents in training order, one row per time that one is taken. Stored, because
    # Spark leaves out a sort below sums.
    kept = mixed.withColumn("doc", F.struct("at", "size"))
    ordered = written(spark, mixing.in_order(kept), "training-order")
    found = ordered.groupBy("at").agg(
        F.sum("size").alias("taken"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
    # Of documents that are not taken, -1.
    places = [F.coalesce(name, F.lit(-1.0)).alias(name) for name in ("first_position", "last_position")]
    docs = mixed.select("at", "doc.doc_id", "size", "source_size", "target").join(found, "at", "left")
    taken = F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken")
    return docs.select("doc_id", "size", "source_size", "target", taken, *places)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    crf = pii.train(docs)
    found = docs.select("doc_id", pii.personal_spans("text", crf).alias("found")).select("doc_id", "found.*")
    return found.select(
        "doc_id", *[n_spans("base", kind) for kind in pii.KINDS],
        F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secret_scan.secret_spans("text").alias("found"))
    base = of_kinds("found", secret_scan.BASE_KINDS)
    return found.select(
        "doc_id", *[n_spans("found", kind) for kind in secret_scan.BASE_KINDS],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text("found").alias("spans"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return scored.select("doc.doc_id", *[f"counts.{n}" for n in names], "base_failed", "kept")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_rows(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_mixing": op3_mixing,
        "op4_warc": op4_warc,
        "op5_personal_data": op5_personal_data,
        "op6_lm_score": op6_lm_score,
        "op7_url_rules": op7_url_rules,
        "op8_secret_scan": op8_secret_scan,
        "op9_decontaminate": op9_decontaminate,
        "op10_quality_rules": op10_quality_rules,
        "op11_alignment": op11_alignment,
        "op12_merkle": op12_merkle,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": sql.mixing(),
        "op4_warc": sql.warc(),
        "op10_quality_rules": sql.quality_rules(),
        "op12_merkle": sql.merkle(),
    }
