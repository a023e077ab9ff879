"""Registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_extract, jaccard, packing, pii, quality_mil, rules, suffix_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    return rules.quality_rules(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return quality_mil.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 100-byte strings."""
    return suffix_dedup.repeat_digests(_table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered roles and canonical text of every conversation."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack_digests(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.DEMO_KEY, counted="n_replaced")


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' records as read back from archives."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_quality_classifier,
            op2_suffix_array_dedup,
            op3_benchmark_decontamination,
            op4_chat_formatting,
            op5_ngram_jaccard_join,
            op6_best_fit_packing,
            op7_html_extraction,
            op8_pii_pseudonyms,
            op9_quality_rules,
            op10_warc_round_trip,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_decontamination": decontaminate.oracle(),
        "op9_quality_rules": rules.oracle(),
    }
