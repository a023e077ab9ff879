"""Corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage reads what its predecessor kept, as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regiongrid.llm import decontaminate, jaccard, packing, pii, quality_mil
from regiongrid.llm.common import release, shared_path, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts are scored like any other."""
    return quality_mil.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked ones; those without words or id stay."""
    return jaccard.keep_one(docs).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those without words or id hold none."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; null texts stay null."""
    return pii.pseudonymise(docs, pii.DEMO_KEY).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; null and empty texts are an end token."""
    return packing.pack_digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: Two stages are a learned model and an iterative component search: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again.

    The tables that a stage wrote on its way are deleted once its result is written.
    What the last one wrote, and the results, stay until ``common.release`` is called.

    Null and empty texts, repeated rows and empty tables pass as each operator's
    docstring states; columns of other names are left out after the first stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = shared_path(spark, f"stage{i}")
        mark = written()
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        release(spark, mark)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
