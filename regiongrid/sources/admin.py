"""Admin list, version record and legacy code table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import adcode
from ..schema import ADMIN, ADMIN_KINDS, VERSION


def read_admin(spark: SparkSession, path: str) -> DataFrame:
    """(kind, pos, code, name) of the admin list."""
    return _entries(spark.read.schema(ADMIN).option("multiLine", True).json(path))


def parse_admin(texts: DataFrame, name: str) -> DataFrame:
    """The same of lists as JSON text in a column."""
    return _entries(texts.select(F.from_json(name, ADMIN).alias("_a")).select("_a.*"))


def _entries(raw: DataFrame) -> DataFrame:
    parts = [
        raw.select(F.lit(kind).alias("kind"), F.posexplode(key).alias("pos", "p")).select(
            "kind", "pos", F.col("p")[0].alias("code"), F.col("p")[1].alias("name")
        )
        for key, kind in ADMIN_KINDS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def admin_json(admin: DataFrame) -> DataFrame:
    """One row, ``value``: the admin list as JSON, sorted by code."""
    lists = [
        F.coalesce(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("code", "name")))),
                lambda x: F.array(x["code"], x["name"]),
            ),
            F.array().cast("array<array<string>>"),
        ).alias(key)
        for key, kind in ADMIN_KINDS.items()
    ]
    return admin.agg(*lists).select(F.to_json(F.struct(*ADMIN_KINDS)).alias("value"))


def write_admin(admin: DataFrame, path: str) -> None:
    admin_json(admin).coalesce(1).write.mode("overwrite").text(path)


def read_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERSION).option("multiLine", True).json(path)


def version_record(admin: DataFrame, source: str, source_url: str, api_base: str, notes: str) -> DataFrame:
    """One row in the form of the version record, with the counts of ``admin``."""
    counts = F.struct(*[F.count(F.when(F.col("kind") == k, 1)).alias(key) for key, k in ADMIN_KINDS.items()])
    return admin.agg(counts.alias("counts")).select(
        F.lit(source).alias("source"),
        F.lit(source_url).alias("source_url"),
        F.lit(api_base).alias("api_base"),
        F.date_format(F.current_date(), "yyyy-MM-dd").alias("fetched_at"),
        F.lit("GCJ-02").alias("original_crs"),
        F.lit("WGS-84").alias("converted_crs"),
        "counts",
        F.lit(notes).alias("notes"),
    )


def write_version(version: DataFrame, path: str) -> None:
    version.select(F.to_json(F.struct(*version.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_code_table(spark: SparkSession, path: str) -> DataFrame:
    """(kind, code, name) of a legacy CSV of code and comma path; a header row, 980000 dropped.

    A spreadsheet is exported to CSV first: Spark has no spreadsheet source.
    """
    return admin_of_paths(spark.read.option("header", True).schema("code string, path string").csv(path))


def admin_of_paths(rows: DataFrame) -> DataFrame:
    """(kind, code, name) of (code, path); 81 and 82 city rows are provinces as well."""
    rows = rows.where("code <> '980000'").select("code", "path")
    own = rows.select(adcode.path_level(F.col("path")).alias("kind"), "code", adcode.path_name(F.col("path")).alias("name"))
    own = own.where("kind IS NOT NULL")
    sar = own.where((F.col("kind") == "city") & F.col("code").endswith("0000") & adcode.prefix(F.col("code"), 2).isin("81", "82"))
    return own.unionByName(sar.withColumn("kind", F.lit("province")))
