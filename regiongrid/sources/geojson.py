"""GeoJSON of one level: scan, Parquet-free registry rows, and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GEOJSON, LEVELS, POLYGONS, GEOJSON_FILES


def polygons_of(kind: Column, coordinates: Column) -> Column:
    """Polygon and MultiPolygon coordinates (JSON text) as polygons, rings, points."""
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", F.from_json(coordinates, POLYGONS))


def _collections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GEOJSON).option("multiLine", True).json(path)


def is_readable(spark: SparkSession, path: str) -> bool:
    """``path`` holds feature collections, perhaps empty ones, and nothing else."""
    n = _collections(spark, path).agg(F.count("*"), F.count(F.when(F.col("type") == "FeatureCollection", F.col("features")))).first()
    return n[0] > 0 and n[0] == n[1]


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """pos, properties, kind, coordinates and polygons of the features, in file order."""
    return _features(_collections(spark, path))


def parse_features(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The same of feature collections as text, with the other columns of ``bodies``; unreadable text has no feature."""
    rest = [c for c in bodies.columns if c != body]
    return _features(bodies.select(*rest, F.from_json(body, GEOJSON).alias("_c")).select(*rest, "_c.features"), *rest)


def _features(collections: DataFrame, *rest: str) -> DataFrame:
    f = collections.select(*rest, F.posexplode("features").alias("pos", "f"))
    return f.select(
        *rest,
        "pos",
        F.col("f.properties").alias("properties"),
        F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates").alias("coordinates"),
        polygons_of(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("polygons"),
    )


def read_level(spark: SparkSession, path: str, level: str) -> DataFrame:
    """level, level_ord, pos, code, name and polygons of one file."""
    return read_features(spark, path).select(
        F.lit(level).alias("level"),
        F.lit(LEVELS.index(level)).alias("level_ord"),
        "pos",
        F.col("properties.adcode").cast("string").alias("code"),
        F.col("properties.name").alias("name"),
        "polygons",
    )


def read_levels(spark: SparkSession, data_dir: str) -> DataFrame:
    """All three levels of a data directory."""
    p, c, d = (read_level(spark, f"{data_dir}/{GEOJSON_FILES[x]}", x) for x in LEVELS)
    return p.unionByName(c).unionByName(d)


def feature_json(regions: DataFrame) -> DataFrame:
    """One GeoJSON feature a row, as text, from level, pos, code, name, polygons and, if there, center, centroid and childrenNum."""
    more = [F.col(c) for c in ("center", "centroid", "childrenNum") if c in regions.columns]
    return regions.select(
        "level",
        "pos",
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.col("name"), F.col("code").alias("adcode"), F.col("level"), *more).alias("properties"),
                F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates")).alias("geometry"),
            )
        ).alias("feature"),
    )


def write_level(regions: DataFrame, path: str, level: str) -> None:
    """One level as a feature collection: one text file in the folder ``path``.

    A level has a few thousand regions; the file format is one JSON document,
    so its features meet in one row.
    """
    rows = feature_json(regions.where(F.col("level") == level))
    ordered = rows.agg(F.sort_array(F.collect_list(F.struct("pos", "feature"))).alias("fs"))
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.col("fs.feature"), ","), F.lit("]}")
    )
    ordered.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)
