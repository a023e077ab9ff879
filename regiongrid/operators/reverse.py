"""Reverse geocoding and containment of points.

Points are mapped to grid cells and joined to the cell index by cell; candidates
are settled in the row, so with the index broadcast there is no shuffle, and the
same plan serves batches and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import adcode
from ..plans.registry import RegionRegistry
from ..schema import LEVELS
from . import geometry


def _cell(c: str, size: float) -> Column:
    """Number of the grid cell; null for null, NaN and coordinates off the globe."""
    return F.when(F.col(c).between(-360.0, 360.0), F.floor(F.col(c) / size))


def locate(points: DataFrame, registry: RegionRegistry, index: DataFrame | None = None) -> DataFrame:
    """``points`` (lat, lng, any others) with ``_hits``: array of (level, pos) of the shapes they are in.

    Regions of one level and equal polygons are one shape, under the first's pos: what
    holds a point does not grow with copies. ``registry.regions`` has each one's shape.
    ``index`` may be a part of the registry's index, for the hits in that part.
    """
    p = points.withColumn("_cx", _cell("lng", registry.grid)).withColumn("_cy", _cell("lat", registry.grid))
    cells = registry.cells(index).select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "candidates")
    joined = p.join(cells, ["_cx", "_cy"], "left")
    found = F.filter("candidates", lambda c: c["full"] | geometry.inside(c["edges"], F.col("lng"), F.col("lat")))
    hits = F.transform(found, lambda c: F.struct(c["level"].alias("level"), c["pos"].alias("pos")))
    return joined.withColumn("_hits", F.coalesce(hits, F.array().cast("array<struct<level:string,pos:int>>"))).drop("_cx", "_cy", "candidates")


def reverse(points: DataFrame, registry: RegionRegistry, backfill: bool = True) -> DataFrame:
    """One row a point with structs province, city and district (null where in none).

    Levels are settled independently; of several regions the first in file order
    wins. A missing city of a merged province is the province as a city.
    """
    out = locate(points, registry)
    small = registry.shapes.select("level", "pos", F.struct("name", "code", "level", F.round("rep_lat", 6).alias("latitude"), F.round("rep_lng", 6).alias("longitude")).alias("r"))
    for level in LEVELS:
        first = F.array_min(F.transform(F.filter("_hits", lambda h: h["level"] == level), lambda h: h["pos"]))
        side = small.where(F.col("level") == level).select(F.col("pos").alias(f"_{level}"), F.col("r").alias(level))
        out = out.withColumn(f"_{level}", first).join(registry.hint(side, shapes=True), f"_{level}", "left").drop(f"_{level}")
    out = out.drop("_hits")
    if backfill:
        as_city = F.col("province").withField("level", F.lit("city"))
        fill = F.col("city").isNull() & adcode.is_merged(F.col("province.code"))
        out = out.withColumn("city", F.when(fill, as_city).otherwise(F.col("city")))
    return out


def flat(reversed_: DataFrame, *keys: str) -> DataFrame:
    """``keys`` with code and name of each level."""
    return reversed_.select(*keys, *[F.col(f"{x}.{f}").alias(f"{x}_{f}") for x in LEVELS for f in ("code", "name")])


def in_country(points: DataFrame, registry: RegionRegistry) -> DataFrame:
    """``points`` with ``in_country``: they are in some province."""
    out = locate(points, registry)
    return out.withColumn("in_country", F.exists("_hits", lambda h: h["level"] == "province")).drop("_hits")


def resolve_region(codes: DataFrame, registry: RegionRegistry) -> DataFrame:
    """``codes`` (code) with the level and the pos of the shape they stand for, or an ``error``.

    A city code of a merged province stands for the province.
    """
    c = F.col("code")
    level = adcode.level(c)
    merged = (level == "city") & adcode.is_merged(c)
    d = codes.withColumn("_level", F.when(merged, "province").otherwise(level)).withColumn("_code", F.when(merged, adcode.province_code(c)).otherwise(c))
    first = registry.shapes.select("level", "shape", F.col("pos").alias("first"))
    known = registry.by_code().join(registry.hint(first, shapes=True), ["level", "shape"], "left")
    known = known.select(F.col("level").alias("_level"), F.col("code").alias("_code"), F.coalesce("first", "pos").alias("region_pos"))
    d = d.join(registry.hint(known), ["_level", "_code"], "left")
    error = F.when(F.col("_level").isNull(), "malformed code").when(F.col("region_pos").isNull(), "unknown code")
    return d.withColumn("error", error).withColumnRenamed("_level", "region_level").drop("_code")


def in_region(points: DataFrame, registry: RegionRegistry) -> DataFrame:
    """``points`` (lat, lng, code) with ``in_region`` (null if the code has an ``error``) and ``error``."""
    d = resolve_region(locate(points, registry), registry)
    hit = F.exists("_hits", lambda h: (h["level"] == F.col("region_level")) & (h["pos"] == F.col("region_pos")))
    return d.withColumn("in_region", F.when(F.col("error").isNull(), hit)).drop("_hits", "region_level", "region_pos")
