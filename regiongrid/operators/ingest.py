"""From raw payloads to the three level tables: normalise, convert, nest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import crs
from ..schema import ADMIN_FILE, GEOJSON_FILES, LEVELS, VERSION_FILE
from ..sources.admin import version_record, write_admin, write_version
from ..sources.geojson import parse_features, write_level


def convert_column(df: DataFrame, name: str, depth: int) -> DataFrame:
    """Coordinates of ``name``, arrays nested ``depth`` deep around [lng, lat] pairs, converted.

    Null stays null, as do nulls within.
    """
    lng, lat = crs.etl_gcj02_to_wgs84("p.lng", "p.lat")
    text = f"CASE WHEN x0 IS NULL THEN NULL ELSE transform(array(named_struct('lng', x0[0], 'lat', x0[1])), p -> array({lng}, {lat}))[0] END"
    for i in range(depth):
        text = f"transform(x{i + 1}, x{i} -> {text})"
    wrapped = f"transform(array({name}), x{depth} -> {text})[0]"
    return df.withColumn(name, F.expr(wrapped))


def normalise(features: DataFrame, level: str) -> DataFrame:
    """parent (if there), pos, name, adcode (text), center, centroid, level, childrenNum (0 if absent) and polygons."""
    p = F.col("properties")
    return features.select(
        *[c for c in ("parent",) if c in features.columns],
        "pos",
        p["name"].alias("name"),
        p["adcode"].cast("string").alias("adcode"),
        p["center"].alias("center"),
        p["centroid"].alias("centroid"),
        F.lit(level).alias("level"),
        F.coalesce(p["childrenNum"], F.lit(0)).alias("childrenNum"),
        "polygons",
    )


def convert(features: DataFrame) -> DataFrame:
    """Geometry, center and centroid from GCJ-02 to WGS-84."""
    out = convert_column(features, "polygons", 3)
    for name in ("center", "centroid"):
        out = convert_column(out, name, 0)
    return out


def build_levels(national: DataFrame, children: DataFrame, grandchildren: DataFrame) -> DataFrame:
    """Regions of all levels from normalised features.

    ``national`` holds the country's features, of which provinces count;
    ``children`` (with ``parent``) those below each province, ``grandchildren``
    those below each city. Below merged provinces the children are districts.
    A city without children is a district as well, under the same code.
    """
    from ..functions import adcode

    p = national.where("level = 'province'")
    under = children.withColumn("_merged", adcode.is_merged(F.col("parent")))
    d1 = under.where("_merged").drop("_merged", "parent").withColumn("level", F.lit("district"))
    c = under.where("NOT _merged").drop("_merged", "parent").withColumn("level", F.lit("city"))
    childless = c.where("childrenNum <= 0").withColumn("level", F.lit("district"))
    d2 = grandchildren.drop("parent").withColumn("level", F.lit("district"))
    every = p.unionByName(c).unionByName(d1).unionByName(childless).unionByName(d2)
    order = F.create_map(*[x for i, level in enumerate(LEVELS) for x in (F.lit(level), F.lit(i))])
    return every.withColumn("level_ord", order[F.col("level")])


def levels_of(payloads: DataFrame, country: str = "100000") -> DataFrame:
    """Regions in the form of the registry, with center, centroid and childrenNum, from raw payloads (parent, body).

    The country's payload gives the provinces, those of provinces the level below
    them, all others districts. Coordinates become WGS-84; regions are numbered
    within a level by code.
    """
    f = parse_features(payloads)
    parent = F.col("parent")

    def normal(of: Column) -> DataFrame:
        return convert(normalise(f.where(of), "district"))

    national = normal((parent == country) & (F.col("properties.level") == "province")).drop("parent").withColumn("level", F.lit("province"))
    children = normal((parent != country) & parent.endswith("0000"))
    grandchildren = normal(~parent.endswith("0000"))
    order = W.partitionBy("level").orderBy("adcode", "name")
    built = build_levels(national, children, grandchildren).withColumn("pos", F.row_number().over(order) - 1)
    return built.withColumnRenamed("adcode", "code")


def write_all(regions: DataFrame, folder: str, source: str, source_url: str, api_base: str, notes: str = "") -> None:
    """The data directory of built regions: three levels, admin list and version record."""
    for level, name in GEOJSON_FILES.items():
        write_level(regions, f"{folder}/{name}", level)
    admin = regions.select(F.col("level").alias("kind"), "pos", "code", "name")
    write_admin(admin, f"{folder}/{ADMIN_FILE}")
    write_version(version_record(admin, source, source_url, api_base, notes), f"{folder}/{VERSION_FILE}")


def admin_list(regions: DataFrame) -> DataFrame:
    """(kind, code, name) of built regions."""
    return regions.select(F.col("level").alias("kind"), F.col("adcode").alias("code"), "name")
