"""Data quality of the region tables: findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import adcode
from ..plans.registry import RegionRegistry
from ..schema import ADMIN_FILE, ADMIN_KINDS, FINDING, GEOJSON_FILES, LEVELS, NO_SUBLEVEL_PREFIX, VERSION_FILE

# The accepted number of regions of each level.
BOUNDS = {"province": (30, 40), "city": (300, 420), "district": (2500, 3500)}
# Landmarks (name, lat, lng) and the province prefix each lies in.
LANDMARKS = (
    ("Beijing", 39.9042, 116.4074, "11"),
    ("Shanghai", 31.2304, 121.4737, "31"),
    ("Guangdong", 23.1291, 113.2644, "44"),
    ("Sichuan", 30.5728, 104.0668, "51"),
    ("Chongqing", 29.5630, 106.5516, "50"),
    ("Heilongjiang", 45.7500, 126.6500, "23"),
    ("Shandong", 36.0671, 120.3826, "37"),
    ("Yunnan", 25.0389, 102.7183, "53"),
)
REQUIRED = ("source", "source_url", "api_base", "fetched_at", "original_crs", "converted_crs", "counts")


def finding(df: DataFrame, category: str, message: Column, severity: str) -> DataFrame:
    """Rows of ``df`` as findings; level and code are kept if it has them."""
    extra = [F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string") for c in ("level", "code")]
    return df.select(F.lit(category).alias("category"), message.alias("message"), F.lit(severity).alias("severity"), extra[0].alias("level"), extra[1].alias("code"))


def count_bounds(regions: DataFrame, bounds: dict = BOUNDS) -> DataFrame:
    spark = regions.sparkSession
    b = spark.createDataFrame([(k, *v) for k, v in bounds.items()], "level string, low int, high int")
    n = b.join(regions.groupBy("level").agg(F.count("*").alias("n")), "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return finding(n.where("n NOT BETWEEN low AND high"), "count", F.format_string("%s: %d regions, expected %d to %d", "level", "n", "low", "high"), "ERROR")


def bad_codes(regions: DataFrame) -> DataFrame:
    bad = regions.where(~adcode.is_code(F.col("code")))
    return finding(bad, "adcode", F.format_string("%s %s: code %s is not six digits", "level", F.coalesce("name", F.lit("?")), F.coalesce("code", F.lit("null"))), "ERROR")


def duplicate_codes(regions: DataFrame) -> DataFrame:
    """One finding a repeat, naming the holder before it; malformed codes are not tested."""
    w = W.partitionBy("level", "code").orderBy("pos")
    d = regions.where(adcode.is_code(F.col("code"))).withColumn("before", F.lag("name").over(w)).withColumn("turn", F.row_number().over(w))
    return finding(d.where("turn > 1"), "duplicate", F.format_string("%s: code %s of %s is that of %s", "level", "code", F.coalesce("name", F.lit("?")), F.coalesce("before", F.lit("?"))), "ERROR")


def orphans(regions: DataFrame) -> DataFrame:
    """Cities without a province; districts without their parent."""
    code = F.col("code")
    at = {x: regions.where(F.col("level") == x) for x in LEVELS}
    p2 = at["province"].select(adcode.prefix(code, 2).alias("p")).distinct()
    p4 = at["city"].select(adcode.prefix(code, 4).alias("p")).distinct()
    city = at["city"].withColumn("p", adcode.prefix(code, 2)).join(p2, "p", "left_anti")
    d = at["district"]
    merged = d.where(adcode.is_merged(code)).withColumn("p", adcode.prefix(code, 2)).join(p2, "p", "left_anti")
    plain = d.where(~adcode.is_merged(code)).withColumn("p", adcode.prefix(code, 4)).join(p4, "p", "left_anti")
    return (
        finding(city, "hierarchy", F.format_string("city %s has no province", "code"), "ERROR")
        .unionByName(finding(merged, "hierarchy", F.format_string("district %s has no province", "code"), "ERROR"))
        .unionByName(finding(plain, "hierarchy", F.format_string("district %s has no city", "code"), "WARN"))
    )


def bad_geometry(regions: DataFrame) -> DataFrame:
    empty = F.col("polygons").isNull() | (F.size("polygons") == 0) | F.exists("polygons", lambda p: F.size(p) == 0)
    return finding(regions.where(F.coalesce(empty, F.lit(True))), "geometry", F.format_string("%s %s has no geometry", "level", "code"), "ERROR")


def uncovered_provinces(regions: DataFrame) -> DataFrame:
    """Provinces without any district, but for the one without sub-levels."""
    code = F.col("code")
    d = regions.where("level = 'district'").select(adcode.prefix(code, 2).alias("p")).distinct()
    p = regions.where("level = 'province'").withColumn("p", adcode.prefix(code, 2)).where(F.col("p") != NO_SUBLEVEL_PREFIX)
    return finding(p.join(d, "p", "left_anti"), "coverage", F.format_string("province %s has no district", "code"), "ERROR")


def tree_sync(regions: DataFrame, admin: DataFrame) -> DataFrame:
    """Province and district codes that only one of boundaries and admin list has."""
    out = None
    for kind, severity in (("province", "ERROR"), ("district", "WARN")):
        a = regions.where(F.col("level") == kind).select("code").distinct()
        b = admin.where(F.col("kind") == kind).select("code").distinct()
        for x, y, where in ((a, b, "boundaries"), (b, a, "admin list")):
            only = x.subtract(y)
            if kind == "province":
                f = finding(only.withColumn("level", F.lit(kind)), "sync", F.format_string("province %s is only in the " + where, "code"), severity)
            else:  # one finding a side, with the first ten codes
                s = only.agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("code")), 1, 10).alias("first")).where("n > 0")
                f = finding(s.withColumn("level", F.lit(kind)), "sync", F.format_string("%d districts are only in the " + where + ": %s", "n", F.array_join("first", ", ")), severity)
            out = f if out is None else out.unionByName(f)
    return out


def landmarks(registry: RegionRegistry, places: tuple = LANDMARKS) -> DataFrame:
    """Places that do not lie in their province."""
    from .reverse import reverse

    points = registry.spark.createDataFrame([(n, la, lo, p) for n, la, lo, p in places], "place string, lat double, lng double, expected string")
    hit = F.col("province.code")
    missed = reverse(points, registry).where(~F.coalesce(hit.startswith(F.col("expected")), F.lit(False))).withColumn("code", hit)
    return finding(missed, "landmark", F.format_string("%s: expected province %s, found %s", "place", "expected", F.coalesce(hit, F.lit("none"))), "ERROR")


def version_record(version: DataFrame, regions: DataFrame) -> DataFrame:
    """Missing keys, and counts that differ from the tables."""
    keys = F.explode(F.filter(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED]), lambda k: k.isNotNull()))
    missing = finding(version.select(keys.alias("k")), "version", F.format_string("key %s is missing", "k"), "ERROR")
    stated = version.select(F.explode(F.create_map(*[x for key, kind in ADMIN_KINDS.items() for x in (F.lit(kind), F.col(f"counts.{key}"))])).alias("level", "stated"))
    n = stated.join(regions.groupBy("level").agg(F.count("*").alias("n")), "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = n.where("stated IS NOT NULL AND stated <> n")
    return missing.unionByName(finding(wrong, "version", F.format_string("%s: the record says %d, the data have %d", "level", "stated", "n"), "ERROR"))


def findings(registry: RegionRegistry, admin: DataFrame, version: DataFrame, bounds: dict = BOUNDS, places: tuple = LANDMARKS) -> DataFrame:
    """All checks of loaded tables."""
    r = registry.regions
    parts = [count_bounds(r, bounds), bad_codes(r), duplicate_codes(r), orphans(r), bad_geometry(r), uncovered_provinces(r), tree_sync(r, admin), landmarks(registry, places), version_record(version, r)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_files(spark: SparkSession, data_dir: str) -> list[str]:
    """Required files that the directory lacks, whatever store it is in."""
    jvm, lost = spark.sparkContext._jvm, []
    for name in (*GEOJSON_FILES.values(), ADMIN_FILE, VERSION_FILE):
        path = jvm.org.apache.hadoop.fs.Path(f"{data_dir}/{name}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            lost.append(name)
    return lost


def validate(spark: SparkSession, data_dir: str, bounds: dict = BOUNDS, places: tuple = LANDMARKS) -> DataFrame:
    """Findings of a data directory; missing or unreadable files end the checks. An empty collection is a matter of counts."""
    from ..sources import admin, geojson

    lost = [("files", f"{name} is missing", "ERROR", None, None) for name in missing_files(spark, data_dir)]
    if lost:
        return spark.createDataFrame(lost, FINDING)
    for level, name in GEOJSON_FILES.items():
        if not geojson.is_readable(spark, f"{data_dir}/{name}"):
            return spark.createDataFrame([("load", f"{name} cannot be read", "ERROR", level, None)], FINDING)
    registry = RegionRegistry(spark, data_dir)
    return findings(registry, admin.read_admin(spark, f"{data_dir}/{ADMIN_FILE}"), admin.read_version(spark, f"{data_dir}/{VERSION_FILE}"), bounds, places)


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").count()


def require_clean(found: DataFrame) -> None:
    """Raise if there is any ERROR."""
    n = found.where("severity = 'ERROR'").count()
    if n:
        raise ValueError(f"{n} errors in the region data")


