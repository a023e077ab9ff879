"""Code chains and the region tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import adcode
from ..plans.registry import RegionRegistry
from ..schema import LEVELS


def lookup(codes: DataFrame, registry: RegionRegistry | None = None, regions: DataFrame | None = None) -> DataFrame:
    """``codes`` (code, any others) with structs province, city and district of its chain.

    A chain may be partial; a malformed or wholly unknown code has nulls.
    ``regions`` (level, code, name), one row each, may stand in for a registry; it
    may be large, so Spark picks the joins.
    """
    known = registry.by_code() if regions is None else regions
    fields = [F.col(c) for c in ("name", "code", "level", "rep_lat", "rep_lng") if c in known.columns]
    c = F.col("code")
    level = adcode.level(c)
    merged = adcode.is_merged(c)
    want = {
        "province": F.when(level.isNotNull(), adcode.province_code(c)),
        "city": F.when((level != "province") & ~merged, adcode.city_code(c)),
        "district": F.when(level == "district", c),
    }
    out = codes
    for x in LEVELS:
        side = known.where(F.col("level") == x).select(F.col("code").alias(f"_{x}"), F.struct(*fields).alias(x))
        out = out.withColumn(f"_{x}", want[x]).join(side if registry is None else registry.hint(side), f"_{x}", "left").drop(f"_{x}")
    as_city = F.col("province").withField("level", F.lit("city"))
    return out.withColumn("city", F.when((level != "province") & merged, as_city).otherwise(F.col("city")))


def group_by_prefix(pairs: DataFrame, length: int) -> DataFrame:
    """(prefix, members): (code, name) pairs by code prefix, sorted."""
    return pairs.groupBy(adcode.prefix(F.col("code"), length).alias("prefix")).agg(F.sort_array(F.collect_list(F.struct("code", "name"))).alias("members"))


def tree_edges(admin: DataFrame) -> DataFrame:
    """(parent, parent_kind, code, name, kind): who hangs below whom in the tree.

    Cities of ordinary provinces by two digits; districts by four digits to every
    city that has them, or by two digits to a merged province's one city node.
    """
    one = lambda kind: admin.where(F.col("kind") == kind)
    code = F.col("code")
    top = one("province").groupBy("code").agg(F.max_by("name", "pos").alias("name"))
    city = one("city").where(~adcode.is_merged(code)).select("code", "name", adcode.province_code(code).alias("parent"))
    city = city.join(top.select(F.col("code").alias("parent")), "parent")
    merged = top.where(adcode.is_merged(code)).select("code", "name", code.alias("parent"))
    d = one("district").select("code", "name")
    ordinary = d.where(~adcode.is_merged(code)).withColumn("p4", adcode.prefix(code, 4))
    under_city = ordinary.join(city.select(F.col("code").alias("parent"), adcode.prefix(code, 4).alias("p4")).distinct(), "p4")
    under_merged = d.where(adcode.is_merged(code)).withColumn("parent", adcode.province_code(code))
    under_merged = under_merged.join(merged.select("parent").distinct(), "parent")
    cols = ["parent", "parent_kind", "code", "name", "kind"]
    label = lambda df, p, k: df.withColumn("parent_kind", F.lit(p)).withColumn("kind", F.lit(k)).select(*cols)
    roots = top.withColumn("parent", F.lit(None).cast("string"))
    return (
        label(roots, "root", "province")
        .unionByName(label(city.unionByName(merged.select(city.columns)), "province", "city"))
        .unionByName(label(under_city.select("parent", "code", "name").unionByName(under_merged.select("parent", "code", "name")), "city", "district"))
    )


def tree(admin: DataFrame) -> DataFrame:
    """One row a province, by value: value, label, children (cities with districts; leaves have no children field)."""
    e = tree_edges(admin)
    leaf = F.sort_array(F.collect_list(F.struct(F.col("code").alias("value"), F.col("name").alias("label"))))
    below = e.where("kind = 'district'").groupBy(F.col("parent").alias("city")).agg(leaf.alias("children"))
    city = e.where("kind = 'city'").join(below, F.col("code") == F.col("city"), "left")
    empty = F.array().cast("array<struct<value:string,label:string>>")
    node = F.struct(F.col("code").alias("value"), F.col("name").alias("label"), F.coalesce("children", empty).alias("children"))
    cities = city.groupBy(F.col("parent").alias("province")).agg(F.sort_array(F.collect_list(node)).alias("children"))
    p = e.where("kind = 'province'").select(F.col("code").alias("value"), F.col("name").alias("label"))
    none = F.array().cast("array<struct<value:string,label:string,children:array<struct<value:string,label:string>>>>")
    return p.join(cities, F.col("value") == F.col("province"), "left").select("value", "label", F.coalesce("children", none).alias("children")).orderBy("value")
