"""Forward search by code, name or pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import RegionRegistry
from ..schema import LEVELS
from .reverse import locate


def _within(hits: DataFrame, registry: RegionRegistry, level: str, parent: str) -> DataFrame:
    """Hits whose rounded representative point is in one region of ``level``: by code if all digits, else the first of the name.

    Points meet the cells of that region only.
    """
    if re.fullmatch("[0-9]+", parent):
        row = registry.by_code().where((F.col("level") == level) & (F.col("code") == parent)).select("shape")
    else:
        row = registry.names.where((F.col("level") == level) & (F.col("name") == parent)).agg(F.min_by("shape", "pos").alias("shape"))
    one = registry.shapes.where(F.col("level") == level).join(F.broadcast(row), "shape").select(F.col("pos").alias("_pos"))
    own = registry.index.select("cx", "cy", F.explode("candidates").alias("c")).where(F.col("c.level") == level).join(F.broadcast(one), F.col("c.pos") == F.col("_pos"))
    own = own.groupBy("cx", "cy").agg(F.collect_list("c").alias("candidates"))
    points = hits.withColumn("lat", F.round("rep_lat", 6)).withColumn("lng", F.round("rep_lng", 6))
    return locate(points, registry, own).where(F.size("_hits") > 0).drop("_hits", "lat", "lng")


def search(registry: RegionRegistry, query: str, level: str | None = None, province: str | None = None, city: str | None = None, fuzzy: bool = True) -> DataFrame:
    """Regions that match, by level and file order.

    All digits: the code. Otherwise the exact name; in a level without an exact
    hit, names that the query, a regular expression, is found in. Parents filter
    by place. An empty ``level`` means all; an unknown one raises ``KeyError``.
    """
    if level and level not in LEVELS:
        raise KeyError(level)
    levels = [level] if level else list(LEVELS)
    if re.fullmatch("[0-9]+", query):
        hits = registry.by_code().where(F.col("level").isin(levels) & (F.col("code") == query))
    else:
        r = registry.names.where(F.col("level").isin(levels))
        exact = r.where(F.col("name") == query)
        hits = exact
        if fuzzy:
            rest = r.join(F.broadcast(exact.select("level").distinct()), "level", "left_anti")
            hits = exact.unionByName(rest.where(F.coalesce(F.col("name").rlike(query), F.lit(False))).select(exact.columns))
    for parent_level, parent in (("province", province), ("city", city)):
        if parent:
            hits = _within(hits, registry, parent_level, parent)
    return hits.orderBy("level_ord", "pos")


#: No pattern: only the letters themselves match. What is special in regular expressions.
_PLAIN = r"^[^\\.\[\](){}*+?^$|]+$"


def _grams(text: str, size: int) -> Column:
    """The runs of ``size`` characters in a text."""
    last = F.length(text) - size + 1
    none = F.array().cast("array<string>")
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(F.col(text), i, F.lit(size)))).otherwise(none)


def search_many(registry: RegionRegistry, queries: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``queries`` (query_id, query) with their hits: the batch form, without parents.

    Codes and names are equi-joins. Of the other queries, plain texts meet only the
    names that hold their rarest three characters, by an equi-join; regular expressions
    meet each name. A query that is no regular expression has one row without a
    region and with an ``error``; it fails nothing else.
    """
    q = queries.select("query_id", "query", F.coalesce(F.col("query").rlike("^[0-9]+$"), F.lit(False)).alias("digits"))
    cols = ["level", "level_ord", "pos", "code", "name"]
    names = registry.names.select(*cols)
    code = q.where("digits").join(registry.hint(registry.by_code().select(*cols)), F.col("query") == F.col("code"))
    name = q.where("NOT digits").join(registry.hint(names), F.col("query") == F.col("name"))
    hits = code.unionByName(name)
    error = F.lit(None).cast("string")
    if not fuzzy:
        return hits.drop("digits").withColumn("error", error)
    done = name.select("query_id", "level").distinct()
    open_ = q.where("NOT digits")
    plain = open_.where(F.col("query").rlike(_PLAIN))
    grams = names.withColumn("_gram", F.explode(F.array_distinct(F.concat(*[_grams("name", k) for k in (1, 2, 3)]))))
    often = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    keys = F.when(F.length("query") >= 3, _grams("query", 3)).otherwise(F.array("query"))
    keyed = plain.select("query").distinct().withColumn("_gram", F.explode(keys)).join(often, "_gram")
    keyed = keyed.groupBy("query").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    loose = plain.join(keyed, "query").join(grams, "_gram").where(F.col("name").contains(F.col("query"))).select(*plain.columns, *cols)
    pattern = open_.where(~F.col("query").rlike(_PLAIN)).withColumn("_ok", F.expr("try_reflect('java.util.regex.Pattern', 'matches', query, '')").isNotNull())
    loose = loose.unionByName(pattern.where("_ok").drop("_ok").join(registry.hint(names), F.expr("coalesce(rlike(name, query), false)")))
    hits = hits.unionByName(loose.join(done, ["query_id", "level"], "left_anti").select(name.columns))
    bad = pattern.where("NOT _ok").drop("_ok").select("*", *[F.lit(None).cast(names.schema[c].dataType).alias(c) for c in cols])
    return hits.withColumn("error", error).unionByName(bad.withColumn("error", F.lit("not a regular expression"))).drop("digits")
