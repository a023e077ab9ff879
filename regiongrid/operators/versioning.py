"""Differences between two versions of the admin list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LEVELS

KEY = ("kind", "code", "name")


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, code, name) only in ``new``; a renamed entry is one added and one removed."""
    return new.select(*KEY).subtract(old.select(*KEY))


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return added(new, old)


def count_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind, n_before, n_after, diff and change (+n, -n or a dash)."""
    kinds = old.sparkSession.createDataFrame([(x,) for x in LEVELS], "kind string")
    a, b = (d.groupBy("kind").agg(F.count("*").alias(n)) for d, n in ((old, "n_before"), (new, "n_after")))
    n = kinds.join(a, "kind", "left").join(b, "kind", "left").na.fill(0, ["n_before", "n_after"])
    n = n.withColumn("diff", F.col("n_after") - F.col("n_before"))
    return n.withColumn("change", F.when(F.col("diff") == 0, "—").otherwise(F.format_string("%+d", "diff")))


def report(old: DataFrame, new: DataFrame, old_version: str = "?", new_version: str = "?") -> str:
    """The differences as Markdown. Admin lists have a few thousand entries."""
    lines = [f"# Region data: {old_version} to {new_version}", "", "| level | before | after | change |", "|---|---|---|---|"]
    lines += [f"| {r['kind']} | {r['n_before']} | {r['n_after']} | {r['change']} |" for r in sorted(count_changes(old, new).collect(), key=lambda r: LEVELS.index(r["kind"]))]
    for title, rows in (("Added", added(old, new)), ("Removed", removed(old, new))):
        found = rows.orderBy(*KEY).collect()
        lines += ["", f"## {title} ({len(found)})", ""] + [f"- {r['kind']} {r['code']} {r['name']}" for r in found]
    return "\n".join(lines) + "\n"
