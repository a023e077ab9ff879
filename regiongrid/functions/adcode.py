"""Six-digit region codes: two digits province, four city, six district."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MERGED_PREFIXES


def is_digits(c: Column) -> Column:
    """All ASCII digits and at least one."""
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def is_code(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{6}$"), F.lit(False))


def level(c: Column) -> Column:
    """province, city or district by the suffix; null if malformed."""
    return (
        F.when(~is_code(c), F.lit(None).cast("string"))
        .when(c.endswith("0000"), "province")
        .when(c.endswith("00"), "city")
        .otherwise("district")
    )


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def province_code(c: Column) -> Column:
    return F.concat(prefix(c, 2), F.lit("0000"))


def city_code(c: Column) -> Column:
    return F.concat(prefix(c, 4), F.lit("00"))


def is_merged(c: Column) -> Column:
    """The province has no city layer."""
    return prefix(c, 2).isin(*MERGED_PREFIXES)


def to_gb(c: Column) -> Column:
    """The older nine-digit code."""
    return F.when(is_code(c), F.concat(F.lit("156"), c)).otherwise(c)


def from_gb(c: Column) -> Column:
    return F.regexp_replace(c, r"^156(?=[0-9]{6}$)", "")


def path_level(path: Column) -> Column:
    """Level of a comma path such as country,province,city,district."""
    n = F.size(F.split(path, ",", -1))
    return F.when(n == 2, "province").when(n == 3, "city").when(n >= 4, "district")


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, ",", -1), -1)
