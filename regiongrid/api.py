"""Scalar calls over a registry: records in, records out, errors raised here.

Single calls are answered by a copy of the region table on the driver, if it is small
(``local``), and by the Spark plans otherwise; batches always by the plans. ``use``
names the session and data of the module-level calls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.point import (
    bd09_to_gcj02,
    bd09_to_wgs84,
    distance,
    gcj02_to_bd09,
    gcj02_to_wgs84,
    wgs84_to_bd09,
    wgs84_to_gcj02,
)
from .local import LocalRegions
from .operators import hierarchy, reverse as _reverse, search as _search
from .plans.registry import RegionRegistry
from .schema import LEVELS
from .sources.admin import read_admin

__all__ = [
    "Region", "RegionTool", "ReverseResult", "bd09_to_gcj02", "bd09_to_wgs84", "distance", "gcj02_to_bd09", "gcj02_to_wgs84",
    "get_administrative_tree", "get_region", "is_in_china", "is_in_region", "list_regions", "lookup_adcode", "reverse",
    "reverse_batch", "search", "use", "wgs84_to_bd09", "wgs84_to_gcj02",
]


@dataclass(frozen=True)
class Region:
    name: str
    code: str
    level: str
    latitude: float | None = None
    longitude: float | None = None


@dataclass(frozen=True)
class ReverseResult:
    province: Region | None = None
    city: Region | None = None
    district: Region | None = None


def _region(row: Row | None) -> Region | None:
    return None if row is None else Region(*(row[k] for k in ("name", "code", "level", "latitude", "longitude")))


def _plain(row: Row | dict | None) -> Region | None:
    r = lambda x: None if x is None else round(x, 6)
    return None if row is None else Region(row["name"], row["code"], row["level"], r(row["rep_lat"]), r(row["rep_lng"]))


class RegionTool:
    """All lookups of one data directory or region frame; ``local=False`` keeps single calls on Spark."""

    def __init__(self, spark: SparkSession, data_dir: str | None = None, regions: DataFrame | None = None, local: bool = True):
        self.spark, self.data_dir = spark, data_dir
        self.registry = RegionRegistry(spark, data_dir, regions)
        self.local = LocalRegions.of(self.registry) if local else None
        self._tree: list[dict] | None = None

    def reverse_batch(self, coords: list[tuple[float, float]]) -> list[ReverseResult]:
        """One result for each (lat, lng), in order."""
        if not coords:
            return []
        rows = [(i, float(lat), float(lng)) for i, (lat, lng) in enumerate(coords)]
        points = self.spark.createDataFrame(rows, "point_id long, lat double, lng double")
        found = _reverse.reverse(points, self.registry).orderBy("point_id").collect()
        return [ReverseResult(*(_region(r[x]) for x in LEVELS)) for r in found]

    def reverse(self, lat: float, lng: float) -> ReverseResult:
        if self.local:
            return ReverseResult(*map(_plain, self.local.reverse(float(lat), float(lng))))
        return self.reverse_batch([(lat, lng)])[0]

    def search(self, query: str, *, level: str | None = None, province: str | None = None, city: str | None = None, fuzzy: bool = True) -> list[Region]:
        if self.local:
            return [_plain(r) for r in self.local.search(query, level, province, city, fuzzy)]
        return [_plain(r) for r in _search.search(self.registry, query, level, province, city, fuzzy).collect()]

    def list_regions(self, level: str) -> list[Region]:
        if self.local and level in LEVELS:
            return [_plain(r) for r in self.local.rows[level]]
        return [_plain(r) for r in self.registry.list_regions(level).collect()]

    def get_region(self, code: str) -> Region | None:
        if self.local:
            return _plain(self.local.get(code))
        row = self.registry.get_regions(self.spark.createDataFrame([(code,)], "code string")).first()
        return None if row["level"] is None else _plain(row)

    def lookup_adcode(self, code: str) -> ReverseResult | None:
        if self.local:
            found = [_plain(r) for r in self.local.lookup(code)]
        else:
            row = hierarchy.lookup(self.spark.createDataFrame([(code,)], "code string"), self.registry).first()
            found = [_plain(row[x]) for x in LEVELS]
        return ReverseResult(*found) if any(found) else None

    def is_in_china(self, lat: float, lng: float) -> bool:
        if self.local:
            return any(x == "province" for x, _ in self.local.hits(float(lat), float(lng)))
        points = self.spark.createDataFrame([(float(lat), float(lng))], "lat double, lng double")
        return _reverse.in_country(points, self.registry).first()["in_country"]

    def is_in_region(self, lat: float, lng: float, code: str) -> bool:
        """Raises ``ValueError`` for a malformed or unknown code."""
        if self.local:
            return self.local.resolve(code) in self.local.hits(float(lat), float(lng))
        points = self.spark.createDataFrame([(float(lat), float(lng), code)], "lat double, lng double, code string")
        row = _reverse.in_region(points, self.registry).first()
        if row["error"]:
            raise ValueError(f"{row['error']}: {code}")
        return row["in_region"]

    def get_administrative_tree(self) -> list[dict]:
        """The nested tree; the same object on every call."""
        if self._tree is None:
            if self.data_dir:
                admin = read_admin(self.spark, f"{self.data_dir}/china_admin.json")
            else:
                admin = self.registry.names.select(F.col("level").alias("kind"), "pos", "code", "name")
            self._tree = [r.asDict(recursive=True) for r in hierarchy.tree(admin).collect()]
        return self._tree


_default: list[tuple[SparkSession, str]] = []
_tools: dict[tuple[str, str], RegionTool] = {}


def use(spark: SparkSession, data_dir: str) -> None:
    """Session and data directory of the calls below."""
    _default[:] = [(spark, data_dir)]


def _tool() -> RegionTool:
    """The tool of the session and directory in use, made at the first call."""
    if not _default:
        raise RuntimeError("call use(spark, data_dir) first")
    spark, data_dir = _default[0]
    key = (spark.sparkContext.applicationId, data_dir)
    if key not in _tools:
        _tools[key] = RegionTool(spark, data_dir)
    return _tools[key]


def reverse(lat: float, lng: float) -> ReverseResult:
    return _tool().reverse(lat, lng)


def reverse_batch(coords: list[tuple[float, float]]) -> list[ReverseResult]:
    return _tool().reverse_batch(coords)


def search(query: str, **options) -> list[Region]:
    return _tool().search(query, **options)


def list_regions(level: str) -> list[Region]:
    return _tool().list_regions(level)


def get_region(code: str) -> Region | None:
    return _tool().get_region(code)


def lookup_adcode(code: str) -> ReverseResult | None:
    return _tool().lookup_adcode(code)


def is_in_china(lat: float, lng: float) -> bool:
    return _tool().is_in_china(lat, lng)


def is_in_region(lat: float, lng: float, code: str) -> bool:
    return _tool().is_in_region(lat, lng, code)


def get_administrative_tree() -> list[dict]:
    return _tool().get_administrative_tree()
