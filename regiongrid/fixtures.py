"""A small synthetic country on whole degrees, with the cases that matter.

A municipality without a city row, a three-level chain, one district name twice,
a province only, a special region in a hole, a childless city stored as district,
sibling codes of four equal digits, two parts, overlap, a self-crossing ring and
a district that leaves its province.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import ADMIN_FILE, ADMIN_KINDS, GEOJSON_FILES, LEVELS, VERSION_FILE


def box(west: float, south: float, east: float, north: float) -> list[list[float]]:
    """A closed ring."""
    return [[west, south], [east, south], [east, north], [west, north], [west, south]]


REGIONS = (
    ("province", "110000", "北京市", [[box(115, 39, 118, 42)]]),
    ("province", "440000", "广东省", [[box(109, 20, 117, 26), box(113, 23, 114, 24)]]),
    ("province", "220000", "吉林省", [[box(121, 40, 126, 46)], [box(128, 42, 131, 45)]]),
    ("province", "710000", "台湾省", [[box(119, 21, 123, 26)]]),
    ("province", "810000", "香港特别行政区", [[box(113, 23, 114, 24)]]),
    ("province", "460000", "海南省", [[box(108, 18, 111, 20)]]),
    ("province", "650000", "新疆维吾尔自治区", [[[[74, 35], [96, 35], [74, 49], [96, 49], [74, 35]]]]),
    ("city", "440300", "深圳市", [[box(110, 21, 113, 23)]]),
    ("city", "220100", "长春市", [[box(122, 41, 125, 44)]]),
    ("city", "460400", "儋州市", [[box(108, 18, 110, 20)]]),
    ("city", "659001", "石河子市", [[box(80, 36, 84, 38)]]),
    ("city", "659002", "阿拉尔市", [[box(85, 36, 88, 38)]]),
    ("district", "110101", "东城区", [[box(116, 39, 117, 41)]]),
    ("district", "110105", "朝阳区", [[box(116, 40, 118, 42)]]),
    ("district", "110108", "海淀区", [[box(115, 41, 116, 42)]]),
    ("district", "440305", "南山区", [[box(110, 21, 112, 22)]]),
    ("district", "440306", "宝安区", [[box(112, 22, 119, 24)]]),
    ("district", "220104", "朝阳区", [[box(122, 41, 124, 43)]]),
    ("district", "810001", "中西区", [[box(113, 23, 114, 24)]]),
    ("district", "460400", "儋州市", [[box(108, 18, 110, 20)]]),
    ("district", "659001", "石河子市", [[box(80, 36, 84, 38)]]),
    ("district", "659002", "阿拉尔市", [[box(85, 36, 88, 38)]]),
)


def positioned() -> list[tuple[str, int, int, str, str, list]]:
    """(level, level_ord, pos, code, name, polygons); pos counts within a level."""
    seen = dict.fromkeys(LEVELS, 0)
    out = []
    for level, code, name, polygons in REGIONS:
        out.append((level, LEVELS.index(level), seen[level], code, name, [[[[float(x), float(y)] for x, y in ring] for ring in p] for p in polygons]))
        seen[level] += 1
    return out


def regions(spark: SparkSession, rows: list | None = None) -> DataFrame:
    """The regions as a frame; polygons go through JSON text, as from a file."""
    data = [(*r[:5], json.dumps(r[5])) for r in rows or positioned()]
    d = spark.createDataFrame(data, "level string, level_ord int, pos int, code string, name string, polygons string")
    return d.withColumn("polygons", F.from_json("polygons", "array<array<array<array<double>>>>"))


def edges() -> list[tuple[str, int, float, float, float, float]]:
    """(level, pos, x1, y1, x2, y2) of all rings."""
    return [(level, pos, *a, *b) for level, _, pos, _, _, polygons in positioned() for p in polygons for ring in p for a, b in zip(ring, ring[1:], strict=False)]


def admin() -> list[tuple[str, int, str, str]]:
    """(kind, pos, code, name) of the admin list."""
    return [(level, pos, code, name) for level, _, pos, code, name, _ in positioned()]


def write(folder: str) -> str:
    """The fixture as a data directory."""
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    counts = dict.fromkeys(ADMIN_KINDS, 0)
    for level, name in GEOJSON_FILES.items():
        features = []
        for lv, _, _, code, title, polygons in positioned():
            if lv == level:
                one = len(polygons) == 1
                geometry = {"type": "Polygon" if one else "MultiPolygon", "coordinates": polygons[0] if one else polygons}
                features.append({"type": "Feature", "properties": {"name": title, "adcode": code, "center": None, "centroid": None, "level": level, "childrenNum": 0}, "geometry": geometry})
        (top / name).write_text(json.dumps({"type": "FeatureCollection", "features": features}, ensure_ascii=False), encoding="utf-8")
        counts[next(k for k, v in ADMIN_KINDS.items() if v == level)] = len(features)
    lists = {key: [[c, n] for k, _, c, n in admin() if k == kind] for key, kind in ADMIN_KINDS.items()}
    (top / ADMIN_FILE).write_text(json.dumps(lists, ensure_ascii=False), encoding="utf-8")
    version = {"source": "synthetic", "source_url": "none", "api_base": "none", "fetched_at": "2026-01-01", "original_crs": "GCJ-02", "converted_crs": "WGS-84", "counts": counts, "notes": "fixture"}
    (top / VERSION_FILE).write_text(json.dumps(version, ensure_ascii=False), encoding="utf-8")
    return str(top)
