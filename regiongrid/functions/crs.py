"""Coordinate systems and distance as SQL expressions over column names.

Every function returns expression text that Spark (``F.expr``) and other SQL
engines evaluate alike; ``column`` makes a Column of it. Arguments of the CRS
functions are ``(lng, lat)``, those of ``distance`` are ``(lat1, lng1, lat2, lng2)``.
Literals carry an exponent, as plain decimals are exact numerics in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the published GCJ-02 and BD-09 transformations.
AXIS, ECCENTRICITY = "6378245.0e0", "0.00669342162296594323e0"
ORIGIN_LNG, ORIGIN_LAT = "105.0e0", "35.0e0"
PI, BD_PI = "3.14159265358979323846e0", "(3.14159265358979323846e0 * 3000.0e0 / 180.0e0)"
WEST, EAST, SOUTH, NORTH = "72.004e0", "137.8347e0", "0.8293e0", "55.8271e0"
EARTH_KM = "6371.0e0"


def column(text: str) -> Column:
    return F.expr(text)


def in_box(lng: str, lat: str) -> str:
    """Strictly inside the country's box; NaN and null are outside."""
    inside = f"({lng} > {WEST} AND {lng} < {EAST} AND {lat} > {SOUTH} AND {lat} < {NORTH})"
    return f"coalesce({inside}, false)"


def _waves(terms: list[tuple[str, str, str]]) -> str:
    """Sum of amplitude * sin(variable * pi / divisor), scaled by two thirds."""
    return "(" + " + ".join(f"{a} * sin({v} * {PI} * {d})" for a, v, d in terms) + ") * 2.0e0 / 3.0e0"


def _third(n: str) -> str:
    return f"(1.0e0 / {n})"


def _offset_lat(x: str, y: str) -> str:
    return (
        f"(-100.0e0 + 2.0e0 * {x} + 3.0e0 * {y} + 0.2e0 * {y} * {y} + 0.1e0 * {x} * {y} + 0.2e0 * sqrt(abs({x}))"
        f" + {_waves([('20.0e0', x, '6.0e0'), ('20.0e0', x, '2.0e0')])}"
        f" + {_waves([('20.0e0', y, '1.0e0'), ('40.0e0', y, _third('3.0e0'))])}"
        f" + {_waves([('160.0e0', y, _third('12.0e0')), ('320.0e0', y, _third('30.0e0'))])})"
    )


def _offset_lng(x: str, y: str) -> str:
    return (
        f"(300.0e0 + {x} + 2.0e0 * {y} + 0.1e0 * {x} * {x} + 0.1e0 * {x} * {y} + 0.1e0 * sqrt(abs({x}))"
        f" + {_waves([('20.0e0', x, '6.0e0'), ('20.0e0', x, '2.0e0')])}"
        f" + {_waves([('20.0e0', x, '1.0e0'), ('40.0e0', x, _third('3.0e0'))])}"
        f" + {_waves([('150.0e0', x, _third('12.0e0')), ('300.0e0', x, _third('30.0e0'))])})"
    )


def gcj_shift(lng: str, lat: str) -> tuple[str, str]:
    """(east, north) shift of GCJ-02 in degrees."""
    x, y = f"({lng} - {ORIGIN_LNG})", f"({lat} - {ORIGIN_LAT})"
    sine = f"sin({lat} * {PI} / 180.0e0)"
    w = f"(1.0e0 - {ECCENTRICITY} * {sine} * {sine})"
    meridian = f"({AXIS} * (1.0e0 - {ECCENTRICITY}) / ({w} * sqrt({w})))"
    parallel = f"({AXIS} / sqrt({w}) * cos({lat} * {PI} / 180.0e0))"
    return f"({_offset_lng(x, y)} * 180.0e0 / ({parallel} * {PI}))", f"({_offset_lat(x, y)} * 180.0e0 / ({meridian} * {PI}))"


def _shifted(lng: str, lat: str, sign: str) -> tuple[str, str]:
    east, north = gcj_shift(lng, lat)
    inside = in_box(lng, lat)
    return tuple(f"(CASE WHEN {inside} THEN {v} {sign} {d} ELSE {v} END)" for v, d in ((lng, east), (lat, north)))


def wgs84_to_gcj02(lng: str, lat: str) -> tuple[str, str]:
    return _shifted(lng, lat, "+")


def gcj02_to_wgs84(lng: str, lat: str) -> tuple[str, str]:
    """One step of subtraction: close to, not exactly, the inverse."""
    return _shifted(lng, lat, "-")


def gcj02_to_bd09(lng: str, lat: str) -> tuple[str, str]:
    """Applies everywhere, without the box."""
    r = f"(sqrt({lng} * {lng} + {lat} * {lat}) + 0.00002e0 * sin({lat} * {BD_PI}))"
    angle = f"(atan2({lat}, {lng}) + 0.000003e0 * cos({lng} * {BD_PI}))"
    return f"({r} * cos({angle}) + 0.0065e0)", f"({r} * sin({angle}) + 0.006e0)"


def bd09_to_gcj02(lng: str, lat: str) -> tuple[str, str]:
    x, y = f"({lng} - 0.0065e0)", f"({lat} - 0.006e0)"
    r = f"(sqrt({x} * {x} + {y} * {y}) - 0.00002e0 * sin({y} * {BD_PI}))"
    angle = f"(atan2({y}, {x}) - 0.000003e0 * cos({x} * {BD_PI}))"
    return f"({r} * cos({angle}))", f"({r} * sin({angle}))"


def wgs84_to_bd09(lng: str, lat: str) -> tuple[str, str]:
    return gcj02_to_bd09(*wgs84_to_gcj02(lng, lat))


def bd09_to_wgs84(lng: str, lat: str) -> tuple[str, str]:
    return gcj02_to_wgs84(*bd09_to_gcj02(lng, lat))


def etl_gcj02_to_wgs84(lng: str, lat: str) -> tuple[str, str]:
    """The ingestion variant: no box, rounded to six places."""
    east, north = gcj_shift(lng, lat)
    return f"round({lng} - {east}, 6)", f"round({lat} - {north}, 6)"


def distance(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Great-circle distance in km by the haversine formula."""
    dlat = f"sin(radians({lat2} - {lat1}) / 2.0e0)"
    dlng = f"sin(radians({lng2} - {lng1}) / 2.0e0)"
    a = f"({dlat} * {dlat} + cos(radians({lat1})) * cos(radians({lat2})) * {dlng} * {dlng})"
    return f"({EARTH_KM} * 2.0e0 * atan2(sqrt({a}), sqrt(greatest(0.0e0, 1.0e0 - {a}))))"


TRANSFORMS = {
    f.__name__: f
    for f in (wgs84_to_gcj02, gcj02_to_wgs84, gcj02_to_bd09, bd09_to_gcj02, wgs84_to_bd09, bd09_to_wgs84, etl_gcj02_to_wgs84)
}


def register(spark) -> None:
    """SQL functions of the transformations: ``wgs84_to_gcj02_lng(lng, lat)`` and so on."""
    for name, f in TRANSFORMS.items():
        for axis, text in zip(("lng", "lat"), f("lng", "lat"), strict=True):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{axis}(lng DOUBLE, lat DOUBLE) RETURNS DOUBLE RETURN {text}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE) "
        f"RETURNS DOUBLE RETURN {distance('lat1', 'lng1', 'lat2', 'lng2')}"
    )
