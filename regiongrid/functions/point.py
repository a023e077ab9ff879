"""The transformations of ``crs`` and the distance for one point, without a Spark job."""

from __future__ import annotations

from math import asin, atan2, cos, hypot, pi, radians, sin, sqrt

# Parameters and terms (amplitude, period) of the published GCJ-02 and BD-09 transformations.
AXIS, ECCENTRICITY, ORIGIN = 6378245.0, 0.00669342162296594323, (105.0, 35.0)
BOX = (72.004, 137.8347), (0.8293, 55.8271)
SHARED = ((20.0, 1 / 3), (20.0, 1.0))
OWN_LNG = ((20.0, 2.0), (40.0, 6.0), (150.0, 24.0), (300.0, 60.0))
OWN_LAT = ((20.0, 2.0), (40.0, 6.0), (160.0, 24.0), (320.0, 60.0))
BD_TURN, BD_SHIFT = 3000.0 * pi / 180.0, (0.0065, 0.006)
EARTH_KM = 6371.0


def in_box(lng: float, lat: float) -> bool:
    return all(low < v < high for v, (low, high) in zip((lng, lat), BOX, strict=True))


def _waves(v: float, terms: tuple) -> float:
    return sum(a * sin(2 * pi * v / period) for a, period in terms) * 2 / 3


def shift(lng: float, lat: float) -> tuple[float, float]:
    """(east, north) shift of GCJ-02 in degrees."""
    x, y = lng - ORIGIN[0], lat - ORIGIN[1]
    root, both = sqrt(abs(x)), _waves(x, SHARED)
    east = 300 + x + 2 * y + (x * x + x * y + root) / 10 + both + _waves(x, OWN_LNG)
    north = -100 + 2 * x + 3 * y + y * y / 5 + x * y / 10 + root / 5 + both + _waves(y, OWN_LAT)
    w = 1 - ECCENTRICITY * sin(radians(lat)) ** 2
    return east * 180 * sqrt(w) / (AXIS * cos(radians(lat)) * pi), north * 180 * w * sqrt(w) / (AXIS * (1 - ECCENTRICITY) * pi)


def wgs84_to_gcj02(lng: float, lat: float) -> tuple[float, float]:
    east, north = shift(lng, lat) if in_box(lng, lat) else (0.0, 0.0)
    return lng + east, lat + north


def gcj02_to_wgs84(lng: float, lat: float) -> tuple[float, float]:
    east, north = shift(lng, lat) if in_box(lng, lat) else (0.0, 0.0)
    return lng - east, lat - north


def _polar(x: float, y: float, sign: int) -> tuple[float, float]:
    r = hypot(x, y) + sign * 0.00002 * sin(y * BD_TURN)
    angle = atan2(y, x) + sign * 0.000003 * cos(x * BD_TURN)
    return r * cos(angle), r * sin(angle)


def gcj02_to_bd09(lng: float, lat: float) -> tuple[float, float]:
    x, y = _polar(lng, lat, 1)
    return x + BD_SHIFT[0], y + BD_SHIFT[1]


def bd09_to_gcj02(lng: float, lat: float) -> tuple[float, float]:
    return _polar(lng - BD_SHIFT[0], lat - BD_SHIFT[1], -1)


def wgs84_to_bd09(lng: float, lat: float) -> tuple[float, float]:
    return gcj02_to_bd09(*wgs84_to_gcj02(lng, lat))


def bd09_to_wgs84(lng: float, lat: float) -> tuple[float, float]:
    return gcj02_to_wgs84(*bd09_to_gcj02(lng, lat))


def distance(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """Great-circle distance in km."""
    a = sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_KM * asin(sqrt(min(1.0, a)))
