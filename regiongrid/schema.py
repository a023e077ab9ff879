"""Types and fixed values of the region model."""

from __future__ import annotations

LEVELS = ("province", "city", "district")
#: Prefixes of the provinces without a city layer.
MERGED_PREFIXES = ("11", "12", "31", "50", "81", "82")
#: Fixed value: the province without sub-levels.
NO_SUBLEVEL_PREFIX = "71"
GEOJSON_FILES = {level: f"china_{level}.geojson" for level in LEVELS}
ADMIN_FILE, VERSION_FILE = "china_admin.json", "DATA_VERSION.json"
ADMIN_KINDS = {"provinces": "province", "cities": "city", "districts": "district"}
POLYGONS = "array<array<array<array<double>>>>"
PROPERTIES = "name string, adcode string, center array<double>, centroid array<double>, level string, childrenNum int"
GEOJSON = f"type string, features array<struct<type: string, properties: struct<{PROPERTIES.replace(' ', ': ').replace(',: ', ', ')}>, geometry: struct<type: string, coordinates: string>>>"
ADMIN = "provinces array<array<string>>, cities array<array<string>>, districts array<array<string>>"
VERSION = "source string, source_url string, api_base string, fetched_at string, original_crs string, converted_crs string, counts struct<provinces: bigint, cities: bigint, districts: bigint>, notes string"
REGION = "struct<name: string, code: string, level: string, latitude: double, longitude: double>"
FINDING = "category string, message string, severity string, level string, code string"
