"""Registered queries of the region operators, with the same rows in plain SQL.

Points are derived from the event keys, codes and boxes from region, nation and
customer keys; the geometry queries run on the synthetic country of ``fixtures``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import adcode, crs
from ..operators import geometry, hierarchy, ingest, quality, reverse, search, versioning
from ..schema import LEVELS, MERGED_PREFIXES
from ..sources import admin as admin_source
from ..sources import geojson
from .registry import RegionRegistry

_registries: dict[str, RegionRegistry] = {}

POINTS_SQL = """SELECT event_id AS point_id,
  73.0e0 + ((event_id * 7919) % 62000) / 1000.0e0 AS lng, 18.0e0 + ((event_id * 104729) % 35000) / 1000.0e0 AS lat FROM events"""


def registry(spark: SparkSession) -> RegionRegistry:
    app = spark.sparkContext.applicationId
    if app not in _registries:
        _registries[app] = RegionRegistry(spark, regions=fixtures.regions(spark))
    return _registries[app]


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _view(spark, sf_dir, "events").select(
        e.alias("point_id"),
        (F.lit(73.0) + ((e * 7919) % 62000) / F.lit(1000.0)).alias("lng"),
        (F.lit(18.0) + ((e * 104729) % 35000) / F.lit(1000.0)).alias("lat"),
    )


PREFIXES = {0: "11", 1: "44", 2: "22", 3: "71", 4: "81"}
_PREFIX_SQL = "CASE r_regionkey " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PREFIXES.items()) + " END"
ADMIN_SQL = f"""SELECT 'province' AS kind, r_regionkey::BIGINT AS pos, {_PREFIX_SQL} || '0000' AS code, r_name AS name FROM region
UNION ALL SELECT 'city', n_nationkey::BIGINT, {_PREFIX_SQL} || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || '00', n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'district', c_custkey::BIGINT, {_PREFIX_SQL} || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || lpad((c_custkey % 99 + 1)::VARCHAR, 2, '0'), c_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, pos, code, name) derived from the keys; codes of districts repeat."""
    prefix = F.element_at(F.create_map(*[x for k, v in PREFIXES.items() for x in (F.lit(k), F.lit(v))]), F.col("r_regionkey"))
    r = _view(spark, sf_dir, "region").withColumn("p2", prefix)
    n = _view(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.withColumn("p4", F.concat("p2", F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")))
    c = _view(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))

    def rows(df: DataFrame, kind: str, pos: str, code, name: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(pos).cast("bigint").alias("pos"), code.alias("code"), F.col(name).alias("name"))

    return (
        rows(r, "province", "r_regionkey", F.concat("p2", F.lit("0000")), "r_name")
        .unionByName(rows(n, "city", "n_nationkey", F.concat("p4", F.lit("00")), "n_name"))
        .unionByName(rows(c, "district", "c_custkey", F.concat("p4", F.lpad((F.col("c_custkey") % 99 + 1).cast("string"), 2, "0")), "c_name"))
    )


def _values(rows: list[tuple], names: str) -> str:
    def text(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else repr(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names}))"


REGIONS_SQL = _values([r[:5] for r in fixtures.positioned()], "level, level_ord, pos, code, name")
EDGES_SQL = _values(fixtures.edges(), "level, pos, x1, y1, x2, y2")
MERGED_SQL = "(" + ", ".join(f"'{p}'" for p in MERGED_PREFIXES) + ")"

HITS_SQL = f"""SELECT point_id, level, pos FROM p JOIN {EDGES_SQL} e ON true GROUP BY point_id, level, pos
HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND ((lng - x1) * (y2 - y1) < (x2 - x1) * (lat - y1)) = (y2 > y1) THEN 1 ELSE 0 END) % 2 = 1
 AND max(CASE WHEN (x2 - x1) * (lat - y1) - (y2 - y1) * (lng - x1) = 0 AND lng BETWEEN least(x1, x2) AND greatest(x1, x2)
  AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0"""


def _reverse_sql(backfill: bool) -> str:
    joins, cols = [], []
    for x in LEVELS:
        joins.append(f"LEFT JOIN (SELECT point_id, min(pos) AS pos FROM h WHERE level = '{x}' GROUP BY 1) h_{x} ON h_{x}.point_id = p.point_id LEFT JOIN {REGIONS_SQL} r_{x} ON r_{x}.level = '{x}' AND r_{x}.pos = h_{x}.pos")
        for f in ("code", "name"):
            plain = f"r_{x}.{f}"
            fill = f"CASE WHEN r_city.code IS NULL AND substr(r_province.code, 1, 2) IN {MERGED_SQL} THEN r_province.{f} ELSE {plain} END"
            cols.append(f"{fill if backfill and x == 'city' else plain} AS {x}_{f}")
    return f"WITH p AS ({POINTS_SQL}), h AS ({HITS_SQL}) SELECT p.point_id, {', '.join(cols)} FROM p {' '.join(joins)}"


def reverse_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverse.flat(reverse.reverse(points(spark, sf_dir), registry(spark), backfill=False), "point_id")


def reverse_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverse.flat(reverse.reverse(points(spark, sf_dir), registry(spark)), "point_id")


def province_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reverse.flat(reverse.reverse(points(spark, sf_dir), registry(spark)), "point_id")
    return found.groupBy("province_code", "province_name").agg(F.count("*").alias("n_points"), F.count("district_code").alias("n_in_district"))


def in_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverse.in_country(points(spark, sf_dir), registry(spark)).select("point_id", "in_country")


_CODES = ("440000", "440300", "110100", "460400", "999999", "abc", "650000", "810001")


def in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in _CODES])
    p = points(spark, sf_dir).withColumn("code", F.get(codes, (F.col("point_id") % len(_CODES)).cast("int")))
    return reverse.in_region(p, registry(spark)).select("point_id", "code", "in_region", "error")


_CODE_SQL = "CASE point_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"
IN_REGION_SQL = f"""WITH p AS (SELECT *, {_CODE_SQL} AS code FROM ({POINTS_SQL})), h AS ({HITS_SQL}),
q AS (SELECT *, CASE WHEN NOT regexp_matches(code, '^[0-9]{{6}}$') THEN NULL WHEN code LIKE '%0000' THEN 'province'
  WHEN code LIKE '%00' AND substr(code, 1, 2) IN {MERGED_SQL} THEN 'province' WHEN code LIKE '%00' THEN 'city' ELSE 'district' END AS rl,
  CASE WHEN code LIKE '%00' AND substr(code, 1, 2) IN {MERGED_SQL} THEN substr(code, 1, 2) || '0000' ELSE code END AS rc FROM p),
k AS (SELECT level, code, max(pos) AS pos FROM {REGIONS_SQL} GROUP BY 1, 2)
SELECT q.point_id, q.code, CASE WHEN rl IS NOT NULL AND k.pos IS NOT NULL THEN h.point_id IS NOT NULL END AS in_region,
 CASE WHEN rl IS NULL THEN 'malformed code' WHEN k.pos IS NULL THEN 'unknown code' END AS error
FROM q LEFT JOIN k ON k.level = rl AND k.code = rc LEFT JOIN h ON h.point_id = q.point_id AND h.level = rl AND h.pos = k.pos"""


def _transform(name: str):
    lng, lat = crs.TRANSFORMS[name]("lng", "lat")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return points(spark, sf_dir).select("point_id", F.expr(f"round({lng}, 6)").alias("out_lng"), F.expr(f"round({lat}, 6)").alias("out_lat"))

    return query, f"SELECT point_id, round(lng, 6) AS out_lng, round(lat, 6) AS out_lat FROM ({_FORMULAS[name](POINTS_SQL)})"


def _gcj_sql(source: str, sign: str, boxed: bool = True) -> str:
    """The published GCJ-02 shift in steps, written apart from ``crs``."""
    inside = "lng > 72.004 AND lng < 137.8347 AND lat > 0.8293 AND lat < 55.8271" if boxed else "true"
    return f"""SELECT point_id, CASE WHEN {inside} THEN lng {sign} east ELSE lng END AS lng, CASE WHEN {inside} THEN lat {sign} north ELSE lat END AS lat FROM (
 SELECT point_id, lng, lat, dx * 180e0 / (6378245e0 / sqrt(m) * cos(radians(lat)) * pi()) AS east,
  dy * 180e0 / (6378245e0 * (1e0 - 0.00669342162296594323e0) / pow(m, 1.5e0) * pi()) AS north FROM (
  SELECT *, 300e0 + x + 2e0 * y + 0.1e0 * pow(x, 2) + 0.1e0 * x * y + 0.1e0 * sqrt(abs(x)) + fast
    + (2e0 / 3e0) * (20e0 * sin(x * pi()) + 40e0 * sin(x * pi() / 3e0) + 150e0 * sin(x * pi() / 12e0) + 300e0 * sin(x * pi() / 30e0)) AS dx,
   -100e0 + 2e0 * x + 3e0 * y + 0.2e0 * pow(y, 2) + 0.1e0 * x * y + 0.2e0 * sqrt(abs(x)) + fast
    + (2e0 / 3e0) * (20e0 * sin(y * pi()) + 40e0 * sin(y * pi() / 3e0) + 160e0 * sin(y * pi() / 12e0) + 320e0 * sin(y * pi() / 30e0)) AS dy FROM (
   SELECT point_id, lng, lat, lng - 105e0 AS x, lat - 35e0 AS y, 1e0 - 0.00669342162296594323e0 * pow(sin(radians(lat)), 2) AS m,
    (40e0 / 3e0) * (sin(6e0 * pi() * (lng - 105e0)) + sin(2e0 * pi() * (lng - 105e0))) AS fast FROM ({source}) AS s1) AS s2) AS s3) AS s4"""


def _bd_sql(source: str) -> str:
    return f"""SELECT point_id, r * cos(t) + 0.0065e0 AS lng, r * sin(t) + 0.006e0 AS lat FROM (
 SELECT point_id, sqrt(pow(lng, 2) + pow(lat, 2)) + 2e-5 * sin(lat * pi() * 50e0 / 3e0) AS r, atan2(lat, lng) + 3e-6 * cos(lng * pi() * 50e0 / 3e0) AS t FROM ({source}) AS b1) AS b2"""


def _from_bd_sql(source: str) -> str:
    return f"""SELECT point_id, r * cos(t) AS lng, r * sin(t) AS lat FROM (
 SELECT point_id, sqrt(pow(x, 2) + pow(y, 2)) - 2e-5 * sin(y * pi() * 50e0 / 3e0) AS r, atan2(y, x) - 3e-6 * cos(x * pi() * 50e0 / 3e0) AS t
 FROM (SELECT point_id, lng - 0.0065e0 AS x, lat - 0.006e0 AS y FROM ({source}) AS c1) AS c2) AS c3"""


_FORMULAS = {
    "wgs84_to_gcj02": lambda p: _gcj_sql(p, "+"),
    "gcj02_to_wgs84": lambda p: _gcj_sql(p, "-"),
    "gcj02_to_bd09": _bd_sql,
    "bd09_to_gcj02": _from_bd_sql,
    "wgs84_to_bd09": lambda p: _bd_sql(_gcj_sql(p, "+")),
    "bd09_to_wgs84": lambda p: _gcj_sql(_from_bd_sql(p), "-"),
    "etl_gcj02_to_wgs84": lambda p: _gcj_sql(p, "-", boxed=False),
}


def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("point_id", F.expr(f"round({crs.distance('lat', 'lng', '39.9e0', '116.4e0')}, 6)").alias("km"))


HAVERSINE_SQL = f"""SELECT point_id, round(12742e0 * asin(sqrt((1e0 - cos(radians(lat - 39.9e0))) / 2e0
 + cos(radians(39.9e0)) * cos(radians(lat)) * pow(sin(radians(lng - 116.4e0) / 2e0), 2))), 6) AS km FROM ({POINTS_SQL})"""


def country_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("point_id", F.expr(crs.in_box("lng + 10.0e0", "lat + 10.0e0")).alias("in_box"))


def adcode_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin(spark, sf_dir).select("kind", "pos", "code", adcode.level(F.col("code")).alias("level"))


LEVEL_SQL = "CASE WHEN NOT regexp_matches(code, '^[0-9]{6}$') THEN NULL WHEN code LIKE '%0000' THEN 'province' WHEN code LIKE '%00' THEN 'city' ELSE 'district' END"
LAST_SQL = "SELECT kind, code, arg_max(name, pos) AS name, max(pos) AS pos FROM a GROUP BY kind, code"


def code_index(a: DataFrame) -> DataFrame:
    """(kind, code, name, pos): the last of repeated codes."""
    return a.groupBy("kind", "code").agg(F.max_by("name", "pos").alias("name"), F.max("pos").alias("pos"))


def code_index_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_index(admin(spark, sf_dir))


def lookup_adcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = code_index(admin(spark, sf_dir)).withColumnRenamed("kind", "level").drop("pos")
    codes = admin(spark, sf_dir).select("kind", "pos", "code")
    return reverse.flat(hierarchy.lookup(codes, regions=known), "kind", "pos", "code")


def _lookup_sql() -> str:
    lv = f"({LEVEL_SQL})"
    keys = {
        "province": f"CASE WHEN {lv} IS NOT NULL THEN substr(a.code, 1, 2) || '0000' END",
        "city": f"CASE WHEN {lv} <> 'province' AND substr(a.code, 1, 2) NOT IN {MERGED_SQL} THEN substr(a.code, 1, 4) || '00' END",
        "district": f"CASE WHEN {lv} = 'district' THEN a.code END",
    }
    keys = {k: v.replace("matches(code", "matches(a.code").replace("WHEN code", "WHEN a.code") for k, v in keys.items()}
    joins = " ".join(f"LEFT JOIN k k_{x} ON k_{x}.kind = '{x}' AND k_{x}.code = {keys[x]}" for x in LEVELS)
    merged = f"substr(a.code, 1, 2) IN {MERGED_SQL} AND {lv} <> 'province'".replace("matches(code", "matches(a.code").replace("WHEN code", "WHEN a.code")
    cols = []
    for x in LEVELS:
        for f in ("code", "name"):
            cols.append(f"CASE WHEN {merged} THEN k_province.{f} ELSE k_city.{f} END AS city_{f}" if x == "city" else f"k_{x}.{f} AS {x}_{f}")
    return f"WITH a AS ({ADMIN_SQL}), k AS ({LAST_SQL}) SELECT a.kind, a.pos, a.code, {', '.join(cols)} FROM a {joins}"


#: Boxes on binary fractions: a province a region, a strip of it a nation, a square of that a customer.
DERIVED_SQL = f"""SELECT 'province' AS level, 0 AS level_ord, r_regionkey::INTEGER AS pos, {_PREFIX_SQL} || '0000' AS code, r_name AS name,
  75e0 + 12 * r_regionkey AS w, 20e0 AS s, 85e0 + 12 * r_regionkey AS e, 52e0 AS n FROM region
UNION ALL SELECT 'city', 1, n_nationkey::INTEGER, {_PREFIX_SQL} || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || '00', n_name,
  75e0 + 12 * r_regionkey, 20e0 + 1.25e0 * n_nationkey, 85e0 + 12 * r_regionkey, 21.25e0 + 1.25e0 * n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'district', 2, c_custkey::INTEGER, {_PREFIX_SQL} || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || lpad((c_custkey % 99 + 1)::VARCHAR, 2, '0'), c_name,
  75e0 + 12 * r_regionkey + 0.15625e0 * (c_custkey % 64), 20e0 + 1.25e0 * n_nationkey + 0.15625e0 * (c_custkey // 64 % 8),
  75.15625e0 + 12 * r_regionkey + 0.15625e0 * (c_custkey % 64), 20.15625e0 + 1.25e0 * n_nationkey + 0.15625e0 * (c_custkey // 64 % 8)
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, level_ord, pos, code, name and w, s, e, n of the regions derived from the tables."""
    r, n, c = (_view(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    a = admin(spark, sf_dir)
    n = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    west, south, key = 75.0 + 12 * F.col("r_regionkey"), 20.0 + 1.25 * F.col("n_nationkey"), F.col("c_custkey")
    x, y = west + 0.15625 * (key % 64), south + 0.15625 * (F.floor(key / 64) % 8)
    parts = (
        r.select(F.lit("province").alias("kind"), F.col("r_regionkey").alias("pos"), west.alias("w"), F.lit(20.0).alias("s"), (west + 10).alias("e"), F.lit(52.0).alias("n")),
        n.select(F.lit("city"), "n_nationkey", west, south, west + 10, south + 1.25),
        c.select(F.lit("district"), "c_custkey", x, y, x + 0.15625, y + 0.15625),
    )
    at = parts[0].union(parts[1]).union(parts[2])
    order = F.create_map(*[v for i, level in enumerate(LEVELS) for v in (F.lit(level), F.lit(i))])
    return a.join(at, ["kind", "pos"]).select(F.col("kind").alias("level"), order[F.col("kind")].alias("level_ord"), F.col("pos").cast("int").alias("pos"), "code", "name", "w", "s", "e", "n")


def with_polygons(rows: DataFrame) -> DataFrame:
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    return rows.withColumn("polygons", F.array(F.array(ring))).drop("w", "s", "e", "n")


def derived(spark: SparkSession, sf_dir: str) -> RegionRegistry:
    """The registry of the derived regions, made once a session and directory."""
    key = f"{spark.sparkContext.applicationId} {sf_dir}"
    if key not in _registries:
        _registries[key] = RegionRegistry(spark, regions=with_polygons(boxes(spark, sf_dir)))
    return _registries[key]


def reverse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the whole records of their regions, coordinates included."""
    found = reverse.reverse(points(spark, sf_dir), derived(spark, sf_dir))
    return found.select("point_id", *[F.col(f"{x}.{f}").alias(f"{x}_{f}") for x in LEVELS for f in ("code", "level", "latitude", "longitude")])


def _records_sql() -> str:
    joins, cols = [], []
    for x in LEVELS:
        joins.append(f"LEFT JOIN (SELECT point_id, arg_min(b, b.pos) AS b FROM p JOIN b ON lng > w AND lng < e AND lat > s AND lat < n WHERE level = '{x}' GROUP BY 1) {x} ON {x}.point_id = p.point_id")
        for f, text in (("code", "{}.b.code"), ("level", "{}.b.level"), ("latitude", "round(({0}.b.s + {0}.b.n) / 2, 6)"), ("longitude", "round(({0}.b.w + {0}.b.e) / 2, 6)")):
            fill = "'city'" if f == "level" else text.format("province")
            cols.append(f"CASE WHEN city.b IS NULL AND substr(province.b.code, 1, 2) IN {MERGED_SQL} THEN {fill} ELSE {text.format(x)} END AS {x}_{f}" if x == "city" else f"{text.format(x)} AS {x}_{f}")
    return f"WITH p AS ({POINTS_SQL}), b AS ({DERIVED_SQL}) SELECT p.point_id, {', '.join(cols)} FROM p {' '.join(joins)}"


def get_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of each derived code, of the nations' numbers and of the suppliers' names."""
    codes = admin(spark, sf_dir).select("code").union(_view(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string"))).union(_view(spark, sf_dir, "supplier").select("s_name"))
    return derived(spark, sf_dir).get_regions(codes.distinct()).select("code", "level", "name")


GET_SQL = f"""WITH b AS ({DERIVED_SQL}), c AS (SELECT code FROM b UNION SELECT n_nationkey::VARCHAR FROM nation UNION SELECT s_name FROM supplier),
k AS (SELECT level, level_ord, code, arg_max(name, pos) AS name FROM b GROUP BY 1, 2, 3)
SELECT c.code, arg_min(k.level, level_ord) AS level, arg_min(k.name, level_ord) AS name FROM c LEFT JOIN k USING (code) GROUP BY c.code"""


def list_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).list_regions("district").select("pos", "code", "name", F.round("rep_lat", 6).alias("latitude"), F.round("rep_lng", 6).alias("longitude"))


def _search(sql: str, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(derived(spark, sf_dir), **options).select("level", "pos", "code", "name")

    return query, f"SELECT level, pos, code, name FROM ({DERIVED_SQL}) AS b WHERE {sql}"


def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations and customers, codes, beginnings of names, patterns and a broken one."""
    n, r, c = (_view(spark, sf_dir, x) for x in ("nation", "region", "customer"))
    q = n.select(F.concat(F.lit("name "), "n_nationkey").alias("query_id"), F.col("n_name").alias("query"))
    q = q.union(c.select(F.concat(F.lit("customer "), "c_custkey"), "c_name")).union(admin(spark, sf_dir).where("kind = 'city'").select(F.concat(F.lit("code "), "pos"), "code"))
    q = q.union(n.select(F.concat(F.lit("part "), "n_nationkey"), F.substring("n_name", 2, 3))).union(r.select(F.concat(F.lit("pattern "), "r_regionkey"), F.concat(F.lit("^"), F.substring("r_name", 1, 1), F.lit(".*A$"))))
    q = q.union(r.select(F.concat(F.lit("broken "), "r_regionkey"), F.concat(F.lit("("), "r_name")))
    return search.search_many(derived(spark, sf_dir), q).select("query_id", "level", "pos", "code", "name", "error")


BATCH_SQL = f"""WITH r AS ({DERIVED_SQL}), q AS (SELECT 'name ' || n_nationkey AS query_id, n_name AS query, false AS loose FROM nation
 UNION ALL SELECT 'customer ' || c_custkey, c_name, false FROM customer UNION ALL SELECT 'code ' || pos, code, false FROM r WHERE level = 'city'
 UNION ALL SELECT 'part ' || n_nationkey, substr(n_name, 2, 3), false FROM nation UNION ALL SELECT 'pattern ' || r_regionkey, '^' || substr(r_name, 1, 1) || '.*A$', true FROM region),
x AS (SELECT query_id, level FROM q JOIN r ON name = query GROUP BY 1, 2),
g AS (SELECT level, pos, code, name, unnest(list_distinct(list_transform(range(1, greatest(2, length(name)::BIGINT)), lambda i: substr(name, i, 2)))) AS gram FROM r),
h AS (SELECT query_id, r.level, r.pos, r.code, r.name FROM q JOIN r ON code = query WHERE regexp_matches(query, '^[0-9]+$')
 UNION ALL SELECT query_id, r.level, r.pos, r.code, r.name FROM q JOIN r ON name = query WHERE NOT regexp_matches(query, '^[0-9]+$')
 UNION ALL SELECT query_id, g.level, g.pos, g.code, g.name FROM q JOIN g ON gram = substr(query, 1, 2) AND contains(name, query) WHERE NOT loose AND NOT regexp_matches(query, '^[0-9]+$')
  AND NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = q.query_id AND x.level = g.level)
 UNION ALL SELECT query_id, r.level, r.pos, r.code, r.name FROM q JOIN r ON regexp_matches(name, query) WHERE loose)
SELECT *, NULL::VARCHAR AS error FROM h UNION ALL SELECT 'broken ' || r_regionkey, NULL, NULL, NULL, NULL, 'not a regular expression' FROM region"""


def admin_tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.tree_edges(admin(spark, sf_dir)).distinct()


TREE_SQL = f"""WITH a AS ({ADMIN_SQL}), p AS (SELECT code, arg_max(name, pos) AS name FROM a WHERE kind = 'province' GROUP BY 1),
c AS (SELECT p.code AS parent, a.code, a.name FROM a JOIN p ON p.code = substr(a.code, 1, 2) || '0000' WHERE kind = 'city' AND substr(a.code, 1, 2) NOT IN {MERGED_SQL}),
m AS (SELECT * FROM p WHERE substr(code, 1, 2) IN {MERGED_SQL})
SELECT DISTINCT NULL::VARCHAR AS parent, 'root' AS parent_kind, code, name, 'province' AS kind FROM p
UNION SELECT parent, 'province', code, name, 'city' FROM c UNION SELECT code, 'province', code, name, 'city' FROM m
UNION SELECT c.code, 'city', a.code, a.name, 'district' FROM a JOIN c ON substr(c.code, 1, 4) = substr(a.code, 1, 4) WHERE a.kind = 'district' AND substr(a.code, 1, 2) NOT IN {MERGED_SQL}
UNION SELECT m.code, 'city', a.code, a.name, 'district' FROM a JOIN m ON m.code = substr(a.code, 1, 2) || '0000' WHERE a.kind = 'district'"""


def admin_tree_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hierarchy.tree(admin(spark, sf_dir))
    return t.select("value", F.size("children").alias("n_children"), F.array_join(F.transform("children", lambda c: F.concat(c["value"], F.lit(":"), F.array_join(c["children"]["value"], "+"))), ",").alias("children"))


def group_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = hierarchy.group_by_prefix(admin(spark, sf_dir).where("kind = 'district'"), 4)
    return g.select("prefix", F.size("members").alias("n"), F.get("members", F.lit(0))["code"].alias("first_code"))


def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).counts()


def childless_city_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities (customers) without children (orders) become districts as well."""
    c, o = _view(spark, sf_dir, "customer"), _view(spark, sf_dir, "orders")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("int").alias("childrenNum"))
    f = c.join(n, "c_custkey", "left").select(F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("adcode"), F.lit("city").alias("level"), F.coalesce("childrenNum", F.lit(0)).alias("childrenNum"), F.lit("440000").alias("parent"))
    none = f.limit(0)
    return ingest.build_levels(none.drop("parent"), f, none).select("level", "adcode", "name")


CHILDLESS_SQL = """WITH f AS (SELECT c_name AS name, c_custkey::VARCHAR AS adcode, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer)
SELECT 'city' AS level, adcode, name FROM f UNION ALL SELECT 'district', adcode, name FROM f WHERE NOT has"""


def bad_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived regions, a province without districts, and suppliers as regions with violations by the state of their account."""
    good = with_polygons(boxes(spark, sf_dir))
    money, key = F.col("s_acctbal"), F.col("s_suppkey")
    two = F.lpad((key % 99 + 1).cast("string"), 2, "0")
    code = F.when(money < 0, F.lpad(key.cast("string"), 5, "0")).when(money < 3000, F.concat(F.lit("1201"), two)).when(money < 6000, F.concat(F.lit("3301"), two)).otherwise(F.concat(F.lit("99"), two, F.lit("00")))
    level = F.when(money < 6000, "district").otherwise("city")
    box = F.lit(fixtures.box(100.0, 30.0, 101.0, 31.0)).cast("array<array<double>>")
    polygons = F.when(F.col("s_nationkey") >= 5, F.array(F.array(box)))
    bad = _view(spark, sf_dir, "supplier").select(level.alias("level"), F.when(money < 6000, 2).otherwise(1).alias("level_ord"), (key + 1_000_000).cast("int").alias("pos"), code.alias("code"), F.col("s_name").alias("name"), polygons.alias("polygons"))
    empty = _view(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("province").alias("level"), F.lit(0).alias("level_ord"), F.lit(1_000_000).alias("pos"), F.lit("520000").alias("code"), F.lit("EMPTY").alias("name"), F.array(F.array(box)).alias("polygons"))
    return good.unionByName(empty).unionByName(bad)


BAD_SQL = f"""(SELECT level, pos, code, name, 1 AS parts FROM ({DERIVED_SQL}) AS g UNION ALL SELECT 'province', 1000000, '520000', 'EMPTY', 1
UNION ALL SELECT CASE WHEN s_acctbal < 6000 THEN 'district' ELSE 'city' END, (s_suppkey + 1000000)::INTEGER,
 CASE WHEN s_acctbal < 0 THEN lpad(s_suppkey::VARCHAR, 5, '0') WHEN s_acctbal < 3000 THEN '1201' || lpad((s_suppkey % 99 + 1)::VARCHAR, 2, '0')
  WHEN s_acctbal < 6000 THEN '3301' || lpad((s_suppkey % 99 + 1)::VARCHAR, 2, '0') ELSE '99' || lpad((s_suppkey % 99 + 1)::VARCHAR, 2, '0') || '00' END,
 s_name, CASE WHEN s_nationkey >= 5 THEN 1 ELSE 0 END FROM supplier)"""


def _dq(check):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return check(spark, sf_dir).select("category", "severity", "level", "code")

    return query


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the derived list: districts go and come by their customer's balance and are renamed by its segment."""
    a = admin(spark, sf_dir).where("kind <> 'province'").select("kind", "pos", "code", "name")
    c = _view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.lit("district").alias("kind"), "c_acctbal", "c_mktsegment")
    a = a.join(c, ["kind", "pos"], "left")
    old = a.where("c_acctbal IS NULL OR c_acctbal >= 0")
    new = a.where("c_acctbal IS NULL OR c_acctbal < 9000").withColumn("name", F.when(F.col("c_mktsegment") == "BUILDING", F.concat("name", F.lit(" (new)"))).otherwise(F.col("name")))
    return old, new


OLD_NEW_SQL = f"""a AS (SELECT a.*, c_acctbal AS b, c_mktsegment AS m FROM ({ADMIN_SQL}) AS a LEFT JOIN customer ON a.kind = 'district' AND a.pos = c_custkey WHERE kind <> 'province'),
o AS (SELECT kind, code, name FROM a WHERE b IS NULL OR b >= 0),
n AS (SELECT kind, code, CASE WHEN m = 'BUILDING' THEN name || ' (new)' ELSE name END AS name FROM a WHERE b IS NULL OR b < 9000)"""


def diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown report, a row a line, numbered from 0."""
    text = versioning.report(*_old_new(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "line int, text string")


def _report_sql() -> str:
    order = "CASE kind WHEN 'province' THEN 0 WHEN 'city' THEN 1 ELSE 2 END"
    parts = ["SELECT 0 AS part, 0::BIGINT AS seq, '# Region data: ? to ?' AS text", "SELECT 0, 1, ''", "SELECT 0, 2, '| level | before | after | change |'", "SELECT 0, 3, '|---|---|---|---|'"]
    parts.append(f"SELECT 1, {order}, '| ' || kind || ' | ' || n_before || ' | ' || n_after || ' | ' || change || ' |' FROM c")
    for part, title, rows in ((2, "Added", "SELECT * FROM n EXCEPT SELECT * FROM o"), (4, "Removed", "SELECT * FROM o EXCEPT SELECT * FROM n")):
        parts += [f"SELECT {part}, 0, ''", f"SELECT {part}, 1, '## {title} (' || (SELECT count(*) FROM ({rows})) || ')'", f"SELECT {part}, 2, ''"]
        parts.append(f"SELECT {part + 1}, row_number() OVER (ORDER BY kind, code, name), '- ' || kind || ' ' || code || ' ' || name FROM ({rows})")
    return f"WITH {OLD_NEW_SQL}, {_COUNTS_SQL}, t AS ({' UNION ALL '.join(parts)}) SELECT (row_number() OVER (ORDER BY part, seq) - 1)::INTEGER AS line, text FROM t"


_COUNTS_SQL = """k AS (SELECT unnest(['province', 'city', 'district']) AS kind),
b AS (SELECT kind, (SELECT count(*) FROM o WHERE o.kind = k.kind) AS n_before, (SELECT count(*) FROM n WHERE n.kind = k.kind) AS n_after FROM k),
c AS (SELECT *, n_after - n_before AS diff, CASE WHEN n_after = n_before THEN '—' WHEN n_after > n_before THEN '+' || (n_after - n_before)::VARCHAR ELSE (n_after - n_before)::VARCHAR END AS change FROM b)"""


def geojson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived regions as features in GeoJSON text, parsed again."""
    f = geojson.feature_json(with_polygons(boxes(spark, sf_dir)))
    body = f.select("level", "pos", F.concat(F.lit('{"type":"FeatureCollection","features":['), "feature", F.lit("]}")).alias("body"))
    back = geojson.parse_features(body.withColumnRenamed("pos", "own"))
    corner = F.col("polygons")[0][0]
    return back.select("level", F.col("own").alias("pos"), F.col("properties.adcode").alias("code"), F.col("properties.name").alias("name"), corner[0][0].alias("west"), corner[2][1].alias("north"), F.size(corner).alias("n_points"))


def admin_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived admin list as one JSON text, sorted by code, read again."""
    return admin_source.parse_admin(admin_source.admin_json(admin(spark, sf_dir)), "value")


def code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, codes and names of comma paths; suppliers stand for the code that is dropped."""
    a = admin(spark, sf_dir)
    depth = F.when(F.col("kind") == "province", F.concat(F.lit("c,"), "name")).when(F.col("kind") == "city", F.concat(F.lit("c,p,"), "name")).otherwise(F.concat(F.lit("c,p,q,"), "name"))
    rows = a.select("code", depth.alias("path"))
    dropped = _view(spark, sf_dir, "supplier").select(F.lit("980000"), F.concat(F.lit("c,"), "s_name"))
    sar = _view(spark, sf_dir, "region").select(F.concat(F.lit("8"), F.when(F.col("r_regionkey") < 2, "1").otherwise("2"), F.lit("0000")), F.concat(F.lit("c,p,"), "r_name"))
    return admin_source.admin_of_paths(rows.union(dropped).union(sar))


CODE_TABLE_SQL = f"""WITH s AS (SELECT '8' || CASE WHEN r_regionkey < 2 THEN '1' ELSE '2' END || '0000' AS code, r_name AS name FROM region)
SELECT kind, code, name FROM ({ADMIN_SQL}) UNION ALL SELECT 'city', code, name FROM s UNION ALL SELECT 'province', code, name FROM s"""


def ingest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payloads of the country, its provinces and their cities, built into levels in WGS-84."""
    b = boxes(spark, sf_dir)
    p2, p4 = adcode.province_code(F.col("code")), adcode.city_code(F.col("code"))
    merged = adcode.is_merged(F.col("code"))
    below = b.where("level = 'district'").groupBy(p4.alias("code")).agg(F.count("*").cast("int").alias("childrenNum")).withColumn("level", F.lit("city"))
    b = b.join(below, ["code", "level"], "left").where("NOT (level = 'city' AND " + "substring(code, 1, 2) IN ('11', '81'))")
    parent = F.when(F.col("level") == "province", "100000").when((F.col("level") == "city") | merged, p2).otherwise(p4)
    b = b.withColumn("parent", parent).withColumn("center", F.array((F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2))
    f = geojson.feature_json(with_polygons(b.drop("level_ord")).join(b.select("level", "pos", "parent"), ["level", "pos"]).drop("parent"))
    f = f.join(b.select("level", "pos", "parent"), ["level", "pos"]).groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("level", "pos", "feature"))).alias("fs"))
    bodies = f.select("parent", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("fs.feature", ","), F.lit("]}")).alias("body"))
    built = ingest.levels_of(bodies)
    return built.select("level", "pos", "code", "name", "childrenNum", F.col("center")[0].alias("center_lng"), F.col("center")[1].alias("center_lat"))


INGEST_SQL = f"""WITH b AS (SELECT *, (w + e) / 2 AS x, (s + n) / 2 AS y FROM ({DERIVED_SQL}) WHERE NOT (level = 'city' AND substr(code, 1, 2) IN {MERGED_SQL})),
k AS (SELECT b.*, CASE WHEN level = 'city' THEN (SELECT count(*) FROM b d WHERE d.level = 'district' AND substr(d.code, 1, 4) = substr(b.code, 1, 4)) ELSE 0 END::INTEGER AS childrenNum FROM b),
e AS (SELECT level, code, name, childrenNum, pos AS p, x, y FROM k UNION ALL SELECT 'district', code, name, childrenNum, pos, x, y FROM k WHERE level = 'city' AND childrenNum <= 0),
i AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY code, name) - 1 AS pos, row_number() OVER () AS point_id FROM e),
w AS (SELECT point_id, round(lng, 6) AS center_lng, round(lat, 6) AS center_lat FROM ({_gcj_sql("SELECT point_id, x AS lng, y AS lat FROM i", "-", boxed=False)}))
SELECT level, pos::INTEGER AS pos, code, name, childrenNum, center_lng, center_lat FROM i JOIN w USING (point_id)"""


def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived(spark, sf_dir).by_name()
    return n.select("level", "name", F.size("positions").alias("n"), F.get("positions", F.lit(0)).alias("first_pos"))


def version_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version record without its source that gives the number of orders for that of districts."""
    v = admin_source.version_record(admin(spark, sf_dir), "s", "u", "b", "n")
    n = _view(spark, sf_dir, "orders").agg(F.count("*").alias("n_orders"))
    v = v.join(n, F.lit(True)).withColumn("counts", F.col("counts").withField("districts", F.col("n_orders"))).withColumn("source", F.lit(None).cast("string")).drop("n_orders")
    return quality.version_record(v, boxes(spark, sf_dir)).select("category", "severity", "level", "message")


PLACES = (("a", 30.5, 80.0, "11"), ("b", 30.5, 92.0, "44"), ("c", 0.0, 0.0, "31"), ("d", 30.5, 104.0, "11"))


def gb_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = admin(spark, sf_dir).select("kind", "pos", "code", adcode.to_gb(F.col("code")).alias("gb"))
    return a.withColumn("back", adcode.from_gb(F.col("gb")))


def parse_admin_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (_view(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    p = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    path = F.when(k % 3 == 0, F.concat_ws(",", F.lit("country"), "r_name")).when(k % 3 == 1, F.concat_ws(",", F.lit("country"), "r_name", "n_name")).otherwise(F.concat_ws(",", F.lit("country"), "r_name", "n_name", "c_name"))
    p = p.select(F.col("c_custkey"), path.alias("path"))
    return p.select("c_custkey", adcode.path_level(F.col("path")).alias("level"), adcode.path_name(F.col("path")).alias("name"))


PATH_SQL = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'province' WHEN 1 THEN 'city' ELSE 'district' END AS level,
 CASE c_custkey % 3 WHEN 0 THEN r_name WHEN 1 THEN n_name ELSE c_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each derived region's representative point and whether it is inside."""
    own = geometry.holds(F.col("polygons"), F.col("rep_lng"), F.col("rep_lat"))
    return derived(spark, sf_dir).regions.select("level", "code", "pos", F.col("rep_lat").alias("lat"), F.col("rep_lng").alias("lng"), own.alias("is_inside"))


def convert_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("point_id", F.array(F.array(F.array(F.array("lng", "lat")))).alias("polygons"))
    d = ingest.convert_column(p, "polygons", 3)
    pair = F.col("polygons")[0][0][0]
    return d.select("point_id", pair[0].alias("out_lng"), pair[1].alias("out_lat"))


def catalogue() -> dict[str, tuple]:
    """name -> (query, SQL or None)."""
    found: dict[str, tuple] = {name: _transform(name) for name in crs.TRANSFORMS}
    found |= {
        "reverse_point": (reverse_point, _reverse_sql(False)),
        "reverse_backfill": (reverse_backfill, _reverse_sql(True)),
        "province_counts": (province_counts, f"SELECT province_code, province_name, count(*) AS n_points, count(district_code) AS n_in_district FROM ({_reverse_sql(True)}) GROUP BY 1, 2"),
        "in_country": (in_country, f"WITH p AS ({POINTS_SQL}), h AS ({HITS_SQL}) SELECT point_id, point_id IN (SELECT point_id FROM h WHERE level = 'province') AS in_country FROM p"),
        "in_region": (in_region, IN_REGION_SQL),
        "haversine": (haversine, HAVERSINE_SQL),
        "country_bbox": (country_box, f"SELECT point_id, lng > 62.004 AND lng < 127.8347 AND lat > -9.1707 AND lat < 45.8271 AS in_box FROM ({POINTS_SQL})"),
        "adcode_level": (adcode_level, f"SELECT kind, pos, code, {LEVEL_SQL} AS level FROM ({ADMIN_SQL})"),
        "code_index_last_wins": (code_index_last_wins, f"WITH a AS ({ADMIN_SQL}) {LAST_SQL}"),
        "lookup_adcode": (lookup_adcode, _lookup_sql()),
        "get_region": (get_region, GET_SQL),
        "list_regions": (list_districts, f"SELECT pos, code, name, round((s + n) / 2, 6) AS latitude, round((w + e) / 2, 6) AS longitude FROM ({DERIVED_SQL}) AS b WHERE level = 'district'"),
        "search_code": _search("pos IN (SELECT max(pos) FROM (" + DERIVED_SQL + ") AS k WHERE level = 'district' AND code = '440207') AND level = 'district'", query="440207"),
        "search_name": _search("name = 'NATION_3'", query="NATION_3", fuzzy=False),
        "search_fuzzy": _search("regexp_matches(name, 'A.*IA$|#0+12.$')", query="A.*IA$|#0+12.$"),
        "search_level": _search("level = 'city' AND regexp_matches(name, '_1.?$')", query="_1.?$", level="city"),
        "search_parent": _search("level = 'district' AND (s + n) / 2 > (SELECT min(s) FROM (" + DERIVED_SQL + ") AS k WHERE level = 'city' AND name = 'NATION_7') AND (s + n) / 2 < (SELECT max(n) FROM (" + DERIVED_SQL + ") AS k WHERE level = 'city' AND name = 'NATION_7') AND (w + e) / 2 > (SELECT min(w) FROM (" + DERIVED_SQL + ") AS k WHERE level = 'city' AND name = 'NATION_7') AND (w + e) / 2 < (SELECT max(e) FROM (" + DERIVED_SQL + ") AS k WHERE level = 'city' AND name = 'NATION_7')", query="Customer", level="district", city="NATION_7"),
        "search_batch": (search_batch, BATCH_SQL),
        "admin_tree_edges": (admin_tree_edges, TREE_SQL),
        "admin_tree_json": (admin_tree_json, f"""WITH a AS ({ADMIN_SQL}), p AS (SELECT code FROM a WHERE kind = 'province'),
c AS (SELECT p.code AS parent, a.code FROM a JOIN p ON p.code = substr(a.code, 1, 2) || '0000' WHERE kind = 'city' AND substr(a.code, 1, 2) NOT IN {MERGED_SQL} UNION ALL SELECT code, code FROM p WHERE substr(code, 1, 2) IN {MERGED_SQL}),
d AS (SELECT c.parent, c.code, coalesce(string_agg(a.code, '+' ORDER BY a.code), '') AS ds FROM c LEFT JOIN a ON a.kind = 'district' AND substr(a.code, 1, CASE WHEN c.parent = c.code THEN 2 ELSE 4 END) = substr(c.code, 1, CASE WHEN c.parent = c.code THEN 2 ELSE 4 END) GROUP BY 1, 2)
SELECT p.code AS value, count(d.code)::INTEGER AS n_children, coalesce(string_agg(d.code || ':' || ds, ',' ORDER BY d.code), '') AS children FROM p LEFT JOIN d ON d.parent = p.code GROUP BY 1"""),
        "group_by_prefix": (group_by_prefix, f"SELECT substr(code, 1, 4) AS prefix, count(*)::INTEGER AS n, min(code) AS first_code FROM ({ADMIN_SQL}) WHERE kind = 'district' GROUP BY 1"),
        "level_counts": (level_counts, f"SELECT level, count(*) AS n FROM ({DERIVED_SQL}) AS b GROUP BY 1"),
        "childless_city_dup": (childless_city_dup, CHILDLESS_SQL),
        "dq_bad_adcode": (_dq(lambda s, d: quality.bad_codes(bad_regions(s, d))), f"SELECT 'adcode' AS category, 'ERROR' AS severity, level, code FROM {BAD_SQL} WHERE NOT regexp_matches(code, '^[0-9]{{6}}$')"),
        "dq_duplicates": (_dq(lambda s, d: quality.duplicate_codes(bad_regions(s, d))), f"SELECT 'duplicate' AS category, 'ERROR' AS severity, level, code FROM (SELECT *, row_number() OVER (PARTITION BY level, code ORDER BY pos) AS k FROM {BAD_SQL} WHERE regexp_matches(code, '^[0-9]{{6}}$')) WHERE k > 1"),
        "dq_hierarchy": (_dq(lambda s, d: quality.orphans(bad_regions(s, d))), f"""WITH b AS (SELECT * FROM {BAD_SQL}) SELECT 'hierarchy' AS category, CASE WHEN level = 'city' OR substr(code, 1, 2) IN {MERGED_SQL} THEN 'ERROR' ELSE 'WARN' END AS severity, level, code FROM b
WHERE (level = 'city' OR (level = 'district' AND substr(code, 1, 2) IN {MERGED_SQL})) AND substr(code, 1, 2) NOT IN (SELECT substr(code, 1, 2) FROM b WHERE level = 'province')
 OR level = 'district' AND substr(code, 1, 2) NOT IN {MERGED_SQL} AND substr(code, 1, 4) NOT IN (SELECT substr(code, 1, 4) FROM b WHERE level = 'city')"""),
        "dq_geometry": (_dq(lambda s, d: quality.bad_geometry(bad_regions(s, d))), f"SELECT 'geometry' AS category, 'ERROR' AS severity, level, code FROM {BAD_SQL} WHERE parts = 0"),
        "dq_coverage": (_dq(lambda s, d: quality.uncovered_provinces(bad_regions(s, d))), f"SELECT 'coverage' AS category, 'ERROR' AS severity, level, code FROM {BAD_SQL} WHERE level = 'province' AND substr(code, 1, 2) <> '71' AND substr(code, 1, 2) NOT IN (SELECT substr(code, 1, 2) FROM {BAD_SQL} WHERE level = 'district')"),
        "dq_tree_sync": (_dq(lambda s, d: quality.tree_sync(bad_regions(s, d), admin(s, d))), f"""WITH x AS (SELECT DISTINCT level, code FROM {BAD_SQL}), y AS (SELECT DISTINCT kind AS level, code FROM ({ADMIN_SQL})),
o AS (SELECT *, 1 AS side FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT *, 2 FROM (SELECT * FROM y EXCEPT SELECT * FROM x))
SELECT 'sync' AS category, 'ERROR' AS severity, level, code FROM o WHERE level = 'province' UNION ALL SELECT 'sync', 'WARN', 'district', NULL FROM o WHERE level = 'district' GROUP BY side"""),
        "dq_landmarks": (_dq(lambda s, d: quality.landmarks(derived(s, d), PLACES)), f"""WITH p AS (SELECT * FROM {_values(list(PLACES), "place, lat, lng, prefix")}), b AS ({DERIVED_SQL}),
h AS (SELECT place, prefix, arg_min(code, pos) AS code FROM p LEFT JOIN b ON level = 'province' AND lng > w AND lng < e AND lat > s AND lat < n GROUP BY 1, 2)
SELECT 'landmark' AS category, 'ERROR' AS severity, NULL::VARCHAR AS level, code FROM h WHERE code IS NULL OR substr(code, 1, 2) <> prefix"""),
        "dq_duplicate_messages": (lambda s, d: quality.duplicate_codes(bad_regions(s, d)).select("level", "code", "message"), f"""SELECT level, code, level || ': code ' || code || ' of ' || name || ' is that of ' || before AS message
FROM (SELECT *, lag(name) OVER (PARTITION BY level, code ORDER BY pos) AS before FROM {BAD_SQL} WHERE regexp_matches(code, '^[0-9]{{6}}$')) WHERE before IS NOT NULL"""),
        "dq_severity_counts": (lambda s, d: quality.severity_counts(quality.orphans(bad_regions(s, d))), f"""WITH b AS (SELECT * FROM {BAD_SQL}) SELECT severity, count(*) AS count FROM (
SELECT 'ERROR' AS severity FROM b WHERE (level = 'city' OR (level = 'district' AND substr(code, 1, 2) IN {MERGED_SQL})) AND substr(code, 1, 2) NOT IN (SELECT substr(code, 1, 2) FROM b WHERE level = 'province')
UNION ALL SELECT 'WARN' FROM b WHERE level = 'district' AND substr(code, 1, 2) NOT IN {MERGED_SQL} AND substr(code, 1, 4) NOT IN (SELECT substr(code, 1, 4) FROM b WHERE level = 'city')) GROUP BY 1"""),
        "dq_counts": (lambda s, d: quality.count_bounds(boxes(s, d)).select("category", "severity", "level", "message"), f"""SELECT 'count' AS category, 'ERROR' AS severity, level, level || ': ' || n || ' regions, expected ' || low || ' to ' || high AS message
FROM (SELECT level, count(*) AS n FROM ({DERIVED_SQL}) AS b GROUP BY 1) JOIN (VALUES ('province', 30, 40), ('city', 300, 420), ('district', 2500, 3500)) AS t(level, low, high) USING (level) WHERE n < low OR n > high"""),
        "dq_version": (version_findings, f"""SELECT 'version' AS category, 'ERROR' AS severity, NULL::VARCHAR AS level, 'key source is missing' AS message
UNION ALL SELECT 'version', 'ERROR', 'district', 'district: the record says ' || (SELECT count(*) FROM orders) || ', the data have ' || (SELECT count(*) FROM customer) WHERE (SELECT count(*) FROM orders) <> (SELECT count(*) FROM customer)"""),
        "name_index": (name_index, f"SELECT level, name, count(*)::INTEGER AS n, min(pos) AS first_pos FROM ({DERIVED_SQL}) AS b GROUP BY 1, 2"),
        "reverse_records": (reverse_records, _records_sql()),
        "geojson_round_trip": (geojson_round_trip, f"SELECT level, pos, code, name, w AS west, n AS north, 5 AS n_points FROM ({DERIVED_SQL}) AS b"),
        "admin_round_trip": (admin_round_trip, f"SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY code, name) - 1)::INTEGER AS pos, code, name FROM ({ADMIN_SQL})"),
        "code_table": (code_table, CODE_TABLE_SQL),
        "ingest_levels": (ingest_levels, INGEST_SQL),
        "diff_report": (diff_report, _report_sql()),
        "diff_added": (lambda s, d: versioning.added(*_old_new(s, d)), f"WITH {OLD_NEW_SQL} SELECT * FROM n EXCEPT SELECT * FROM o"),
        "diff_removed": (lambda s, d: versioning.removed(*_old_new(s, d)), f"WITH {OLD_NEW_SQL} SELECT * FROM o EXCEPT SELECT * FROM n"),
        "diff_counts": (lambda s, d: versioning.count_changes(*_old_new(s, d)), f"WITH {OLD_NEW_SQL}, {_COUNTS_SQL} SELECT * FROM c"),
        "gb_code": (gb_code, f"SELECT kind, pos, code, '156' || code AS gb, code AS back FROM ({ADMIN_SQL})"),
        "parse_admin_path": (parse_admin_path, PATH_SQL),
        "representative_point": (representative, f"SELECT level, code, pos, (s + n) / 2 AS lat, (w + e) / 2 AS lng, true AS is_inside FROM ({DERIVED_SQL}) AS b"),
        "convert_nested": (convert_nested, f"SELECT point_id, round(lng, 6) AS out_lng, round(lat, 6) AS out_lat FROM ({_gcj_sql(POINTS_SQL, '-', boxed=False)})"),
    }
    return found
