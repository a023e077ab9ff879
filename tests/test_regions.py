import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from regiongrid import api, fixtures
from regiongrid.functions import adcode, crs, point
from regiongrid.operators import hierarchy, ingest, quality, reverse, search, versioning
from regiongrid.plans.registry import RegionRegistry
from regiongrid.sources import admin, geojson, payload


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return fixtures.write(str(tmp_path_factory.mktemp("data")))


@pytest.fixture(scope="module")
def tool(spark, folder):
    return api.RegionTool(spark, folder)


def brute(level, lng, lat):
    """Smallest position of a region of the level that strictly holds the point."""
    for lv, _, pos, code, _, polygons in fixtures.positioned():
        if lv != level:
            continue
        odd = edge = False
        for p in polygons:
            for ring in p:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                    cross = (x2 - x1) * (lat - y1) - (y2 - y1) * (lng - x1)
                    edge |= cross == 0 and min(x1, x2) <= lng <= max(x1, x2) and min(y1, y2) <= lat <= max(y1, y2)
                    if (y1 > lat) != (y2 > lat):
                        odd ^= lng < x1 + (lat - y1) / (y2 - y1) * (x2 - x1)
        if odd and not edge:
            return code
    return None


def test_points_against_a_loop(spark, tool):
    r = random.Random(4)
    coords = [(r.choice([r.uniform(17, 50), float(r.randint(17, 50)), r.randint(34, 100) / 2]), r.choice([r.uniform(72, 133), float(r.randint(72, 133))])) for _ in range(600)]
    for (lat, lng), found in zip(coords, tool.reverse_batch(coords), strict=True):
        for level in ("province", "district"):
            got = getattr(found, level)
            assert (got.code if got else None) == brute(level, lng, lat), (lat, lng, level)


def test_special_points(tool):
    cases = {
        (40.5, 116.5): ("110000", "110000", "110101"),  # overlap: first in file order
        (39.0, 116.5): (None, None, None),  # border
        (42.0, 118.0): (None, None, None),  # vertex
        (23.0, 113.5): (None, None, "440306"),  # edge of the hole
        (23.5, 113.5): ("810000", "810000", "440306"),  # in the hole
        (43.0, 127.0): (None, None, None),  # between two parts
        (43.0, 129.0): ("220000", None, None),  # second part
        (23.5, 118.0): (None, None, "440306"),  # a district outside its province
        (0.0, 0.0): (None, None, None),
        (float("nan"), 116.0): (None, None, None),
    }
    for found, want in zip(tool.reverse_batch(list(cases)), cases.values(), strict=True):
        assert tuple(x.code if x else None for x in (found.province, found.city, found.district)) == want
    assert tool.reverse(40.5, 116.5).city.level == "city"
    assert tool.reverse_batch([]) == []


def test_null_coordinates_keep_the_row(spark, tool):
    p = spark.createDataFrame([(1, None, 116.0), (2, 40.0, None), (2, 40.0, None)], "point_id int, lat double, lng double")
    assert [r["province"] for r in reverse.reverse(p, tool.registry).collect()] == [None] * 3


def test_plan_is_broadcast_joins_only(spark, tool):
    p = spark.range(10).select((F.col("id") + 35.5).alias("lat"), (F.col("id") + 110.5).alias("lng"))
    plan = reverse.reverse(p, tool.registry)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 4
    assert not any(x in plan for x in ("NestedLoop", "Cartesian", "Python"))


def test_search(tool):
    names = lambda *a, **k: [(r.level, r.code) for r in tool.search(*a, **k)]
    assert names("朝阳区") == [("district", "110105"), ("district", "220104")]
    assert names("朝阳区", province="北京市") == names("朝阳区", province="110000") == [("district", "110105")]
    assert names("朝阳区", city="长春市") == [("district", "220104")]
    assert names("朝阳区", province="广东省") == names("朝阳区", city="北京市") == names("朝阳区", province="nowhere") == []
    assert names("深圳市")[0] == ("city", "440300")
    assert names("深圳") == [("city", "440300")] and names("深圳", fuzzy=False) == []
    assert names("朝.区") == names("朝阳区")
    assert names("460400") == [("city", "460400"), ("district", "460400")]
    assert len(names("")) == len(fixtures.REGIONS) and names("", fuzzy=False) == []
    assert names("儋州市", level="city") == [("city", "460400")]
    with pytest.raises(KeyError):
        tool.search("x", level="planet")
    with pytest.raises(Exception):  # noqa: B017
        tool.search("(")


def test_get_and_list(tool):
    assert tool.get_region("460400").level == "city" and tool.get_region("110100") is None
    assert [r.code for r in tool.list_regions("city")] == ["440300", "220100", "460400", "659001", "659002"]
    with pytest.raises(ValueError):
        tool.list_regions("planet")


def test_lookup(tool):
    codes = lambda c: (lambda r: r and tuple(x.code if x else None for x in (r.province, r.city, r.district)))(tool.lookup_adcode(c))
    assert codes("440305") == ("440000", "440300", "440305")
    assert codes("440300") == ("440000", "440300", None) and codes("440000") == ("440000", None, None)
    assert codes("110108") == ("110000", "110000", "110108") and codes("110000") == ("110000", None, None)
    assert codes("110100") == ("110000", "110000", None) and tool.lookup_adcode("110108").city.level == "city"
    assert codes("440399") == ("440000", "440300", None) and codes("659001") == ("650000", None, "659001")
    assert [codes(c) for c in ("abc", "12345", "", "999999")] == [None] * 4


def test_containment(tool):
    assert tool.is_in_china(40.5, 116.5) and not tool.is_in_china(35.68, 139.69)
    assert tool.is_in_region(21.5, 110.5, "440300") and tool.is_in_region(40.5, 116.5, "110100")
    assert not tool.is_in_region(40.5, 116.5, "440300")
    for code in ("xyz", "999999"):
        with pytest.raises(ValueError):
            tool.is_in_region(40.5, 116.5, code)


def test_tree(tool):
    t = tool.get_administrative_tree()
    assert t is tool.get_administrative_tree()
    assert [n["value"] for n in t] == sorted(n["value"] for n in t) and len(t) == 7
    by = {n["value"]: n["children"] for n in t}
    assert [c["value"] for c in by["110000"]] == ["110000"] and len(by["110000"][0]["children"]) == 3
    assert by["710000"] == [] and "children" not in by["110000"][0]["children"][0]
    assert [[d["value"] for d in c["children"]] for c in by["650000"]] == [["659001", "659002"]] * 2


def test_representative_points_are_inside(spark, tool):
    for r in tool.registry.names.collect():
        hit = tool.registry.regions  # the own region holds the point
        assert r["rep_lat"] is not None
        p = spark.createDataFrame([(r["rep_lat"], r["rep_lng"])], "lat double, lng double")
        hits = reverse.locate(p, tool.registry).first()["_hits"]
        assert (r["level"], r["pos"]) in {(h["level"], h["pos"]) for h in hits}, (r["code"], hit)


def by_plan(spark, name, lng, lat):
    point = spark.createDataFrame([(float(lng), float(lat))], "lng double, lat double")
    return tuple(point.select(*[F.expr(t) for t in crs.TRANSFORMS[name]("lng", "lat")]).first())


def test_crs_facts(spark):
    c = lambda n, x, y: getattr(api, n)(x, y)
    x, y = c("wgs84_to_gcj02", 116.3, 39.9)
    assert 0 < abs(x - 116.3) < 0.01 and 0 < abs(y - 39.9) < 0.01
    for p in ((0.0, 0.0), (139.69, 35.68)):
        assert c("wgs84_to_gcj02", *p) == p and c("gcj02_to_wgs84", *p) == p
    assert all(abs(a - b) < 0.001 for a, b in zip(c("gcj02_to_wgs84", x, y), (116.3, 39.9), strict=True))
    bx, by = c("gcj02_to_bd09", 116.3, 39.9)
    assert 0 < abs(bx - 116.3) < 0.02 and 0 < abs(by - 39.9) < 0.02
    assert all(abs(a - b) < 0.0001 for a, b in zip(c("bd09_to_gcj02", bx, by), (116.3, 39.9), strict=True))
    assert all(abs(a - b) < 1e-10 for a, b in zip(c("wgs84_to_bd09", 116.3, 39.9), c("gcj02_to_bd09", x, y), strict=True))
    assert all(math.isnan(v) for v in c("wgs84_to_gcj02", float("nan"), float("nan")))
    assert c("gcj02_to_bd09", 0.0, 0.0) != (0.0, 0.0)
    assert api.distance(39.9, 116.4, 39.9, 116.4) == 0.0
    assert 1000 < api.distance(39.9, 116.4, 31.2, 121.5) < 1200
    assert 250 < api.distance(32.06, 118.79, 31.23, 121.47) < 290
    assert abs(api.distance(0, 0, 0, 180) - 6371 * math.pi) < 1e-6
    crs.register(spark)
    assert spark.sql("SELECT haversine_km(0D, 0D, 0D, 0D), wgs84_to_gcj02_lng(0D, 0D)").first() == (0.0, 0.0)


def test_crs_plans_equal_single_points(spark):
    r = random.Random(8)
    points = [(r.uniform(70, 140), r.uniform(0, 57)) for _ in range(200)] + [(105.0, 35.0), (72.004, 30.0), (0.0, 0.0)]
    d = spark.createDataFrame(points, "lng double, lat double")
    for name in crs.TRANSFORMS:
        if name.startswith("etl"):
            continue
        got = d.select("lng", "lat", *[F.expr(t) for t in crs.TRANSFORMS[name]("lng", "lat")]).collect()
        assert all(abs(v - w) < 1e-9 for lng, lat, *out in got for v, w in zip(out, getattr(point, name)(lng, lat), strict=True)), name
    got = d.select("lng", "lat", F.expr(crs.distance("lat", "lng", "39.9e0", "116.4e0"))).collect()
    assert all(abs(km - point.distance(lat, lng, 39.9, 116.4)) < 1e-7 for lng, lat, km in got)


def test_exports_and_module_calls(spark, folder):
    import regiongrid

    assert all(hasattr(regiongrid, name) for name in regiongrid.__all__) and len(regiongrid.__all__) == 20
    api._default.clear()
    with pytest.raises(RuntimeError):
        regiongrid.reverse(40.5, 116.5)
    regiongrid.use(spark, folder)
    assert regiongrid.reverse(40.5, 116.5).district.code == "110101" and regiongrid.get_region("460400").level == "city"
    assert regiongrid.reverse_batch([(40.5, 116.5)])[0] == regiongrid.reverse(40.5, 116.5)
    assert regiongrid.search("朝阳区", city="长春市")[0].code == "220104" and regiongrid.is_in_china(40.5, 116.5)
    assert regiongrid.lookup_adcode("440305").city.code == "440300" and regiongrid.is_in_region(21.5, 110.5, "440300")
    assert len(regiongrid.list_regions("city")) == 5 and regiongrid.get_administrative_tree() is regiongrid.get_administrative_tree()
    began = time.perf_counter()
    for _ in range(100):
        regiongrid.reverse(40.5, 116.5), regiongrid.search("朝阳区"), regiongrid.lookup_adcode("440305")
    assert (time.perf_counter() - began) / 300 < 0.005


def test_single_calls_equal_the_plans(spark, tool, folder):
    plans = api.RegionTool(spark, folder, local=False)
    r = random.Random(5)
    coords = [(r.choice([r.uniform(17, 50), float(r.randint(17, 50)), r.randint(34, 100) / 2]), r.choice([r.uniform(72, 133), float(r.randint(72, 133))])) for _ in range(400)]
    coords += [(float("nan"), 116.0), (40.0, float("inf")), (0.0, 0.0)]
    assert [tool.reverse(*c) for c in coords] == plans.reverse_batch(coords)
    for code in sorted({x[1] for x in fixtures.REGIONS} | {"110100", "440399", "abc", "", "999999"}):
        assert tool.get_region(code) == plans.get_region(code) and tool.lookup_adcode(code) == plans.lookup_adcode(code)
    for args in ({"query": "区$"}, {"query": "朝阳区", "province": "110000"}, {"query": "", "city": "220100"}, {"query": "460400"}, {"query": "市", "level": "city"}):
        assert tool.search(**args) == plans.search(**args)
    assert tool.list_regions("district") == plans.list_regions("district")
    assert tool.is_in_china(40.5, 116.5) == plans.is_in_china(40.5, 116.5) and tool.is_in_region(40.5, 116.5, "110100") == plans.is_in_region(40.5, 116.5, "110100")


def test_codes(spark):
    d = spark.createDataFrame([("440305",), ("440300",), ("440000",), ("44",), (None,)], "c string")
    assert [r[0] for r in d.select(adcode.level(F.col("c"))).collect()] == ["district", "city", "province", None, None]
    assert d.select(adcode.from_gb(adcode.to_gb(F.col("c")))).first()[0] == "440305"


def test_quality(spark, folder):
    found = quality.validate(spark, folder, bounds={"province": (1, 9), "city": (1, 9), "district": (1, 99)}, places=(("a", 40.5, 116.5, "11"),))
    assert found.isEmpty()
    with pytest.raises(ValueError):
        quality.require_clean(quality.validate(spark, folder))
    assert quality.validate(spark, folder + "/none").count() == 5


def test_versions(spark):
    old = spark.createDataFrame([("city", "1", "a"), ("city", "2", "b"), ("district", "3", "c")], "kind string, code string, name string")
    new = spark.createDataFrame([("city", "1", "a"), ("city", "2", "bb"), ("province", "9", "p")], "kind string, code string, name string")
    assert {tuple(r) for r in versioning.added(old, new).collect()} == {("city", "2", "bb"), ("province", "9", "p")}
    assert {tuple(r) for r in versioning.removed(old, new).collect()} == {("city", "2", "b"), ("district", "3", "c")}
    assert {r["kind"]: r["change"] for r in versioning.count_changes(old, new).collect()} == {"province": "+1", "city": "—", "district": "-1"}
    assert "## Added (2)" in versioning.report(old, new)


def test_ingest(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"name": "x", "adcode": 110000, "center": [116.3, 39.9], "level": "province"}, "geometry": {"type": "Polygon", "coordinates": [[[116.3, 39.9], [117, 39.9], [117, 41], [116.3, 39.9]]]}}
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    n = ingest.normalise(payload.read_payload(spark, str(tmp_path / "p.json")), "province")
    row = ingest.convert(n).first()
    assert row["adcode"] == "110000" and row["childrenNum"] == 0 and row["centroid"] is None
    want = by_plan(spark, "etl_gcj02_to_wgs84", 116.3, 39.9)
    assert tuple(row["center"]) == want == tuple(row["polygons"][0][0][0])


def test_payload_files_to_registry(spark, tmp_path):
    """Raw payloads to levels in WGS-84, written and read again with all properties."""
    def feature(code, level, west, south, size, children=0):
        ring = [[west, south], [west + size, south], [west + size, south + size], [west, south + size], [west, south]]
        middle = [west + size / 2, south + size / 2]
        return {"type": "Feature", "properties": {"name": f"n{code}", "adcode": code, "center": middle, "centroid": None if children else middle, "level": level, "childrenNum": children}, "geometry": {"type": "Polygon", "coordinates": [ring]}}

    raw = tmp_path / "raw"
    raw.mkdir()
    payloads = {
        "100000": [feature(440000, "province", 110.0, 21.0, 4.0, 2), feature(110000, "province", 115.0, 39.0, 2.0, 1), feature(0, "line", 100.0, 20.0, 1.0)],
        "440000": [feature(440300, "city", 110.0, 21.0, 2.0, 1), feature(441900, "city", 112.0, 23.0, 1.0)],
        "110000": [feature(110101, "district", 115.0, 39.0, 1.0)],
        "440300": [feature(440305, "district", 110.0, 21.0, 1.0)],
    }
    for code, features in payloads.items():
        (raw / f"{code}_full.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    built = ingest.levels_of(payload.read_payloads(spark, str(raw))).persist()
    out = str(tmp_path / "out")
    ingest.write_all(built, out, "s", "u", "b")
    codes = {x: [r["code"] for r in built.where(F.col("level") == x).orderBy("pos").collect()] for x in ("province", "city", "district")}
    assert codes == {"province": ["110000", "440000"], "city": ["440300", "441900"], "district": ["110101", "440305", "441900"]}
    back = geojson.read_features(spark, f"{out}/china_city.geojson").select("properties.*").collect()
    want = point.gcj02_to_wgs84(111.0, 22.0)
    assert [(r["adcode"], r["childrenNum"]) for r in back] == [("440300", 1), ("441900", 0)] and back[0]["centroid"] is None
    assert all(abs(a - b) < 2e-6 for a, b in zip(back[0]["center"], want, strict=True))
    found = api.RegionTool(spark, out).reverse(21.5, 110.5)
    assert (found.province.code, found.city.code, found.district.code) == ("440000", "440300", "440305")
    bounds = {"province": (1, 9), "city": (1, 9), "district": (1, 99)}
    assert quality.validate(spark, out, bounds=bounds, places=()).isEmpty()
    built.unpersist()


def test_files_that_cannot_be_read(spark, folder, tmp_path):
    import shutil

    bounds = {"province": (1, 9), "city": (1, 9), "district": (1, 99)}
    for text, category in (("{", "load"), ("[]", "load"), ('{"type": "Topology", "features": []}', "load"), ('{"type": "FeatureCollection", "features": []}', "count")):
        shutil.rmtree(tmp_path / "d", ignore_errors=True)
        shutil.copytree(folder, tmp_path / "d")
        (tmp_path / "d" / "china_city.geojson").write_text(text)
        found = quality.validate(spark, str(tmp_path / "d"), bounds=bounds, places=())
        assert category in {r["category"] for r in found.collect()}, text


def test_version_record_findings(spark, folder):
    v = admin.read_version(spark, f"{folder}/DATA_VERSION.json")
    r = geojson.read_levels(spark, folder)
    assert quality.version_record(v, r).isEmpty()
    wrong = v.withColumn("source", F.lit(None).cast("string")).withColumn("counts", F.col("counts").withField("cities", F.lit(99).cast("bigint")))
    assert {x["message"] for x in quality.version_record(wrong, r).collect()} == {"key source is missing", "city: the record says 99, the data have 5"}


def test_large_index_is_joined_by_shuffle(spark, folder, monkeypatch):
    from regiongrid.operators import geometry
    from regiongrid.plans import registry as plans

    monkeypatch.setattr(geometry, "INDEX_BYTES", 1)
    monkeypatch.setattr(plans, "REGION_ROWS", 1)
    t = api.RegionTool(spark, folder, local=False)
    assert t.registry.cells() is t.registry.index
    assert t.reverse(40.5, 116.5).district.code == "110101" and t.search("朝阳区", city="长春市")[0].code == "220104"


def test_search_many_with_a_broken_pattern(spark, tool):
    q = [(0, "("), (1, "深圳"), (2, "区"), (3, "阳区"), (4, "^朝"), (5, None), (6, "")]
    rows = search.search_many(tool.registry, spark.createDataFrame(q, "query_id int, query string")).collect()
    assert [(r["query_id"], r["code"], r["error"]) for r in rows if r["error"]] == [(0, None, "not a regular expression")]
    codes = lambda i: sorted(r["code"] for r in rows if r["query_id"] == i)
    assert codes(1) == ["440300"] and codes(4) == ["110105", "220104"] and codes(5) == []
    for i, text in q[1:5]:
        assert codes(i) == sorted(r.code for r in tool.search(text)), text
    assert len(codes(6)) == len(tool.search("")) == len(fixtures.REGIONS)


def test_sinks_round_trip(spark, folder, tmp_path):
    r = geojson.read_levels(spark, folder)
    geojson.write_level(r, str(tmp_path / "g"), "province")
    back = geojson.read_level(spark, str(tmp_path / "g"), "province")
    key = lambda d: {(x["pos"], x["code"], x["name"], json.dumps(x["polygons"])) for x in d.collect()}
    assert key(back) == key(r.where("level = 'province'"))
    a = admin.read_admin(spark, f"{folder}/china_admin.json")
    admin.write_admin(a, str(tmp_path / "a"))
    assert admin.read_admin(spark, str(tmp_path / "a")).select("kind", "code", "name").exceptAll(a.select("kind", "code", "name")).isEmpty()
    v = admin.version_record(a, "s", "u", "b", "n")
    admin.write_version(v, str(tmp_path / "v"))
    assert admin.read_version(spark, str(tmp_path / "v")).first()["counts"]["provinces"] == 7


def test_code_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,path\n320000,\"c,p\"\n320100,\"c,p,q\"\n320101,\"c,p,q,r\"\n980000,\"c,x\"\n810000,\"c,hk,hk\"\n")
    rows = {tuple(r) for r in admin.read_code_table(spark, str(tmp_path / "t.csv")).collect()}
    assert rows == {("province", "320000", "p"), ("city", "320100", "q"), ("district", "320101", "r"), ("city", "810000", "hk"), ("province", "810000", "hk")}


def test_http_retries():
    calls = []

    class Body:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self):
            return b"ok"

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return Body()

    assert payload.fetch_text("u", opener=opener, sleep=lambda s: None) == "ok" and len(calls) == 3
    calls[:] = []
    with pytest.raises(OSError):
        payload.fetch_text("u", tries=2, opener=opener, sleep=lambda s: None)


def test_stream_equals_batch(spark, folder, tmp_path):
    from regiongrid.streaming.enrich import write_enriched

    registry = RegionRegistry(spark, folder)
    p = spark.range(50).select("id", (F.lit(18.0) + F.col("id") / 2).alias("lat"), (F.lit(100.0) + F.col("id") / 3).alias("lng"))
    p.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    s = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    write_enriched(s, registry, lambda b, n: reverse.flat(b, "id").write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination(120)
    want = reverse.flat(reverse.reverse(p, registry), "id")
    assert spark.read.parquet(out).exceptAll(want).isEmpty() and spark.read.parquet(out).count() == 50


def test_search_many_equals_single(spark, tool):
    q = ["朝阳区", "市$", "460400", "none"]
    many = search.search_many(tool.registry, spark.createDataFrame(list(enumerate(q)), "query_id int, query string"))
    for i, text in enumerate(q):
        assert sorted((r["level"], r["code"]) for r in many.where(F.col("query_id") == i).collect()) == sorted((r.level, r.code) for r in tool.search(text))


def test_group_by_prefix(spark):
    d = spark.createDataFrame([("1102", "b"), ("1101", "a"), ("4403", "c")], "code string, name string")
    assert {r["prefix"]: [m["code"] for m in r["members"]] for r in hierarchy.group_by_prefix(d, 2).collect()} == {"11": ["1101", "1102"], "44": ["4403"]}


def copies(spark, n):
    """A registry of two cities and of n districts on each of two equal places in the first."""
    box = [[[fixtures.box(*b)]] for b in ((100, 30, 103, 32), (103, 30, 105, 32), (101, 30, 101.5, 30.25), (102, 31, 102.25, 31.25))]
    rows = [("city", 1, 0, "330100", "west", box[0]), ("city", 1, 1, "330200", "east", box[1]), ("city", 1, 2, "330300", "again", box[0])]
    rows += [("district", 2, i, f"3301{i % 90 + 10}", f"d{i}", box[2 + i % 2]) for i in range(2 * n)]
    return RegionRegistry(spark, regions=fixtures.regions(spark, rows))


def test_copies_are_one_candidate_and_all_found_by_parent(spark):
    registry = copies(spark, 150)
    assert registry.index.agg(F.max(F.size("candidates"))).first()[0] <= 4
    found = lambda **k: [(r["level"], r["pos"]) for r in search.search(registry, "d", **k).collect()]
    every = [("district", i) for i in range(300)]
    assert found(city="west") == found(city="330100") == found(city="330300") == every
    assert found(city="east") == found(city="nowhere") == []


def test_reverse_among_copies(spark):
    registry = copies(spark, 150)
    points = [(30.1, 101.2), (31.1, 102.1), (31.9, 100.1), (31.0, 104.0), (30.1, 101.0)]
    d = spark.createDataFrame([(i, la, lo) for i, (la, lo) in enumerate(points)], "id int, lat double, lng double")
    assert reverse.locate(d, registry).agg(F.max(F.size("_hits"))).first()[0] == 2
    rows = reverse.flat(reverse.reverse(d, registry), "id").orderBy("id").collect()
    assert [(r["city_name"], r["district_name"]) for r in rows] == [("west", "d0"), ("west", "d1"), ("west", None), ("east", None), ("west", None)]
    codes = d.where("id < 2").withColumn("code", F.explode(F.array(F.lit("330300"), F.lit("330200"), F.lit("330110"), F.lit("330199"), F.lit("330111"), F.lit("330109"))))
    got = {(r["id"], r["code"]): (r["in_region"], r["error"]) for r in reverse.in_region(codes, registry).collect()}
    held = {(0, "330300"), (1, "330300"), (0, "330110"), (1, "330199"), (1, "330111")}
    assert got == {k: ((None, "unknown code") if k[1] == "330109" else (k in held, None)) for k in got} and len(got) == 12


def test_representative_points_need_no_shuffle(spark):
    from regiongrid.operators import geometry

    open_ring = [[[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]]]
    holed = [fixtures.box(10, 0, 20, 10), fixtures.box(11, 1, 18, 9)]
    bow = [[[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]]
    cases = [([open_ring], (2.0, 1.0)), ([holed], (19.0, 5.0)), ([bow], None), ([[fixtures.box(0, 0, 1, 1)], open_ring], (2.0, 1.0)), ([], None), ([[]], None), (None, None)]
    rows = [("district", 2, i, f"{i}", f"{i}", p) for i, (p, _) in enumerate(cases)]
    registry = RegionRegistry(spark, regions=fixtures.regions(spark, rows))
    own = geometry.holds(F.col("polygons"), F.col("rep_lng"), F.col("rep_lat"))
    d = registry.regions.select("pos", "rep_lng", "rep_lat", own.alias("own"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Aggregate"))
    got = {r["pos"]: ((r["rep_lng"], r["rep_lat"]) if r["rep_lng"] is not None else None, r["own"]) for r in d.collect()}
    for i, (_, want) in enumerate(cases):
        if i != 2:  # where the ring crosses itself, only that it is inside
            assert got[i] == (want, want is not None), i
    assert got[2][1] and got[2][0] != (1.0, 1.0)
