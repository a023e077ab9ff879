"""Point in polygon without spatial types: edges, a grid, parity.

A point is in a region if the number of edges to its right is odd and it lies on
no edge; holes and several parts follow from the parity, borders belong to no
region. A grid cell that no edge of a region meets is wholly in or wholly out,
so most points need no geometry at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 0.5  # degrees
#: Beyond so many bytes the index is joined by shuffle. It holds cells, their candidates and the edges of these.
INDEX_BYTES, CELL_BYTES, CANDIDATE_BYTES, EDGE_BYTES = 256 << 20, 64, 64, 40


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part_edges(part: Column) -> Column:
    """The edges (x1, y1, x2, y2) of the rings of a part; an open ring is closed."""
    closed = lambda ring: F.when(F.element_at(ring, -1) == F.get(ring, F.lit(0)), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    at = lambda p, i: F.get(p, F.lit(i))
    edge = lambda p, q: F.struct(at(p, 0).alias("x1"), at(p, 1).alias("y1"), at(q, 0).alias("x2"), at(q, 1).alias("y2"))
    own = lambda ring: F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), edge)
    return F.flatten(F.transform(F.filter(part, lambda ring: F.size(ring) > 0), lambda ring: let(closed(ring), own)))


def edges_of(regions: DataFrame) -> DataFrame:
    """(level, pos, part, x1, y1, x2, y2) of all rings."""
    r = regions.select("level", "pos", F.posexplode("polygons").alias("part", "rings"))
    return r.select("level", "pos", "part", F.explode(part_edges(F.col("rings"))).alias("e")).select("level", "pos", "part", "e.*")


def crosses(e, lng: Column, lat: Column) -> Column:
    """The edge is crossed by the ray from the point to the right."""
    right = ((lng - e["x1"]) * (e["y2"] - e["y1"]) < (e["x2"] - e["x1"]) * (lat - e["y1"])) == (e["y2"] > e["y1"])
    return ((e["y1"] > lat) != (e["y2"] > lat)) & right


def touches(e, lng: Column, lat: Column) -> Column:
    """The point lies on the edge."""
    return (
        ((e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lng - e["x1"]) == 0)
        & lng.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def inside(edges: Column, lng: Column, lat: Column) -> Column:
    """Strictly inside the region of an array of edges."""
    odd = F.aggregate(edges, F.lit(False), lambda acc, e: acc != crosses(e, lng, lat))
    return odd & ~F.exists(edges, lambda e: touches(e, lng, lat))


def holds(polygons: Column, lng: Column, lat: Column) -> Column:
    """The point is strictly inside the polygons of its row; false where either is missing."""
    edges = F.flatten(F.transform(F.filter(polygons, lambda part: part.isNotNull()), part_edges))
    return F.coalesce(lng.between(-360.0, 360.0) & lat.between(-360.0, 360.0) & let(edges, lambda e: inside(e, lng, lat)), F.lit(False))


def shape_of(polygons: Column) -> Column:
    """A digest that only equal polygons share; null if there are none."""
    return F.unhex(F.sha2(F.to_json(polygons), 256))


def cell_index(regions: DataFrame, size: float = GRID) -> DataFrame:
    """(cx, cy, candidates): the regions that a cell can lie in.

    A candidate has level, level_ord, pos and the edges that share the cell's
    band of latitudes; ``full`` ones hold the whole cell and have no edges.
    """
    e = edges_of(regions)
    low = lambda a, b: F.floor(F.least(a, b) / size)
    high = lambda a, b: F.floor(F.greatest(a, b) / size)
    e = e.select("*", low("x1", "x2").alias("cx1"), high("x1", "x2").alias("cx2"), low("y1", "y2").alias("cy1"), high("y1", "y2").alias("cy2"))
    bands = e.select("level", "pos", F.explode(F.sequence("cy1", "cy2")).alias("cy"), "cx1", "cx2", F.struct("x1", "y1", "x2", "y2").alias("e"))
    met = bands.select("level", "pos", "cy", F.explode(F.sequence("cx1", "cx2")).alias("cx")).distinct().withColumn("met", F.lit(True))
    span = bands.groupBy("level", "pos", "cy").agg(F.min("cx1").alias("from_x"), F.max("cx2").alias("to_x"), F.collect_list("e").alias("edges"))
    cells = span.select("level", "pos", "cy", "edges", F.explode(F.sequence("from_x", "to_x")).alias("cx"))
    cells = cells.join(met, ["level", "pos", "cx", "cy"], "left")
    centre = inside(F.col("edges"), (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size)
    cells = cells.withColumn("full", F.col("met").isNull()).where(~F.col("full") | centre)
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    cells = cells.select("level", "pos", "cx", "cy", "full", F.when(F.col("full"), none).otherwise(F.col("edges")).alias("edges"))
    return cells.groupBy("cx", "cy").agg(F.sort_array(F.collect_list(F.struct("level", "pos", "full", "edges"))).alias("candidates"))


def _scan(e: Column, lo: Column, hi: Column, part: Column) -> Column:
    """The candidates for the representative point, one a line of latitude."""
    # where a ring crosses itself on the middle line, the lines a quarter off it serve
    lines = F.array((lo + hi) / 2, (3 * lo + hi) / 4, (lo + 3 * hi) / 4)

    def crossings(y: Column) -> Column:
        met = F.filter(e, lambda d: (d["y1"] > y) != (d["y2"] > y))
        return F.sort_array(F.transform(met, lambda d: d["x1"] + (y - d["y1"]) / (d["y2"] - d["y1"]) * (d["x2"] - d["x1"])))

    def widest(xs: Column) -> Column:
        left, right = (lambda i: F.get(xs, 2 * i)), (lambda i: F.get(xs, 2 * i + 1))
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1),
            lambda i: F.struct((right(i) - left(i)).alias("wide"), (-i).alias("o"), ((right(i) + left(i)) / 2).alias("x")),
        )
        return F.when(F.size(xs) > 1, F.array_max(pairs))

    def candidate(y: Column, turn: Column) -> Column:
        def of(b: Column) -> Column:
            first = F.when(b["wide"] > 1e-9, -turn).otherwise(F.lit(-9))
            return F.when(b.isNotNull(), F.struct(first.alias("f"), b["wide"].alias("wide"), (-part).alias("o"), b["x"].alias("x"), y.alias("y")))

        return let(let(crossings(y), widest), of)

    return F.transform(lines, candidate)


def with_representative_points(regions: DataFrame) -> DataFrame:
    """``regions`` with rep_lng and rep_lat: a point inside each, found within the row; null without an area.

    On a line of latitude between the vertices around the middle of a part, the
    middle of the widest run inside; the widest over the parts, the first on ties.
    """

    def middle(e: Column) -> Column:
        return (F.array_min(F.transform(e, lambda d: F.least(d["y1"], d["y2"]))) + F.array_max(F.transform(e, lambda d: F.greatest(d["y1"], d["y2"])))) / 2

    def near(e: Column, mid: Column) -> Column:
        ys = F.transform(e, lambda d: d["y1"])
        return F.struct(F.array_max(F.filter(ys, lambda y: y <= mid)).alias("lo"), F.array_min(F.filter(ys, lambda y: y > mid)).alias("hi"))

    def best(part: Column, i: Column) -> Column:
        around = lambda e: let(middle(e), lambda mid: near(e, mid))
        return let(part_edges(part), lambda e: let(around(e), lambda n: F.array_max(_scan(e, n["lo"], n["hi"], i))))

    found = regions.withColumn("_top", F.array_max(F.transform("polygons", best)))
    return found.withColumn("rep_lng", F.col("_top.x")).withColumn("rep_lat", F.col("_top.y")).drop("_top")
