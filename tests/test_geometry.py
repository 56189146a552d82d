"""Geometry against hand values, invariants and the topology library that ships with Spark."""

import math
import random

import pytest
from pyspark.sql import functions as F

from transitloom.functions import geometry as g
from transitloom.operators import lines as l
from transitloom.operators import spatial as sp

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
HOLE = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4)]


def lines_df(spark, lines):
    rows = [(k, i, x, y) for k, pts in lines.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "id string, i int, lon double, lat double")


def areas_df(spark, areas):
    pts = lambda ring: [{"lon": x, "lat": y} for x, y in ring]
    return spark.createDataFrame([(k, [[pts(r) for r in part] for part in parts]) for k, parts in areas.items()], f"id string, geom {g.MULTIPOLYGON_TYPE}")


def jts(spark, wkt):
    return spark._jvm.org.locationtech.jts.io.WKTReader().read(wkt)


def test_distances_on_sphere_and_ellipsoid(spark):
    row = spark.range(1).select(
        g.distance_sphere(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("a"),
        g.distance_spheroid(F.lit(0.0), F.lit(0.0), F.lit(0.01), F.lit(0.0)).alias("b"),
        g.distance_spheroid(F.lit(0.0), F.lit(49.0), F.lit(0.0), F.lit(49.01)).alias("c")).first()
    assert row.a == pytest.approx(math.radians(1) * g.SPHERE_RADIUS_M)
    assert row.b == pytest.approx(math.radians(0.01) * g.WGS84_A)
    assert row.c == pytest.approx(1112.10, abs=0.01)


def test_locate_and_cut_agree_with_the_topology_library(spark):
    rng = random.Random(7)
    lines = {f"l{k}": [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(rng.randint(2, 9))] for k in range(20)}
    edges = l.edge_table(lines_df(spark, lines), "id", "i")
    spots = [(k, f"p{n}", rng.uniform(0, 1), rng.uniform(0, 1)) for k in lines for n in range(5)]
    points = spark.createDataFrame(spots, "id string, p string, x double, y double")
    joined = {(r.id, r.p): r.share for r in l.locate_points(points, edges, "id", ["p"], "x", "y").collect()}
    column = {(r.id, r.p): r.share for r in points.join(l.tracks(edges, "id"), "id").select("id", "p", g.locate_point("track", "x", "y").alias("share")).collect()}
    indexed = spark._jvm.org.locationtech.jts.linearref.LengthIndexedLine
    for k, p, x, y in spots:
        line = jts(spark, "LINESTRING(" + ", ".join(f"{a!r} {b!r}" for a, b in lines[k]) + ")")
        want = indexed(line).project(jts(spark, f"POINT({x!r} {y!r})").getCoordinate()) / line.getLength()
        assert joined[(k, p)] == pytest.approx(want, abs=1e-9) and column[(k, p)] == pytest.approx(want, abs=1e-9)


def test_cutting_a_line_into_pieces_keeps_its_length(spark):
    rng = random.Random(11)
    lines = {f"l{k}": [(rng.uniform(0, 0.01), rng.uniform(49, 49.01)) for _ in range(6)] for k in range(10)}
    points = lines_df(spark, lines)
    edges = l.edge_table(points, "id", "i")
    marks = [0.0, 0.1, 0.35, 0.35, 0.8, 1.0]
    parts = spark.createDataFrame([(k, n, marks[n], marks[n + 1]) for k in lines for n in range(5)], "id string, n int, perc1 double, perc2 double")
    cut = l.cut_lines(parts, edges, "id", ["n", "perc1", "perc2"])
    rows = cut.collect()
    assert len(rows) == 50 and all(r.no_points is None and len(r.seg_geom) == 1 for r in rows if r.n == 2)
    total = {r.id: r.m for r in l.make_line(points, "id", "i").select("id", g.length_m("line").alias("m")).collect()}
    for k in lines:
        assert sum(r.seg_length for r in rows if r.id == k) == pytest.approx(total[k], rel=1e-7)
    # the column form gives the same pieces
    same = parts.join(l.tracks(edges, "id"), "id").select("id", "n", g.line_substring("track", "perc1", "perc2").alias("s")).collect()
    by_key = {(r.id, r.n): r.seg_geom for r in rows}
    for r in same:
        assert len(by_key[(r.id, r.n)]) == len(r.s)
        assert all(a.lon == pytest.approx(b.lon, abs=1e-12) and a.lat == pytest.approx(b.lat, abs=1e-12) for a, b in zip(by_key[(r.id, r.n)], r.s))
    assert l.cut_lines(spark.createDataFrame([("l0", 0, 0.5, 0.2)], "id string, n int, perc1 double, perc2 double"), edges, "id", ["n", "perc1", "perc2"]).count() == 0


def test_first_spot_wins_on_ties(spark):
    there_and_back = {"x": [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]}
    edges = l.edge_table(lines_df(spark, there_and_back), "id", "i")
    points = spark.createDataFrame([("x", "p", 0.5, 0.1)], "id string, p string, x double, y double")
    assert l.locate_points(points, edges, "id", ["p"], "x", "y").first().share == 0.25


def test_clipping_agrees_with_the_topology_library(spark):
    rng = random.Random(3)
    other = [(1.0, 0.2), (1.7, 0.3), (1.4, 1.1), (1.0, 0.2)]
    areas = {"holed": [[SQUARE, HOLE]], "two": [[SQUARE], [[(2.0, 0.0), (2.5, 0.1), (2.2, 0.9), (2.0, 0.0)]]], "tri": [[other]]}
    lines = {f"l{k}": [(rng.uniform(-0.5, 3), rng.uniform(-0.5, 1.5)) for _ in range(4)] for k in range(25)}
    # along an edge, touching a corner, inside the hole, outside everything
    lines |= {"edge": [(0.0, 0.0), (0.5, 0.0)], "corner": [(-1.0, 2.0), (0.0, 1.0)], "in_hole": [(0.45, 0.45), (0.55, 0.55)], "away": [(5.0, 5.0), (6.0, 6.0)]}
    made = l.make_line(lines_df(spark, lines), "id", "i").select(F.col("id").alias("line"), F.col("line").alias("seg_geom"))
    got = {(r.line, r.id): r.inside_m for r in sp.line_polygon_intersects(made, ["line"], sp.area_cover(areas_df(spark, areas), "id", cell=0.13), "id", cell=0.13).collect()}
    metres = lambda geom: sum(_metres(geom.getGeometryN(i)) for i in range(geom.getNumGeometries()))
    ring = lambda pts: "(" + ", ".join(f"{x!r} {y!r}" for x, y in pts) + ")"
    for name, parts in areas.items():
        poly = jts(spark, "MULTIPOLYGON(" + ", ".join("(" + ", ".join(ring(r) for r in part) + ")" for part in parts) + ")")
        for k, pts in lines.items():
            line = jts(spark, "LINESTRING" + ring(pts))
            assert ((k, name) in got) == line.intersects(poly), (k, name)
            if (k, name) in got:
                assert got[(k, name)] == pytest.approx(metres(line.intersection(poly)), rel=1e-5, abs=1e-2), (k, name)  # edges are 100 km and more here
    assert got[("edge", "holed")] > 0 and got[("corner", "holed")] == 0 and ("in_hole", "holed") not in got


def test_a_long_boundary_over_many_cells(spark):
    """A polygon of 10,000 vertices with a hole, over more than 1,000 cells."""
    turn = lambda k, n: 2 * math.pi * (k % n) / n
    radius = lambda a: 0.5 + 0.05 * math.sin(11 * a) + 0.01 * math.sin(301 * a)
    ring = [(math.cos(turn(k, 10000)) * radius(turn(k, 10000)), math.sin(turn(k, 10000)) * radius(turn(k, 10000))) for k in range(10001)]
    hole = [(0.2 * math.cos(turn(k, 500)), 0.2 * math.sin(turn(k, 500))) for k in range(501)]
    areas = areas_df(spark, {"big": [[ring, hole]]})
    cover = sp.area_cover(areas, "id", cell=0.025)
    seen = cover.select(F.count("*"), F.max(F.size("edges")), F.count_if("inside"), F.count_if(F.size("edges") == 0)).first()
    assert seen[0] > 1000 and seen[1] < 400 and seen[2] > 900 and seen[3] > 700
    rng = random.Random(17)
    lines = {f"l{k}": [(rng.uniform(-0.7, 0.7), rng.uniform(-0.7, 0.7)) for _ in range(3)] for k in range(60)}
    lines |= {"in_hole": [(-0.1, 0.1), (0.1, 0.02)], "in_ring": [(0.3, 0.0), (0.31, 0.3)], "grid": [(-0.7, 0.025), (0.7, 0.025)], "point": [(0.3, 0.01)], "off": [(0.01, 0.01)]}
    made = l.make_line(lines_df(spark, lines), "id", "i").select(F.col("id").alias("line"), F.col("line").alias("seg_geom"))
    met = sp.line_polygon_intersects(made, ["line"], cover, "id", cell=0.025)
    got = {r.line: r.inside_m for r in met.collect()}
    text = lambda pts: "(" + ", ".join(f"{x!r} {y!r}" for x, y in pts) + ")"
    poly = jts(spark, "POLYGON(" + text(ring) + ", " + text(hole) + ")")
    for k, pts in lines.items():
        shape = jts(spark, "LINESTRING" + text(pts) if len(pts) > 1 else "POINT" + text(pts))
        assert (k in got) == shape.intersects(poly), k
        if k in got and len(pts) > 1:
            inner = shape.intersection(poly)
            assert got[k] == pytest.approx(sum(_metres(inner.getGeometryN(i)) for i in range(inner.getNumGeometries())), rel=1e-6, abs=1e-3), k
    assert got["point"] == 0 and "off" not in got and "in_hole" not in got and got["in_ring"] > 0


def _metres(geom):
    c = geom.getCoordinates()
    total = 0.0
    for a, b in zip(list(c), list(c)[1:]):
        mid = math.radians((a.getY() + b.getY()) / 2)
        w = 1 - g.WGS84_E2 * math.sin(mid) ** 2
        north = g.WGS84_A * (1 - g.WGS84_E2) / w ** 1.5 * math.radians(b.getY() - a.getY())
        east = g.WGS84_A / math.sqrt(w) * math.cos(mid) * math.radians(b.getX() - a.getX())
        total += math.hypot(north, east)
    return total


def test_area_and_centroid_respect_holes_and_parts(spark):
    rows = {r.id: r for r in areas_df(spark, {"whole": [[SQUARE]], "holed": [[SQUARE, HOLE]], "hole": [[HOLE]], "two": [[SQUARE], [[(x + 3, y) for x, y in SQUARE]]]}).select(
        "id", g.area_m2("geom").alias("a"), g.centroid("geom").alias("c")).collect()}
    assert rows["whole"].a == pytest.approx(rows["holed"].a + rows["hole"].a, rel=1e-9)
    assert rows["whole"].a / 1e6 == pytest.approx(12308.8, rel=1e-4)
    assert (rows["holed"].c.lon, rows["holed"].c.lat) == (pytest.approx(0.5), pytest.approx(0.5))
    assert rows["two"].c.lon == pytest.approx(2.0)


def test_buffer_is_a_closed_ring_at_the_radius(spark):
    ring = spark.range(1).select(g.buffer_polygon(F.lit(-123.1), F.lit(49.27), 600.0)[0][0].alias("r")).select(
        F.size("r").alias("n"), (F.col("r")[0] == F.element_at("r", -1)).alias("closed"),
        F.transform("r", lambda p: g.distance_spheroid(F.lit(-123.1), F.lit(49.27), p["lon"], p["lat"])).alias("d")).first()
    assert ring.n == 33 and ring.closed and all(abs(d - 600) < 0.1 for d in ring.d)


def test_snapping_is_never_farther_than_any_vertex(spark):
    rng = random.Random(5)
    lines = {"s": [(rng.random(), rng.random()) for _ in range(12)]}
    track = l.tracks(l.edge_table(lines_df(spark, lines), "id", "i"), "id")
    points = spark.createDataFrame([("s", rng.random() * 2, rng.random() * 2) for _ in range(40)], "id string, x double, y double")
    for r in points.join(track, "id").select("x", "y", g.snap_point("track", "x", "y").alias("p")).collect():
        near = math.hypot(r.p.lon - r.x, r.p.lat - r.y)
        assert all(near <= math.hypot(a - r.x, b - r.y) + 1e-12 for a, b in lines["s"])


def test_geojson_and_repeats(spark):
    df = l.make_line(lines_df(spark, {"a": [(0.1, 1.0), (0.1, 1.0), (0.25, 2.0)], "b": [(1.0, 2.0)]}), "id", "i")
    got = {r[0]: r[1:] for r in df.select("id", g.as_geojson("line"), F.size(g.collapse_repeats("line")), g.num_points("line")).collect()}
    assert got["a"] == ('{"type":"LineString","coordinates":[[0.1,1.0],[0.1,1.0],[0.25,2.0]]}', 2, 3)
    assert got["b"] == ('{"type":"Point","coordinates":[1.0,2.0]}', 1, None)


def test_near_points_finds_everything_in_reach(spark):
    rng = random.Random(9)
    pois = spark.createDataFrame([(n, f"p{n}", "t", 49 + rng.random() / 50, -123 + rng.random() / 50) for n in range(12)], "poi_id int, name string, team string, latitude double, longitude double")
    stops = spark.createDataFrame([(str(n), 49 + rng.random() / 50, -123 + rng.random() / 50) for n in range(200)], "stop_id string, stop_lat double, stop_lon double")
    got = {(r.poi_id, r.stop_id) for r in sp.near_points(pois, stops).collect()}
    want = {(r.poi_id, r.stop_id) for r in pois.crossJoin(stops).where(g.distance_sphere("longitude", "latitude", "stop_lon", "stop_lat") <= 600).collect()}
    assert got == want and len(got) > 20
