"""Geometry as plain columns.

A point is ``struct<lon, lat>``, a line ``array<point>``, a ring a closed line, a multipolygon
``array<polygon>`` with a polygon being ``array<ring>`` (outer ring first, then holes). "Planar"
means degrees. A *track* is a line packed for measuring (operators.lines.tracks):
``array<struct<edge_no, x1, y1, dx, dy, len, start>>``, one entry per edge with its planar running start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
SPHERE_RADIUS_M = 6371008.77141506
BUFFER_EDGES = 32
SRID = 4326
POINT_TYPE = "struct<lon:double,lat:double>"
LINE_TYPE = f"array<{POINT_TYPE}>"
MULTIPOLYGON_TYPE = f"array<array<{LINE_TYPE}>>"
# Vertices nearer to an end of a sub-line than this share of the line are not repeated.
SAME_SPOT = 1e-12
# -------------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def make_point(lon, lat) -> Column:
    return F.struct(_col(lon).alias("lon"), _col(lat).alias("lat"))


def point_x(p) -> Column:
    return _col(p)["lon"]


def point_y(p) -> Column:
    return _col(p)["lat"]


# ---- distances ----------------------------------------------------------------------------
def distance_sphere(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres on the mean sphere (haversine)."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    u = F.sin(F.radians(lat2 - lat1) / 2)
    v = F.sin(F.radians(lon2 - lon1) / 2)
    h = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return F.lit(2 * SPHERE_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def distance_spheroid(lon1, lat1, lon2, lat2) -> Column:
    """Ellipsoidal metres by the mid-latitude formula; relative error is far below 1e-6 at street scale."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    mid = F.radians((lat1 + lat2) / 2)
    w = 1 - F.lit(WGS84_E2) * F.sin(mid) * F.sin(mid)
    prime = F.lit(WGS84_A) / F.sqrt(w)
    meridian = F.lit(WGS84_A * (1 - WGS84_E2)) / (w * F.sqrt(w))
    north = meridian * F.radians(lat2 - lat1)
    east = prime * F.cos(mid) * F.radians(lon2 - lon1)
    return F.sqrt(north * north + east * east)


# ---- lines --------------------------------------------------------------------------------
def vertex_pairs(line) -> Column:
    """Consecutive vertices as ``array<struct<x1, y1, x2, y2>>``."""
    line = _col(line)
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(
        F.slice(line, F.lit(1), n),
        F.slice(line, F.lit(2), n),
        lambda a, b: F.struct(
            a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")
        ),
    )


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)


def length_m(line) -> Column:
    """Ellipsoidal length; 0 for a single point."""
    return _sum(F.transform(
        vertex_pairs(line), lambda e: distance_spheroid(e["x1"], e["y1"], e["x2"], e["y2"])
    ))


def length_deg(line) -> Column:
    return _sum(F.transform(vertex_pairs(line), lambda e: F.sqrt(
        (e["x2"] - e["x1"]) * (e["x2"] - e["x1"]) + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"])
    )))


def distance_planar(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(_col, (x1, y1, x2, y2))
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def num_points(line) -> Column:
    """Vertex count; NULL when the line has shrunk to a point."""
    n = F.size(_col(line))
    return F.when(n > 1, n)


def track_total(track) -> Column:
    track = _col(track)
    last = F.try_element_at(track, F.lit(-1))
    return F.coalesce(last["start"] + last["len"], F.lit(0.0))


def closest_on_track(track, lon, lat) -> Column:
    """Nearest spot of a track, first one on ties: ``struct<d2, pos, lon, lat>``."""
    track, px, py = map(_col, (track, lon, lat))

    def foot(e: Column) -> Column:
        along = (px - e["x1"]) * e["dx"] + (py - e["y1"]) * e["dy"]
        share = F.try_divide(along, e["dx"] * e["dx"] + e["dy"] * e["dy"])
        return F.struct(e.alias("e"), F.coalesce(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)), F.lit(0.0)).alias("t"))

    def spot(s: Column) -> Column:
        return F.struct(
            (s["e"]["start"] + s["t"] * s["e"]["len"]).alias("pos"),
            (s["e"]["x1"] + s["t"] * s["e"]["dx"]).alias("lon"),
            (s["e"]["y1"] + s["t"] * s["e"]["dy"]).alias("lat"),
        )

    def ranked(s: Column) -> Column:
        away_x, away_y = s["lon"] - px, s["lat"] - py
        return F.struct((away_x * away_x + away_y * away_y).alias("d2"), s["pos"].alias("pos"),
                        s["lon"].alias("lon"), s["lat"].alias("lat"))

    return F.array_min(F.transform(F.transform(F.transform(track, foot), spot), ranked))


def locate_point(track, lon, lat) -> Column:
    """Share (0-1) of the planar length at the nearest spot."""
    inside = F.try_divide(closest_on_track(track, lon, lat)["pos"], track_total(track))
    known = _col(track).isNotNull() & _col(lon).isNotNull() & _col(lat).isNotNull()
    return F.when(known, F.coalesce(F.least(inside, F.lit(1.0)), F.lit(0.0)))


def snap_point(track, lon, lat) -> Column:
    """The nearest spot itself, i.e. the point at ``locate_point``."""
    near = closest_on_track(track, lon, lat)
    return F.when(near.isNotNull(), F.struct(near["lon"].alias("lon"), near["lat"].alias("lat")))


def interpolate_point(track, share) -> Column:
    """Point at a share of the planar length; the share is clamped to 0-1."""
    track, share = _col(track), _col(share)
    target = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * track_total(track)
    edge = F.get(F.filter(track, lambda e: e["start"] + e["len"] >= target), F.lit(0))
    r = F.coalesce(F.try_divide(target - edge["start"], edge["len"]), F.lit(0.0))
    point = F.struct((edge["x1"] + edge["dx"] * r).alias("lon"), (edge["y1"] + edge["dy"] * r).alias("lat"))
    return F.when(share.isNotNull() & edge.isNotNull(), point)


def line_substring(track, share1, share2) -> Column:
    """Part of a track between two shares as a line; NULL if they are reversed, one point if equal."""
    track, f1, f2 = map(_col, (track, share1, share2))
    total = track_total(track)
    first, last = interpolate_point(track, f1), interpolate_point(track, f2)
    inner = F.transform(
        F.filter(
            track,
            lambda e: (e["start"] > (f1 + SAME_SPOT) * total) & (e["start"] < (f2 - SAME_SPOT) * total),
        ),
        lambda e: F.struct(e["x1"].alias("lon"), e["y1"].alias("lat")),
    )
    usable = first.isNotNull() & last.isNotNull()
    return (
        F.when(usable & (f1 == f2), F.array(first))
        .when(usable & (f1 < f2), F.concat(F.array(first), inner, F.array(last)))
    )


def geometry_key(line) -> Column:
    """64-bit key of the ordered coordinates; used next to the stop ids, never alone."""
    return F.xxhash64(_col(line))


def collapse_repeats(line) -> Column:
    """Drop vertices equal to the one before."""
    line = _col(line)
    return F.filter(line, lambda p, i: (i == 0) | (F.get(line, i - 1) != p))


def as_geojson(line, digits: int = 9) -> Column:
    """GeoJSON text, LineString or Point."""
    line = _col(line)
    pairs = F.transform(line, lambda p: F.array(F.round(p["lon"], digits), F.round(p["lat"], digits)))
    as_line = F.to_json(F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates")))
    as_point = F.to_json(F.struct(F.lit("Point").alias("type"), F.get(pairs, F.lit(0)).alias("coordinates")))
    return F.when(F.size(line) > 1, as_line).when(F.size(line) == 1, as_point)


# ---- polygons -----------------------------------------------------------------------------
def ring_edges(multipolygon) -> Column:
    """All boundary edges of a multipolygon, holes included."""
    return F.flatten(F.transform(F.flatten(_col(multipolygon)), vertex_pairs))


def on_boundary(edges, x, y) -> Column:
    edges, x, y = map(_col, (edges, x, y))
    return F.exists(edges, lambda e: (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    ))


def covers_point(edges, x, y) -> Column:
    """Even-odd test over all rings; the boundary counts as inside."""
    edges, x, y = map(_col, (edges, x, y))
    crossings = F.filter(edges, lambda e: (
        ((e["y1"] > y) != (e["y2"] > y))
        & (x < e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"]))
    ))
    return (F.size(crossings) % 2 == 1) | on_boundary(edges, x, y)


def cut_shares(edges, x1, y1, x2, y2) -> Column:
    """Sorted shares, 0 and 1 included, at which a segment meets the boundary edges."""
    edges, x1, y1, x2, y2 = map(_col, (edges, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1

    def meets(e: Column) -> Column:
        ex, ey = e["x2"] - e["x1"], e["y2"] - e["y1"]
        qx, qy = e["x1"] - x1, e["y1"] - y1
        cross = dx * ey - dy * ex
        t = F.try_divide(qx * ey - qy * ex, cross)
        s = F.try_divide(qx * dy - qy * dx, cross)
        square = dx * dx + dy * dy
        near = F.try_divide(qx * dx + qy * dy, square)
        far = F.try_divide((e["x2"] - x1) * dx + (e["y2"] - y1) * dy, square)
        aligned = (cross == 0) & (qx * dy == qy * dx)
        return (
            F.when((cross != 0) & s.between(0.0, 1.0) & t.between(0.0, 1.0), F.array(t))
            .when(aligned, F.filter(F.array(near, far), lambda v: v.between(0.0, 1.0)))
            .otherwise(F.array().cast("array<double>"))
        )

    found = F.flatten(F.transform(edges, meets))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), found)))


def covers_from(edges, inside, rx, ry, x, y) -> Column:
    """Whether a polygon covers a point, from the edges near it and whether it covers a reference point.

    The point is inside if the way from the reference point crosses the boundary an even number of times
    and that is inside, or an odd number of times and that is not. The edges need only be those the
    way can meet. The boundary counts as inside.
    """
    edges, inside, rx, ry, x, y = map(_col, (edges, inside, rx, ry, x, y))
    left = lambda ax, ay, bx, by, px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0
    crossed = F.filter(edges, lambda e: (
        (left(rx, ry, x, y, e["x1"], e["y1"]) != left(rx, ry, x, y, e["x2"], e["y2"]))
        & (left(e["x1"], e["y1"], e["x2"], e["y2"], rx, ry) != left(e["x1"], e["y1"], e["x2"], e["y2"], x, y))
    ))
    return ((F.size(crossed) % 2 == 1) != inside) | on_boundary(edges, x, y)


def cuts_between(edges, x1, y1, x2, y2, a, b) -> Column:
    """``a``, ``b`` and the shares of a segment between them at which it meets the boundary edges, sorted."""
    a, b = map(_col, (a, b))
    within = F.filter(cut_shares(edges, x1, y1, x2, y2), lambda t: (t > a) & (t < b))
    return F.array_sort(F.array_distinct(F.concat(F.array(a, b), within)))


def covered_shares(cuts, covers) -> Column:
    """The parts between consecutive cuts whose middle ``covers`` (a function of a share) holds for: ``array<struct<a, b>>``."""
    cuts = _col(cuts)
    n = F.size(cuts) - 1
    spans = F.zip_with(F.slice(cuts, F.lit(1), n), F.slice(cuts, F.lit(2), n), lambda u, v: F.struct(u.alias("a"), v.alias("b")))
    return F.filter(spans, lambda s: covers((s["a"] + s["b"]) / 2))


def touched_share(cuts, covers) -> Column:
    """The first cut that ``covers`` holds for, as a part of length zero; no part if there is none."""
    return F.transform(F.slice(F.filter(_col(cuts), covers), 1, 1), lambda t: F.struct(t.alias("a"), t.alias("b")))


def at_share(p, q, t: Column) -> Column:
    """The coordinate at a share of a segment; its ends are taken as they are, without rounding."""
    p, q = map(_col, (p, q))
    return F.when(t == 1, q).otherwise(p + (q - p) * t)


def shares_length_m(spans, x1, y1, x2, y2) -> Column:
    """Ellipsoidal length of the given parts of a segment; parts that adjoin are measured as one."""
    x1, y1, x2, y2 = map(_col, (x1, y1, x2, y2))
    spans = F.array_sort(_col(spans))
    apart = 1e-12
    begins = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["b"] < s["a"] - apart))
    ends = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["a"] > s["b"] + apart))
    at_x = lambda t: x1 + (x2 - x1) * t
    at_y = lambda t: y1 + (y2 - y1) * t
    return _sum(F.zip_with(begins, ends, lambda s, e: distance_spheroid(at_x(s["a"]), at_y(s["a"]), at_x(e["b"]), at_y(e["b"]))))


def area_m2(multipolygon) -> Column:
    """Ellipsoidal area: shoelace in the equal-area cylinder, holes subtracted."""
    e = math.sqrt(WGS84_E2)

    def height(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        tail = F.log((1 - F.lit(e) * s) / (1 + F.lit(e) * s)) / (2 * e)
        return F.lit(1 - WGS84_E2) * (s / (1 - F.lit(WGS84_E2) * s * s) - tail)

    def ring_area(ring: Column) -> Column:
        terms = F.transform(vertex_pairs(ring), lambda v: (
            F.radians(v["x1"]) * height(v["y2"]) - F.radians(v["x2"]) * height(v["y1"])))
        return F.abs(_sum(terms)) * (WGS84_A * WGS84_A / 4)

    def part_area(part: Column) -> Column:
        rings = F.transform(part, lambda ring, i: F.when(i == 0, ring_area(ring)).otherwise(-ring_area(ring)))
        return _sum(rings)

    return _sum(F.transform(_col(multipolygon), part_area))


def centroid(multipolygon) -> Column:
    """Planar area-weighted centroid of a multipolygon, measured from its first vertex."""
    geom = _col(multipolygon)
    origin = F.get(F.get(F.get(geom, F.lit(0)), F.lit(0)), F.lit(0))

    def moments(ring: Column, sign: Column) -> Column:
        pairs = F.transform(vertex_pairs(ring), lambda v: F.struct(
            (v["x1"] - origin["lon"]).alias("x1"), (v["y1"] - origin["lat"]).alias("y1"),
            (v["x2"] - origin["lon"]).alias("x2"), (v["y2"] - origin["lat"]).alias("y2")))
        cross = lambda v: v["x1"] * v["y2"] - v["x2"] * v["y1"]
        area = _sum(F.transform(pairs, cross))
        turn = F.when(area < 0, -sign).otherwise(sign)
        return F.struct(
            (turn * area).alias("a"),
            (turn * _sum(F.transform(pairs, lambda v: (v["x1"] + v["x2"]) * cross(v)))).alias("mx"),
            (turn * _sum(F.transform(pairs, lambda v: (v["y1"] + v["y2"]) * cross(v)))).alias("my"),
        )

    parts = F.flatten(F.transform(geom, lambda part: F.transform(
        part, lambda ring, i: moments(ring, F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))))))
    total = lambda name: _sum(F.transform(parts, lambda m: m[name]))
    return F.struct(
        (origin["lon"] + F.try_divide(total("mx"), 3 * total("a"))).alias("lon"),
        (origin["lat"] + F.try_divide(total("my"), 3 * total("a"))).alias("lat"),
    )


def buffer_polygon(lon, lat, radius_m: float) -> Column:
    """Closed ring of equal-angle vertices around a point, as a multipolygon."""
    lon, lat = _col(lon), _col(lat)
    s = F.sin(F.radians(lat))
    w = 1 - F.lit(WGS84_E2) * s * s
    prime = F.lit(WGS84_A) / F.sqrt(w)
    meridian = F.lit(WGS84_A * (1 - WGS84_E2)) / (w * F.sqrt(w))
    step = 2 * math.pi / BUFFER_EDGES

    def vertex(k: Column) -> Column:
        angle = (k % BUFFER_EDGES) * F.lit(step)
        return F.struct(
            (lon + F.degrees(F.lit(radius_m) * F.cos(angle) / (prime * F.cos(F.radians(lat))))).alias("lon"),
            (lat - F.degrees(F.lit(radius_m) * F.sin(angle) / meridian)).alias("lat"),
        )

    ring = F.transform(F.sequence(F.lit(0), F.lit(BUFFER_EDGES)), vertex)
    return F.array(F.array(ring))


def box_polygon(min_x, min_y, max_x, max_y) -> Column:
    """Axis-parallel box as a multipolygon."""
    a, b, c, d = map(_col, (min_x, min_y, max_x, max_y))
    ring = F.array(make_point(a, b), make_point(c, b), make_point(c, d), make_point(a, d), make_point(a, b))
    return F.array(F.array(ring))


def grid_cells(min_x, min_y, max_x, max_y, size: float) -> Column:
    """Every grid cell a bounding box touches: ``array<struct<cx, cy>>``."""
    a, b, c, d = map(_col, (min_x, min_y, max_x, max_y))
    index = lambda v: F.floor(v / size)
    return F.flatten(F.transform(
        F.sequence(index(a), index(c)),
        lambda cx: F.transform(
            F.sequence(index(b), index(d)),
            lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")),
        ),
    ))


def _between(low: Column, high: Column) -> Column:
    """Whole numbers from low to high; none if high is below low."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def cell_pieces(x1, y1, x2, y2, size: float) -> Column:
    """A segment cut at the grid lines: ``array<struct<a, b, cx, cy>>``, shares of the segment and the cell they lie in."""
    x1, y1, x2, y2 = map(_col, (x1, y1, x2, y2))
    index = lambda v: F.floor(v / size)

    def lines(p: Column, q: Column) -> Column:
        return F.transform(_between(index(F.least(p, q)) + 1, index(F.greatest(p, q))), lambda k: (k * F.lit(size) - p) / (q - p))

    found = F.filter(F.concat(lines(x1, x2), lines(y1, y2)), lambda t: (t > 0) & (t < 1))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), found)))
    n = F.size(cuts) - 1

    def piece(a: Column, b: Column) -> Column:
        t = (a + b) / 2
        return F.struct(a.alias("a"), b.alias("b"), index(x1 + (x2 - x1) * t).alias("cx"), index(y1 + (y2 - y1) * t).alias("cy"))

    return F.zip_with(F.slice(cuts, F.lit(1), n), F.slice(cuts, F.lit(2), n), piece)


def edge_cells(edge, size: float) -> Column:
    """Every grid cell an edge comes near: ``array<struct<cx, cy>>``, column by column.

    Cells reach out by a thousandth of their size, so rounding never hides an edge from a cell it touches.
    """
    e = _col(edge)
    reach = size * 1e-3
    left, right = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])
    index = lambda v: F.floor(v / size)
    rise = F.try_divide(e["y2"] - e["y1"], e["x2"] - e["x1"])

    def column(cx: Column) -> Column:
        steep = right - left < reach
        at = lambda x: e["y1"] + (x - e["x1"]) * rise
        p = F.when(steep, e["y1"]).otherwise(at(F.greatest(left, cx * F.lit(size) - reach)))
        q = F.when(steep, e["y2"]).otherwise(at(F.least(right, (cx + 1) * F.lit(size) + reach)))
        return F.transform(_between(index(F.least(p, q) - reach), index(F.greatest(p, q) + reach)),
                           lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(_between(index(left - reach), index(right + reach)), column))


# A point of each cell, as a share of its size, that lies on no grid line and no round coordinate.
CELL_X, CELL_Y = 0.3819660112501051, 0.7236067977499789


def cell_x(cx, size: float) -> Column:
    return (_col(cx) + CELL_X) * F.lit(size)


def cell_y(cy, size: float) -> Column:
    return (_col(cy) + CELL_Y) * F.lit(size)


def edge_rows(edge, size: float) -> Column:
    """Rows of the grid whose reference points are level with an edge, with the place where it crosses that level: ``array<struct<cy, x>>``."""
    e = _col(edge)
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    rows = _between(F.floor(low / size - CELL_Y), F.ceil(high / size - CELL_Y))
    crossed = F.filter(rows, lambda cy: (e["y1"] > cell_y(cy, size)) != (e["y2"] > cell_y(cy, size)))
    return F.transform(crossed, lambda cy: F.struct(
        cy.alias("cy"), (e["x1"] + (cell_y(cy, size) - e["y1"]) * F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"])).alias("x")))


def columns_between(x1, x2, size: float) -> Column:
    """Columns of the grid whose reference points lie from ``x1`` up to, not at, ``x2``."""
    x1, x2 = map(_col, (x1, x2))
    wide = _between(F.floor(x1 / size - CELL_X), F.ceil(x2 / size - CELL_X))
    return F.filter(wide, lambda cx: (cell_x(cx, size) >= x1) & (cell_x(cx, size) < x2))
