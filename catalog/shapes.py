"""Geometry, moving points, spatial joins."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from catalog.columns import DENSITY_SQL
from catalog.registry import add, cte, dist, r, sphere
from catalog.standins import POSITION_TIES
from transitloom.functions import geometry as g
from transitloom.functions import scalars as s
from transitloom.operators import lines as l
from transitloom.operators import moving as m
from transitloom.operators import spatial as sp
from transitloom.operators import timetable as t
from transitloom.plans import timetable as pt

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
END = datetime(2024, 2, 1, tzinfo=timezone.utc)


def _exploded(df, line, *keys):
    return df.select(*keys, F.posexplode(line).alias("i", "p")).select(*keys, (F.col("i") + 1).alias("i"), "p.lon", "p.lat")


# ---- lines --------------------------------------------------------------------------------
add("g01_make_line", lambda T: _exploded(l.make_line(T.shapes, "shape_id", "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat"), "line", "shape_id"),
    f"SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY i) AS i, {r('lon', 'lon')}, {r('lat', 'lat')} FROM x_shapes")
add("g02_line_edges", lambda T: l.line_edges(T.edges, "line_id").select("line_id", "edge_no", "len_deg", "cum_deg", "len_m", "cum_m"),
    f"""SELECT e.line_id, e.edge_no, {r('e.len', 'len_deg')}, {r('e.start', 'cum_deg')}, {r('p.m', 'len_m', 3)},
        {r('sum(p.m) OVER (PARTITION BY e.line_id ORDER BY e.edge_no) - p.m', 'cum_m', 3)}
        FROM x_edges e JOIN x_edge_metres p ON p.line_id = e.line_id AND p.edge_no = e.edge_no""", len_m=3, cum_m=3)
add("g03_locate_point",
    lambda T: l.locate_points(_line_stops(T), T.edges, "line_id", ["stop_id"], "stop_lon", "stop_lat"),
    f"SELECT line_id, stop_id, {r('share', 'share')} FROM x_spots")
add("g03_locate_point_column",
    lambda T: _line_stops(T).join(l.tracks(T.edges, "line_id"), "line_id").select("line_id", "stop_id", g.locate_point("track", "stop_lon", "stop_lat").alias("share")),
    f"SELECT line_id, stop_id, {r('share', 'share')} FROM x_spots")


def _line_stops(T):
    return T.transit_stops.select(t.line_id().alias("line_id"), "stop_id").distinct().join(T.stops.select("stop_id", "stop_lon", "stop_lat"), "stop_id")


add("g04_stop_fraction", lambda T: t.stop_fraction(t.with_line(T.transit_stops), t.shape_edges(T.shapes).unionByName(t.pattern_edges(t.with_line(T.transit_stops), T.stops)), T.stops).select("trip_id", "stop_sequence", "perc"),
    f"SELECT trip_id, CAST(stop_sequence AS BIGINT) AS stop_sequence, {r('perc', 'perc')} FROM x_placed")
SEG = "trip_id, CAST(stop1_sequence AS BIGINT) AS stop1_sequence"
cte("x_vertices", """
SELECT line_id, stop1_id, stop2_id, perc1, perc2, row_number() OVER (PARTITION BY line_id, stop1_id, stop2_id, perc1, perc2 ORDER BY edge_no) AS i, pax AS lon, pay AS lat FROM x_pieces
UNION ALL
SELECT line_id, stop1_id, stop2_id, perc1, perc2, count(*) + 1, arg_max(pbx, edge_no), arg_max(pby, edge_no) FROM x_pieces GROUP BY ALL
UNION ALL
SELECT p.line_id, p.stop1_id, p.stop2_id, p.perc1, p.perc2, 1, e.x1 + e.dx * greatest(0, p.perc1 * e.total - e.start) / e.len, e.y1 + e.dy * greatest(0, p.perc1 * e.total - e.start) / e.len
FROM x_parts p JOIN x_edges e ON e.line_id = p.line_id AND p.perc1 = p.perc2 AND e.upto >= p.perc1 * e.total AND (e.start < p.perc1 * e.total OR e.edge_no = 1)""")
add("g05_substring",
    lambda T: _exploded(_cut(T), "seg_geom", "line_id", "stop1_id", "stop2_id", "perc1", "perc2"),
    f"""SELECT line_id, stop1_id, stop2_id, {r('perc1', 'perc1')}, {r('perc2', 'perc2')}, i, {r('lon', 'lon')}, {r('lat', 'lat')} FROM x_vertices""")
def _cut(T):
    placed = t.with_pattern(t.segments_lead(T.transit_stops))
    return t.pattern_geometry(placed, T.edges, T.stops).select("line_id", "stop1_id", "stop2_id", "perc1", "perc2", "seg_geom").distinct()


add("g05_substring_column",
    lambda T: l.tracks(t.shape_edges(T.shapes), "line_id").select("line_id", g.line_substring("track", F.lit(0.2), F.lit(0.7)).alias("part")).select(
        "line_id", F.size("part").alias("n"), g.length_m("part").alias("length_m")),
    f"""SELECT line_id, count(*) + 1 AS n, {r('sum(m)', 'length_m', 3)} FROM (SELECT line_id, {dist('pax', 'pay', 'pbx', 'pby')} AS m FROM (
          SELECT line_id, x1 + dx * (a - start) / len AS pax, y1 + dy * (a - start) / len AS pay, x1 + dx * (b - start) / len AS pbx, y1 + dy * (b - start) / len AS pby
          FROM (SELECT *, greatest(start, 0.2e0 * total) AS a, least(upto, 0.7e0 * total) AS b FROM x_edges
                WHERE line_id LIKE 'shape:%' AND upto > 0.2e0 * total + 1e-12 * total AND start < 0.7e0 * total - 1e-12 * total))) GROUP BY line_id""", length_m=3)
add("g06_interpolate_point",
    lambda T: l.tracks(t.shape_edges(T.shapes), "line_id").select("line_id", F.explode(F.array(*[F.lit(x) for x in (-1.0, 0.0, 0.25, 0.5, 0.9, 1.0, 2.0)])).alias("f"), "track")
    .withColumn("p", g.interpolate_point("track", "f")).select("line_id", "f", "p.lon", "p.lat"),
    f"""SELECT line_id, f, {r('x1 + dx * (d - start) / len', 'lon')}, {r('y1 + dy * (d - start) / len', 'lat')} FROM (
          SELECT e.*, f, greatest(least(f, 1), 0) * total AS d FROM x_edges e, (VALUES (-1e0), (0e0), (0.25e0), (0.5e0), (0.9e0), (1e0), (2e0)) v(f) WHERE line_id LIKE 'shape:%')
        WHERE upto >= d AND (start < d OR edge_no = 1)""")
add("g07_length_m", lambda T: l.make_line(T.shapes, "shape_id", "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat").select("shape_id", g.length_m("line").alias("length_m")),
    f"SELECT substr(line_id, 7) AS shape_id, {r('sum(m)', 'length_m', 3)} FROM x_edge_metres WHERE line_id LIKE 'shape:%' GROUP BY 1", length_m=3)
add("g08_num_points", lambda T: T.segments.select("trip_id", "stop1_sequence", g.num_points("seg_geom").alias("no_points")),
    f"SELECT {SEG}, no_points FROM x_segments")
cte("x_dumped", """
SELECT s.trip_id, s.route_id, s.service_id, s.stop1_sequence, s.stop2_sequence, s.num_stops, s.stop1_arrival, s.stop2_arrival, s.seg_length, s.no_points, v.i, v.lon, v.lat,
  sum(coalesce(v.m, 0)) OVER (PARTITION BY s.trip_id, s.stop1_sequence ORDER BY v.i ROWS UNBOUNDED PRECEDING) AS run
FROM x_segments s JOIN x_vertex_steps v
  ON v.line_id = s.line_id AND v.stop1_id = s.stop1_id AND v.stop2_id = s.stop2_id AND v.perc1 = s.perc1 AND v.perc2 = s.perc2
WHERE s.seg_length > 0""")
cte("x_vertex_steps", f"""
SELECT *, {dist('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS m, sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)) AS deg
FROM x_vertices WINDOW w AS (PARTITION BY line_id, stop1_id, stop2_id, perc1, perc2 ORDER BY i)""")
cte("x_points", """
SELECT *, CASE WHEN i = 1 THEN stop1_arrival WHEN i = no_points THEN stop2_arrival ELSE stop1_arrival + (stop2_arrival - stop1_arrival) * run / seg_length END AS secs
FROM x_dumped WHERE i <> no_points OR stop2_sequence = num_stops""")
add("g09_dump_points",
    lambda T: l.dump_points(T.segments.select("trip_id", "stop1_sequence", "seg_geom"), "seg_geom").select("trip_id", "stop1_sequence", "point_sequence", "point.lon", "point.lat"),
    f"""SELECT {SEG}, v.i AS point_sequence, {r('v.lon', 'lon')}, {r('v.lat', 'lat')} FROM x_segments s JOIN x_vertices v
        ON v.line_id = s.line_id AND v.stop1_id = s.stop1_id AND v.stop2_id = s.stop2_id AND v.perc1 = s.perc1 AND v.perc2 = s.perc2""")
add("g10_interpolate_times", lambda T: T.points.select("trip_id", "stop1_sequence", "point_sequence", "point_arrival"),
    f"SELECT {SEG}, i AS point_sequence, {r('secs', 'point_arrival', 4)} FROM x_points", point_arrival=4)
cte("x_dumped_deg", """
SELECT s.trip_id, s.stop1_sequence, s.stop2_sequence, s.num_stops, s.stop1_arrival, s.stop2_arrival, s.seg_length, s.no_points, v.i,
  sum(coalesce(v.deg, 0)) OVER (PARTITION BY s.trip_id, s.stop1_sequence ORDER BY v.i ROWS UNBOUNDED PRECEDING) AS run
FROM x_segments s JOIN x_vertex_steps v
  ON v.line_id = s.line_id AND v.stop1_id = s.stop1_id AND v.stop2_id = s.stop2_id AND v.perc1 = s.perc1 AND v.perc2 = s.perc2 WHERE s.seg_length > 0""")
add("g10_interpolate_times_degrees", lambda T: pt.trip_points(T.segments, "degrees").select("trip_id", "stop1_sequence", "point_sequence", "point_arrival"),
    f"""SELECT {SEG}, i AS point_sequence, {r('CASE WHEN i = 1 THEN stop1_arrival WHEN i = no_points THEN stop2_arrival ELSE stop1_arrival + (stop2_arrival - stop1_arrival) * run / seg_length END', 'point_arrival', 5)}
        FROM x_dumped_deg WHERE i <> no_points OR stop2_sequence = num_stops""", point_arrival=5)

# ---- polygons and distances ---------------------------------------------------------------
cte("x_lines", "SELECT stop1_id || stop2_id AS segment_id, geom, count(*) AS copies, any_value(line_id) AS line_id, any_value(stop1_id) AS stop1_id, any_value(stop2_id) AS stop2_id, any_value(perc1) AS perc1, any_value(perc2) AS perc2 FROM x_bus_segments GROUP BY stop1_id || stop2_id, geom")
cte("x_line_edges", """
SELECT l.segment_id, l.geom, l.copies, p.pax, p.pay, p.pbx, p.pby FROM x_lines l JOIN x_pieces p
  ON p.line_id = l.line_id AND p.stop1_id = l.stop1_id AND p.stop2_id = l.stop2_id AND p.perc1 = l.perc1 AND p.perc2 = l.perc2""")
# box clipping by the four half-planes of a box
_lim = lambda p, d, lo, hi, pick: f"CASE WHEN {d} = 0 THEN NULL ELSE {pick}(({lo} - {p}) / {d}, ({hi} - {p}) / {d}) END"
cte("x_clip", f"""
SELECT segment_id, geom, copies, id, {dist('pax + (pbx - pax) * t0', 'pay + (pby - pay) * t0', 'pax + (pbx - pax) * t1', 'pay + (pby - pay) * t1')} AS m FROM (
  SELECT l.*, a.id, greatest(0, {_lim('pax', '(pbx - pax)', 'a.x1', 'a.x2', 'least')}, {_lim('pay', '(pby - pay)', 'a.y1', 'a.y2', 'least')}) AS t0,
    least(1, {_lim('pax', '(pbx - pax)', 'a.x1', 'a.x2', 'greatest')}, {_lim('pay', '(pby - pay)', 'a.y1', 'a.y2', 'greatest')}) AS t1
  FROM x_line_edges l, x_areas a
  WHERE greatest(pax, pbx) >= a.x1 AND least(pax, pbx) <= a.x2 AND greatest(pay, pby) >= a.y1 AND least(pay, pby) <= a.y2) WHERE t0 <= t1""")
cte("x_inside", "SELECT segment_id, geom, id, any_value(copies) AS copies, sum(m) AS m FROM x_clip GROUP BY segment_id, geom, id")
D3 = {"inside_m": 3}
add("g11_intersection_length_m",
    lambda T: sp.line_polygon_intersects(sp.distinct_segments(T.segments, T.routes), sp.LINE, sp.area_cover(T.areas, "id"), "id").select("segment_id", "id", "inside_m"),
    f"SELECT segment_id, CAST(id AS BIGINT) AS id, {r('m', 'inside_m', 3)} FROM x_inside", **D3)
W = "(1 - 0.0066943799901413165 * pow(sin(radians(latitude)), 2))"
cte("x_disc", f"""
SELECT poi_id, longitude, latitude, k, longitude + degrees(600 * cos(k * pi() / 16) / (6378137.0 / sqrt({W}) * cos(radians(latitude)))) AS lon,
  latitude - degrees(600 * sin(k * pi() / 16) / (6335439.3272928195 / pow({W}, 1.5))) AS lat FROM x_pois, range(0, 32) g(k)""")
add("g12_buffer", lambda T: _exploded(_discs(T), F.get(F.get("geom", F.lit(0)), F.lit(0)), "stop_id"),
    f"""SELECT stop_id, k + 1 AS i, {r(f'longitude + degrees(600 * cos(k % 32 * pi() / 16) / (6378137.0 / sqrt({W}) * cos(radians(latitude))))', 'lon')},
        {r(f'latitude - degrees(600 * sin(k % 32 * pi() / 16) / (6335439.3272928195 / pow({W}, 1.5)))', 'lat')}
        FROM (SELECT stop_id, stop_lon AS longitude, stop_lat AS latitude FROM x_stops), range(0, 33) g(k)""")


def _discs(T):
    return T.stops.select("stop_id", g.buffer_polygon("stop_lon", "stop_lat", 600.0).alias("geom"))


add("g13_area_km2", lambda T: T.areas.select("id", (g.area_m2("geom") / 1e6).alias("area_km2")),
    f"SELECT CAST(id AS BIGINT) AS id, {r('a', 'area_km2')} FROM x_areas")
add("g14_centroid", lambda T: T.areas.select("id", g.centroid("geom").alias("c")).select("id", "c.lon", "c.lat"),
    f"SELECT CAST(id AS BIGINT) AS id, {r('(x1 + x2) / 2', 'lon')}, {r('(y1 + y2) / 2', 'lat')} FROM x_areas")
cte("x_hops", "SELECT trip_id, stop1_sequence, a.stop_lon AS lon1, a.stop_lat AS lat1, b.stop_lon AS lon2, b.stop_lat AS lat2 FROM x_segments s JOIN x_stops a ON a.stop_id = s.stop1_id JOIN x_stops b ON b.stop_id = s.stop2_id")


def _hops(T):
    one = T.stops.select(F.col("stop_id").alias("stop1_id"), F.col("stop_lon").alias("lon1"), F.col("stop_lat").alias("lat1"))
    two = T.stops.select(F.col("stop_id").alias("stop2_id"), F.col("stop_lon").alias("lon2"), F.col("stop_lat").alias("lat2"))
    return T.segments.join(one, "stop1_id").join(two, "stop2_id")


add("g15_distance_sphere", lambda T: _hops(T).select("trip_id", "stop1_sequence", g.distance_sphere("lon1", "lat1", "lon2", "lat2").alias("d")),
    f"SELECT {SEG}, {r(sphere('lon1', 'lat1', 'lon2', 'lat2'), 'd', 3)} FROM x_hops", d=3)
add("g16_distance_spheroid", lambda T: _hops(T).select("trip_id", "stop1_sequence", g.distance_spheroid("lon1", "lat1", "lon2", "lat2").alias("d")),
    f"SELECT {SEG}, {r(dist('lon1', 'lat1', 'lon2', 'lat2'), 'd', 3)} FROM x_hops", d=3)
add("g17_collect_lines", lambda T: l.collect_lines(T.segments).select("route_id", "stop1_id", "stop2_id", "copies", "seg_length"),
    f"""SELECT route_id, stop1_id, stop2_id, count(*) AS copies, {r('max(seg_length)', 'seg_length', 3)} FROM x_segments GROUP BY route_id, stop1_id, stop2_id, geom""", seg_length=3)
cte("x_json_parts", """
SELECT trip_id, stop1_sequence, v.i, v.lon, v.lat FROM x_segments s JOIN x_vertices v
  ON v.line_id = s.line_id AND v.stop1_id = s.stop1_id AND v.stop2_id = s.stop2_id AND v.perc1 = s.perc1 AND v.perc2 = s.perc2""")
add("g18_as_geojson",
    lambda T: T.segments.select("trip_id", "stop1_sequence", F.from_json(g.as_geojson("seg_geom"), "type string, coordinates array<array<double>>").alias("j"))
    .select("trip_id", "stop1_sequence", "j.type", F.posexplode("j.coordinates").alias("k", "c"))
    .select("trip_id", "stop1_sequence", "type", (F.col("k") + 1).alias("i"), F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat")),
    f"SELECT {SEG}, 'LineString' AS type, i, {r('lon', 'lon')}, {r('lat', 'lat')} FROM x_json_parts")
add("g19_make_point", lambda T: T.stops.withColumn("p", g.make_point("stop_lon", "stop_lat")).select("stop_id", g.point_x("p").alias("x"), g.point_y("p").alias("y")),
    f"SELECT stop_id, {r('stop_lon', 'x')}, {r('stop_lat', 'y')} FROM x_stops")
add("g20_in_cells",
    lambda T: _hops(T).select("trip_id", "stop1_sequence", F.explode(g.grid_cells(F.least("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lon1", "lon2"), F.greatest("lat1", "lat2"), 0.25)).alias("c"))
    .select("trip_id", "stop1_sequence", "c.cx", "c.cy"),
    f"""SELECT {SEG}, cx, cy FROM (SELECT trip_id, stop1_sequence, lat1, lat2,
          unnest(range(CAST(floor(least(lon1, lon2) / 0.25e0) AS BIGINT), CAST(floor(greatest(lon1, lon2) / 0.25e0) AS BIGINT) + 1)) AS cx FROM x_hops),
        LATERAL (SELECT unnest(range(CAST(floor(least(lat1, lat2) / 0.25e0) AS BIGINT), CAST(floor(greatest(lat1, lat2) / 0.25e0) AS BIGINT) + 1)) AS cy)""")
add("g21_population_layer", lambda T: sp.population_layer(T.areas).drop("geom"),
    f"SELECT CAST(id AS BIGINT) AS id, {r('population_density', 'population_density')}, {r('a', 'area_km2')} FROM x_areas WHERE population_density > 0")
add("g22_poi_layer",
    lambda T: sp.poi_layer(T.stops.select(F.col("stop_name").alias("name"), F.col("stop_id").alias("team"), F.col("stop_lat").alias("latitude"), F.col("stop_lon").alias("longitude"))).drop("geom"),
    f"SELECT stop_name AS poi_name, stop_id AS team, {r('stop_lat', 'latitude')}, {r('stop_lon', 'longitude')} FROM x_stops")

# ---- moving points ------------------------------------------------------------------------
add("m01_moving_point",
    lambda T: m.moving_point(_first(T), ["trip_instance_id"], ["vehicle_id"]).select(
        "trip_instance_id", "vehicle_id", F.posexplode("trip").alias("i", "p")).select("trip_instance_id", "vehicle_id", "i", "p.t", "p.lon", "p.lat"),
    f"""SELECT trip_instance_id, vehicle_id, row_number() OVER (PARTITION BY trip_instance_id ORDER BY entity_timestamp) - 1 AS i, epoch_us(entity_timestamp) AS t,
        {r('longitude', 'lon')}, {r('latitude', 'lat')} FROM x_positions_first QUALIFY count(*) OVER (PARTITION BY trip_instance_id) > 1""")


def _first(T):
    return m.dedup_positions(T.positions, POSITION_TIES).select(
        "trip_instance_id", "vehicle_id", F.col("entity_timestamp").alias("t"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))


def _coarse(T):
    """Positions on a coarse grid, so that consecutive repeats occur."""
    return _first(T).withColumns({"lon": F.floor(F.col("lon") * 10) / 10, "lat": F.floor(F.col("lat") * 4) / 4})


add("m02_path_of",
    lambda T: m.moving_point(_coarse(T), ["trip_instance_id"]).select("trip_instance_id", F.size(m.path_of("trip")).alias("n")),
    """SELECT trip_instance_id, CAST(sum(CASE WHEN plon IS NULL OR lon <> plon OR lat <> plat THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (
         SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM (
           SELECT trip_instance_id, entity_timestamp, floor(longitude * 10) / 10 AS lon, floor(latitude * 4) / 4 AS lat FROM x_positions_first)
         WINDOW w AS (PARTITION BY trip_instance_id ORDER BY entity_timestamp)) GROUP BY 1 HAVING count(*) > 1""")
add("m03_start_time", lambda T: m.moving_point(_first(T), ["trip_instance_id"]).select("trip_instance_id", m.start_time("trip").alias("starttime")),
    "SELECT trip_instance_id, epoch_us(min(entity_timestamp)) AS starttime FROM x_positions_first GROUP BY 1 HAVING count(*) > 1")
cte("x_snapped", """
SELECT p.trip_instance_id, p.trip_id, p.route_id, p.vehicle_id, p.entity_timestamp, coalesce(n.lon, p.longitude) AS lon, coalesce(n.lat, p.latitude) AS lat
FROM x_positions_first p LEFT JOIN (
  SELECT trip_instance_id, entity_timestamp, lon, lat FROM (
    SELECT trip_instance_id, entity_timestamp, edge_no, x1 + t * dx AS lon, y1 + t * dy AS lat, pow(x1 + t * dx - longitude, 2) + pow(y1 + t * dy - latitude, 2) AS d2
    FROM (SELECT p.trip_instance_id, p.entity_timestamp, p.longitude, p.latitude, e.edge_no, e.x1, e.y1, e.dx, e.dy,
            greatest(least(((p.longitude - e.x1) * e.dx + (p.latitude - e.y1) * e.dy) / (e.dx * e.dx + e.dy * e.dy), 1), 0) AS t
          FROM x_positions_first p JOIN x_trips q ON q.trip_id = p.trip_id JOIN x_edges e ON e.line_id = 'shape:' || q.shape_id))
  QUALIFY row_number() OVER (PARTITION BY trip_instance_id, entity_timestamp ORDER BY d2, edge_no) = 1) n
  ON n.trip_instance_id = p.trip_instance_id AND n.entity_timestamp = p.entity_timestamp""")


def _snapped(T):
    first = m.dedup_positions(T.positions, POSITION_TIES).withColumn("service_date", s.service_date("start_date", "entity_timestamp"))
    return m.snap_to_lines(first, T.trips, T.shape_tracks)


add("m04_snap_positions", lambda T: _snapped(T).select("trip_instance_id", "entity_timestamp", "lon", "lat"),
    f"SELECT trip_instance_id, epoch_us(entity_timestamp) AS entity_timestamp, {r('lon', 'lon')}, {r('lat', 'lat')} FROM x_snapped")


def _flat_trips(df):
    return df.select("trip_instance_id", "trip_id", "route_id", F.col("service_date").cast("string").alias("service_date"), "vehicle_id", "starttime",
                     F.size("trip").alias("n"), F.aggregate("trip", F.lit(0.0), lambda a, p: a + p["lon"] + p["lat"]).alias("checksum"))


cte("x_actual", f"""
SELECT trip_instance_id, min(trip_id) AS trip_id, min(route_id) AS route_id, min(strftime(entity_timestamp, '%Y-%m-%d')) AS service_date, min(vehicle_id) AS vehicle_id,
  epoch_us(min(entity_timestamp)) AS starttime, count(*) AS n, {r('sum(lon + lat)', 'checksum', 4)} FROM x_snapped GROUP BY 1 HAVING count(*) > 1""")
add("m05_actual_trajectories",
    lambda T: _flat_trips(m.actual_trajectories(T.positions, T.trips, T.shape_tracks, START, END, ties=POSITION_TIES)),
    "SELECT * FROM x_actual", checksum=4)
add("m06_matched_trajectories", lambda T: _matched(T),
    f"""SELECT a.trip_instance_id, a.trip_id, a.route_id, a.service_date, a.vehicle_id, a.starttime, a.n, a.checksum,
        CASE WHEN CAST(a.vehicle_id AS BIGINT) % 2 = 0 THEN CAST(2 AS BIGINT) ELSE NULL END AS shape_points FROM x_actual a""", checksum=4)


def _matched(T):
    rows = _snapped(T).select("trip_instance_id", "trip_id", "route_id", "service_date", "vehicle_id", "entity_timestamp", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    even = F.col("vehicle_id").cast("long") % 2 == 0
    shapes = rows.where(even).select("trip_instance_id", F.array(g.make_point(F.lit(0.0), F.lit(0.0)), g.make_point(F.lit(1.0), F.lit(1.0))).alias("shape")).distinct()
    out = m.matched_trajectories(rows, shapes)
    size = F.when(F.col("path")[0]["lon"] == 0.0, F.size("path"))
    return _flat_trips(out).join(out.select("trip_instance_id", size.alias("shape_points")), "trip_instance_id")


cte("x_days", """
SELECT DISTINCT service_id, date FROM (
  SELECT c.service_id, CAST(d AS DATE) AS date FROM x_calendar c, LATERAL (SELECT unnest(generate_series(c.start_date, c.end_date, INTERVAL 1 DAY)) AS d)
  WHERE (CAST(c.service_id AS INTEGER) + extract(dow FROM d)) % 3 <> 0
  UNION SELECT service_id, date FROM x_calendar_dates WHERE exception_type = 1)
WHERE date NOT IN (SELECT date FROM x_calendar_dates WHERE exception_type = 2)""")
cte("x_scheduled", """
SELECT p.trip_id, p.route_id, d.date, p.lon, p.lat, epoch_us(CAST(d.date AS TIMESTAMP)) + CAST(round(p.secs * 1e6) AS BIGINT) AS t
FROM x_points p JOIN x_days d ON d.service_id = p.service_id WHERE d.date = (SELECT min(date) FROM x_days)
QUALIFY row_number() OVER (PARTITION BY p.trip_id, p.route_id, d.date, p.secs ORDER BY p.i, p.stop1_sequence) = 1""")
add("m07_scheduled_trajectories",
    lambda T: pt.scheduled_trajectories(T.points, T.service_days).select(
        "trip_id", "route_id", "date", F.size("trip").alias("n"), F.size("path").alias("path_points"), F.date_trunc("second", "starttime").alias("starttime")),
    """SELECT trip_id, route_id, strftime(date, '%Y-%m-%d') AS date, count(*) AS n, CAST(sum(CASE WHEN lon = plon AND lat = plat THEN 0 ELSE 1 END) AS BIGINT) AS path_points,
       min(t) // 1000000 * 1000000 AS starttime
       FROM (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM x_scheduled WINDOW w AS (PARTITION BY trip_id, route_id, date ORDER BY t))
       GROUP BY trip_id, route_id, date HAVING count(*) > 1""")

# ---- spatial joins ------------------------------------------------------------------------
cte("x_bus_stops", """SELECT DISTINCT st.stop_id FROM x_stop_times st JOIN x_trips t ON t.trip_id = st.trip_id JOIN x_routes r ON r.route_id = t.route_id WHERE r.route_type = '3'""")
cte("x_near", f"""
SELECT * FROM (SELECT p.*, s.stop_id, s.stop_name, {sphere('p.longitude', 'p.latitude', 's.stop_lon', 's.stop_lat')} AS d, {dist('p.longitude', 'p.latitude', 's.stop_lon', 's.stop_lat')} AS e
  FROM x_pois p CROSS JOIN x_stops s)""")
cte("x_proximity", "SELECT * FROM x_near WHERE d <= 600 AND stop_id IN (SELECT stop_id FROM x_bus_stops)")


def _proximity(T):
    return sp.poi_proximity(T.pois, T.stops, T.stop_times, T.trips, T.routes)


def _near_routes(T):
    return sp.routes_near_pois(T.pois, T.stops, T.stop_times, T.trips, T.routes)


add("j09_near_points", lambda T: _proximity(T).select("poi_name", "team", "stop_id", "stop_name", "distance_m"),
    f"SELECT name AS poi_name, team, stop_id, stop_name, {r('d', 'distance_m', 3)} FROM x_proximity", distance_m=3)
cte("x_near_routes", """
SELECT DISTINCT n.poi_id, n.name, n.team, n.longitude, n.latitude, t.route_id FROM x_near n JOIN x_stop_times st ON st.stop_id = n.stop_id JOIN x_trips t ON t.trip_id = st.trip_id
JOIN x_routes r ON r.route_id = t.route_id WHERE n.e <= 600 AND r.route_type = '3'""")
add("j10_dwithin", lambda T: _near_routes(T).select("poi_id", "name", "route_id"), "SELECT CAST(poi_id AS BIGINT) AS poi_id, name, route_id FROM x_near_routes")
add("j11_line_polygon_intersects",
    lambda T: T.areas.select("id").join(sp.line_polygon_intersects(sp.distinct_segments(T.segments, T.routes), sp.LINE, sp.area_cover(T.areas, "id"), "id"), "id", "left").select("id", "segment_id"),
    "SELECT CAST(a.id AS BIGINT) AS id, segment_id FROM x_areas a LEFT JOIN x_inside i ON i.id = a.id")
# disc clipping by its 32 half-planes: vertices run clockwise, so inside is to the right
cte("x_near_disc", f"""
SELECT poi_id, segment_id, geom, any_value(copies) AS copies,
  sum({dist('pax + (pbx - pax) * t0', 'pay + (pby - pay) * t0', 'pax + (pbx - pax) * t1', 'pay + (pby - pay) * t1')}) AS m FROM (
  SELECT poi_id, segment_id, geom, copies, pax, pay, pbx, pby, greatest(0, max(CASE WHEN den < 0 THEN num / den END)) AS t0, least(1, min(CASE WHEN den > 0 THEN num / den END)) AS t1,
    bool_or(den = 0 AND num < 0) AS outside
  FROM (SELECT h.poi_id, l.*, (h.ex * (l.pby - l.pay) - h.ey * (l.pbx - l.pax)) AS den, -(h.ex * (l.pay - h.lat) - h.ey * (l.pax - h.lon)) AS num
        FROM (SELECT a.poi_id, a.lon, a.lat, b.lon - a.lon AS ex, b.lat - a.lat AS ey FROM x_disc a JOIN x_disc b ON b.poi_id = a.poi_id AND b.k = (a.k + 1) % 32) h, x_line_edges l)
  GROUP BY poi_id, segment_id, geom, copies, pax, pay, pbx, pby) WHERE NOT outside AND t0 <= t1 GROUP BY poi_id, segment_id, geom""")
add("j12_poi_buffer_intersects",
    lambda T: sp.poi_buffer_intersects(T.pois, T.usage, T.routes).select("poi_id", "segment_id", "copies", "inside_m"),
    f"SELECT CAST(p.poi_id AS BIGINT) AS poi_id, segment_id, copies, {r('m', 'inside_m', 3)} FROM x_pois p LEFT JOIN x_near_disc n ON n.poi_id = p.poi_id", **D3)
cte("x_dense", "SELECT * FROM x_areas WHERE population_density > (SELECT quantile_cont(population_density, 0.75) FROM x_areas)")
cte("x_through", "SELECT DISTINCT i.id, s.route_id FROM x_inside i JOIN x_bus_segments s ON s.stop1_id || s.stop2_id = i.segment_id AND s.geom = i.geom JOIN x_dense d ON d.id = i.id")
cte("x_route_stats", "SELECT route_id, count(DISTINCT stop1_id || stop2_id) AS segs, sum(seg_length) / 1000 AS km FROM x_segments GROUP BY 1")
cte("x_links", f"""
SELECT n.poi_id, n.name, n.team, d.id, d.population_density, d.pop, n.route_id, coalesce(q.segs, 0) AS segs, coalesce(q.km, 0) AS km,
  {sphere('n.longitude', 'n.latitude', '((d.x1 + d.x2) / 2)', '((d.y1 + d.y2) / 2)')} AS d_m
FROM x_near_routes n JOIN x_through t ON t.route_id = n.route_id JOIN x_dense d ON d.id = t.id LEFT JOIN x_route_stats q ON q.route_id = n.route_id""")


def _links(T):
    dense = sp.high_density_areas(T.areas)
    return sp.poi_area_connectivity(_near_routes(T), sp.routes_through_areas(T.usage, T.routes, dense), dense, T.usage)


add("j13_poi_area_connectivity",
    lambda T: _links(T).select("poi_id", "area_id", "route_id", "population", "connecting_segments", "direct_route_length_km", "distance_m"),
    f"""SELECT CAST(poi_id AS BIGINT) AS poi_id, CAST(id AS BIGINT) AS area_id, route_id, {r('pop', 'population')}, segs AS connecting_segments, {r('km', 'direct_route_length_km', 4)},
        {r('d_m', 'distance_m', 2)} FROM x_links""", direct_route_length_km=4, distance_m=2)
add("j15_exists_bus_service", lambda T: sp.exists_bus_service(T.stops, T.stop_times, T.trips, T.routes).select("stop_id"),
    "SELECT stop_id FROM x_stops WHERE stop_id IN (SELECT stop_id FROM x_bus_stops)")
cte("x_access", """
SELECT p.name AS poi_name, p.team, count(DISTINCT p.stop_id) AS stops_600m, count(DISTINCT t.route_id) AS unique_routes_600m, count(DISTINCT t.trip_id) AS trips_per_day, min(p.d) AS nearest
FROM x_proximity p JOIN x_stop_times st ON st.stop_id = p.stop_id JOIN x_trips t ON t.trip_id = st.trip_id JOIN x_routes r ON r.route_id = t.route_id WHERE r.route_type = '3' GROUP BY 1, 2""")
add("a21_poi_access", lambda T: sp.poi_access(_proximity(T), T.stop_times, T.trips, T.routes),
    f"SELECT poi_name, team, stops_600m, unique_routes_600m, trips_per_day, {r('nearest', 'nearest_stop_distance_m', 3)} FROM x_access", nearest_stop_distance_m=3)
add("a22_stop_poi_count", lambda T: sp.stop_poi_count(_proximity(T)).select("poi_name", "stop_id", "poi_count"),
    """SELECT p.name AS poi_name, p.stop_id, c.n AS poi_count FROM x_proximity p JOIN (SELECT stop_id, count(DISTINCT name) AS n FROM x_proximity GROUP BY 1) c ON c.stop_id = p.stop_id""")
cte("x_stats", """
SELECT l.poi_id, l.name, l.team, count(DISTINCT id) FILTER (segs > 0) AS areas, sum(CASE WHEN segs > 0 THEN pop ELSE 0 END) AS people, avg(population_density) FILTER (segs > 0) AS avg_d,
  max(population_density) FILTER (segs > 0) AS max_d, CAST(sum(segs) AS BIGINT) AS segs, sum(km) AS km, avg(d_m) AS avg_m, min(d_m) AS min_m, any_value(u.people_once) AS people_once
FROM x_links l JOIN (SELECT poi_id, sum(p) AS people_once FROM (SELECT DISTINCT poi_id, id, pop AS p FROM x_links) GROUP BY 1) u ON u.poi_id = l.poi_id GROUP BY 1, 2, 3""")
STATS = (f"CAST(poi_id AS BIGINT) AS poi_id, name AS poi_name, team, areas AS num_high_density_areas_connected, {r('people', 'total_population_connected')}, {r('avg_d', 'avg_density_connected', 3)}, "
         f"{r('max_d', 'max_density_connected', 3)}, segs AS total_connecting_segments, {r('km', 'total_route_length_km', 3)}, {r('avg_m', 'avg_distance_to_dense_areas_m', 3)}, "
         f"{r('min_m', 'nearest_dense_area_distance_m', 3)}, {r('people_once', 'population_distinct')}")
SD = {"avg_density_connected": 3, "max_density_connected": 3, "total_route_length_km": 3, "avg_distance_to_dense_areas_m": 3, "nearest_dense_area_distance_m": 3}
add("a23_poi_connectivity_stats", lambda T: sp.poi_connectivity_stats(T.connectivity), f"SELECT {STATS} FROM x_stats", **SD)
SCORE = r("CASE WHEN people > 0 THEN segs / (people / 1e6) ELSE 0 END", "connectivity_score_segments_per_million", 4)
add("a24_connectivity_score", lambda T: sp.connectivity_score(sp.poi_connectivity_stats(T.connectivity)).select("poi_id", "connectivity_score_segments_per_million"),
    f"SELECT CAST(poi_id AS BIGINT) AS poi_id, {SCORE} FROM x_stats", connectivity_score_segments_per_million=4)
cte("x_coverage", """
SELECT a.id, a.population_density, a.pop, a.a, count(DISTINCT i.segment_id) AS segs, coalesce(sum(i.m) / 1000, 0) AS km, coalesce(sum(i.m) / 1000, 0) / nullif(a.a, 0) AS density
FROM x_areas a LEFT JOIN x_inside i ON i.id = a.id GROUP BY 1, 2, 3, 4""")


def _coverage(T):
    return sp.population_coverage(T.segments, T.routes, T.areas)


add("a25_population_coverage", lambda T: _coverage(T),
    f"""SELECT CAST(id AS BIGINT) AS id, {r('population_density', 'population_density', 4)}, {r('a', 'area_km2', 4)}, segs AS num_segments, {r('km', 'route_length_km', 4)},
        {r('density', 'route_density_km_per_km2', 5)} FROM x_coverage""", population_density=4, area_km2=4, route_length_km=4, route_density_km_per_km2=5)
add("a37_density_category_stats", lambda T: sp.density_category_stats(T.coverage).select("density_category", "mean_route_density", "mean_segments", "mean_population_density"),
    f"""SELECT c.density_category, {r('avg(density)', 'mean_route_density', 4)}, {r('avg(segs)', 'mean_segments', 4)}, {r('avg(population_density)', 'mean_population_density', 3)}
        FROM (VALUES ('Low (<1k)'), ('Medium (1k-5k)'), ('High (5k-10k)'), ('Very High (>10k)')) c(density_category)
        LEFT JOIN x_coverage ON {DENSITY_SQL('population_density')} = c.density_category GROUP BY 1""", mean_route_density=4, mean_segments=4, mean_population_density=3)
add("a38_correlation", lambda T: sp.correlation(T.coverage, "population_density", "route_density_km_per_km2"),
    f"SELECT {r('covar_pop(population_density, density) / nullif(stddev_pop(population_density) * stddev_pop(density), 0)', 'correlation')} FROM x_coverage")
add("a38_correlation_connected", lambda T: sp.correlation(sp.poi_connectivity_stats(T.connectivity), "total_population_connected", "total_connecting_segments"),
    f"SELECT {r('covar_pop(people, segs) / nullif(stddev_pop(people) * stddev_pop(segs), 0)', 'correlation')} FROM x_stats")
add("a39_quantile_trim", lambda T: sp.quantile_trim(T.coverage, ["population_density", "route_density_km_per_km2"]).select("id"),
    """SELECT CAST(id AS BIGINT) AS id FROM x_coverage WHERE population_density < (SELECT quantile_cont(population_density, 0.95) FROM x_coverage)
       AND density < (SELECT quantile_cont(density, 0.95) FROM x_coverage)""")
add("a43_transit_coverage_flags", lambda T: sp.coverage_flags(T.coverage),
    "SELECT count(*) AS areas, count(*) FILTER (segs > 0) AS with_transit, count(*) FILTER (segs = 0) AS without_transit FROM x_coverage")
