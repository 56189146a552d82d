"""Equi-joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import add, cte, r
from transitloom.functions import scalars as s
from transitloom.operators import layers as y
from transitloom.operators import moving as m
from transitloom.operators import realtime as rt
from transitloom.operators import spatial as sp
from transitloom.operators import timetable as t
from transitloom.plans import timetable as pt
from transitloom.session import store_and_reload

SEQ = "CAST(stop_sequence AS BIGINT) AS stop_sequence"

add("j01_build_transit_stops", lambda T: t.transit_stops(T.trips, T.stop_times),
    f"""SELECT trip_id, route_id, service_id, shape_id, {SEQ}, stop_id, CAST(arrival_seconds AS BIGINT) AS arrival_seconds, CAST(num_stops AS BIGINT) AS num_stops
        FROM x_transit_stops""")
cte("x_kept_stops", "SELECT stop_id FROM x_stops WHERE stop_lon BETWEEN -123.3 AND -122.3 AND stop_lat BETWEEN 49.0 AND 49.5")
cte("x_kept_calls", "SELECT trip_id, stop_sequence, stop_id FROM x_stop_times WHERE stop_id IN (SELECT stop_id FROM x_kept_stops)")
cte("x_kept_trips", "SELECT * FROM x_trips WHERE trip_id IN (SELECT trip_id FROM x_kept_calls)")
cte("x_kept_sizes", """
SELECT 'agency' AS table_name, count(*) AS n FROM region WHERE CAST(r_regionkey AS VARCHAR) IN (SELECT agency_id FROM x_routes WHERE route_id IN (SELECT route_id FROM x_kept_trips))
UNION ALL SELECT 'stops', count(*) FROM x_kept_stops UNION ALL SELECT 'stop_times', count(*) FROM x_kept_calls UNION ALL SELECT 'trips', count(*) FROM x_kept_trips
UNION ALL SELECT 'routes', count(*) FROM x_routes WHERE route_id IN (SELECT route_id FROM x_kept_trips)
UNION ALL SELECT 'calendar', count(*) FROM x_calendar WHERE service_id IN (SELECT service_id FROM x_kept_trips)
UNION ALL SELECT 'calendar_dates', count(*) FROM x_calendar_dates WHERE service_id IN (SELECT service_id FROM x_kept_trips)
UNION ALL SELECT 'shapes', count(*) FROM x_shapes WHERE shape_id IN (SELECT shape_id FROM x_kept_trips)""")


def _sizes(tables):
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _referenced(T, stage=lambda df: df):
    tables = {"agency": T.agency, "stops": T.stops, "stop_times": T.stop_times, "trips": T.trips, "routes": T.routes,
              "calendar": T.calendar, "calendar_dates": T.calendar_dates, "shapes": T.shapes}
    return t.keep_referenced(tables, t.filter_bbox(T.stops).select("stop_id"), stage)


add("j02_keep_referenced", lambda T: _sizes(_referenced(T, lambda df: store_and_reload(df, "kept"))), "SELECT table_name, n FROM x_kept_sizes")
add("j02_kept_trips", lambda T: _referenced(T)["trips"].select("trip_id", "route_id"), "SELECT trip_id, route_id FROM x_kept_trips")
add("j03_valid_trips", lambda T: t.valid_trips(T.stop_times, _referenced(T)["trips"]).select("trip_id", "stop_sequence"),
    f"SELECT trip_id, {SEQ} FROM x_stop_times WHERE trip_id IN (SELECT trip_id FROM x_kept_trips)")
OBS = f"""trip_instance_id, {SEQ}, next_stop_id, CAST(scheduled_seconds AS BIGINT) AS scheduled_seconds, CAST(actual_seconds AS DOUBLE) AS actual_seconds, {r('seg_length', 'seg_length', 3)}"""
add("j04_updates_to_segments",
    lambda T: rt.updates_to_segments(rt.next_stop(T.deduped), T.segment_rows).select("trip_instance_id", "stop_sequence", "next_stop_id", "scheduled_seconds", "actual_seconds", "seg_length"),
    f"SELECT {OBS} FROM x_observed", seg_length=3)
add("j04_updates_to_segments_adjacent",
    # stops that report no delay are the gaps
    lambda T: rt.updates_to_segments(rt.next_stop(T.deduped.where("arrival_delay_seconds IS NOT NULL")), T.segment_rows, require_adjacent=True).select("trip_instance_id", "stop_sequence", "next_stop_id"),
    f"""SELECT trip_instance_id, {SEQ}, next_stop_id FROM (
          SELECT *, lead(stop_sequence) OVER w AS nseq, lead(stop_id) OVER w AS next_stop_id, lead(arrival_epoch) OVER w AS nep FROM x_deduped WHERE delay IS NOT NULL
          WINDOW w AS (PARTITION BY trip_instance_id ORDER BY stop_sequence)) n
        JOIN x_segments s ON s.trip_id = n.trip_id AND s.stop1_sequence = n.stop_sequence AND s.stop2_sequence = n.nseq
        WHERE s.seg_length > 10 AND s.scheduled_seconds > 0 AND nep - arrival_epoch > 0 AND nep - arrival_epoch < 3600""")
add("j05_attach_names",
    lambda T: rt.attach_names(rt.next_stop(T.deduped), T.routes, T.stops).select("trip_instance_id", "stop_sequence", "route_short_name", "from_stop_name", "to_stop_name", "to_lat"),
    f"""SELECT trip_instance_id, {SEQ}, route_short_name, f.stop_name AS from_stop_name, t.stop_name AS to_stop_name, {r('t.stop_lat', 'to_lat')} FROM x_next n
        LEFT JOIN x_routes r ON r.route_id = n.route_id LEFT JOIN x_stops f ON f.stop_id = n.stop_id LEFT JOIN x_stops t ON t.stop_id = n.next_stop_id""")
add("j06_attach_schedule",
    lambda T: rt.attach_schedule(T.deduped, T.transit_stops).select("trip_instance_id", "stop_sequence", "scheduled_arrival_seconds"),
    f"""SELECT trip_instance_id, CAST(d.stop_sequence AS BIGINT) AS stop_sequence, CAST(ts.arrival_seconds AS BIGINT) AS scheduled_arrival_seconds FROM x_deduped d
        LEFT JOIN x_transit_stops ts ON ts.trip_id = d.trip_id AND ts.stop_sequence = d.stop_sequence""")
add("j07_speed_with_geometry",
    lambda T: rt.speed_with_geometry(T.speeds, T.delays, T.geometries).select("trip_instance_id", "stop_sequence", F.size("geom").alias("points")),
    f"SELECT trip_instance_id, {SEQ}, coalesce(no_points, 1) AS points FROM x_observed")
add("j08_headway_with_schedule",
    lambda T: y.headway_with_schedule(T.bus_headways, T.scheduled_headways).select("route_id", "stop_id", "arrival_time", "headway_minutes", "scheduled_headway_minutes"),
    f"""SELECT h.route_id, h.stop_id, h.arrival_epoch * 1000000 AS arrival_time, {r('h.headway_minutes', 'headway_minutes')}, {r('s.scheduled_headway_minutes', 'scheduled_headway_minutes')}
        FROM x_bus_headways h LEFT JOIN x_sched_headway s ON s.route_id = h.route_id AND s.stop_id = h.stop_id""")
add("j14_route_pair_self_join",
    lambda T: y.route_pair_self_join(T.segments.select("route_id", s.segment_key("stop1_id", "stop2_id").alias("segment_id"))),
    """SELECT a.route_id AS route1, b.route_id AS route2, count(*) AS shared_segments FROM (SELECT DISTINCT route_id, stop1_id || stop2_id AS k FROM x_segments) a
       JOIN (SELECT DISTINCT route_id, stop1_id || stop2_id AS k FROM x_segments) b ON a.k = b.k AND a.route_id < b.route_id GROUP BY 1, 2""")
add("j14_route_pair_self_join_stops",
    lambda T: y.route_pair_self_join(T.updates.select("route_id", F.col("stop_id").alias("segment_id"))),
    """SELECT a.route_id AS route1, b.route_id AS route2, count(*) AS shared_segments FROM (SELECT DISTINCT route_id, stop_id AS k FROM x_updates) a
       JOIN (SELECT DISTINCT route_id, stop_id AS k FROM x_updates) b ON a.k = b.k AND a.route_id < b.route_id GROUP BY 1, 2""")
add("j16_drop_trips_with_bad_segment",
    lambda T: t.drop_trips_with_bad_segment(T.segments.withColumn("seg_geom", F.when(F.col("seg_length") > 30000, F.col("seg_geom")))).select("trip_id", "stop1_sequence"),
    """SELECT trip_id, CAST(stop1_sequence AS BIGINT) AS stop1_sequence FROM x_segments
       WHERE trip_id NOT IN (SELECT trip_id FROM x_segments WHERE seg_length <= 30000)""")
add("j17_trip_to_line_cascade", lambda T: _cascade(T),
    """SELECT p.tie1, t.shape_id IS NOT NULL AS on_shape, t.shape_id IS NULL AND b.trip_id IS NOT NULL AS on_schedule
       FROM x_positions p LEFT JOIN x_trips t ON t.trip_id = p.trip_id
       LEFT JOIN (SELECT trip_id, date FROM x_scheduled GROUP BY 1, 2 HAVING count(*) > 1) b ON b.trip_id = p.trip_id AND b.date = CAST(p.entity_timestamp AS DATE)""")


def _cascade(T):
    scheduled = pt.scheduled_tracks(pt.scheduled_trajectories(T.points, T.service_days))
    rows = T.positions.withColumn("service_date", s.service_date("start_date", "entity_timestamp"))
    out = m.trip_to_line(rows, T.trips, T.shape_tracks, scheduled)
    return out.select("tie1", F.col("shape_track").isNotNull().alias("on_shape"),
                      (F.col("shape_track").isNull() & F.col("scheduled_track").isNotNull()).alias("on_schedule"))


add("j18_points_to_dates",
    lambda T: _dated(T),
    """SELECT p.trip_id, CAST(p.stop1_sequence AS BIGINT) AS stop1_sequence, p.i AS point_sequence, strftime(d.date, '%Y-%m-%d') AS date,
       round((epoch_us(CAST(d.date AS TIMESTAMP)) + CAST(round(p.secs * 1e6) AS BIGINT)) / 1e6, 3) + 0.0 AS t
       FROM x_points p JOIN x_days d ON d.service_id = p.service_id WHERE d.date = (SELECT min(date) FROM x_days)""", t=3)


def _dated(T):
    rows = pt.points_to_dates(T.points, T.service_days)
    return rows.select("trip_id", "stop1_sequence", "point_sequence", "date", (F.unix_micros("t") / 1e6).alias("t"))


cte("x_regular", """
SELECT c.service_id, CAST(d AS DATE) AS date FROM x_calendar c, LATERAL (SELECT unnest(generate_series(c.start_date, c.end_date, INTERVAL 1 DAY)) AS d)
WHERE (CAST(c.service_id AS INTEGER) + extract(dow FROM d)) % 3 <> 0""")
ISO = "strftime(date, '%Y-%m-%d') AS date"
add("j19_expand_calendar", lambda T: t.expand_calendar(T.calendar), f"SELECT service_id, {ISO} FROM x_regular")
ADDED = "SELECT service_id, date FROM x_calendar_dates WHERE exception_type = 1"
add("u01_union_service_days", lambda T: t.union_service_days(t.expand_calendar(T.calendar), T.calendar_dates.where("exception_type = 1")),
    f"SELECT service_id, {ISO} FROM (SELECT service_id, date FROM x_regular UNION {ADDED})")
add("u02_except_removed_days", lambda T: t.except_removed_days(t.expand_calendar(T.calendar), T.calendar_dates.where("exception_type = 2")),
    f"SELECT service_id, {ISO} FROM x_regular WHERE date NOT IN (SELECT date FROM x_calendar_dates WHERE exception_type = 2)")
add("u02_except_removed_days_by_service",
    lambda T: t.except_removed_days(t.expand_calendar(T.calendar), T.calendar_dates.where("exception_type = 2"), "service"),
    f"""SELECT service_id, {ISO} FROM x_regular q WHERE NOT EXISTS
        (SELECT 1 FROM x_calendar_dates c WHERE c.exception_type = 2 AND c.service_id = q.service_id AND c.date = q.date)""")
add("u03_distinct_on",
    lambda T: t.distinct_on(T.updates.select("route_id", "stop_id", "arrival_time", "trip_id", "tie1", "tie2"), ["route_id", "stop_id", "arrival_time"], ["trip_id", "tie1", "tie2"])
    .select("route_id", "stop_id", "arrival_time", "trip_id"),
    """SELECT route_id, stop_id, arrival_epoch * 1000000 AS arrival_time, min(trip_id) AS trip_id FROM x_updates GROUP BY route_id, stop_id, arrival_epoch""")
add("u04_distinct_segments", lambda T: sp.distinct_segments(T.segments, T.routes).select("segment_id", "copies"),
    "SELECT stop1_id || stop2_id AS segment_id, count(*) AS copies FROM x_bus_segments GROUP BY stop1_id || stop2_id, geom")
add("u05_inline_values",
    lambda T: T.routes.join(T.spark.createDataFrame(list(s.REPORT_MODE_NAMES.items()), "route_type string, mode string"), "route_type", "left").select("route_id", "mode"),
    "SELECT route_id, CASE route_type WHEN '1' THEN 'subway' WHEN '3' THEN 'bus' END AS mode FROM x_routes")
