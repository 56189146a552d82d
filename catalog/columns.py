"""Scalar columns, predicates and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import DAY, PERIOD, add, cte, local, r
from transitloom.functions import scalars as s
from transitloom.operators import layers as y
from transitloom.operators import moving as m
from transitloom.operators import realtime as rt
from transitloom.operators import timetable as t

cte("x_raw_times", """
SELECT trip_id, stop_sequence, stop_id, arrival_seconds AS secs, CAST(trip_id AS BIGINT) % 3 AS kind,
  CAST(arrival_seconds // 3600 AS VARCHAR) AS h, lpad(CAST(arrival_seconds // 3600 AS VARCHAR), 2, '0') AS hh,
  lpad(CAST(arrival_seconds % 3600 // 60 AS VARCHAR), 2, '0') AS mm, lpad(CAST(arrival_seconds % 60 AS VARCHAR), 2, '0') AS ss
FROM x_stop_times""")

add("p01_filter_bbox", lambda T: t.filter_bbox(T.stops).select("stop_id"),
    "SELECT stop_id FROM x_stops WHERE stop_lon BETWEEN -123.3 AND -122.3 AND stop_lat BETWEEN 49.0 AND 49.5")
add("p02_bus_only", lambda T: t.bus_only(T.trips, T.routes).select("trip_id", "route_id"),
    "SELECT trip_id, t.route_id FROM x_trips t JOIN x_routes r ON r.route_id = t.route_id WHERE route_type = '3'")
add("p03_normalise_time",
    lambda T: T.raw["stop_times"].select("trip_id", "stop_sequence", s.normalise_time("arrival_time").alias("arrival_time")),
    """SELECT trip_id, CAST(stop_sequence AS VARCHAR) AS stop_sequence,
       CASE WHEN kind = 2 THEN hh || ':' || mm || ':00' ELSE hh || ':' || mm || ':' || ss END AS arrival_time FROM x_raw_times""")
add("p04_service_seconds",
    lambda T: T.raw["stop_times"].select("trip_id", "stop_sequence", s.service_seconds(s.normalise_time("arrival_time")).alias("seconds")),
    """SELECT trip_id, CAST(stop_sequence AS VARCHAR) AS stop_sequence,
       CAST(CASE WHEN kind = 2 THEN secs - secs % 60 ELSE secs END AS BIGINT) AS seconds FROM x_raw_times""")
add("p05_route_filter",
    lambda T: t.route_filter(T.trips, T.routes, ids=[" 3 ", ""], short_names=["CANADA", "BRAZIL", "no such route"]).select("trip_id", "route_id"),
    """SELECT trip_id, route_id FROM x_trips WHERE route_id = '3'
       OR route_id IN (SELECT route_id FROM x_routes WHERE route_short_name IN ('CANADA', 'BRAZIL', 'no such route'))""")
add("p06_parse_service_date",
    lambda T: T.read("orders").select("o_orderkey", s.parse_service_date(
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("20241399")).when(F.col("o_orderkey") % 9 == 1, F.lit("not a date"))
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd"))).alias("service_date")),
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS service_date FROM orders""")
add("p07_trip_instance_id",
    lambda T: T.read("events").select("event_id", s.trip_instance_id(
        F.when(F.col("event_id") % 5 != 0, (F.col("user_id") * 3).cast("string")),
        F.when(F.col("event_id") % 5 != 0, F.to_date("ts")),
        F.when(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "HH:mm:ss"))),
        F.when(F.col("event_id") % 35 != 0, F.col("user_id").cast("string")),
        F.col("ts").cast("timestamp")).alias("trip_instance_id")),
    """SELECT event_id, CASE
         WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN CAST(user_id * 3 AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') || '_' || strftime(ts, '%H%M%S')
         WHEN event_id % 5 <> 0 THEN CAST(user_id * 3 AS VARCHAR) || '_' || strftime(ts, '%Y%m%d')
         WHEN event_id % 35 <> 0 THEN CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%dT%H%M%S')
         ELSE 'trip_' || strftime(ts, '%Y%m%dT%H%M%S') END AS trip_instance_id FROM events""")
add("p08_entity_time",
    lambda T: T.read("events").select("event_id", s.entity_time(
        F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("event_id") + 1704067200),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id") + 1704000000),
        fallback=F.timestamp_seconds(F.lit(1700000000))).alias("entity_time")),
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id + 1704067200 WHEN event_id % 2 = 0 THEN event_id + 1704000000
       ELSE 1700000000 END * 1000000 AS entity_time FROM events""")
add("p09_time_window",
    lambda T: _window(T),
    """SELECT tie1, trip_instance_id FROM x_positions WHERE trip_instance_id IS NOT NULL
       AND entity_timestamp BETWEEN TIMESTAMP '2024-01-08 06:00:00' AND TIMESTAMP '2024-01-08 09:00:00'""")
add("p10_service_date",
    lambda T: T.read("orders").select("o_orderkey", s.service_date(
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("2024-01-08").cast("date")), F.col("o_orderdate").cast("timestamp")).alias("service_date")),
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '2024-01-08' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS service_date FROM orders""")
add("p11_local_hour_dow",
    lambda T: T.read("events").select("event_id", s.local_hour(F.col("ts").cast("timestamp")).alias("hour_of_day"),
                                      s.local_dow(F.col("ts").cast("timestamp")).alias("day_of_week")),
    f"SELECT event_id, {local('epoch(ts)')} FROM events")
add("p12_day_type",
    lambda T: T.read("events").select("event_id", s.day_type(s.local_dow(F.col("ts").cast("timestamp"))).alias("day_type")),
    f"SELECT event_id, {DAY} AS day_type FROM (SELECT event_id, {local('epoch(ts)')} FROM events)")
add("p13_time_period",
    lambda T: T.read("events").select("event_id", s.time_period(s.local_hour(F.col("ts").cast("timestamp"))).alias("time_period")),
    f"SELECT event_id, {PERIOD} AS time_period FROM (SELECT event_id, {local('epoch(ts)')} FROM events)")
add("p14_speed_kmh",
    lambda T: T.read("lineitem").select("l_orderkey", "l_linenumber", s.speed_kmh(F.col("l_extendedprice"), F.floor(F.col("l_quantity") / 10)).alias("speed")),
    f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {r('l_extendedprice / nullif(floor(l_quantity / 10), 0) * 3.6', 'speed', 3)} FROM lineitem", speed=3)
add("p15_epoch_diff",
    lambda T: T.read("lineitem").join(T.read("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", s.epoch_diff(F.col("l_shipdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp")).alias("seconds")),
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, {r('CAST(epoch_us(l_shipdate) - epoch_us(o_orderdate) AS DOUBLE) / 1e6', 'seconds')}
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
add("p16_segment_key",
    lambda T: T.segments.select("trip_id", "stop1_sequence", s.segment_key("stop1_id", "stop2_id").alias("segment_key"),
                                s.segment_key("route_id", "stop1_sequence", "stop2_sequence").alias("sequence_key")),
    """SELECT trip_id, CAST(stop1_sequence AS BIGINT) AS stop1_sequence, stop1_id || stop2_id AS segment_key,
       route_id || stop1_sequence || stop2_sequence AS sequence_key FROM x_segments""")
_edge = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} <= -7 THEN '{1[0]}' WHEN {0} <= -3 THEN '{1[1]}' WHEN {0} <= 3 THEN '{1[2]}' WHEN {0} <= 7 THEN '{1[3]}' ELSE '{1[4]}' END"
SEVERITY_SQL = lambda c: _edge.format(c, s.DELAY_SEVERITY)
CATEGORY_SQL = lambda c: _edge.format(c, s.DELAY_CATEGORY)
HEADWAY_SQL = lambda c: ("CASE WHEN {0} IS NULL OR {0} <= 0 THEN NULL WHEN {0} <= 3 THEN '{1[0]}' WHEN {0} <= 10 THEN '{1[1]}' "  # noqa: E731
                         "WHEN {0} <= 20 THEN '{1[2]}' ELSE '{1[3]}' END").format(c, s.HEADWAY_CATEGORY)
DENSITY_SQL = lambda c: ("CASE WHEN {0} IS NULL OR {0} <= 0 THEN NULL WHEN {0} <= 1000 THEN '{1[0]}' WHEN {0} <= 5000 THEN '{1[1]}' "  # noqa: E731
                         "WHEN {0} <= 10000 THEN '{1[2]}' ELSE '{1[3]}' END").format(c, s.DENSITY_CATEGORY)
add("p17_bin_right_closed",
    lambda T: T.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        s.bin_right_closed(F.col("l_quantity") - 25, s.DELAY_EDGES, s.DELAY_SEVERITY).alias("severity"),
        s.bin_right_closed(F.col("l_quantity") - 25, s.DELAY_EDGES, s.DELAY_CATEGORY).alias("category"),
        s.headway_category(F.col("l_quantity") - 5).alias("headway"),
        s.bin_right_closed(F.col("l_extendedprice") / 8 - 200, s.DENSITY_EDGES, s.DENSITY_CATEGORY, low=0.0).alias("density")),
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, {SEVERITY_SQL('(l_quantity - 25)')} AS severity, {CATEGORY_SQL('(l_quantity - 25)')} AS category,
        {HEADWAY_SQL('(l_quantity - 5)')} AS headway, {DENSITY_SQL('(l_extendedprice / 8 - 200)')} AS density FROM lineitem""")
add("p18_delay_metrics",
    lambda T: T.bus_delays.select("trip_instance_id", "from_seq", "segment_delay_seconds", "delay_per_km", "scheduled_speed_kmh",
                                  "actual_speed_kmh", "speed_reduction_pct", "delay_severity"),
    f"""SELECT trip_instance_id, CAST(stop_sequence AS BIGINT) AS from_seq, CAST(actual_seconds - scheduled_seconds AS DOUBLE) AS segment_delay_seconds,
        {r('(actual_seconds - scheduled_seconds) / (seg_length / 1000)', 'delay_per_km', 3)}, {r('scheduled_speed', 'scheduled_speed_kmh', 3)},
        {r('actual_speed', 'actual_speed_kmh', 3)}, {r('reduction', 'speed_reduction_pct', 3)}, {SEVERITY_SQL('delay_minutes')} AS delay_severity FROM x_bus_delays""",
    delay_per_km=3, scheduled_speed_kmh=3, actual_speed_kmh=3, speed_reduction_pct=3)
add("p19_speed_metrics",
    lambda T: T.bus_speeds.select("trip_instance_id", "stop_sequence", "day_type", "speed_delta_kmh", "speed_ratio"),
    f"""SELECT trip_instance_id, CAST(stop_sequence AS BIGINT) AS stop_sequence, day_type, {r('delta', 'speed_delta_kmh', 3)},
        {r('actual_speed / scheduled_speed', 'speed_ratio', 5)} FROM x_bus_speeds""", speed_delta_kmh=3, speed_ratio=5)
add("p20_outlier_filters",
    lambda T: rt.keep_headway_range(rt.keep_delay_range(rt.keep_speed_range(
        T.read("lineitem").withColumns({"x": F.col("l_quantity") * 4, "d": F.col("l_quantity") * 3 - 40, "h": F.col("l_extendedprice") / 5}), "x"), "d"), "h")
    .select("l_orderkey", "l_linenumber", "l_partkey"),
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem WHERE l_quantity * 4 > 0 AND l_quantity * 4 < 150
       AND l_quantity * 3 - 40 BETWEEN -30 AND 60 AND l_extendedprice / 5 > 0 AND l_extendedprice / 5 < 7200""")
add("p21_clip",
    lambda T: T.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s.clip(F.col("l_quantity") * 3 - 60, -30, 30).alias("clipped")),
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, greatest(least(l_quantity * 3 - 60, 30), -30) AS clipped FROM lineitem")
add("p22_mode_name",
    lambda T: T.read("orders").select("o_orderkey", s.mode_name((F.col("o_custkey") % 12).cast("string")).alias("mode")),
    """SELECT o_orderkey, CASE o_custkey % 12 WHEN 0 THEN 'Streetcar' WHEN 1 THEN 'Subway' WHEN 2 THEN 'Rail' WHEN 3 THEN 'Bus' WHEN 4 THEN 'Ferry'
       WHEN 5 THEN 'Cable' WHEN 6 THEN 'Aerial' WHEN 7 THEN 'Funicular' ELSE 'Other' END AS mode FROM orders""")
add("p23_truncate_label",
    lambda T: T.read("part").select("p_partkey", s.truncate_label("p_name", 15).alias("short"), s.truncate_label("p_type", 10, "...").alias("dotted")),
    """SELECT p_partkey, substr(p_name, 1, 15) AS short, CASE WHEN length(p_type) > 10 THEN substr(p_type, 1, 10) || '...' ELSE p_type END AS dotted FROM part""")
add("p24_on_time_flags",
    lambda T: s.on_time_flags(T.schedule).select("trip_instance_id", "stop_sequence", "on_time", "early", "late"),
    """SELECT trip_instance_id, CAST(stop_sequence AS BIGINT) AS stop_sequence, delay_minutes BETWEEN -3 AND 3 AS on_time,
       delay_minutes < -3 AS early, delay_minutes > 3 AS late FROM x_schedule""")
add("p25_overlap_proxy",
    lambda T: y.overlap_proxy(T.trips.groupBy("route_id").agg(F.countDistinct("service_id", "shape_id").alias("k"), F.count("*").alias("n")), "n")
    .select("route_id", "n", "max_overlap_percentage"),
    f"""SELECT route_id, n, {r('coalesce(greatest(least(CAST(n - min(n) OVER () AS DOUBLE) / nullif(max(n) OVER () - min(n) OVER (), 0) * 50 + 30, 80), 30), 30)', 'max_overlap_percentage')}
        FROM (SELECT route_id, count(*) AS n FROM x_trips GROUP BY 1)""")
add("p26_parse_iso",
    lambda T: T.read("events").select("event_id", s.parse_iso(
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+02:00")).otherwise(F.lit("soon"))).alias("parsed")),
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('day', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts))
       WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 7200000000 ELSE NULL END AS parsed FROM events""")
add("p27_pairs_for_routes",
    lambda T: y.pairs_for_routes(T.pairs, ["1", "2", "3", "10"]).select("route1", "route2", "overlap_percentage"),
    f"SELECT route1, route2, {r('overlap', 'overlap_percentage')} FROM x_pairs WHERE route1 IN ('1', '2', '3', '10') OR route2 IN ('1', '2', '3', '10')")


def _window(T):
    from datetime import datetime, timezone

    at = lambda hour: datetime(2024, 1, 8, hour, tzinfo=timezone.utc)
    return m.time_window(T.positions, at(6), at(9)).select("tie1", "trip_instance_id")
