"""Composite views and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import add, r
from catalog.shapes import SCORE, SD, STATS
from transitloom.operators import layers as y
from transitloom.operators import realtime as rt
from transitloom.plans import layers as pl
from transitloom.plans import timetable as pt
from transitloom.session import store_and_reload

SEQ = "CAST(stop_sequence AS BIGINT) AS stop_sequence"


def _cleaned(T):
    from catalog.joins import _sizes

    return pt.clean_timetable(T.raw, stage=lambda df: store_and_reload(df, "kept")), _sizes


add("v01_clean_timetable", lambda T: (lambda c, sizes: sizes(c))(*_cleaned(T)), "SELECT table_name, n FROM x_kept_sizes")
add("v01_clean_timetable_stop_times", lambda T: _cleaned(T)[0]["stop_times"].select("trip_id", "stop_sequence", "stop_id", "arrival_time"),
    """SELECT k.trip_id, CAST(k.stop_sequence AS VARCHAR) AS stop_sequence, k.stop_id, CASE WHEN kind = 2 THEN hh || ':' || mm || ':00' ELSE hh || ':' || mm || ':' || ss END AS arrival_time
       FROM x_kept_calls k JOIN x_raw_times t ON t.trip_id = k.trip_id AND t.stop_sequence = k.stop_sequence""")
ISO = "strftime(date, '%Y-%m-%d') AS date"
add("v02_service_dates", lambda T: pt.service_dates(T.calendar, T.calendar_dates), f"SELECT service_id, {ISO} FROM x_days")
add("v02_service_dates_by_service", lambda T: pt.service_dates(T.calendar, T.calendar_dates, "service"),
    f"""SELECT service_id, {ISO} FROM (SELECT service_id, date FROM x_regular UNION SELECT service_id, date FROM x_calendar_dates WHERE exception_type = 1) q
        WHERE NOT EXISTS (SELECT 1 FROM x_calendar_dates c WHERE c.exception_type = 2 AND c.service_id = q.service_id AND c.date = q.date)""")
add("v03_route_segments",
    lambda T: pt.route_segments(T.trips, T.stop_times, T.stops, T.shapes, T.stage).select(
        "trip_id", "route_id", "service_id", "stop1_sequence", "stop2_sequence", "stop1_id", "stop2_id", "stop1_arrival", "stop2_arrival", "perc1", "perc2", "seg_length", "no_points"),
    f"""SELECT trip_id, route_id, service_id, CAST(stop1_sequence AS BIGINT) AS stop1_sequence, CAST(stop2_sequence AS BIGINT) AS stop2_sequence, stop1_id, stop2_id,
        CAST(stop1_arrival AS BIGINT) AS stop1_arrival, CAST(stop2_arrival AS BIGINT) AS stop2_arrival, {r('perc1', 'perc1')}, {r('perc2', 'perc2')}, {r('seg_length', 'seg_length', 3)}, no_points
        FROM x_segments""", seg_length=3)
add("v04_trip_points", lambda T: pt.trip_points(T.segments),
    f"""SELECT trip_id, route_id, service_id, CAST(stop1_sequence AS BIGINT) AS stop1_sequence, i AS point_sequence, {r('lon', 'lon')}, {r('lat', 'lat')}, {r('secs', 'point_arrival', 4)}
        FROM x_points""", point_arrival=4)
V5 = {"segment_length_m": 3, "scheduled_speed_kmh": 3, "actual_speed_kmh": 3}
add("v05_speed_comparison",
    lambda T: rt.speed_comparison(T.deduped, T.segments, T.routes, T.stops).select(
        "trip_instance_id", "stop_sequence", "next_stop_sequence", "stop_id", "next_stop_id", "route_short_name", "from_stop_name", "to_stop_name", "segment_length_m",
        "scheduled_seconds", "actual_seconds", "arrival_delay_seconds", "hour_of_day", "day_of_week", "scheduled_speed_kmh", "actual_speed_kmh"),
    f"""SELECT trip_instance_id, {SEQ}, CAST(next_sequence AS BIGINT) AS next_stop_sequence, stop_id, next_stop_id, route_short_name, from_stop_name, to_stop_name,
        {r('seg_length', 'segment_length_m', 3)}, CAST(scheduled_seconds AS BIGINT) AS scheduled_seconds, CAST(actual_seconds AS DOUBLE) AS actual_seconds,
        delay AS arrival_delay_seconds, hour_of_day, day_of_week, {r('scheduled_speed', 'scheduled_speed_kmh', 3)}, {r('actual_speed', 'actual_speed_kmh', 3)} FROM x_observed""", **V5)
add("v06_delay_analysis",
    lambda T: rt.delay_analysis(T.deduped, T.segments, T.routes, T.stops).select(
        "trip_instance_id", "from_seq", "to_seq", "from_stop_id", "to_stop_id", "from_stop_name", "to_stop_name", "from_lat", "from_lon", "to_lat", "to_lon", "segment_length_m",
        "scheduled_seconds", "actual_seconds", "from_delay", "to_delay", "segment_delay_change", "segment_delay_minutes", "hour_of_day", "day_of_week", "day_type", "time_period",
        F.size("seg_geom").alias("points")),
    f"""SELECT trip_instance_id, CAST(stop_sequence AS BIGINT) AS from_seq, CAST(next_sequence AS BIGINT) AS to_seq, stop_id AS from_stop_id, next_stop_id AS to_stop_id,
        from_stop_name, to_stop_name, {r('from_lat', 'from_lat')}, {r('from_lon', 'from_lon')}, {r('to_lat', 'to_lat')}, {r('to_lon', 'to_lon')}, {r('seg_length', 'segment_length_m', 3)},
        CAST(scheduled_seconds AS BIGINT) AS scheduled_seconds, CAST(actual_seconds AS DOUBLE) AS actual_seconds, delay AS from_delay, next_delay AS to_delay,
        next_delay - delay AS segment_delay_change, {r('delay_minutes', 'segment_delay_minutes')}, hour_of_day, day_of_week, day_type, time_period, coalesce(no_points, 1) AS points FROM x_delays""",
    segment_length_m=3)
add("v07_headway_stats", lambda T: rt.headway_stats(T.updates, T.routes, T.stops).drop("route_long_name", "route_type"),
    f"""SELECT route_id, route_short_name, stop_id, stop_name, {r('stop_lat', 'stop_lat')}, {r('stop_lon', 'stop_lon')}, trip_instance_id, prev_trip AS prev_trip_instance_id,
        arrival_epoch * 1000000 AS arrival_time, prev_epoch * 1000000 AS prev_arrival, {r('headway_minutes', 'headway_minutes')}, hour_of_day, day_of_week, day_type, time_period FROM x_headways""")
add("v07_headway_stats_deduped", lambda T: rt.headway_stats(T.deduped.withColumnRenamed("actual_arrival", "arrival_time"), T.routes, T.stops).select("route_id", "stop_id", "trip_instance_id", "arrival_time", "headway_minutes"),
    f"""SELECT route_id, stop_id, trip_instance_id, arrival_epoch * 1000000 AS arrival_time, {r('(arrival_epoch - prev_epoch) / 60e0', 'headway_minutes')} FROM (
          SELECT route_id, stop_id, trip_instance_id, arrival_epoch, lag(arrival_epoch) OVER w AS prev_epoch, lag(trip_instance_id) OVER w AS prev_trip FROM x_deduped
          WINDOW w AS (PARTITION BY route_id, stop_id ORDER BY arrival_epoch, trip_instance_id, stop_sequence))
        WHERE trip_instance_id <> prev_trip AND arrival_epoch > prev_epoch AND arrival_epoch - prev_epoch < 7200""")
add("v08_schedule_times",
    lambda T: rt.schedule_times(T.deduped, T.transit_stops, T.routes, T.stops).select(
        "trip_instance_id", "stop_sequence", "stop_id", "stop_name", "route_short_name", "scheduled_arrival_seconds", "actual_arrival", "arrival_delay_seconds", "delay_minutes",
        "hour_of_day", "day_of_week", "day_type"),
    f"""SELECT trip_instance_id, {SEQ}, stop_id, stop_name, route_short_name, CAST(scheduled_arrival_seconds AS BIGINT) AS scheduled_arrival_seconds, arrival_epoch * 1000000 AS actual_arrival,
        delay AS arrival_delay_seconds, {r('delay_minutes', 'delay_minutes')}, hour_of_day, day_of_week, day_type FROM x_schedule""")
add("v09_route_layer", lambda T: pl.route_layer(T.routes, T.trips, T.segments),
    f"SELECT route_id, route_short_name, route_long_name, route_type, num_trips, num_lines, {r('total_length_km', 'total_length_km', 4)} FROM x_route_layer", total_length_km=4)
add("v09_route_lines", lambda T: pl.route_lines(T.routes, T.segments).select("route_id", "stop1_id", "stop2_id", "copies", F.size("seg_geom").alias("points")),
    """SELECT route_id, stop1_id, stop2_id, count(*) AS copies, coalesce(max(no_points), 1) AS points FROM x_bus_segments GROUP BY route_id, stop1_id, stop2_id, geom""")


def _overlay(T):
    return pl.poi_population_overlay(T.pois, T.areas, T.segments, T.stops, T.stop_times, T.trips, T.routes, T.stage)


add("v10_poi_population_overlay", _overlay,
    f"""SELECT {STATS}, {SCORE}, coalesce(n.k, 0) AS num_segments_near_poi, {r('coalesce(n.m / 1000, 0)', 'route_length_km_near_poi', 3)} FROM x_stats
        LEFT JOIN (SELECT poi_id AS pid, count(DISTINCT segment_id) AS k, sum(m * copies) AS m FROM x_near_disc GROUP BY 1) n ON n.pid = poi_id""",
    connectivity_score_segments_per_million=4, route_length_km_near_poi=3, **SD)
add("v11_connecting_routes", lambda T: pl.connecting_routes(T.pois, T.areas, T.segments, T.stops, T.stop_times, T.trips, T.routes, T.stage),
    f"""SELECT CAST(poi_id AS BIGINT) AS poi_id, l.name AS poi_name, team, CAST(id AS BIGINT) AS area_id, {r('population_density', 'population_density', 3)}, l.route_id,
        r.route_short_name, r.route_long_name, segs AS num_segments, {r('km', 'total_route_length_km', 3)} FROM x_links l JOIN x_routes r ON r.route_id = l.route_id""",
    population_density=3, total_route_length_km=3)
add("v12_route_pairs_layer", lambda T: pl.y.route_pairs_layer(T.pairs, T.routes),
    f"""SELECT route1, route2, a.route_short_name AS route1_name, b.route_short_name AS route2_name, shared AS shared_segments, total1 AS route1_total_segments, total2 AS route2_total_segments,
        {r('overlap', 'overlap_percentage')} FROM x_pairs JOIN x_routes a ON a.route_id = route1 JOIN x_routes b ON b.route_id = route2""")


def _refresh(T):
    """Build the base views and some layers into a folder; report name and size of each."""
    from transitloom.session import scratch_path
    from transitloom.sources.tables import materialise

    folder = scratch_path(T.spark, "refresh")

    def failing():
        raise RuntimeError("a layer that cannot be built")

    builders = {
        "speed_comparison": lambda: T.speeds.drop("seg_geom"),
        "headway_stats": lambda: T.headways,
        "broken": failing,
        "headway_by_stop": lambda: y.headway_by_stop(T.headways),
        "delay_by_stop": lambda: y.delay_by_stop(T.schedule),
    }
    status = pl.refresh_all(builders, lambda df, name: materialise(df, name, folder)[1])
    return T.spark.createDataFrame(list(status.items()), "layer string, status string")


add("v13_refresh_all", _refresh,
    """SELECT 'speed_comparison' AS layer, 'ok: ' || (SELECT count(*) FROM x_observed) || ' rows' AS status
       UNION ALL SELECT 'headway_stats', 'ok: ' || (SELECT count(*) FROM x_headways) || ' rows' UNION ALL SELECT 'broken', 'failed: RuntimeError: a layer that cannot be built'
       UNION ALL SELECT 'headway_by_stop', 'ok: ' || (SELECT count(*) FROM (SELECT 1 FROM x_bus_headways GROUP BY stop_id, route_short_name, stop_name, stop_lat, stop_lon HAVING count(*) >= 5)) || ' rows'
       UNION ALL SELECT 'delay_by_stop', 'ok: ' || (SELECT count(*) FROM (SELECT 1 FROM x_bus_schedule GROUP BY stop_id, route_short_name, stop_name, stop_lat, stop_lon HAVING count(*) >= 3)) || ' rows'""")
