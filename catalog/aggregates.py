"""Windows, aggregates and top-n."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.columns import CATEGORY_SQL, DENSITY_SQL, HEADWAY_SQL, SEVERITY_SQL
from catalog.registry import CTES, add, cte, r
from catalog.standins import POSITION_TIES, TIES
from transitloom.functions import scalars as s
from transitloom.functions.statistics import histogram
from transitloom.operators import layers as y
from transitloom.operators import lines as l
from transitloom.operators import metrics as k
from transitloom.operators import moving as m
from transitloom.operators import ordering as o
from transitloom.operators import realtime as rt
from transitloom.operators import spatial as sp
from transitloom.operators import timetable as t
from transitloom.plans import layers as pl
from transitloom.sources.tables import number_rows

SEQ = "CAST(stop_sequence AS BIGINT) AS stop_sequence"

# ---- windows ------------------------------------------------------------------------------
add("w01_dedup_updates",
    lambda T: rt.dedup_updates(T.updates, TIES).select("trip_instance_id", "stop_sequence", "stop_id", "actual_arrival", "arrival_delay_seconds"),
    f"SELECT trip_instance_id, {SEQ}, stop_id, arrival_epoch * 1000000 AS actual_arrival, delay AS arrival_delay_seconds FROM x_deduped")
cte("x_positions_first", """
SELECT * FROM x_positions QUALIFY row_number() OVER (PARTITION BY trip_instance_id, entity_timestamp ORDER BY fetch_timestamp, tie1) = 1""")
add("w02_dedup_positions",
    lambda T: m.dedup_positions(T.positions, POSITION_TIES).select("trip_instance_id", "entity_timestamp", "tie1"),
    "SELECT trip_instance_id, epoch_us(entity_timestamp) AS entity_timestamp, tie1 FROM x_positions_first")
add("w03_strictly_increasing",
    lambda T: m.strictly_increasing(T.positions, ["vehicle_id"], "entity_timestamp", ["tie1"]).select("vehicle_id", "entity_timestamp", "tie1"),
    "SELECT vehicle_id, epoch_us(entity_timestamp) AS entity_timestamp, min(tie1) AS tie1 FROM x_positions GROUP BY ALL")
add("w04_next_stop",
    lambda T: rt.next_stop(T.deduped).select("trip_instance_id", "stop_sequence", "next_stop_sequence", "next_stop_id", "next_actual_arrival", "next_delay_seconds"),
    f"""SELECT trip_instance_id, {SEQ}, CAST(next_sequence AS BIGINT) AS next_stop_sequence, next_stop_id,
        next_epoch * 1000000 AS next_actual_arrival, next_delay AS next_delay_seconds FROM x_next""")
add("w05_prev_vehicle",
    lambda T: rt.prev_vehicle(T.updates).select("route_id", "stop_id", "trip_instance_id", "arrival_time", "prev_arrival", "prev_trip_instance_id"),
    """SELECT route_id, stop_id, trip_instance_id, arrival_epoch * 1000000 AS arrival_time, prev_epoch * 1000000 AS prev_arrival,
       prev_trip AS prev_trip_instance_id FROM x_lagged WHERE prev_epoch IS NULL OR prev_epoch < arrival_epoch""")
add("w06_segments_lead",
    lambda T: t.segments_lead(T.transit_stops).select("trip_id", "stop1_sequence", "stop2_sequence", "stop1_id", "stop2_id", "stop1_arrival", "stop2_arrival", "num_stops"),
    """SELECT trip_id, CAST(stop1_sequence AS BIGINT) AS stop1_sequence, CAST(stop2_sequence AS BIGINT) AS stop2_sequence, stop1_id, stop2_id,
       CAST(stop1_arrival AS BIGINT) AS stop1_arrival, CAST(stop2_arrival AS BIGINT) AS stop2_arrival, CAST(num_stops AS BIGINT) AS num_stops FROM x_lead""")
cte("x_shape_runs", """
SELECT s.line_id, s.edge_no, sum(coalesce(p.m, 0)) OVER (PARTITION BY s.line_id ORDER BY s.edge_no ROWS UNBOUNDED PRECEDING) AS run
FROM x_steps s LEFT JOIN x_edge_metres p ON p.line_id = s.line_id AND p.edge_no = s.edge_no""")
add("w07_running_line",
    lambda T: l.running_length(T.shapes, ["shape_id"], "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat").select("shape_id", "shape_pt_sequence", "run_m"),
    f"""SELECT s.shape_id, CAST(s.i AS BIGINT) AS shape_pt_sequence, {r('q.run', 'run_m', 3)} FROM
        (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY i) - 1 AS n FROM x_shapes) s
        JOIN x_shape_runs q ON q.line_id = 'shape:' || s.shape_id AND q.edge_no = s.n""", run_m=3)
add("w08_share_of_total",
    lambda T: y.share_of_total(T.read("orders"), "o_orderpriority"),
    "SELECT o_orderpriority, count(*) AS qty, round(count(*) * 100e0 / sum(count(*)) OVER (), 2) AS perc FROM orders GROUP BY 1", perc=2)
add("w09_gid", lambda T: _numbered(T),
    "SELECT row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS gid, o_custkey, o_orderkey FROM orders")


def _numbered(T):
    from transitloom.sources.tables import number_rows

    return number_rows(T.read("orders").select("o_custkey", "o_orderkey"), ["-o_custkey", "o_orderkey"])


# ---- layers -------------------------------------------------------------------------------
add("a01_route_trip_counts", lambda T: t.route_trip_counts(T.trips, T.routes).select("route_id", "num_trips"),
    """SELECT r.route_id, count(DISTINCT t.trip_id) AS num_trips FROM x_routes r LEFT JOIN x_trips t ON t.route_id = r.route_id
       WHERE r.route_type = '3' GROUP BY 1""")
cte("x_density", """
SELECT stop1_id, stop2_id, stop1_id || stop2_id AS segment_id, geom, max(seg_length) AS seg_length, max(no_points) AS no_points,
  count(DISTINCT route_id) AS num_routes FROM x_bus_segments GROUP BY stop1_id, stop2_id, geom""")


def _with_line(T, layer, one="stop1_id", two="stop2_id"):
    """Attach the geometry and show its size."""
    shown = l.attach_geometry(layer, l.segment_geometries(T.segments), one, two)
    return shown.withColumn("points", F.size("geom")).drop("geom", "geom_key")


add("a02_segment_route_density",
    lambda T: _with_line(T, y.segment_route_density(T.segments, T.routes)).select("segment_id", "points", "num_routes"),
    "SELECT segment_id, coalesce(no_points, 1) AS points, num_routes FROM x_density")
add("a02_segment_route_density_all_modes",
    lambda T: y.segment_route_density(T.segments, T.routes, buses_only=False).select("segment_id", "num_routes"),
    "SELECT stop1_id || stop2_id AS segment_id, count(DISTINCT route_id) AS num_routes FROM x_segments GROUP BY stop1_id, stop2_id, geom")
add("a03_shared_segments",
    lambda T: y.shared_segments(T.segments, T.routes, 1).select("segment_id", "num_routes_sharing"),
    "SELECT segment_id, num_routes AS num_routes_sharing FROM x_density WHERE num_routes >= 1")
add("a03_shared_segments_two_routes",
    lambda T: y.shared_segments(T.segments, T.routes).select("segment_id", "num_routes_sharing"),
    "SELECT segment_id, num_routes AS num_routes_sharing FROM x_density WHERE num_routes >= 2")
add("a04_speed_segments", lambda T: y.speed_segments(T.segments, T.routes).select("segment_id", "route_id", "route_short_name", "speed_kmh"),
    f"SELECT segment_id, route_id, route_short_name, {r('speed', 'speed_kmh', 4)} FROM x_speed_layer", speed_kmh=4)
add("a05_route_speed_stats",
    lambda T: y.route_speed_stats(T.speed_layer, T.routes),
    f"""SELECT r.route_id, r.route_short_name, r.route_long_name, r.route_type, count(*) AS num_segments, {r('avg(speed)', 'avg_speed_kmh', 4)},
        {r('min(speed)', 'min_speed_kmh', 4)}, {r('max(speed)', 'max_speed_kmh', 4)}, {r('quantile_cont(speed, 0.5)', 'median_speed_kmh', 4)}
        FROM x_speed_layer q JOIN x_routes r ON r.route_id = q.route_id GROUP BY r.route_id, r.route_short_name, r.route_long_name, r.route_type""",
    avg_speed_kmh=4, min_speed_kmh=4, max_speed_kmh=4, median_speed_kmh=4)
add("a06_high_speed_segments",
    lambda T: y.high_speed_segments(T.speed_layer, 60.0, 3, digits=3),
    f"""SELECT route_id, route_short_name, {r('speed', 'speed_kmh', 3)}, count(*) AS segment_count FROM x_speed_layer WHERE speed > 60
        GROUP BY route_id, route_short_name, round(speed, 3) + 0.0 HAVING count(*) >= 3""", speed_kmh=3)
# the stand-ins have few fast segments, few pairs a route and few routes a segment: lower limits give rows to compare
add("a06_high_speed_segments_seen_once",
    lambda T: y.high_speed_segments(T.speed_layer, 60.0, 1, digits=3),
    f"""SELECT route_id, route_short_name, {r('speed', 'speed_kmh', 3)}, count(*) AS segment_count FROM x_speed_layer WHERE speed > 60
        GROUP BY route_id, route_short_name, round(speed, 3) + 0.0""", speed_kmh=3)
add("a07_speed_bands", lambda T: y.speed_bands(T.speed_layer),
    """SELECT CASE WHEN speed < 20 THEN 'slow' WHEN speed < 40 THEN 'medium' WHEN speed < 60 THEN 'fast' ELSE 'very fast' END AS band, count(*) AS qty,
       round(count(*) * 100e0 / sum(count(*)) OVER (), 2) AS perc FROM x_speed_layer GROUP BY 1""", perc=2)
STOP = "stop_id, stop_name, stop_lat, stop_lon, route_short_name"
STOP_R = f"stop_id, stop_name, {r('stop_lat', 'stop_lat')}, {r('stop_lon', 'stop_lon')}, route_short_name"
add("a08_headway_by_stop", lambda T: y.headway_by_stop(rt.headway_stats(T.updates, T.routes, T.stops)),
    f"""SELECT {STOP_R}, {r('avg(headway_minutes)', 'avg_headway')}, count(*) AS total_observations,
        count(*) FILTER (headway_minutes < 3) AS bunched_count, {r('count(*) FILTER (headway_minutes < 3) * 100e0 / count(*)', 'bunching_rate')}
        FROM x_bus_headways GROUP BY x_bus_headways.stop_id, x_bus_headways.stop_name, x_bus_headways.stop_lat, x_bus_headways.stop_lon, x_bus_headways.route_short_name HAVING count(*) >= 5""")
add("a09_delay_by_stop", lambda T: y.delay_by_stop(T.schedule),
    f"""SELECT {STOP_R}, {r('avg(delay_minutes)', 'avg_delay_minutes')}, {r('stddev_samp(delay_minutes)', 'std_delay_minutes')}, count(*) AS total_observations,
        count(*) FILTER (delay_minutes > 5) AS late_count, {r('count(*) FILTER (delay_minutes > 5) * 100e0 / count(*)', 'late_rate')}
        FROM x_bus_schedule s GROUP BY s.stop_id, s.stop_name, s.stop_lat, s.stop_lon, s.route_short_name HAVING count(*) >= 3""")
FROM_TO = "stop_id AS from_stop_id, next_stop_id AS to_stop_id, from_stop_name, to_stop_name, route_short_name, coalesce(max(no_points), 1) AS points"
FT_KEY = "GROUP BY stop_id, next_stop_id, from_stop_name, to_stop_name, route_short_name, geom"
LAYER = ["from_stop_id", "to_stop_id", "from_stop_name", "to_stop_name", "route_short_name", "points"]
add("a10_delay_by_segment",
    lambda T: _with_line(T, y.delay_by_segment(T.delays), "seg_stop1_id", "seg_stop2_id").select(*LAYER, "avg_delay_minutes", "std_delay_minutes", "total_observations"),
    f"""SELECT {FROM_TO}, {r('avg(delay_minutes)', 'avg_delay_minutes')}, {r('stddev_samp(delay_minutes)', 'std_delay_minutes')}, count(*) AS total_observations
        FROM x_delays WHERE route_type = '3' AND delay_minutes BETWEEN -30 AND 60 {FT_KEY} HAVING count(*) >= 3""")
add("a11_delay_hotspots",
    lambda T: _with_line(T, y.delay_hotspots(T.delays), "seg_stop1_id", "seg_stop2_id").select(*LAYER, "avg_delay_minutes", "total_observations"),
    f"""SELECT {FROM_TO}, {r('avg(delay_minutes)', 'avg_delay_minutes')}, count(*) AS total_observations
        FROM x_delays WHERE route_type = '3' AND delay_minutes > 1 {FT_KEY} HAVING count(*) >= 3""")
SPEEDS = (f"{r('avg(scheduled_speed)', 'avg_scheduled_speed', 4)}, {r('avg(actual_speed)', 'avg_actual_speed', 4)}, "
          f"{r('avg(actual_speed - scheduled_speed)', 'avg_speed_difference', 4)}, count(*) AS total_observations")
D4 = {"avg_scheduled_speed": 4, "avg_actual_speed": 4, "avg_speed_difference": 4}
add("a12_speed_by_segment", lambda T: y.speed_by_segment(T.speeds),
    f"""SELECT stop_id, next_stop_id, from_stop_name, to_stop_name, route_short_name, {SPEEDS} FROM x_bus_speeds
        GROUP BY stop_id, next_stop_id, from_stop_name, to_stop_name, route_short_name""", **D4)
add("a13_speed_by_segment_geom",
    lambda T: _with_line(T, y.speed_by_segment_geom(T.speeds), "seg_stop1_id", "seg_stop2_id").drop("seg_stop1_id", "seg_stop2_id"),
    f"""SELECT stop_id, next_stop_id, from_stop_name, to_stop_name, route_short_name, coalesce(max(no_points), 1) AS points, {SPEEDS}
        FROM x_bus_speeds {FT_KEY}""", **D4)
add("a14_scheduled_headway", lambda T: t.scheduled_headway(T.transit_stops, T.routes),
    f"SELECT route_id, route_short_name, stop_id, {r('scheduled_headway_minutes', 'scheduled_headway_minutes')} FROM x_sched_headway")
HVS = (f"route_id, route_short_name, stop_id, stop_name, {r('stop_lat', 'stop_lat')}, {r('stop_lon', 'stop_lon')}, observations, {r('actual', 'avg_actual_headway_min')}, "
       f"{r('median_actual', 'median_actual_headway_min')}, {r('std_actual', 'std_actual_headway_min')}, {r('sched', 'scheduled_headway_minutes')}, "
       f"{r('delta', 'headway_delta_min')}, {r('bunching', 'bunching_rate_pct')}, {r('gaps', 'gap_rate_pct')}")
add("a15_headway_vs_schedule", lambda T: y.headway_vs_schedule(T.headways, T.scheduled_headways), f"SELECT {HVS} FROM x_hvs")
add("a16_trip_instances",
    lambda T: m.trip_instances(T.positions.withColumn("trip_instance_id", F.when(F.col("tie1") % 3 != 0, F.col("trip_instance_id"))))
    .select("trip_instance_id", "trip_id", "route_id", "vehicle_id", "first_observed"),
    """SELECT CASE WHEN tie1 % 3 <> 0 THEN trip_instance_id ELSE trip_id || '_' || strftime(entity_timestamp, '%Y%m%d%H%M%S') END AS trip_instance_id,
       min(trip_id) AS trip_id, min(route_id) AS route_id, min(vehicle_id) AS vehicle_id, epoch_us(min(entity_timestamp)) AS first_observed FROM x_positions GROUP BY 1""")
add("a17_scalar_quartile", lambda T: sp.high_density_areas(T.areas).select("id", "population_density"),
    f"""SELECT CAST(id AS BIGINT) AS id, {r('population_density', 'population_density', 3)} FROM x_areas
        WHERE population_density > (SELECT quantile_cont(population_density, 0.75) FROM x_areas)""", population_density=3)
add("a18_route_statistics", lambda T: y.route_statistics(T.segments),
    f"""SELECT route_id, count(DISTINCT stop1_id || stop2_id) AS total_segments, {r('sum(seg_length) / 1000', 'total_length_km', 4)} FROM x_segments GROUP BY 1""",
    total_length_km=4)
add("a19_route_duplication", lambda T: T.pairs,
    f"""SELECT route1, route2, shared AS shared_segments, total1 AS route1_total_segments, total2 AS route2_total_segments, {r('overlap', 'overlap_percentage')} FROM x_pairs""")
cte("x_ends", "SELECT route1 AS route_id, overlap, shared FROM x_pairs UNION ALL SELECT route2, overlap, shared FROM x_pairs")
add("a20_highly_duplicated_routes", lambda T: y.highly_duplicated_routes(T.pairs),
    f"""SELECT route_id, count(*) AS num_duplicate_pairs, {r('max(overlap)', 'max_overlap_percentage')}, {r('avg(overlap)', 'avg_overlap_percentage')},
        CAST(sum(shared) AS BIGINT) AS total_shared_segments FROM x_ends GROUP BY 1 HAVING count(*) >= 3""")
add("a20_highly_duplicated_routes_one_pair", lambda T: y.highly_duplicated_routes(T.pairs, 1),
    f"""SELECT route_id, count(*) AS num_duplicate_pairs, {r('max(overlap)', 'max_overlap_percentage')}, {r('avg(overlap)', 'avg_overlap_percentage')},
        CAST(sum(shared) AS BIGINT) AS total_shared_segments FROM x_ends GROUP BY 1""")
# ---- summaries ----------------------------------------------------------------------------
BUNCHED = "count(*) FILTER (headway_minutes <= 3) * 100e0 / count(*)"
add("a26_route_summary_stats", lambda T: k.route_summary_stats(T.bus_headways),
    f"""SELECT route_short_name, {r('avg(headway_minutes)', 'avg_headway')}, {r('stddev_samp(headway_minutes)', 'std_headway')}, count(*) AS n,
        {r(BUNCHED, 'bunching_rate_pct')} FROM x_bus_headways GROUP BY 1 HAVING count(*) >= 10""")
cte("x_otp", """
SELECT route_short_name, avg(CASE WHEN delay_minutes BETWEEN -3 AND 3 THEN 1e0 ELSE 0 END) AS on_time, avg(CASE WHEN delay_minutes < -3 THEN 1e0 ELSE 0 END) AS early,
  avg(CASE WHEN delay_minutes > 3 THEN 1e0 ELSE 0 END) AS late, count(*) AS samples FROM x_bus_schedule GROUP BY 1 HAVING count(*) >= 10""")
add("a27_on_time_by_route", lambda T: k.on_time_by_route(T.bus_schedule),
    f"SELECT route_short_name, {r('on_time', 'on_time')}, {r('early', 'early')}, {r('late', 'late')}, samples FROM x_otp")
add("a27_on_time_performance", lambda T: k.on_time_performance(T.bus_schedule),
    f"""SELECT CASE WHEN delay_minutes < -7 THEN 'severe early' WHEN delay_minutes < -3 THEN 'minor early' WHEN delay_minutes <= 3 THEN 'on time'
        WHEN delay_minutes <= 7 THEN 'minor late' ELSE 'severe late' END AS class, count(*) AS n, {r('count(*) * 100e0 / sum(count(*)) OVER ()', 'share_pct')} FROM x_bus_schedule GROUP BY 1""")
RANK = "CAST(list_position(['Night', 'Morning Rush', 'Midday', 'Evening Rush', 'Evening'], time_period) AS BIGINT) AS period_rank"
add("a28_period_means_delay", lambda T: k.period_means(T.bus_delays, "segment_delay_minutes"),
    f"SELECT time_period, {RANK}, {r('avg(delay_minutes)', 'mean_value')}, count(*) AS n FROM x_bus_delays GROUP BY time_period")
add("a28_period_means_headway", lambda T: k.headway_by_period(T.bus_headways),
    f"SELECT time_period, {RANK}, {r('avg(headway_minutes)', 'mean_value')}, count(*) AS n, {r(BUNCHED, 'bunching_rate_pct')} FROM x_bus_headways GROUP BY time_period")
add("a28_daytype_means_headway", lambda T: k.headway_by_day_type(T.bus_headways),
    f"SELECT day_type, {r('avg(headway_minutes)', 'avg_headway')}, {r('stddev_samp(headway_minutes)', 'std_headway')}, {r(BUNCHED, 'bunching_rate_pct')} FROM x_bus_headways GROUP BY 1")


def _with_weekend(T):
    """Headways where every second trip runs five days later, on a Saturday."""
    later = F.timestamp_seconds(F.unix_seconds("arrival_time") + F.col("trip_id").cast("long") % 2 * 5 * 86400)
    return rt.headway_stats(T.updates.withColumn("arrival_time", later), T.routes, T.stops).where(F.col("route_type") == "3")


cte("z_updates", "SELECT * REPLACE (arrival_epoch + CAST(trip_id AS BIGINT) % 2 * 5 * 86400 AS arrival_epoch) FROM x_updates")
for old, new in (("lagged", "updates"), ("headways", "lagged"), ("bus_headways", "headways")):
    cte(f"z_{old}", CTES[f"x_{old}"].replace(f"x_{new}", f"z_{new}"))
add("a28_daytype_means_headway_weekend", lambda T: k.headway_by_day_type(_with_weekend(T)),
    f"SELECT day_type, {r('avg(headway_minutes)', 'avg_headway')}, {r('stddev_samp(headway_minutes)', 'std_headway')}, {r(BUNCHED, 'bunching_rate_pct')} FROM z_bus_headways GROUP BY 1")
add("a28_daytype_means_speed", lambda T: k.speed_by_day_type(T.bus_speeds),
    f"SELECT day_type, {r('avg(scheduled_speed)', 'scheduled_speed', 4)}, {r('avg(actual_speed)', 'actual_speed', 4)}, {r('avg(delta)', 'speed_delta', 4)} FROM x_bus_speeds GROUP BY 1",
    scheduled_speed=4, actual_speed=4, speed_delta=4)
RUSH = "time_period IN ('Morning Rush', 'Evening Rush')"
add("a29_rush_vs_offpeak", lambda T: k.rush_vs_offpeak(T.bus_delays),
    f"SELECT {r(f'avg(delay_minutes) FILTER ({RUSH})', 'rush_mean_delay')}, {r(f'avg(delay_minutes) FILTER (NOT {RUSH})', 'offpeak_mean_delay')} FROM x_bus_delays")
S4 = ["sched_speed_mean", "sched_speed_std", "actual_speed_mean", "actual_speed_std", "speed_delta_mean", "speed_delta_std", "speed_delta_min", "speed_delta_max"]
add("a30_speed_summary", lambda T: k.speed_summary(T.bus_speeds),
    f"""SELECT route_short_name, from_stop_name, to_stop_name, {r('avg(scheduled_speed)', 'sched_speed_mean', 4)}, {r('stddev_samp(scheduled_speed)', 'sched_speed_std', 4)},
        {r('avg(actual_speed)', 'actual_speed_mean', 4)}, {r('stddev_samp(actual_speed)', 'actual_speed_std', 4)}, {r('avg(delta)', 'speed_delta_mean', 4)},
        {r('stddev_samp(delta)', 'speed_delta_std', 4)}, {r('min(delta)', 'speed_delta_min', 4)}, {r('max(delta)', 'speed_delta_max', 4)},
        {r('first(seg_length ORDER BY trip_instance_id, stop_sequence)', 'segment_length_m', 3)}, count(*) AS sample_count
        FROM x_bus_speeds WHERE from_stop_name IS NOT NULL AND to_stop_name IS NOT NULL GROUP BY ALL""", segment_length_m=3, **{c: 4 for c in S4})
add("a31_schedule_summary", lambda T: k.schedule_summary(T.bus_schedule),
    f"""SELECT s.route_short_name, s.stop_name, {r('avg(delay_minutes)', 'avg_delay')}, {r('stddev_samp(delay_minutes)', 'std_delay')}, {r('min(delay_minutes)', 'min_delay')},
        {r('max(delay_minutes)', 'max_delay')}, count(*) AS sample_count, any_value(h.hour_of_day) AS most_common_hour
        FROM x_bus_schedule s JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_short_name, stop_name ORDER BY c DESC, hour_of_day) AS rn
            FROM (SELECT route_short_name, stop_name, hour_of_day, count(*) AS c FROM x_bus_schedule GROUP BY 1, 2, 3)) WHERE rn = 1) h
        ON h.route_short_name = s.route_short_name AND h.stop_name = s.stop_name GROUP BY s.route_short_name, s.stop_name""")
add("a32_delay_summary", lambda T: k.delay_summary(T.bus_delays),
    f"""SELECT route_short_name, from_stop_name, to_stop_name, time_period, {r('avg(delay_minutes)', 'avg_delay')}, {r('stddev_samp(delay_minutes)', 'std_delay')},
        count(*) AS sample_count, {r('avg(reduction)', 'speed_reduction_pct', 3)} FROM x_bus_delays
        WHERE from_stop_name IS NOT NULL AND to_stop_name IS NOT NULL GROUP BY route_short_name, from_stop_name, to_stop_name, time_period""", speed_reduction_pct=3)
add("a33_headway_summary", lambda T: k.headway_summary(T.bus_headways),
    f"""SELECT route_short_name, stop_name, time_period, {r('avg(headway_minutes)', 'avg_headway')}, {r('stddev_samp(headway_minutes)', 'std_headway')},
        {r('min(headway_minutes)', 'min_headway')}, {r('max(headway_minutes)', 'max_headway')}, count(*) AS n, {r(BUNCHED, 'bunching_rate_pct')}
        FROM x_bus_headways WHERE stop_name IS NOT NULL GROUP BY route_short_name, stop_name, time_period""")
add("a34_hvs_summary", lambda T: k.headway_vs_schedule_summary(T.hvs),
    f"""SELECT route_short_name, stop_name, CAST(sum(observations) AS BIGINT) AS observations, {r('avg(actual)', 'avg_actual_headway_min')}, {r('avg(sched)', 'scheduled_headway_minutes')},
        {r('avg(delta)', 'headway_delta_min')}, {r('avg(bunching)', 'bunching_rate_pct')}, {r('avg(gaps)', 'gap_rate_pct')}
        FROM x_hvs WHERE sched IS NOT NULL AND stop_name IS NOT NULL GROUP BY 1, 2""")


def _describe_sql(view, pairs, distinct=()):
    extra = "".join(f", (SELECT count(DISTINCT {c}) FROM {view}) AS distinct_{c}" for c in distinct)
    return " UNION ALL ".join(
        f"SELECT '{name}' AS measure, count({c}) AS n, {r(f'avg({c})', 'mean', d)}, {r(f'quantile_cont({c}, 0.5)', 'median', d)}, {r(f'stddev_samp({c})', 'std', d)}, "
        f"{r(f'min({c})', 'min', d)}, {r(f'max({c})', 'max', d)}{extra} FROM {view}" for c, name, d in pairs)


M4 = {c: 4 for c in ("mean", "median", "std", "min", "max")}
add("a35_describe_delays", lambda T: k.describe(T.bus_delays, ["segment_delay_minutes"], ["trip_instance_id", "route_short_name"], stage=T.stage),
    _describe_sql("x_bus_delays", [("delay_minutes", "segment_delay_minutes", 4)], ["trip_instance_id", "route_short_name"]), **M4)
add("a35_describe_schedule", lambda T: k.describe(T.bus_schedule, ["delay_minutes"], ["trip_instance_id", "route_short_name", "stop_id"], stage=T.stage),
    _describe_sql("x_bus_schedule", [("delay_minutes", "delay_minutes", 4)], ["trip_instance_id", "route_short_name", "stop_id"]), **M4)
add("a35_describe_speeds", lambda T: k.describe(T.bus_speeds, ["scheduled_speed_kmh", "actual_speed_kmh", "speed_delta_kmh"], ["trip_instance_id", "route_short_name"], stage=T.stage),
    _describe_sql("x_bus_speeds", [("scheduled_speed", "scheduled_speed_kmh", 4), ("actual_speed", "actual_speed_kmh", 4), ("delta", "speed_delta_kmh", 4)],
                  ["trip_instance_id", "route_short_name"]), **M4)
add("a35_describe_headways", lambda T: k.describe(T.bus_headways, ["headway_minutes"], ["route_short_name", "stop_id"], stage=T.stage),
    _describe_sql("x_bus_headways", [("headway_minutes", "headway_minutes", 4)], ["route_short_name", "stop_id"]), **M4)
add("a35_describe_headway_vs_schedule", lambda T: k.describe(T.hvs.where(F.col("scheduled_headway_minutes").isNotNull()), ["headway_delta_min", "bunching_rate_pct", "gap_rate_pct"], stage=T.stage),
    _describe_sql("(SELECT * FROM x_hvs WHERE sched IS NOT NULL)", [("delta", "headway_delta_min", 4), ("bunching", "bunching_rate_pct", 4), ("gaps", "gap_rate_pct", 4)]), **M4)
add("a35_faster_slower", lambda T: k.faster_slower(T.bus_speeds),
    "SELECT count(*) FILTER (delta > 0) AS faster, count(*) FILTER (delta < 0) AS slower, count(*) AS n FROM x_bus_speeds")
add("a36_category_counts_severity", lambda T: k.category_counts(T.bus_delays, "delay_severity"),
    f"SELECT {SEVERITY_SQL('delay_minutes')} AS delay_severity, count(*) AS n, {r('count(*) * 100e0 / sum(count(*)) OVER ()', 'share_pct')} FROM x_bus_delays GROUP BY 1")
add("a36_category_counts_delay",
    lambda T: k.category_counts(T.bus_schedule.withColumn("delay_category", s.bin_right_closed("delay_minutes", s.DELAY_EDGES, s.DELAY_CATEGORY)), "delay_category"),
    f"SELECT {CATEGORY_SQL('delay_minutes')} AS delay_category, count(*) AS n, {r('count(*) * 100e0 / sum(count(*)) OVER ()', 'share_pct')} FROM x_bus_schedule GROUP BY 1")
add("a36_category_counts_headway",
    lambda T: k.category_counts(T.bus_headways.withColumn("headway_category", s.headway_category("headway_minutes")), "headway_category"),
    f"SELECT {HEADWAY_SQL('headway_minutes')} AS headway_category, count(*) AS n, {r('count(*) * 100e0 / sum(count(*)) OVER ()', 'share_pct')} FROM x_bus_headways GROUP BY 1")


def _histogram_sql(source, c, bins, d=4):
    return f"""SELECT CAST(b AS BIGINT) AS bin, {r(f'lo + (hi - lo) / {bins} * b', 'bin_start', d)}, {r(f'lo + (hi - lo) / {bins} * (b + 1)', 'bin_end', d)}, count(v) AS n
        FROM range(0, {bins}) g(b) CROSS JOIN (SELECT min({c}) AS lo, max({c}) AS hi FROM {source})
        LEFT JOIN (SELECT {c} AS v, least(floor(({c} - (SELECT min({c}) FROM {source})) / ((SELECT max({c}) FROM {source}) - (SELECT min({c}) FROM {source})) * {bins}), {bins - 1}) AS at_bin
          FROM {source} WHERE {c} IS NOT NULL) ON at_bin = b GROUP BY b, lo, hi"""


H4 = {"bin_start": 4, "bin_end": 4}
add("a40_histogram_headway", lambda T: histogram(T.bus_headways.withColumn("c", s.clip("headway_minutes", 0.0, 60.0)), "c", 60),
    _histogram_sql("(SELECT greatest(least(headway_minutes, 60), 0) AS c FROM x_bus_headways)", "c", 60), **H4)
add("a40_histogram_delay", lambda T: histogram(T.bus_schedule, "delay_minutes", 50), _histogram_sql("x_bus_schedule", "delay_minutes", 50), **H4)
add("a40_histogram_trip_length", lambda T: histogram(T.transit_stops.groupBy("trip_id").agg(F.count("*").alias("n")), "n", 30),
    _histogram_sql("(SELECT CAST(count(*) AS DOUBLE) AS c FROM x_stop_times GROUP BY trip_id)", "c", 30), **H4)
add("a40_histogram_headway_delta", lambda T: histogram(T.hvs.select(s.clip("headway_delta_min", -30.0, 30.0).alias("c")), "c", 50),
    _histogram_sql("(SELECT greatest(least(delta, 30), -30) AS c FROM x_hvs WHERE delta IS NOT NULL)", "c", 50), **H4)
cte("x_type_speed", """
SELECT r.route_type, avg(q.seg_length / q.scheduled_seconds * 3.6) AS v FROM x_segments q JOIN x_routes r ON r.route_id = q.route_id
WHERE q.scheduled_seconds > 0 GROUP BY r.route_type, q.route_id""")
add("a41_box_stats", lambda T: sp.box_stats(_route_speeds(T), "v", "mode"),
    f"""SELECT mode, {r('q1', 'q1', 3)}, {r('md', 'median', 3)}, {r('q3', 'q3', 3)}, {r('min(v)', 'whisker_low', 3)}, {r('max(v)', 'whisker_high', 3)} FROM (
          SELECT CASE route_type WHEN '1' THEN 'Subway' WHEN '3' THEN 'Bus' END AS mode, v, quantile_cont(v, 0.25) OVER p AS q1, quantile_cont(v, 0.5) OVER p AS md,
            quantile_cont(v, 0.75) OVER p AS q3 FROM x_type_speed WINDOW p AS (PARTITION BY route_type))
        WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY mode, q1, md, q3""", q1=3, median=3, q3=3, whisker_low=3, whisker_high=3)


def _route_speeds(T):
    rows = T.segments.where(F.col("stop2_arrival") > F.col("stop1_arrival"))
    v = s.speed_kmh(F.col("seg_length"), F.col("stop2_arrival") - F.col("stop1_arrival"))
    return rows.groupBy("route_id").agg(F.avg(v).alias("v")).join(T.routes, "route_id").withColumn("mode", s.mode_name("route_type"))


add("a42_route_type_share", lambda T: y.route_type_share(T.routes),
    """SELECT CASE route_type WHEN '1' THEN 'subway' WHEN '3' THEN 'bus' END AS name, count(*) AS qty, round(count(*) * 100e0 / sum(count(*)) OVER (), 2) AS perc
       FROM x_routes GROUP BY route_type""", perc=2)
add("a44_speed_by_route", lambda T: k.speed_by_route(T.bus_speeds, 5),
    f"""SELECT route_short_name, {r('avg(scheduled_speed)', 'scheduled_speed', 4)}, {r('avg(actual_speed)', 'actual_speed', 4)}, count(*) AS samples
        FROM x_bus_speeds GROUP BY 1 ORDER BY avg(actual_speed_raw) DESC LIMIT 5""".replace("actual_speed_raw", "x_bus_speeds.actual_speed"),
    scheduled_speed=4, actual_speed=4)
add("a45_shape_coverage", lambda T: t.shape_coverage(T.raw["trips"]),
    "SELECT count(*) AS trips, count(shape_id) AS with_shape, count(*) - count(shape_id) AS without_shape FROM x_trips")
cte("x_route_layer", """
SELECT r.route_id, r.route_short_name, r.route_long_name, r.route_type, t.n AS num_trips, g.lines AS num_lines, g.km AS total_length_km FROM x_routes r
JOIN (SELECT route_id, count(*) AS lines, sum(seg_length) / 1000 AS km FROM x_segments GROUP BY 1) g ON g.route_id = r.route_id
JOIN (SELECT route_id, count(DISTINCT trip_id) AS n FROM x_trips GROUP BY 1) t ON t.route_id = r.route_id WHERE r.route_type = '3'""")
add("a46_trips_per_route", lambda T: pl.trips_per_route(pl.route_layer(T.routes, T.trips, T.segments)),
    """SELECT route_id, route_short_name || ' - ' || CASE WHEN length(route_long_name) > 30 THEN substr(route_long_name, 1, 30) || '...' ELSE route_long_name END AS label, num_trips
       FROM x_route_layer ORDER BY num_trips DESC, route_id LIMIT 20""")
add("a46_trips_per_route_distribution", lambda T: histogram(pl.route_layer(T.routes, T.trips, T.segments), "num_trips", 30),
    _histogram_sql("(SELECT CAST(num_trips AS DOUBLE) AS c FROM x_route_layer)", "c", 30), **H4)

# ---- order and top-n ----------------------------------------------------------------------
add("o01_order_nulls",
    # the rows are numbered in the order they come in, so the comparison sees it
    lambda T: number_rows(T.updates.groupBy("arrival_delay_seconds").agg(F.count("*").alias("n")), ["-arrival_delay_seconds"], "place"),
    "SELECT row_number() OVER (ORDER BY delay DESC NULLS FIRST) AS place, delay AS arrival_delay_seconds, count(*) AS n FROM x_updates GROUP BY delay")
add("o02_top_n", lambda T: o.top_n(T.hvs.select("route_id", "stop_id", "observations", "headway_delta_min"), 15, "-headway_delta_min!", "-observations", "route_id", "stop_id"),
    f"""SELECT route_id, stop_id, observations, {r('delta', 'headway_delta_min')} FROM x_hvs ORDER BY delta DESC NULLS LAST, observations DESC, route_id, stop_id LIMIT 15""")
add("o02_top_duplicated_segments", lambda T: o.top_n(y.shared_segments(T.segments, T.routes, 5).select("segment_id", "num_routes_sharing"), 50, "-num_routes_sharing", "segment_id"),
    "SELECT segment_id, num_routes AS num_routes_sharing FROM x_density WHERE num_routes >= 5 ORDER BY num_routes DESC, segment_id LIMIT 50")
add("o02_top_duplicated_segments_two_routes",
    lambda T: o.top_n(y.shared_segments(T.segments, T.routes, 2).select("segment_id", "num_routes_sharing"), 50, "-num_routes_sharing", "segment_id"),
    "SELECT segment_id, num_routes AS num_routes_sharing FROM x_density WHERE num_routes >= 2 ORDER BY num_routes DESC, segment_id LIMIT 50")
add("o02_bunching_top_routes", lambda T: k.bunching_top_routes(T.bus_headways, 5).select("route_short_name", "bunching_rate_pct"),
    f"SELECT route_short_name, {r(BUNCHED, 'bunching_rate_pct')} FROM x_bus_headways GROUP BY 1 HAVING count(*) >= 10 ORDER BY {BUNCHED} DESC, route_short_name LIMIT 5")
add("o03_worst_segments", lambda T: k.worst_segments(T.bus_delays),
    f"""SELECT from_stop_name, to_stop_name, route_short_name, {r('avg(delay_minutes)', 'avg_delay')}, count(*) AS samples,
        substr(from_stop_name, 1, 15) || ' → ' || substr(to_stop_name, 1, 15) AS segment FROM x_bus_delays
        WHERE from_stop_name IS NOT NULL AND to_stop_name IS NOT NULL GROUP BY from_stop_name, to_stop_name, route_short_name HAVING count(*) >= 3
        ORDER BY avg(delay_minutes) DESC, from_stop_name, to_stop_name, route_short_name LIMIT 20""")
add("o04_tail_n", lambda T: k.delay_by_route(T.bus_schedule),
    f"SELECT route_short_name, {r('avg(delay_minutes)', 'avg_delay')} FROM x_bus_schedule GROUP BY 1 ORDER BY avg(delay_minutes) DESC, route_short_name LIMIT 20")
add("o04_on_time_tail", lambda T: o.tail_n(k.on_time_by_route(T.bus_schedule), 20, "on_time", "route_short_name").select("route_short_name", "on_time"),
    f"SELECT route_short_name, {r('on_time', 'on_time')} FROM x_otp ORDER BY x_otp.on_time DESC, route_short_name LIMIT 20")
