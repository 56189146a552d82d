"""Sources, landing, sinks, table maintenance and streams."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from catalog import registry
from catalog.registry import add, cte, r
from catalog.standins import POSITION_TIES
from transitloom.functions import geometry as g
from transitloom.functions import scalars as s
from transitloom.operators import metrics as k
from transitloom.operators import moving as m
from transitloom.plans import timetable as pt
from transitloom.session import scratch_path
from transitloom.sources import census, feed, gtfs, landed, tables
from transitloom.streaming import feeds

SEQ = "CAST(stop_sequence AS BIGINT) AS stop_sequence"


# ---- timetable files ----------------------------------------------------------------------
def _written(T) -> str:
    path = scratch_path(T.spark, "gtfs")
    gtfs.write_gtfs(T.raw, path)
    return path


def _reread(T):
    return gtfs.read_gtfs(T.spark, _written(T))[0]


add("c01_read_gtfs", lambda T: _reread(T)["stop_times"].select("trip_id", "arrival_time", "stop_id", "stop_sequence", "pickup_type"),
    """SELECT trip_id, CASE kind WHEN 0 THEN ' ' || h || ':' || mm || ':' || ss WHEN 1 THEN hh || ':' || mm || ':' || ss ELSE h || ':' || mm END AS arrival_time,
       stop_id, CAST(stop_sequence AS VARCHAR) AS stop_sequence, '0' AS pickup_type FROM x_raw_times""")
add("c02_prune_columns", lambda T: gtfs.prune_columns(T.raw["trips"], gtfs.KEEP["trips"]),
    """SELECT route_id, service_id, trip_id, CAST(CAST(trip_id AS BIGINT) % 2 AS VARCHAR) AS direction_id, coalesce(shape_id, '') AS shape_id FROM x_trips""")
add("c03_drop_empty_rows",
    lambda T: gtfs.drop_empty_rows(T.read("orders").select(*[F.when(F.col("o_orderkey") % 7 != 0, F.col(c)).alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus")])),
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0")
add("c04_blank_to_null", lambda T: T.raw["trips"].select("trip_id", s.blank_to_null("shape_id").alias("shape_id")), "SELECT trip_id, shape_id FROM x_trips")
add("c05_write_gtfs", lambda T: gtfs.typed_shapes(_reread(T)["shapes"]).select("shape_id", "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat"),
    f"SELECT shape_id, CAST(i AS BIGINT) AS shape_pt_sequence, {r('lon', 'shape_pt_lon')}, {r('lat', 'shape_pt_lat')} FROM x_shapes")


# ---- census and points of interest --------------------------------------------------------
def _census(T):
    """Stop neighbourhoods written as GeoJSON collections, some with unusable numbers."""
    n = F.col("stop_id").cast("long")
    ring = F.array(*[F.array(F.col("stop_lon") + dx, F.col("stop_lat") + dy) for dx, dy in ((0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01), (0, 0))])
    props = F.struct(F.col("stop_id").alias("id"), F.when(n % 6 == 5, "n/a").otherwise((n * 10).cast("string")).alias("pop"), F.lit("2.5").alias("a"))
    simple = F.struct(F.lit("Polygon").alias("type"), F.to_json(F.array(ring)).alias("c"))
    several = F.struct(F.lit("MultiPolygon").alias("type"), F.to_json(F.array(F.array(ring), F.array(ring))).alias("c"))
    shape = F.when(n % 2 == 0, simple).otherwise(several)
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(props), F.lit(',"geometry":{"type":"'), shape["type"], F.lit('","coordinates":'), shape["c"], F.lit("}}"))
    path = scratch_path(T.spark, "census")
    # a few files of one document each; the groups are as large as a file is meant to be
    files = T.stops.select(text.alias("f"), (n % 4).alias("file")).groupBy("file").agg(F.array_join(F.collect_list("f"), ", ").alias("all"))
    files.select(F.concat(F.lit('{"type":"FeatureCollection","name":"areas","features":['), "all", F.lit("]}")).alias("value")).write.text(path)
    return census.read_census(T.spark, path)


def _census_lines(T):
    """The same areas, one feature per line."""
    folder = scratch_path(T.spark, "census-lines")
    props = F.to_json(F.struct(F.col("stop_id").alias("id"), (F.col("stop_id").cast("long") * 10).cast("string").alias("pop"), F.lit("2.5").alias("a")))
    T.stops.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":null}')).alias("value")).write.text(folder)
    return census.read_census(T.spark, folder, one_feature_per_line=True)


add("c06_read_census",
    lambda T: _census(T).select("id", "pop", "a", "population_density", F.size("geom").alias("parts"), g.point_x(F.col("geom")[0][0][2]).alias("corner_lon")),
    f"""SELECT stop_id AS id, CAST(stop_id AS BIGINT) * 10e0 AS pop, 2.5e0 AS a, CAST(stop_id AS BIGINT) * 4e0 AS population_density,
        CASE WHEN CAST(stop_id AS BIGINT) % 2 = 0 THEN CAST(1 AS BIGINT) ELSE 2 END AS parts, {r('stop_lon + 0.01', 'corner_lon')} FROM x_stops WHERE CAST(stop_id AS BIGINT) % 6 <> 5""")


add("c06_read_census_lines", lambda T: _census_lines(T).select("id", "pop", "population_density", F.col("geom").isNull().alias("bare")),
    "SELECT stop_id AS id, CAST(stop_id AS BIGINT) * 10e0 AS pop, CAST(stop_id AS BIGINT) * 4e0 AS population_density, true AS bare FROM x_stops")


def _census_csv(T):
    path = scratch_path(T.spark, "census-csv")
    k_ = F.col("c_custkey")
    T.read("customer").select(
        k_.cast("string").alias("GeoUID"), F.lit("CT").alias("Type"), F.col("c_name").alias("Region Name"), (k_ * 0.25).alias("Area (sq km)"), (k_ * 3).alias("Population "),
        k_.alias("Dwellings "), k_.alias("Households "), F.lit(12.0).alias("v_CA21_6: Population density per square kilometre")).write.csv(path, header=True)
    return census.read_census_csv(T.spark, path)


add("c07_read_census_csv", lambda T: _census_csv(T).select("geo_uid", "region_name", "area_sq_km", "population", "density_per_sq_km"),
    "SELECT CAST(c_custkey AS VARCHAR) AS geo_uid, c_name AS region_name, c_custkey * 0.25e0 AS area_sq_km, c_custkey * 3 AS population, 12e0 AS density_per_sq_km FROM customer")
add("c08_normalise_columns",
    lambda T: census.normalise_columns(T.read("part").select(F.col("p_partkey").alias("Part (key)"), F.col("p_name").alias("65+ Name/-x."), F.col("p_brand").alias("A - B, C"))),
    "SELECT p_partkey AS part_key, p_name AS _65_plus_name_x, p_brand AS a_b_c FROM part")


def _extra_pois(T):
    return T.stops.select(F.col("stop_id").cast("int").alias("poi_id"), F.when(F.col("stop_id").cast("int") % 10 == 0, F.lit("BC Place")).otherwise(F.concat(F.lit("poi "), (F.col("stop_id").cast("int") % 40))).alias("name"),
                          F.col("stop_name").alias("team"), F.col("stop_lat").alias("latitude"), F.col("stop_lon").alias("longitude"))


add("c09_poi_table", lambda T: census.poi_table(T.spark, _extra_pois(T)).select("poi_id", "name", "team"),
    """SELECT CAST(max(poi_id) AS BIGINT) AS poi_id, name, arg_max(team, poi_id) AS team FROM (
         SELECT CAST(stop_id AS BIGINT) AS poi_id, CASE WHEN CAST(stop_id AS BIGINT) % 10 = 0 THEN 'BC Place' ELSE 'poi ' || CAST(CAST(stop_id AS BIGINT) % 40 AS VARCHAR) END AS name, stop_name AS team FROM x_stops) GROUP BY name
       UNION ALL SELECT CAST(poi_id AS BIGINT), name, team FROM x_pois WHERE name <> 'BC Place'""")

# ---- landing ------------------------------------------------------------------------------
cte("x_landed_positions", """
SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS f,
  CASE WHEN event_id % 3 <> 0 THEN epoch_us(date_trunc('hour', ts)) // 1000000 WHEN event_id % 6 <> 0 THEN epoch_us(date_trunc('second', ts)) // 1000000 - 5
       ELSE epoch_us(date_trunc('second', ts)) // 1000000 END AS e,
  CASE WHEN event_id % 5 <> 0 THEN CAST(user_id * 3 AS VARCHAR) END AS trip_id, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id % 25 AS VARCHAR) END AS route_id,
  CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y%m%d') END AS d, CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN strftime(ts, '%H0000') END AS h,
  CASE WHEN event_id % 35 <> 0 THEN CAST(user_id AS VARCHAR) END AS vehicle_id, 49e0 + (event_id % 500) * 1e-3 AS latitude, -123.3e0 + user_id % 50 * 0.02e0 AS longitude
FROM events WHERE event_id % 11 <> 0""")
_LANDED = f"""SELECT f * 1000000 AS fetch_timestamp, e * 1000000 AS entity_timestamp,
  CASE WHEN trip_id IS NOT NULL THEN concat_ws('_', trip_id, d, h) WHEN vehicle_id IS NOT NULL THEN vehicle_id || '_' || strftime(to_timestamp(e) AT TIME ZONE 'UTC', '%Y%m%dT%H%M%S')
       ELSE 'trip_' || strftime(to_timestamp(e) AT TIME ZONE 'UTC', '%Y%m%dT%H%M%S') END AS trip_instance_id,
  trip_id, route_id, vehicle_id, {r('latitude', 'latitude')}, {r('longitude', 'longitude')} FROM x_landed_positions"""
_POS = ["fetch_timestamp", "entity_timestamp", "trip_instance_id", "trip_id", "route_id", "vehicle_id", "latitude", "longitude"]
add("c10_land_vehicle_positions", lambda T: feed.land_vehicle_positions(T.parsed(T.position_snapshots)).select(*_POS), _LANDED)
add("c10_land_vehicle_positions_filtered",
    lambda T: feed.land_vehicle_positions(T.parsed(T.position_snapshots), T.routes.where("route_type = '1'")).select(*_POS),
    _LANDED + " WHERE route_id IN (SELECT route_id FROM x_routes WHERE route_type = '1')")
_UPD = ["fetch_timestamp", "entity_timestamp", "trip_instance_id", "trip_id", "route_id", "start_date", "stop_sequence", "stop_id", "arrival_time", "arrival_delay_seconds", "departure_time", "departure_delay_seconds"]
_UPDATES = f"""SELECT epoch_us(fetch_timestamp) AS fetch_timestamp, epoch_us(fetch_timestamp) AS entity_timestamp, trip_id || '_20240108' AS trip_instance_id, trip_id, route_id,
  '2024-01-08' AS start_date, {SEQ}, stop_id, arrival_epoch * 1000000 AS arrival_time, delay AS arrival_delay_seconds, (arrival_epoch + 20) * 1000000 AS departure_time,
  delay AS departure_delay_seconds FROM x_updates"""
add("c11_land_trip_updates", lambda T: feed.land_trip_updates(T.parsed(T.update_snapshots)).select(*_UPD), _UPDATES)
add("c11_land_trip_updates_keep_zero",
    lambda T: feed.land_trip_updates(T.parsed(T.update_snapshots), zero_delay_is_null=False).groupBy("arrival_delay_seconds").agg(F.count("*").alias("n")),
    "SELECT coalesce(delay, 0) AS arrival_delay_seconds, count(*) AS n FROM x_updates GROUP BY 1")


# ---- sinks and maintenance ----------------------------------------------------------------
def _appended(T):
    path = scratch_path(T.spark, "append")
    rows = feed.land_vehicle_positions(T.parsed(T.position_snapshots))
    for part in (0, 1):
        tables.append_sink(rows.where(F.crc32(F.encode("trip_instance_id", "utf-8")) % 2 == part), path)
    return T.spark.read.parquet(path).groupBy(tables.DATE_COLUMN).agg(F.count("*").alias("n"))


add("c12_append_sink", _appended,
    "SELECT strftime(to_timestamp(e) AT TIME ZONE 'UTC', '%Y-%m-%d') AS entity_date, count(*) AS n FROM x_landed_positions GROUP BY 1")
add("c13_materialise",
    lambda T: tables.materialise(T.read("customer").select("c_nationkey", "c_custkey"), "stored_customers", scratch_path(T.spark, "views"), ["c_nationkey", "-c_custkey"])[0],
    "SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey DESC) AS gid, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey FROM customer")


def _upserted(T):
    """Two builds over overlapping windows, stored as versions; the second replaces shared trips."""
    path = scratch_path(T.spark, "trips")
    at = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    for first, last in ((1, 15), (10, 31)):
        feeds.rebuild_window(T.positions, T.trips, T.shape_tracks, path, at(last), start=at(first), ties=POSITION_TIES)
    return tables.read_snapshot(T.spark, path).select("trip_instance_id", F.size("trip").alias("n"), "starttime")


add("c14_upsert_trips", _upserted,
    """SELECT trip_instance_id, count(*) AS n, epoch_us(min(entity_timestamp)) AS starttime FROM x_positions_first
       WHERE entity_timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' AND NOT (entity_timestamp > TIMESTAMP '2024-01-15' AND entity_timestamp < TIMESTAMP '2024-01-10')
       GROUP BY 1 HAVING count(*) > 1""")
add("c14_upsert_trips_keeps_id",
    # keys of orders and of parts overlap in part; both tables are whole
    lambda T: m.upsert_trips(
        T.read("orders").select((F.col("o_orderkey") * 2).alias("trip_instance_id"), F.col("o_custkey").alias("trip_id"), F.col("o_orderstatus").alias("state")),
        T.read("part").select((F.col("p_partkey") * 3).alias("trip_instance_id"), F.col("p_partkey").alias("trip_id"), F.lit("new").alias("state")), truncate=False),
    """SELECT coalesce(o_orderkey * 2, p_partkey * 3) AS trip_instance_id, CASE WHEN o_orderkey IS NOT NULL THEN o_custkey ELSE p_partkey END AS trip_id,
       CASE WHEN p_partkey IS NOT NULL THEN 'new' ELSE o_orderstatus END AS state FROM orders FULL JOIN part ON o_orderkey * 2 = p_partkey * 3""")


def _aging(T):
    return T.positions.withColumn("entity_timestamp", F.when(F.col("tie1") % 13 != 0, F.col("entity_timestamp")))


cte("x_aging", "SELECT tie1, CASE WHEN tie1 % 13 <> 0 THEN entity_timestamp END AS t FROM x_positions")
NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)
add("c15_table_stats", lambda T: tables.table_stats(_aging(T), "entity_timestamp"),
    "SELECT count(*) AS row_count, epoch_us(min(t)) AS min_ts, epoch_us(max(t)) AS max_ts FROM x_aging")
add("c16_retain_by_age", lambda T: tables.retain_by_age(_aging(T), "entity_timestamp", timedelta(days=5), NOW).select("tie1"),
    "SELECT tie1 FROM x_aging WHERE t IS NULL OR t >= TIMESTAMP '2024-01-15'")
add("c16_retain_by_age_dry_run", lambda T: tables.retain_by_age(_aging(T), "entity_timestamp", timedelta(days=5), NOW, dry_run=True),
    "SELECT count(*) AS rows_to_delete FROM x_aging WHERE t < TIMESTAMP '2024-01-15'")
add("c17_retain_by_range", lambda T: tables.retain_by_range(_aging(T), "entity_timestamp", NOW - timedelta(days=10), NOW).select("tie1"),
    "SELECT tie1 FROM x_aging WHERE t IS NULL OR NOT t BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")


def _retained(T):
    """The aged positions as a stored table, after the deletion of what is older than a cutoff at noon."""
    path = scratch_path(T.spark, "retained")
    tables.write_snapshot(_aging(T), path, ["tie1"])
    tables.retain_snapshot(T.spark, path, F.col("entity_timestamp") < F.lit(NOW - timedelta(days=4, hours=12)), "trip_id")
    return tables.read_snapshot(T.spark, path).select("tie1")


add("c16_retain_stored", _retained, "SELECT tie1 FROM x_aging WHERE t IS NULL OR t >= TIMESTAMP '2024-01-15 12:00:00'")


def _landed_folder(T):
    path = scratch_path(T.spark, "landed")
    tables.append_sink(_aging(T), path)
    return path


def _landed_after(T, delete):
    path = _landed_folder(T)
    delete(path)
    return T.spark.read.parquet(path).select("tie1")


add("c16_retain_landed", lambda T: _landed_after(T, lambda path: landed.retain_landed_by_age(T.spark, path, "entity_timestamp", timedelta(days=4, hours=12), NOW)),
    "SELECT tie1 FROM x_aging WHERE t IS NULL OR t >= TIMESTAMP '2024-01-15 12:00:00'")
add("c16_retain_landed_dry_run",
    lambda T: landed.retain_landed_by_age(T.spark, _landed_folder(T), "entity_timestamp", timedelta(days=4, hours=12), NOW, dry_run=True),
    """SELECT strftime(t, '%Y-%m-%d') AS entity_date, count(*) AS rows_to_delete FROM x_aging
       WHERE t < TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1""")
add("c17_retain_landed",
    lambda T: _landed_after(T, lambda path: landed.retain_landed_by_range(T.spark, path, "entity_timestamp", NOW - timedelta(days=9, hours=12), NOW)),
    "SELECT tie1 FROM x_aging WHERE t IS NULL OR NOT t BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-20'")


def _truncated(T):
    """A folder emptied, then appended to with what is older than the middle of the month."""
    path = _landed_folder(T)
    landed.truncate_landed(T.spark, path, confirm=True)
    tables.append_sink(_aging(T).where(F.col("entity_timestamp") < F.lit(NOW - timedelta(days=5))), path)
    return T.spark.read.parquet(path).select("tie1")


add("c18_truncate_landed", _truncated, "SELECT tie1 FROM x_aging WHERE t < TIMESTAMP '2024-01-15'")
add("c18_truncate", lambda T: tables.truncate(T.positions, confirm=True).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM x_positions WHERE false")


def _exported(T):
    path = scratch_path(T.spark, "export")
    tables.export_summary({
        "headway_summary": (k.headway_summary(T.bus_headways), ["-bunching_rate_pct", "route_short_name", "stop_name", "time_period"]),
        "schedule_times_summary": (k.schedule_summary(T.bus_schedule), ["route_short_name", "stop_name"]),
        "delay_segments_summary": (k.delay_summary(T.bus_delays), ["-avg_delay", "route_short_name"]),
        "speed_summary": (k.speed_summary(T.bus_speeds), ["route_short_name", "from_stop_name"]),
        "headway_vs_schedule_summary": (k.headway_vs_schedule_summary(T.hvs), ["route_short_name", "stop_name"]),
    }, path)
    out = None
    for name, (place, value, _) in EXPORTED.items():
        one = T.spark.read.csv(f"{path}/{name}", header=True).select(
            F.lit(name).alias("file"), "route_short_name", F.col(place).alias("place"), F.round(F.col(value).cast("double"), 4 if name == "speed_summary" else 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


# of each file: the place, a measure, and the query whose SQL is its check
EXPORTED = {
    "headway_summary": ("stop_name", "avg_headway", "a33_headway_summary"), "schedule_times_summary": ("stop_name", "avg_delay", "a31_schedule_summary"),
    "delay_segments_summary": ("from_stop_name", "avg_delay", "a32_delay_summary"), "speed_summary": ("from_stop_name", "actual_speed_mean", "a30_speed_summary"),
    "headway_vs_schedule_summary": ("stop_name", "headway_delta_min", "a34_hvs_summary"),
}
add("c19_export_summary", lambda T: _exported(T), " UNION ALL ".join(
    f"SELECT '{name}' AS file, route_short_name, {place} AS place, {value} AS value FROM ({registry.ORACLE[query]})"
    for name, (place, value, query) in EXPORTED.items()))


# ---- streams ------------------------------------------------------------------------------
# Predictions are most of what is landed, and their documents repeat every name: packed, they take a twelfth.
PACKED = 100_000


def _run(query):
    query.awaitTermination()


def _streamed(T, snapshots, landing, name, wanted, ts="entity_timestamp", most=None):
    folder, out = T.landed(snapshots, name, most), scratch_path(T.spark, f"{name}-table")
    _run(feeds.start_append(landing(T.spark, folder), out, scratch_path(T.spark, f"{name}-checkpoint"), ts))
    return T.spark.read.parquet(out).select(*wanted)


add("st01_stream_positions", lambda T: _streamed(T, T.position_snapshots, feeds.stream_positions, "positions", _POS), _LANDED)
add("st01_stream_positions_filtered",
    lambda T: _streamed(T, T.position_snapshots, lambda spark, folder: feeds.stream_positions(spark, folder, routes=T.routes.where("route_type = '1'")), "positions-1", _POS),
    _LANDED + " WHERE route_id IN (SELECT route_id FROM x_routes WHERE route_type = '1')")
add("st02_stream_updates", lambda T: _streamed(T, T.update_snapshots, feeds.stream_updates, "updates", _UPD, "arrival_time", PACKED), _UPDATES)


def _one_file_at_a_time(T):
    folder, out = T.landed(T.position_snapshots.repartition(3), "polls"), scratch_path(T.spark, "polls-table")
    stream = feeds.stream_positions(T.spark, folder, max_files=1)
    _run(feeds.start_append(stream, out, scratch_path(T.spark, "polls-checkpoint"), **feeds.trigger(once=True)))
    return T.spark.read.parquet(out).select(*_POS)


add("st03_trigger", _one_file_at_a_time, _LANDED)


def _latest(T):
    folder, path = T.landed(T.update_snapshots, "latest", PACKED), scratch_path(T.spark, "latest-table")
    _run(feeds.start_latest_updates(feeds.stream_updates(T.spark, folder), path, scratch_path(T.spark, "latest-checkpoint")))
    return tables.read_snapshot(T.spark, path).select("trip_instance_id", "stop_sequence", "fetch_timestamp")


add("st04_latest_update_state", _latest,
    f"SELECT trip_instance_id, {SEQ}, epoch_us(max(fetch_timestamp)) AS fetch_timestamp FROM x_updates GROUP BY trip_instance_id, stop_sequence")


def _unrepeated(T):
    folder, out = T.landed(T.position_snapshots, "repeats"), scratch_path(T.spark, "repeats-table")
    _run(feeds.start_first_sightings(feeds.stream_positions(T.spark, folder), out, scratch_path(T.spark, "repeats-checkpoint")))
    return tables.read_snapshot(T.spark, out).select("trip_instance_id", "entity_timestamp", "fetch_timestamp")


add("st05_drop_repeats", _unrepeated, f"""SELECT trip_instance_id, entity_timestamp, min(fetch_timestamp) AS fetch_timestamp FROM ({_LANDED})
    GROUP BY trip_instance_id, entity_timestamp""")


def _first_to_come(T):
    """Sightings with bounded state, in one batch, with the late rows that the state no longer covers: none here."""
    folder, out = T.landed(T.position_snapshots, "bounded"), scratch_path(T.spark, "bounded-table")
    _run(feeds.start_drop_repeats(feeds.stream_positions(T.spark, folder), out, scratch_path(T.spark, "bounded-checkpoint")))
    made = [T.spark.read.parquet(f"{out}/{kind}").select("trip_instance_id", "entity_timestamp", "fetch_timestamp") for kind in ("rows", "late")]
    return made[0].unionByName(made[1])


add("st05_drop_repeats_bounded", _first_to_come, f"""
    SELECT trip_instance_id, entity_timestamp, min(fetch_timestamp) AS fetch_timestamp FROM ({_LANDED})
    WHERE trip_instance_id IS NOT NULL GROUP BY trip_instance_id, entity_timestamp""")


def _rebuilt(T):
    folder, path = T.landed(T.position_snapshots, "rebuild"), scratch_path(T.spark, "rebuild-trips")
    _run(feeds.start_rebuild(feeds.stream_positions(T.spark, folder), scratch_path(T.spark, "rebuild-positions"), T.trips, T.shape_tracks, path,
                             scratch_path(T.spark, "rebuild-checkpoint"), hours=48))
    return tables.read_snapshot(T.spark, path).select("trip_instance_id", F.size("trip").alias("n"), "starttime")


add("st06_rebuild_window", _rebuilt,
    f"""SELECT trip_instance_id, count(DISTINCT entity_timestamp) AS n, min(entity_timestamp) AS starttime FROM ({_LANDED})
        WHERE entity_timestamp >= (SELECT max(e) * 1000000 - 172800000000 FROM x_landed_positions) GROUP BY 1 HAVING count(DISTINCT entity_timestamp) > 1""")


def _with_heads(T):
    """The last two hours, trips seen in them with what they did up to a day before."""
    folder, path = T.landed(T.position_snapshots, "heads"), scratch_path(T.spark, "heads-trips")
    _run(feeds.start_rebuild(feeds.stream_positions(T.spark, folder), scratch_path(T.spark, "heads-positions"), T.trips, T.shape_tracks, path,
                             scratch_path(T.spark, "heads-checkpoint"), hours=2, head=timedelta(days=1)))
    return tables.read_snapshot(T.spark, path).select("trip_instance_id", F.size("trip").alias("n"), "starttime")


def _scheduled_fallback(T):
    """Trips without a shape are snapped to their scheduled path: how many vertices of theirs lie on it."""
    folder, path = T.landed(T.position_snapshots, "fallback"), scratch_path(T.spark, "fallback-trips")
    line = F.array(g.make_point(F.lit(-123.4), F.lit(49.2)), g.make_point(F.lit(-122.2), F.lit(49.2)))
    positions = feed.land_vehicle_positions(T.parsed(T.position_snapshots))
    runs = positions.where("trip_id IS NOT NULL").select("trip_id", s.service_date("start_date", "entity_timestamp").alias("date")).distinct()
    scheduled = pt.scheduled_tracks(runs.withColumn("path", line))
    bare = T.trips.withColumn("shape_id", F.lit(None).cast("string"))
    _run(feeds.start_rebuild(feeds.stream_positions(T.spark, folder), scratch_path(T.spark, "fallback-positions"), bare, T.shape_tracks, path,
                             scratch_path(T.spark, "fallback-checkpoint"), hours=48, options={"scheduled": scheduled}))
    rows = tables.read_snapshot(T.spark, path)
    return rows.where("trip_id IS NOT NULL").select("trip_instance_id", F.size("trip").alias("n"), F.forall("path", lambda p: F.abs(p["lat"] - 49.2) < 1e-9).alias("on_schedule"))


add("st06_rebuild_window_with_heads", _with_heads,
    f"""SELECT trip_instance_id, count(DISTINCT entity_timestamp) AS n, min(entity_timestamp) AS starttime FROM ({_LANDED})
        WHERE entity_timestamp >= (SELECT max(e) * 1000000 - 93600000000 FROM x_landed_positions)
          AND trip_instance_id IN (SELECT trip_instance_id FROM ({_LANDED}) WHERE entity_timestamp >= (SELECT max(e) * 1000000 - 7200000000 FROM x_landed_positions))
        GROUP BY 1 HAVING count(DISTINCT entity_timestamp) > 1""")
add("st06_rebuild_window_scheduled", _scheduled_fallback,
    f"""SELECT trip_instance_id, count(DISTINCT entity_timestamp) AS n, true AS on_schedule FROM ({_LANDED})
        WHERE trip_id IS NOT NULL AND entity_timestamp >= (SELECT max(e) * 1000000 - 172800000000 FROM x_landed_positions)
        GROUP BY 1 HAVING count(DISTINCT entity_timestamp) > 1""")


def _three_days(T):
    """The predictions dealt over three service dates, and the same after one date is gone and another has lost rows."""
    days = F.col("trip_id").cast("long") % 3
    # the runs are named by their dates before they are dealt out, so nothing is moved again
    updates = T.dealt_updates(lambda order: order % 3)
    later = lambda c: F.timestamp_seconds(F.unix_seconds(c) + days * 86400)
    dealt = updates.withColumns({
        "service_date": F.date_add(F.lit("2024-01-08").cast("date"), days.cast("int")), "arrival_time": later("arrival_time"),
        "departure_time": later("departure_time")})
    return dealt, dealt.where((days != 1) & ~((days == 2) & (F.col("tie1") % 7 == 0)))


def _refreshed(T):
    """The contents of the views after a full refresh and one of the two dates that have changed since."""
    folder, (before, after) = scratch_path(T.spark, "live-views"), _three_days(T)
    rest = (T.segment_rows, T.transit_stops, T.routes, T.stops, folder)
    feeds.refresh_views(before, *rest, ties=["tie1", "tie2"])
    feeds.refresh_views(after, *rest, service_dates=[date(2024, 1, 9), date(2024, 1, 10)], ties=["tie1", "tie2"])
    told = {
        "speed_comparison": ("stop_sequence", "actual_speed_kmh"), "delay_analysis": ("from_seq", "segment_delay_minutes"),
        "schedule_times": ("stop_sequence", "delay_minutes"), "headway_stats": ("arrival_time", "headway_minutes")}
    out = None
    for name, (place, value) in told.items():
        at = F.unix_seconds(place) if name == "headway_stats" else F.col(place)
        one = T.spark.read.parquet(f"{folder}/{name}").select(
            F.lit(name).alias("view"), "trip_instance_id", at.cast("long").alias("place"), F.col(value).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


cte("y_updates", """
SELECT * REPLACE (concat(trip_id, '_', 20240108 + CAST(trip_id AS BIGINT) % 3) AS trip_instance_id,
  arrival_epoch + CAST(trip_id AS BIGINT) % 3 * 86400 AS arrival_epoch) FROM x_updates
WHERE CAST(trip_id AS BIGINT) % 3 <> 1 AND NOT (CAST(trip_id AS BIGINT) % 3 = 2 AND tie1 % 7 = 0)""")
LIVE = ["updates", "deduped", "next", "observed", "lagged", "headways", "schedule"]
for name in LIVE[1:]:
    text = registry.CTES[f"x_{name}"]
    for other in LIVE:
        text = re.sub(rf"\bx_{other}\b", f"y_{other}", text)
    cte(f"y_{name}", text)
add("st07_refresh_views", _refreshed, f"""
    SELECT 'speed_comparison' AS view, trip_instance_id, CAST(stop_sequence AS BIGINT) AS place, {r('actual_speed', 'value', 3)} FROM y_observed
    UNION ALL SELECT 'delay_analysis', trip_instance_id, stop_sequence, {r('delay_minutes', 'value', 3)} FROM y_observed
    UNION ALL SELECT 'schedule_times', trip_instance_id, stop_sequence, {r('delay_minutes', 'value', 3)} FROM y_schedule
    UNION ALL SELECT 'headway_stats', trip_instance_id, arrival_epoch, {r('headway_minutes', 'value', 3)} FROM y_headways""", value=3)
