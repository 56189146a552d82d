"""Landing of live feed snapshots: one row per snapshot document to flat tables.

The same functions serve batch and streaming frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.functions import scalars as s

# ---- fixed values: the landed snapshot layout ----------------------------------------------
_TRIP = (
    "struct<trip_id:string,route_id:string,direction_id:int,start_time:string,start_date:string,"
    "schedule_relationship:string>"
)
_VEHICLE = "struct<id:string,label:string,license_plate:string>"
_EVENT = "struct<time:bigint,delay:int>"
SNAPSHOT_SCHEMA = (
    "fetched_at bigint, header struct<timestamp:bigint>, entity array<struct<id:string,"
    f"vehicle:struct<trip:{_TRIP},vehicle:{_VEHICLE},"
    "position:struct<latitude:double,longitude:double,bearing:double,speed:double>,"
    "timestamp:bigint,current_stop_sequence:int,stop_id:string,current_status:string,occupancy_status:string>,"
    f"trip_update:struct<trip:{_TRIP},vehicle:{_VEHICLE},timestamp:bigint,"
    f"stop_time_update:array<struct<stop_sequence:int,stop_id:string,arrival:{_EVENT},departure:{_EVENT},"
    "schedule_relationship:string>>>>>"
)
# -------------------------------------------------------------------------------------------


def _text(c) -> F.Column:
    return F.nullif(F.col(c), F.lit(""))


def _who(part: str) -> dict[str, F.Column]:
    """Fields both landing steps share, from the trip and vehicle descriptors of an entity part."""
    fetched = F.timestamp_seconds("fetched_at")
    start = s.parse_service_date(f"{part}.trip.start_date")
    at = s.entity_time(F.col(f"{part}.timestamp"), F.col("header.timestamp"), fallback=fetched)
    return {
        "fetch_timestamp": fetched,
        "entity_timestamp": at,
        "trip_instance_id": s.trip_instance_id(
            F.col(f"{part}.trip.trip_id"), start, F.col(f"{part}.trip.start_time"), F.col(f"{part}.vehicle.id"), at),
        "trip_id": _text(f"{part}.trip.trip_id"),
        "route_id": _text(f"{part}.trip.route_id"),
        "start_time": _text(f"{part}.trip.start_time"),
        "start_date": start,
        "vehicle_id": F.col(f"{part}.vehicle.id"),
    }


def _only_routes(df: DataFrame, routes: DataFrame | None) -> DataFrame:
    return df if routes is None else df.join(routes.select("route_id"), "route_id", "left_semi").select(*df.columns)


def land_vehicle_positions(snapshots: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """One row per vehicle entity; a coordinate that is missing or zero drops the row.

    ``routes`` (route_id) switches the route filter on; a row without a route then fails.
    """
    v = snapshots.select("fetched_at", "header", F.explode("entity").alias("e")).select(
        "fetched_at", "header", F.col("e.vehicle").alias("v")).where(F.col("v").isNotNull())
    v = v.where((F.coalesce("v.position.latitude", F.lit(0.0)) != 0) & (F.coalesce("v.position.longitude", F.lit(0.0)) != 0))
    rows = v.select(
        *[c.alias(n) for n, c in _who("v").items()],
        F.col("v.trip.direction_id").cast("short").alias("direction_id"),
        F.col("v.vehicle.label").alias("vehicle_label"),
        F.col("v.vehicle.license_plate").alias("license_plate"),
        F.col("v.current_stop_sequence").alias("current_stop_sequence"),
        _text("v.stop_id").alias("stop_id"),
        F.col("v.current_status").alias("current_status"),
        F.col("v.trip.schedule_relationship").alias("schedule_relationship"),
        F.col("v.occupancy_status").alias("occupancy_status"),
        F.col("v.position.bearing").alias("bearing"),
        F.col("v.position.speed").alias("speed_mps"),
        F.col("v.position.latitude").alias("latitude"),
        F.col("v.position.longitude").alias("longitude"),
    )
    return _only_routes(rows, routes)


def land_trip_updates(snapshots: DataFrame, routes: DataFrame | None = None, zero_delay_is_null: bool = True) -> DataFrame:
    """One row per stop-time update; times only where set. A delay of exactly zero is stored as missing
    unless ``zero_delay_is_null`` is off."""
    u = snapshots.select("fetched_at", "header", F.explode("entity").alias("e")).select(
        "fetched_at", "header", F.col("e.trip_update").alias("u")).where(F.col("u").isNotNull())
    rows = u.select(*[c.alias(n) for n, c in _who("u").items()],
                    F.col("u.trip.schedule_relationship").alias("schedule_relationship"),
                    F.explode("u.stop_time_update").alias("s"))
    at = lambda side: F.timestamp_seconds(F.nullif(F.col(f"s.{side}.time"), F.lit(0)))

    def delay(side: str) -> F.Column:
        value = F.col(f"s.{side}.delay")
        return F.nullif(value, F.lit(0)) if zero_delay_is_null else value

    flat = rows.select(
        "fetch_timestamp", "entity_timestamp", "trip_instance_id", "trip_id", "route_id", "start_time", "start_date",
        "vehicle_id", F.col("s.stop_sequence").alias("stop_sequence"), _text("s.stop_id").alias("stop_id"),
        at("arrival").alias("arrival_time"), delay("arrival").alias("arrival_delay_seconds"),
        at("departure").alias("departure_time"), delay("departure").alias("departure_delay_seconds"),
        "schedule_relationship", F.col("s.schedule_relationship").alias("stop_schedule_relationship"),
    )
    return _only_routes(flat, routes)


def as_updates(landed: DataFrame) -> DataFrame:
    """Landed updates under the names the operators use."""
    return landed.withColumnRenamed("start_date", "service_date")
