"""Moving points: a trip as ``array<struct<t, lon, lat>>`` sorted by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitloom.functions import geometry as g
from transitloom.functions import scalars as s
from transitloom.operators.timetable import route_filter

WHO = ["trip_id", "route_id", "service_date", "vehicle_id"]


def moving_point(points: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """Time-ordered instants per key, at least two; carried fields take their smallest value.

    One key is one run of one vehicle inside the requested time window, with one point per instant.
    """
    instants = F.sort_array(F.collect_list(F.struct("t", "lon", "lat")))
    return (
        points.groupBy(*keys)
        .agg(instants.alias("trip"), *[F.min(c).alias(c) for c in carry])
        .where(F.size("trip") > 1)
    )


def path_of(trip: Column | str) -> Column:
    """Spatial path of a moving point, consecutive repeats collapsed."""
    trip = F.col(trip) if isinstance(trip, str) else trip
    return g.collapse_repeats(F.transform(trip, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))))


def start_time(trip: Column | str) -> Column:
    trip = F.col(trip) if isinstance(trip, str) else trip
    return F.get(trip, F.lit(0))["t"]


def time_window(df: DataFrame, start, end, ts: str = "entity_timestamp") -> DataFrame:
    """Rows of identified trips in a closed time window."""
    if start >= end:
        raise ValueError("window start must be before its end")
    return df.where(F.col(ts).between(F.lit(start), F.lit(end)) & F.col("trip_instance_id").isNotNull())


def dedup_positions(positions: DataFrame, ties: list[str] = ()) -> DataFrame:
    """First fetch per (trip instance, entity time); an aggregate, so repeats shrink before the shuffle."""
    keys = ["trip_instance_id", "entity_timestamp"]
    order = ["fetch_timestamp", *ties]
    rest = [c for c in positions.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__r")
    return positions.groupBy(*keys).agg(first).select(
        *keys, *[F.col(f"__r.{c}").alias(c) for c in [*order, *rest]]
    )


def strictly_increasing(points: DataFrame, keys: list[str], ts: str, order: list[str] = ()) -> DataFrame:
    """Keep points later than the last kept one: on sorted input that is one row per (key, time)."""
    rest = [c for c in points.columns if c not in keys and c != ts and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__r")
    return points.groupBy(*keys, ts).agg(first).select(
        *keys, ts, *[F.col(f"__r.{c}").alias(c) for c in [*order, *rest]]
    )


def trip_to_line(positions: DataFrame, trips: DataFrame, shape_tracks: DataFrame,
                 scheduled: DataFrame | None = None) -> DataFrame:
    """Attach the line a position should lie on: the trip's shape, else its scheduled path.

    ``shape_tracks`` has (line_id, track); ``scheduled`` has (trip_id, date, scheduled_track). Which of them a position takes is
    settled by joins on ids alone. Each track is attached last, in the one join that finds it, so no exchange carries a
    track of a position; nothing is grouped after that, and a hot shape can be split by the adaptive skew join.
    """
    shaped = trips.where(F.coalesce("shape_id", F.lit("")) != "").select("trip_id", F.concat(F.lit("shape:"), "shape_id").alias("__line")).distinct()
    known = shape_tracks.select(F.col("line_id").alias("__line"), F.lit(True).alias("__known"))
    tracks = shape_tracks.select(F.col("line_id").alias("__line"), F.col("track").alias("shape_track"))
    none = F.lit(None).cast(tracks.schema["shape_track"].dataType)
    placed = positions.join(shaped, "trip_id", "left")
    if scheduled is None:
        return placed.join(tracks, "__line", "left").drop("__line").withColumn("scheduled_track", none)
    placed = placed.join(known, "__line", "left")
    on_shape = placed.where("__known").join(tracks, "__line").drop("__line", "__known").withColumn("scheduled_track", none)
    paths = scheduled.select("trip_id", F.col("date").alias("service_date"), "scheduled_track")
    others = placed.where("__known IS NULL").drop("__line", "__known").withColumn("shape_track", none).join(paths, ["trip_id", "service_date"], "left")
    return on_shape.unionByName(others)


def snap_positions(placed: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Snap each position to its line; without a line the raw point stays."""
    snapped = F.coalesce(
        g.snap_point("shape_track", lon, lat),
        g.snap_point("scheduled_track", lon, lat),
        g.make_point(lon, lat),
    )
    return placed.withColumn("__p", snapped).withColumns(
        {"lon": F.col("__p.lon"), "lat": F.col("__p.lat")}
    ).drop("__p", "shape_track", "scheduled_track")


def snap_to_lines(positions: DataFrame, trips: DataFrame, shape_tracks: DataFrame, scheduled: DataFrame | None = None,
                  lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Snap positions to the trip's shape, else to its scheduled path, else leave them where they are.

    A line is dropped as soon as it was used, so no later exchange carries one, and scheduled paths are
    attached only to rows that have no shape. Equals `snap_positions` of `trip_to_line`.
    """
    out = trip_to_line(positions, trips, shape_tracks).withColumn("__p", g.snap_point("shape_track", lon, lat)).drop(
        "shape_track", "scheduled_track")
    if scheduled is not None:
        paths = scheduled.select(F.col("trip_id").alias("__trip"), F.col("date").alias("__date"), F.col("scheduled_track").alias("__track"))
        wanted = (F.col("trip_id") == F.col("__trip")) & (F.col("service_date") == F.col("__date")) & F.col("__p").isNull()
        out = out.join(paths, wanted, "left").withColumn(
            "__p", F.coalesce("__p", g.snap_point("__track", lon, lat))).drop("__trip", "__date", "__track")
    return out.withColumn("__p", F.coalesce("__p", g.make_point(lon, lat))).withColumns(
        {"lon": F.col("__p.lon"), "lat": F.col("__p.lat")}).drop("__p")


def actual_trajectories(positions: DataFrame, trips: DataFrame, shape_tracks: DataFrame, start, end,
                        scheduled: DataFrame | None = None, routes: DataFrame | None = None,
                        route_ids=(), route_names=(), ties: list[str] = (), now: Column | None = None) -> DataFrame:
    """Observed paths in a time window: first fetch per instant, snapped, in time order."""
    rows = time_window(positions, start, end)
    if routes is not None:
        rows = route_filter(rows, routes, route_ids, route_names)
    rows = rows.withColumn("service_date", s.service_date("start_date", "entity_timestamp"))
    columns = ["trip_instance_id", *WHO, "entity_timestamp", "fetch_timestamp", *ties, "longitude", "latitude"]
    first = dedup_positions(rows.select(*columns), list(ties))
    snapped = snap_to_lines(first, trips, shape_tracks, scheduled)
    return _assemble(snapped.withColumn("t", F.col("entity_timestamp")), now)


def matched_trajectories(matched: DataFrame, shapes: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Observed paths from points a map matcher supplied; its shape is preferred over the path."""
    points = strictly_increasing(
        matched.select("trip_instance_id", *WHO, "entity_timestamp", "longitude", "latitude"),
        ["trip_instance_id"], "entity_timestamp",
    )
    out = _assemble(points.select(
        "trip_instance_id", *WHO, F.col("entity_timestamp").alias("t"),
        F.col("longitude").alias("lon"), F.col("latitude").alias("lat"),
    ), now)
    if shapes is None:
        return out
    usable = shapes.where(F.size("shape") > 1).select("trip_instance_id", "shape")
    return (
        out.join(usable, "trip_instance_id", "left")
        .withColumn("path", F.coalesce("shape", "path")).drop("shape")
    )


def _assemble(points: DataFrame, now: Column | None) -> DataFrame:
    out = moving_point(points, ["trip_instance_id"], WHO)
    return out.select(
        "trip_instance_id", *WHO, "trip", path_of("trip").alias("path"), start_time("trip").alias("starttime"),
        (F.current_timestamp() if now is None else now).alias("updated_at"),
    )


def upsert_trips(old: DataFrame, new: DataFrame, truncate: bool = True) -> DataFrame:
    """Replace rows by trip instance; a row that existed keeps its trip_id. Truncation starts afresh."""
    if truncate:
        return new
    kept = old.join(new.select("trip_instance_id"), "trip_instance_id", "left_anti")
    before = old.select("trip_instance_id", F.col("trip_id").alias("__old"), F.lit(True).alias("__seen"))
    fresh = (
        new.join(before, "trip_instance_id", "left")
        .withColumn("trip_id", F.when(F.col("__seen"), F.col("__old")).otherwise(F.col("trip_id")))
        .select(*old.columns)
    )
    return kept.select(*old.columns).unionByName(fresh)


def trip_instances(positions: DataFrame) -> DataFrame:
    """Smallest value of each field per trip instance, with a stand-in id where it is missing."""
    stamp = F.date_format("entity_timestamp", "yyyyMMddHHmmss")
    who = F.coalesce("trip_instance_id", F.concat("trip_id", F.lit("_"), stamp))
    return (
        positions.where(F.col("trip_id").isNotNull() | F.col("vehicle_id").isNotNull())
        .groupBy(who.alias("trip_instance_id"))
        .agg(
            F.min("trip_id").alias("trip_id"),
            F.min("route_id").alias("route_id"),
            F.min("vehicle_id").alias("vehicle_id"),
            F.min("start_date").alias("start_date"),
            F.min("entity_timestamp").alias("first_observed"),
        )
    )
