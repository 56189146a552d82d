"""Operators on stop-time predictions: latest prediction, next stop, previous vehicle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitloom.functions import scalars as s
from transitloom.functions.windows import sliced_lag
from transitloom.operators.lines import attach_geometry, segment_geometries

UPDATE_VALUES = [
    "trip_id", "route_id", "service_date", "stop_id", "arrival_time", "departure_time",
    "arrival_delay_seconds", "departure_delay_seconds",
]


def dedup_updates(updates: DataFrame, ties: list[str] = ()) -> DataFrame:
    """Latest fetch per (trip instance, stop sequence) among rows with an arrival.

    Written as MAX of a struct: repeats of one stop collapse on the map side, so a prediction that
    was polled a million times is not a hot key.
    """
    keys = ["trip_instance_id", "stop_sequence"]
    latest = F.max(F.struct("fetch_timestamp", *ties, *UPDATE_VALUES)).alias("__r")
    rows = updates.where(F.col("arrival_time").isNotNull()).groupBy(*keys).agg(latest)
    names = {"arrival_time": "actual_arrival", "departure_time": "actual_departure"}
    return rows.select(*keys, *[F.col(f"__r.{c}").alias(names.get(c, c)) for c in UPDATE_VALUES])


NEXT = ["next_stop_sequence", "next_stop_id", "next_actual_arrival", "next_delay_seconds"]


def next_stop(deduped: DataFrame) -> DataFrame:
    """Sequence, stop, arrival and delay of the next observed stop of the same trip instance.

    Input has one row per (trip instance, stop sequence), so a window holds one trip's stops.
    """
    w = Window.partitionBy("trip_instance_id").orderBy(F.col("stop_sequence").asc_nulls_last())
    return deduped.withColumns({
        "next_stop_sequence": F.lead("stop_sequence").over(w),
        "next_stop_id": F.lead("stop_id").over(w),
        "next_actual_arrival": F.lead("actual_arrival").over(w),
        "next_delay_seconds": F.lead("arrival_delay_seconds").over(w),
    })


def updates_to_segments(pairs: DataFrame, segments: DataFrame, require_adjacent: bool = False) -> DataFrame:
    """Join observed stop pairs to the timetable segment that starts at the first stop.

    A missing observation makes the observed pair span several segments; ``require_adjacent``
    drops such pairs. Segments may come without their lines; ``with_lines`` attaches them to what is left.
    """
    seg = segments.select(
        "trip_id", F.col("stop1_sequence").alias("stop_sequence"), "stop2_sequence", "seg_length",
        (F.col("stop2_arrival") - F.col("stop1_arrival")).alias("scheduled_seconds"),
        *(c for c in ("seg_geom",) if c in segments.columns), "geom_key",
        F.col("stop1_id").alias("seg_stop1_id"), F.col("stop2_id").alias("seg_stop2_id"),
    ).where((F.col("seg_length") > 10) & (F.col("scheduled_seconds") > 0))
    observed = pairs.withColumn("actual_seconds", s.epoch_diff("next_actual_arrival", "actual_arrival")).where(
        (F.col("actual_seconds") > 0) & (F.col("actual_seconds") < 3600)
    )
    out = observed.join(seg, ["trip_id", "stop_sequence"])
    if require_adjacent:
        out = out.where(F.col("next_stop_sequence") == F.col("stop2_sequence"))
    return out


def with_lines(rows: DataFrame, geometries: DataFrame) -> DataFrame:
    """Attach the line of the segment to observed pairs: no coordinates move with a row before."""
    return attach_geometry(rows, geometries, "seg_stop1_id", "seg_stop2_id").withColumnRenamed("geom", "seg_geom")


def attach_names(rows: DataFrame, routes: DataFrame, stops: DataFrame,
                 from_stop: str = "stop_id", to_stop: str | None = "next_stop_id") -> DataFrame:
    """Left-join route names and stop names with positions."""
    out = rows.join(routes.select("route_id", "route_short_name", "route_long_name", "route_type"), "route_id", "left")
    for col, side in ((from_stop, "from"), (to_stop, "to")):
        if col is None:
            continue
        named = stops.select(
            F.col("stop_id").alias(col),
            F.col("stop_name").alias(f"{side}_stop_name"),
            F.col("stop_lat").alias(f"{side}_lat"),
            F.col("stop_lon").alias(f"{side}_lon"),
        )
        out = out.join(named, col, "left")
    return out


def attach_schedule(deduped: DataFrame, ts: DataFrame) -> DataFrame:
    """Left-join the scheduled arrival of the same (trip, stop sequence)."""
    scheduled = ts.select("trip_id", "stop_sequence", F.col("arrival_seconds").alias("scheduled_arrival_seconds"))
    return deduped.join(scheduled, ["trip_id", "stop_sequence"], "left")


def arrival_instants(updates: DataFrame, *by: str) -> DataFrame:
    """Each instant at which a route arrives at a stop, with its first and last trip (per further columns ``by``).

    Rows with equal arrival have a gap of zero and are never a headway, so this is all a headway needs. It collapses repeated
    predictions before the shuffle.
    """
    return (
        updates.where(F.col("arrival_time").isNotNull() & F.col("stop_id").isNotNull() & F.col("route_id").isNotNull())
        .groupBy("route_id", "stop_id", "arrival_time", *by)
        .agg(F.min("trip_instance_id").alias("trip_instance_id"), F.max("trip_instance_id").alias("last_trip"))
    )


def prev_vehicle(updates: DataFrame) -> DataFrame:
    """Previous arrival, and the trip it belonged to, per (route, stop) in order of arrival.

    The lookup is sliced by day, so one busy (route, stop) does not end in one task.
    """
    out = sliced_lag(
        arrival_instants(updates), ["route_id", "stop_id"], ["arrival_time"], F.to_date("arrival_time"),
        {"arrival_time": "prev_arrival", "last_trip": "prev_trip_instance_id"},
    )
    return out.drop("last_trip")


def closing_vehicles(instants: DataFrame, day: str) -> DataFrame:
    """The last vehicle of each (route, stop) on each day, which the first one of the next day follows."""
    last = F.max(F.struct("arrival_time", "last_trip")).alias("__r")
    return instants.groupBy("route_id", "stop_id", day).agg(last).select("route_id", "stop_id", day, "__r.*")


def prev_vehicle_of_days(instants: DataFrame, closings: DataFrame, day: str, *within: str) -> DataFrame:
    """As ``prev_vehicle`` for the instants of some days, with the closing vehicles of the days before.

    A vehicle that came more than a day before the first of a day is left out; such a gap is no headway. Both sides may
    lie by the day and further columns ``within``, which depend on (route, stop) only; no row is moved then.
    """
    keys = ["route_id", "stop_id", day, *within]
    here = Window.partitionBy(*keys).orderBy("arrival_time")
    before = closings.select("route_id", "stop_id", F.date_add(day, 1).alias(day), *within, F.struct("arrival_time", "last_trip").alias("__before"))
    near = instants.withColumn("__near", F.lag(F.struct("arrival_time", "last_trip")).over(here))
    joined = near.join(before, keys, "left").withColumn("__prev", F.coalesce("__near", "__before"))
    return joined.select("route_id", "stop_id", "arrival_time", "trip_instance_id", day, F.col("__prev.arrival_time").alias("prev_arrival"),
                         F.col("__prev.last_trip").alias("prev_trip_instance_id"))


# ---- named range filters ------------------------------------------------------------------
def keep_delay_range(df: DataFrame, c: str = "segment_delay_minutes") -> DataFrame:
    return df.where(F.col(c).between(-30, 60))


def keep_speed_range(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where((F.col(c) > 0) & (F.col(c) < 150))
    return df


def keep_headway_range(df: DataFrame, seconds: str) -> DataFrame:
    return df.where((F.col(seconds) > 0) & (F.col(seconds) < 7200))


# ---- base views ---------------------------------------------------------------------------
def _local_time(ts: str) -> dict:
    return {"hour_of_day": s.local_hour(ts), "day_of_week": s.local_dow(ts)}


def speed_comparison(deduped: DataFrame, segments: DataFrame, routes: DataFrame, stops: DataFrame,
                     require_adjacent: bool = False) -> DataFrame:
    """Scheduled against observed speed per observed segment."""
    rows = updates_to_segments(next_stop(deduped), segments.drop("seg_geom"), require_adjacent)
    return drawn_speeds(speeds_of(rows, routes, stops), segment_geometries(segments))


def drawn_speeds(speeds: DataFrame, geometries: DataFrame) -> DataFrame:
    keys = ["geom_key", "seg_stop1_id", "seg_stop2_id"]
    return with_lines(speeds, geometries).select(*(c for c in speeds.columns if c not in keys), "seg_geom", *keys)


def speeds_of(observed: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """The speed comparison of observed segments, without their lines."""
    rows = observed.withColumns({
        "scheduled_speed_kmh": s.speed_kmh("seg_length", "scheduled_seconds"),
        "actual_speed_kmh": s.speed_kmh("seg_length", "actual_seconds"),
        **_local_time("actual_arrival"),
    })
    return attach_names(rows, routes, stops).select(
        "trip_instance_id", "trip_id", "route_short_name", "route_long_name", "route_type", "route_id",
        "service_date", "stop_sequence", "next_stop_sequence", "stop_id", "next_stop_id",
        "from_stop_name", "to_stop_name", F.col("seg_length").alias("segment_length_m"),
        "scheduled_seconds", "actual_seconds", "arrival_delay_seconds", "hour_of_day", "day_of_week",
        "scheduled_speed_kmh", "actual_speed_kmh", "geom_key", "seg_stop1_id", "seg_stop2_id",
    )


def delay_analysis(deduped: DataFrame, segments: DataFrame, routes: DataFrame, stops: DataFrame,
                   require_adjacent: bool = False) -> DataFrame:
    """Delay gained per observed segment, with local time labels and geometry."""
    rows = updates_to_segments(next_stop(deduped), segments.drop("seg_geom"), require_adjacent)
    return drawn_delays(delays_of(rows, routes, stops), segment_geometries(segments))


def drawn_delays(delays: DataFrame, geometries: DataFrame) -> DataFrame:
    from transitloom.functions.geometry import as_geojson

    # the text is made once per line, not per row
    lines = geometries.withColumn("seg_geojson", as_geojson("geom"))
    before = delays.columns[:delays.columns.index("geom_key")]
    drawn = attach_geometry(delays, lines, "seg_stop1_id", "seg_stop2_id", "seg_geojson").withColumnRenamed("geom", "seg_geom")
    return drawn.select(*before, "seg_geom", "seg_geojson", *delays.columns[len(before):])


def delays_of(observed: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """The delay analysis of observed segments, without their lines."""
    rows = observed.withColumns(_local_time("actual_arrival"))
    return attach_names(rows, routes, stops).select(
        "trip_instance_id", "trip_id", "route_short_name", "route_long_name", "route_type", "route_id",
        "service_date", F.col("stop_sequence").alias("from_seq"), F.col("next_stop_sequence").alias("to_seq"),
        F.col("stop_id").alias("from_stop_id"), F.col("next_stop_id").alias("to_stop_id"),
        "from_stop_name", "to_stop_name", "from_lat", "from_lon", "to_lat", "to_lon",
        F.col("seg_length").alias("segment_length_m"),
        "geom_key", "seg_stop1_id", "seg_stop2_id", "scheduled_seconds", "actual_seconds",
        F.col("arrival_delay_seconds").alias("from_delay"), F.col("next_delay_seconds").alias("to_delay"),
        (F.col("next_delay_seconds") - F.col("arrival_delay_seconds")).alias("segment_delay_change"),
        ((F.col("actual_seconds") - F.col("scheduled_seconds")) / 60.0).alias("segment_delay_minutes"),
        "hour_of_day", "day_of_week",
        s.day_type("day_of_week").alias("day_type"), s.time_period("hour_of_day").alias("time_period"),
    )


def headways(arrivals: DataFrame, routes: DataFrame, stops: DataFrame, *more: str) -> DataFrame:
    """Headways under two hours from arrivals with their previous vehicle, with names and local times."""
    rows = arrivals.withColumn("__gap", s.epoch_diff("arrival_time", "prev_arrival"))
    rows = keep_headway_range(rows, "__gap").where(F.col("trip_instance_id") != F.col("prev_trip_instance_id"))
    return (
        rows.withColumns(_local_time("arrival_time"))
        .join(routes.select("route_id", "route_short_name", "route_long_name", "route_type"), "route_id")
        .join(stops.select("stop_id", "stop_name", "stop_lat", "stop_lon"), "stop_id", "left")
        .select(
            "route_id", "route_short_name", "route_long_name", "route_type", "stop_id", "stop_name", "stop_lat",
            "stop_lon", "trip_instance_id", "prev_trip_instance_id", "arrival_time", "prev_arrival",
            (F.col("__gap") / 60.0).alias("headway_minutes"), "hour_of_day", "day_of_week",
            s.day_type("day_of_week").alias("day_type"), s.time_period("hour_of_day").alias("time_period"), *more,
        )
    )


def headway_stats(updates: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Time between consecutive vehicles of a route at a stop, under two hours.

    Takes the raw updates; pass deduplicated ones (with ``arrival_time``) for one prediction per stop.
    """
    return headways(prev_vehicle(updates), routes, stops)


def schedule_times(deduped: DataFrame, ts: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Arrival delay against the timetable for every stop that reports one."""
    rows = attach_schedule(deduped.where(F.col("arrival_delay_seconds").isNotNull()), ts)
    return (
        rows.withColumns(_local_time("actual_arrival"))
        .join(routes.select("route_id", "route_short_name", "route_long_name", "route_type"), "route_id")
        .join(stops.select("stop_id", "stop_name", "stop_lat", "stop_lon"), "stop_id", "left")
        .select(
            "trip_instance_id", "trip_id", "route_short_name", "route_long_name", "route_type", "route_id",
            "service_date", "stop_sequence", "stop_id", "stop_name", "stop_lat", "stop_lon",
            "scheduled_arrival_seconds", "actual_arrival", "actual_departure",
            "arrival_delay_seconds", "departure_delay_seconds",
            (F.col("arrival_delay_seconds") / 60.0).alias("delay_minutes"),
            "hour_of_day", "day_of_week", s.day_type("day_of_week").alias("day_type"),
        )
    )


# ---- derived measures ---------------------------------------------------------------------
def delay_metrics(delay_view: DataFrame) -> DataFrame:
    """Per-row measures on the delay view: seconds, per km, speeds, reduction; observed speed under 150."""
    d = delay_view.withColumn("segment_delay_seconds", F.col("actual_seconds") - F.col("scheduled_seconds"))
    d = d.withColumns({
        "delay_per_km": F.try_divide(F.col("segment_delay_seconds"), F.col("segment_length_m") / 1000),
        "scheduled_speed_kmh": s.speed_kmh("segment_length_m", "scheduled_seconds"),
        "actual_speed_kmh": s.speed_kmh("segment_length_m", "actual_seconds"),
    })
    slower = F.col("scheduled_speed_kmh") - F.col("actual_speed_kmh")
    return d.withColumns({
        "speed_reduction_pct": F.try_divide(slower, F.col("scheduled_speed_kmh")) * 100,
        "delay_severity": s.bin_right_closed("segment_delay_minutes", s.DELAY_EDGES, s.DELAY_SEVERITY),
    }).where(F.col("actual_speed_kmh") < 150)


def speed_metrics(speed_view: DataFrame) -> DataFrame:
    """Speed difference and ratio, with the day type."""
    return speed_view.withColumns({
        "day_type": s.day_type("day_of_week"),
        "speed_delta_kmh": F.col("actual_speed_kmh") - F.col("scheduled_speed_kmh"),
        "speed_ratio": F.try_divide(F.col("actual_speed_kmh"), F.col("scheduled_speed_kmh")),
    })


def speed_with_geometry(speed_view: DataFrame, delay_view: DataFrame, geometries: DataFrame | None = None) -> DataFrame:
    """Attach segment geometry from the delay view to the speed view on (trip instance, sequence).

    A delay view without lines has the keys of ``geometries``, which are joined last.
    """
    keys, at = ["trip_instance_id", "stop_sequence"], F.col("from_seq").alias("stop_sequence")
    if geometries is None:
        rows = speed_view.join(delay_view.select("trip_instance_id", at, F.col("seg_geom").alias("geom")), keys, "left")
    else:
        line = {"seg_stop1_id": "__stop1", "seg_stop2_id": "__stop2", "geom_key": "__line"}
        named = delay_view.select("trip_instance_id", at, *[F.col(c).alias(n) for c, n in line.items()])
        dim = geometries.select(F.col("stop1_id").alias("__stop1"), F.col("stop2_id").alias("__stop2"), F.col("geom_key").alias("__line"), "geom")
        rows = speed_view.join(named, keys).join(dim, list(line.values())).drop(*line.values())
        rows = rows.select(*keys, *(c for c in rows.columns if c not in keys))
    return rows.where(F.col("geom").isNotNull())
