"""Timetable jobs: cleaning, service days, stop-to-stop network, timed points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.functions import geometry as g
from transitloom.functions import scalars as s
from transitloom.operators import timetable as t
from transitloom.operators.lines import edge_table, tracks
from transitloom.operators.moving import moving_point, path_of, start_time

Stage = Callable[[DataFrame], DataFrame]
# Service days up to this number are broadcast: a few dozen megabytes.
MOST_DAYS_BROADCAST = 500_000


def _as_is(df: DataFrame) -> DataFrame:
    return df


def clean_timetable(tables: dict[str, DataFrame], box: dict[str, float] = t.REGION_BOX,
                    stage: Stage = _as_is) -> dict[str, DataFrame]:
    """Prune columns, drop empty rows, keep what lies in the box and what refers to it, clean times.

    ``stage`` is that of `keep_referenced`: pass one when several of the tables are used.
    """
    from transitloom.sources.gtfs import KEEP, drop_empty_rows, prune_columns

    pruned = {n: drop_empty_rows(prune_columns(df, KEEP[n])) for n, df in tables.items() if n in KEEP}
    pruned["trips"] = pruned["trips"].withColumn("shape_id", s.blank_to_null("shape_id"))
    located = pruned["stops"].withColumns(
        {c: F.col(c).try_cast("double") for c in ("stop_lat", "stop_lon")}
    )
    kept = t.keep_referenced(pruned, t.filter_bbox(located, box).select("stop_id"), stage)
    times = kept["stop_times"].withColumns(
        {c: s.normalise_time(c) for c in ("arrival_time", "departure_time")}
    )
    kept["stop_times"] = t.valid_trips(times, kept["trips"])
    return kept


def service_dates(calendar: DataFrame, calendar_dates: DataFrame, removal_scope: str = "global") -> DataFrame:
    """Days each service runs: weekday pattern, plus added days, minus removed days."""
    added = calendar_dates.where(F.col("exception_type") == 1)
    removed = calendar_dates.where(F.col("exception_type") == 2)
    return t.except_removed_days(t.union_service_days(t.expand_calendar(calendar), added), removed, removal_scope)


def route_segments(trips: DataFrame, stop_times: DataFrame, stops: DataFrame, shapes: DataFrame,
                   stage: Stage = _as_is) -> DataFrame:
    """Stop-to-stop segments with geometry, length and scheduled times.

    Geometry is cut once per distinct (line, stop pair) and joined back; trips without a shape share the line of their
    stop pattern. Its running lengths (``run_m``) come with it. Calls, which have the next call beside them, and edges feed several branches:
    on a large feed pass a ``stage`` that writes them to the shared folder and reads them back, so that each is computed once.
    """
    calls = stage(t.with_pattern(t.calls_lead(t.with_line(t.transit_stops(trips, stop_times)))))
    segments = calls.where(F.col("stop2_sequence").isNotNull()).drop("__place")
    edges = stage(t.shape_edges(shapes).unionByName(t.pattern_edges(calls.withColumnRenamed("stop1_id", "stop_id"), stops)))
    patterns = stage(t.pattern_geometry(segments, edges, stops))
    # stored, its size is known before the segments are: few or none, so they are not moved to meet it
    broken = stage(segments.join(patterns.select(*t.PATTERN), t.PATTERN, "left_anti").select("trip_id").distinct())
    return (
        segments.join(broken, "trip_id", "left_anti")
        .join(patterns, t.PATTERN)
        .drop("line_id", "head1", "head2", "tail2")
    )


def trip_points(segments: DataFrame, fraction_units: str = "consistent") -> DataFrame:
    """Timed vertices of every trip, in one pass without a shuffle; the running lengths come with the segments.

    A vertex lies at its share of the segment: metres over metres (``consistent``), or planar
    degrees over metres (``degrees``, which keeps inner vertices at almost the start time).
    """
    run = {"consistent": F.col("run_m"), "degrees": F.col("run_deg")}[fraction_units]
    rows = segments.where(F.col("seg_length") > 0).withColumn("__v", F.arrays_zip(F.col("seg_geom").alias("p"), run.alias("run")))
    rows = rows.select(
        "trip_id", "route_id", "service_id", "stop1_sequence", "stop2_sequence", "num_stops", "no_points",
        "stop1_arrival", "stop2_arrival", "seg_length", F.posexplode("__v").alias("__i", "__p"),
    ).withColumn("point_sequence", F.col("__i") + 1)
    first, last = F.col("stop1_arrival"), F.col("stop2_arrival")
    between = first + (last - first) * (F.col("__p.run") / F.col("seg_length"))
    at = (
        F.when(F.col("point_sequence") == 1, first.cast("double"))
        .when(F.col("point_sequence") == F.col("no_points"), last.cast("double"))
        .otherwise(between)
    )
    return (
        rows.where((F.col("point_sequence") != F.col("no_points")) | (F.col("stop2_sequence") == F.col("num_stops")))
        .select(
            "trip_id", "route_id", "service_id", "stop1_sequence", "point_sequence",
            F.col("__p.p.lon").alias("lon"), F.col("__p.p.lat").alias("lat"), at.alias("point_arrival"),
        )
    )


def points_to_dates(points: DataFrame, dates: DataFrame, on_dates: list | None = None) -> DataFrame:
    """Timed points on real dates: the given ones, or the earliest service date.

    A handful of services holds all points, so a shuffle on the service would end in a few tasks. The days are
    broadcast if they are counted to be few; beyond that, their join is the planner's.
    """
    if on_dates:
        chosen = dates.where(F.col("date").isin([F.lit(d).cast("date") for d in on_dates]))
    else:
        chosen = dates.where(F.col("date") == dates.agg(F.min("date")).scalar())
    micros = F.round(F.col("point_arrival") * 1e6).cast("long")
    midnight = F.unix_date("date").cast("long") * 86_400_000_000
    if chosen.limit(MOST_DAYS_BROADCAST + 1).count() <= MOST_DAYS_BROADCAST:
        chosen = F.broadcast(chosen)
    return points.join(chosen, "service_id").withColumn("t", F.timestamp_micros(midnight + micros))


def scheduled_trajectories(points: DataFrame, dates: DataFrame, on_dates: list | None = None) -> DataFrame:
    """Timetable moving points for one date (the earliest by default) or several."""
    keys = ["trip_id", "route_id", "date", "t"]
    timed = points_to_dates(points, dates, on_dates).select(*keys, "point_sequence", "stop1_sequence", "lon", "lat")
    first = t.distinct_on(timed, keys, ["point_sequence", "stop1_sequence"])
    trips = moving_point(first, ["trip_id", "route_id", "date"])
    return trips.withColumns({"path": path_of("trip"), "starttime": start_time("trip")})


def scheduled_tracks(scheduled: DataFrame) -> DataFrame:
    """Scheduled paths packed for snapping, one per (trip, date)."""
    points = scheduled.select(F.struct("trip_id", "date").alias("run"), F.posexplode("path").alias("i", "p")).select(
        "run", "i", "p.lon", "p.lat")
    return tracks(edge_table(points, "run", "i"), "run").select(
        "run.trip_id", "run.date", F.col("track").alias("scheduled_track"))
