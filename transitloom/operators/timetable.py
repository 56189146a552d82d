"""Operators on timetable tables: cleaning joins, stop sequences, calendars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitloom.functions import scalars as s
from transitloom.operators.lines import cut_lines, edge_table, locate_points

# ---- fixed values -------------------------------------------------------------------------
REGION_BOX = {"min_lon": -123.3, "max_lon": -122.3, "min_lat": 49.0, "max_lat": 49.5}
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
# -------------------------------------------------------------------------------------------


def semi(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows whose key occurs in another table, columns in their own order."""
    return df.join(ids.select(col).distinct(), col, "left_semi").select(*df.columns)


def filter_bbox(stops: DataFrame, box: dict[str, float] = REGION_BOX) -> DataFrame:
    """Stops in a closed lon/lat box."""
    return stops.where(
        F.col("stop_lon").between(box["min_lon"], box["max_lon"])
        & F.col("stop_lat").between(box["min_lat"], box["max_lat"])
    )


def bus_only(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows whose route exists and is a bus route."""
    return semi(df, routes.where(F.col("route_type") == s.BUS), "route_id")


def resolve_route_ids(routes: DataFrame, ids=(), short_names=()) -> tuple[bool, DataFrame]:
    """(filter is on, table of route ids): trims tokens, drops blanks, expands short names."""
    clean = lambda tokens: sorted({t.strip() for t in tokens or () if t and t.strip()})
    ids, names = clean(ids), clean(short_names)
    given = routes.sparkSession.createDataFrame([(i,) for i in ids], "route_id string")
    named = routes.where(F.col("route_short_name").isin(names)).select("route_id") if names else given.limit(0)
    return bool(ids or names), given.union(named).distinct()


def route_filter(df: DataFrame, routes: DataFrame, ids=(), short_names=()) -> DataFrame:
    """Keep rows of the chosen routes; names that resolve to nothing let nothing pass."""
    on, wanted = resolve_route_ids(routes, ids, short_names)
    return semi(df, wanted, "route_id") if on else df


def keep_referenced(tables: dict[str, DataFrame], stop_ids: DataFrame,
                    stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Cascade of semi-joins from the kept stops to every table that refers to them.

    Every table hangs on the kept trips, and those on the kept stop times. When all are written, pass a ``stage``
    that writes these two to the shared folder and reads them back, so that each is found once.
    """
    out = dict(tables)
    out["stops"] = semi(tables["stops"], stop_ids, "stop_id")
    out["stop_times"] = stage(semi(tables["stop_times"], stop_ids, "stop_id"))
    out["trips"] = stage(semi(tables["trips"], out["stop_times"], "trip_id"))
    out["routes"] = semi(tables["routes"], out["trips"], "route_id")
    for name in ("calendar", "calendar_dates"):
        if name in tables:
            out[name] = semi(tables[name], out["trips"], "service_id")
    if "shapes" in tables:
        out["shapes"] = semi(tables["shapes"], out["trips"], "shape_id")
    if "agency" in tables and "agency_id" in tables["routes"].columns:
        used = out["routes"].select("agency_id").where(F.col("agency_id").isNotNull())
        kept = semi(tables["agency"], used, "agency_id")
        # without a single agency id on the routes every agency stays
        none_used = used.groupBy().agg(F.count("*").alias("n")).scalar() == 0
        out["agency"] = kept.union(tables["agency"].where(none_used))
    return out


def valid_trips(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Stop times whose trip exists."""
    return semi(stop_times, trips, "trip_id")


def shape_coverage(trips: DataFrame) -> DataFrame:
    """Trips with and without a usable shape id."""
    usable = F.col("shape_id").isNotNull() & (F.trim("shape_id") != "") & (F.col("shape_id") != "nan")
    return trips.agg(
        F.count("*").alias("trips"),
        F.count_if(usable).alias("with_shape"),
        (F.count("*") - F.count_if(usable)).alias("without_shape"),
    )


def transit_stops(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Stops of every trip in order, with the trip's highest sequence number.

    (trip_id, stop_sequence) is the timetable's key, so a window per trip holds one trip's stops.
    """
    return (
        trips.select("trip_id", "route_id", "service_id", "shape_id")
        .join(stop_times.select("trip_id", "stop_sequence", "stop_id", "arrival_seconds"), "trip_id")
        .withColumn("num_stops", F.max("stop_sequence").over(Window.partitionBy("trip_id")))
    )


def line_id() -> Column:
    """Which line a trip runs on: its shape, or the line through its own stops."""
    shape = F.nullif(F.col("shape_id"), F.lit(""))
    return F.coalesce(F.concat(F.lit("shape:"), shape), F.concat(F.lit("trip:"), F.col("trip_id")))


def with_line(ts: DataFrame) -> DataFrame:
    """Add the line that each trip runs on: its shape, or the pattern of its stops.

    Trips without a shape that call at the same stops in the same order share a line. The pattern is two hashes over (place in the trip, stop),
    combined without regard to order, so no list of stops is built, and the windows need the trip's rows only.
    """
    trip = Window.partitionBy("trip_id")
    place = F.row_number().over(trip.orderBy("stop_sequence"))
    rows = ts.withColumn("__place", place)
    part = lambda seed: F.hex(F.bit_xor(F.xxhash64("__place", "stop_id", F.lit(seed))).over(trip))
    shape = F.nullif(F.col("shape_id"), F.lit(""))
    return rows.withColumn("line_id", F.coalesce(
        F.concat(F.lit("shape:"), shape), F.concat(F.lit("stops:"), part("one"), F.lit("-"), part("two"))))


def pattern_edges(ts: DataFrame, stops: DataFrame) -> DataFrame:
    """Lines through the stops of trips that have no shape, one for each stop pattern."""
    points = ts.where(F.coalesce("shape_id", F.lit("")) == "").select("line_id", "__place", "stop_id").distinct()
    return edge_table(points.join(stops.select("stop_id", "stop_lon", "stop_lat"), "stop_id"), "line_id", "__place", "stop_lon", "stop_lat")


def shape_edges(shapes: DataFrame) -> DataFrame:
    lines = shapes.withColumn("line_id", F.concat(F.lit("shape:"), F.col("shape_id")))
    return edge_table(lines, "line_id", "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat")


def stop_edges(trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Lines through the stops of trips that have no shape."""
    bare = trips.where(F.coalesce("shape_id", F.lit("")) == "").select("trip_id")
    points = (
        stop_times.select("trip_id", "stop_sequence", "stop_id")
        .join(bare, "trip_id", "left_semi")
        .join(stops.select("stop_id", "stop_lon", "stop_lat"), "stop_id")
        .withColumn("line_id", F.concat(F.lit("trip:"), F.col("trip_id")))
    )
    return edge_table(points, "line_id", "stop_sequence", "stop_lon", "stop_lat")


def trip_edges(trips: DataFrame, stop_times: DataFrame, stops: DataFrame, shapes: DataFrame) -> DataFrame:
    return shape_edges(shapes).unionByName(stop_edges(trips, stop_times, stops))


def stop_shares(ends: DataFrame, edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Nearest-spot share once per distinct (line, stop): trips share shapes."""
    located = ends.select("line_id", "stop_id").distinct().join(stops.select("stop_id", "stop_lon", "stop_lat"), "stop_id")
    return locate_points(located, edges, "line_id", ["stop_id"], "stop_lon", "stop_lat")


def stop_fraction(ts: DataFrame, edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Position of every stop along its trip's line, 0 at sequence 1 and 1 at the last stop."""
    rows = ts if "line_id" in ts.columns else ts.withColumn("line_id", line_id())
    perc = (
        F.when(F.col("share").isNull(), F.lit(None).cast("double"))
        .when(F.col("stop_sequence") == 1, F.lit(0.0))
        .when(F.col("stop_sequence") == F.col("num_stops"), F.lit(1.0))
        .otherwise(F.col("share"))
    )
    return rows.join(stop_shares(rows, edges, stops), ["line_id", "stop_id"], "left").withColumn("perc", perc).drop("share", "line_id", "__place")


def calls_lead(ts: DataFrame) -> DataFrame:
    """Each stop with the next stop of its trip, if there is one."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    return ts.select(
        "trip_id", "route_id", "service_id", "shape_id", "num_stops", *(c for c in ("line_id", "__place") if c in ts.columns),
        F.col("stop_sequence").alias("stop1_sequence"),
        F.lead("stop_sequence").over(w).alias("stop2_sequence"),
        F.col("stop_id").alias("stop1_id"),
        F.lead("stop_id").over(w).alias("stop2_id"),
        F.col("arrival_seconds").alias("stop1_arrival"),
        F.lead("arrival_seconds").over(w).alias("stop2_arrival"),
    )


def segments_lead(ts: DataFrame) -> DataFrame:
    """Each stop with the next stop of its trip; the last stop has no segment."""
    return calls_lead(ts).where(F.col("stop2_sequence").isNotNull()).drop("__place")


PATTERN = ["line_id", "stop1_id", "stop2_id", "head1", "head2", "tail2"]


def with_pattern(segments: DataFrame) -> DataFrame:
    """Add what decides a segment's geometry: line, both stops, and which ends are forced."""
    return segments.withColumns({
        "line_id": F.col("line_id") if "line_id" in segments.columns else line_id(),
        "head1": F.col("stop1_sequence") == 1,
        "head2": F.col("stop2_sequence") == 1,
        "tail2": F.col("stop2_sequence") == F.col("num_stops"),
    })


def pattern_geometry(segments: DataFrame, edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Geometry, length and vertex count once per distinct pattern; unusable patterns are left out."""
    patterns = segments.select(*PATTERN).distinct()
    ends = patterns.select("line_id", F.explode(F.array("stop1_id", "stop2_id")).alias("stop_id"))
    shares = stop_shares(ends, edges, stops)
    one = shares.select("line_id", F.col("stop_id").alias("stop1_id"), F.col("share").alias("share1"))
    two = shares.select("line_id", F.col("stop_id").alias("stop2_id"), F.col("share").alias("share2"))
    placed = patterns.join(one, ["line_id", "stop1_id"]).join(two, ["line_id", "stop2_id"]).withColumns({
        "perc1": F.when(F.col("head1"), F.lit(0.0)).otherwise(F.col("share1")),
        "perc2": F.when(F.col("head2"), F.lit(0.0)).when(F.col("tail2"), F.lit(1.0)).otherwise(F.col("share2")),
    })
    return cut_lines(placed, edges, "line_id", [*PATTERN[1:], "perc1", "perc2"])


def drop_trips_with_bad_segment(segments: DataFrame) -> DataFrame:
    """Remove every segment of a trip that has one without geometry."""
    bad = segments.where(F.col("seg_geom").isNull()).select("trip_id").distinct()
    return segments.join(bad, "trip_id", "left_anti").select(*segments.columns)


def expand_calendar(calendar: DataFrame) -> DataFrame:
    """Dates of each service between start and end (closed) on its flagged weekdays."""
    day = F.dayofweek("date")
    runs = F.lit(False)
    for i, name in enumerate(WEEKDAYS):
        runs = runs | ((F.col(name) == 1) & (day == i + 1))
    return (
        calendar.where(F.col("start_date") <= F.col("end_date"))
        .withColumn("date", F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))))
        .where(runs)
        .select("service_id", "date")
    )


def union_service_days(regular: DataFrame, added: DataFrame) -> DataFrame:
    return regular.select("service_id", "date").union(added.select("service_id", "date")).distinct()


def except_removed_days(days: DataFrame, removed: DataFrame, scope: str = "global") -> DataFrame:
    """Take out removed dates: for all services, or only for the service they are listed under.

    ``global`` is how the layers have always been computed: a date removed for one service is
    dropped for every service.
    """
    keys = {"global": ["date"], "service": ["service_id", "date"]}[scope]
    gone = removed.where(F.col("date").isNotNull()).select(*keys).distinct()
    return days.join(gone, keys, "left_anti").select(*days.columns)


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in a total order, with map-side combine."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in [*order, *rest]])


def scheduled_headway(ts: DataFrame, routes: DataFrame, service_ids: DataFrame | None = None) -> DataFrame:
    """Mean gap of consecutive timetable arrivals per (bus route, stop), over all services by default.

    Gaps of zero never count, so only distinct arrival seconds matter: the distinct step shrinks a
    busy (route, stop) to the seconds of a service day before the window runs.
    """
    rows = ts if service_ids is None else ts.join(service_ids, "service_id", "left_semi")
    times = (
        bus_only(rows.where(F.col("arrival_seconds").isNotNull()), routes)
        .select("route_id", "stop_id", "arrival_seconds").distinct()
    )
    w = Window.partitionBy("route_id", "stop_id").orderBy("arrival_seconds")
    gap = F.col("arrival_seconds") - F.lag("arrival_seconds").over(w)
    return (
        times.withColumn("gap", gap).where((F.col("gap") > 0) & (F.col("gap") < 7200))
        .groupBy("route_id", "stop_id")
        .agg(F.avg(F.col("gap") / 60.0).alias("scheduled_headway_minutes"))
        .join(routes.select("route_id", "route_short_name"), "route_id")
    )


def route_trip_counts(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Distinct trips per bus route, 0 where there is none."""
    counts = trips.groupBy("route_id").agg(F.countDistinct("trip_id").alias("num_trips"))
    return (
        routes.where(F.col("route_type") == s.BUS).join(counts, "route_id", "left")
        .withColumn("num_trips", F.coalesce("num_trips", F.lit(0)))
    )
