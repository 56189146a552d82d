"""Grouped layers over the base views and the segment table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitloom.functions import scalars as s
from transitloom.functions.statistics import exact_percentiles
from transitloom.operators import realtime as r
from transitloom.operators.timetable import bus_only

STOP_KEYS = ["stop_id", "stop_name", "stop_lat", "stop_lon", "route_short_name"]
# geom_key with the segment's own stops stands for the geometry (operators.lines.attach_geometry)
GEOMETRY = ["seg_stop1_id", "seg_stop2_id", "geom_key"]


def _buses(df: DataFrame) -> DataFrame:
    return df.where(F.col("route_type") == s.BUS)


def _share(condition) -> F.Column:
    return F.count_if(condition) / F.count("*") * 100


# ---- live layers --------------------------------------------------------------------------
def headway_by_stop(headways: DataFrame, min_obs: int = 5) -> DataFrame:
    bunched = F.col("headway_minutes") < 3
    return _buses(headways).groupBy(*STOP_KEYS).agg(
        F.avg("headway_minutes").alias("avg_headway"),
        F.count("*").alias("total_observations"),
        F.count_if(bunched).alias("bunched_count"),
        _share(bunched).alias("bunching_rate"),
    ).where(F.col("total_observations") >= min_obs)


def delay_by_stop(schedule: DataFrame, min_obs: int = 3) -> DataFrame:
    late = F.col("delay_minutes") > 5
    return _buses(schedule).groupBy(*STOP_KEYS).agg(
        F.avg("delay_minutes").alias("avg_delay_minutes"),
        F.stddev_samp("delay_minutes").alias("std_delay_minutes"),
        F.count("*").alias("total_observations"),
        F.count_if(late).alias("late_count"),
        _share(late).alias("late_rate"),
    ).where(F.col("total_observations") >= min_obs)


DELAY_KEYS = ["from_stop_id", "to_stop_id", "from_stop_name", "to_stop_name", "route_short_name", *GEOMETRY]


def delay_by_segment(delays: DataFrame, min_obs: int = 3) -> DataFrame:
    return r.keep_delay_range(_buses(delays)).groupBy(*DELAY_KEYS).agg(
        F.avg("segment_delay_minutes").alias("avg_delay_minutes"),
        F.stddev_samp("segment_delay_minutes").alias("std_delay_minutes"),
        F.count("*").alias("total_observations"),
    ).where(F.col("total_observations") >= min_obs)


def delay_hotspots(delays: DataFrame, min_obs: int = 3) -> DataFrame:
    return _buses(delays).where(F.col("segment_delay_minutes") > 1).groupBy(*DELAY_KEYS).agg(
        F.avg("segment_delay_minutes").alias("avg_delay_minutes"),
        F.count("*").alias("total_observations"),
    ).where(F.col("total_observations") >= min_obs)


SPEED_KEYS = ["stop_id", "next_stop_id", "from_stop_name", "to_stop_name", "route_short_name"]


def _speed_layer(speeds: DataFrame, keys: list[str]) -> DataFrame:
    rows = r.keep_speed_range(_buses(speeds), "scheduled_speed_kmh", "actual_speed_kmh")
    return rows.groupBy(*keys).agg(
        F.avg("scheduled_speed_kmh").alias("avg_scheduled_speed"),
        F.avg("actual_speed_kmh").alias("avg_actual_speed"),
        F.avg(F.col("actual_speed_kmh") - F.col("scheduled_speed_kmh")).alias("avg_speed_difference"),
        F.count("*").alias("total_observations"),
    )


def speed_by_segment(speeds: DataFrame) -> DataFrame:
    return _speed_layer(speeds, SPEED_KEYS)


def speed_by_segment_geom(speeds: DataFrame) -> DataFrame:
    """As speed_by_segment, split by geometry. Both base views come from the same observed pairs with
    the same filters, so the speed view carries the geometry and no join is needed."""
    return _speed_layer(speeds, [*SPEED_KEYS, *GEOMETRY])


def headway_with_schedule(headways: DataFrame, scheduled: DataFrame) -> DataFrame:
    return headways.join(
        scheduled.select("route_id", "stop_id", "scheduled_headway_minutes"), ["route_id", "stop_id"], "left"
    )


def headway_vs_schedule(headways: DataFrame, scheduled: DataFrame, min_obs: int = 3) -> DataFrame:
    """Observed headway per (route, stop) against the timetable, with bunching and gap rates.

    Headways are whole seconds under two hours, so the exact median of a group holds at most a few
    thousand distinct values, counted on the map side.
    """
    keys = ["route_id", "route_short_name", "stop_id", "stop_name", "stop_lat", "stop_lon"]
    x, sched = F.col("headway_minutes"), F.col("scheduled_headway_minutes")
    gap = F.when(sched.isNotNull(), x > sched * 1.8).otherwise(x > 20)
    return (
        headway_with_schedule(_buses(headways), scheduled)
        .groupBy(*keys, "scheduled_headway_minutes")
        .agg(
            F.count("*").alias("observations"),
            F.avg(x).alias("avg_actual_headway_min"),
            F.percentile(x, 0.5).alias("median_actual_headway_min"),
            F.stddev_samp(x).alias("std_actual_headway_min"),
            (F.avg(x) - sched).alias("headway_delta_min"),
            _share(x < 3).alias("bunching_rate_pct"),
            _share(gap).alias("gap_rate_pct"),
        )
        .where(F.col("observations") >= min_obs)
    )


# ---- network layers -----------------------------------------------------------------------
def segment_route_density(segments: DataFrame, routes: DataFrame, buses_only: bool = True) -> DataFrame:
    """Distinct routes per (stop pair, geometry)."""
    rows = segments.where(F.col("seg_geom").isNotNull())
    rows = bus_only(rows, routes) if buses_only else rows
    return (
        rows.groupBy("stop1_id", "stop2_id", "geom_key").agg(F.countDistinct("route_id").alias("num_routes"))
        .withColumn("segment_id", s.segment_key("stop1_id", "stop2_id"))
    )


def shared_segments(segments: DataFrame, routes: DataFrame, min_routes: int = 2) -> DataFrame:
    return (
        segment_route_density(segments, routes).where(F.col("num_routes") >= min_routes)
        .withColumnRenamed("num_routes", "num_routes_sharing")
    )


def speed_segments(segments: DataFrame, routes: DataFrame) -> DataFrame:
    """Mean scheduled speed per (route, sequence pair, geometry), speeds in (0, 150)."""
    seconds = F.col("stop2_arrival") - F.col("stop1_arrival")
    rows = (
        segments.where((seconds != 0) & (F.col("seg_length") > 0) & F.col("seg_geom").isNotNull())
        .withColumn("speed", s.speed_kmh(F.col("seg_length"), seconds))
        .where((F.col("speed") > 0) & (F.col("speed") < 150))
    )
    return (
        rows.join(_buses(routes).select("route_id", "route_short_name"), "route_id")
        .groupBy("route_id", "stop1_sequence", "stop2_sequence", "stop1_id", "stop2_id", "geom_key", "route_short_name")
        .agg(F.sum("speed").alias("__s"), F.count("*").alias("__n"))
        .groupBy("route_id", "stop1_sequence", "stop2_sequence", "geom_key", "route_short_name")
        .agg(F.try_divide(F.sum("__s"), F.sum("__n")).alias("speed_kmh"))
        .withColumn("segment_id", s.segment_key("route_id", "stop1_sequence", "stop2_sequence"))
    )


def route_speed_stats(speed_layer: DataFrame, routes: DataFrame) -> DataFrame:
    rows = speed_layer.where(F.col("speed_kmh").isNotNull())
    stats = rows.groupBy("route_id").agg(
        F.count("*").alias("num_segments"),
        F.avg("speed_kmh").alias("avg_speed_kmh"),
        F.min("speed_kmh").alias("min_speed_kmh"),
        F.max("speed_kmh").alias("max_speed_kmh"),
    )
    medians = exact_percentiles(rows, "speed_kmh", {"median_speed_kmh": 0.5}, ["route_id"])
    names = routes.select("route_id", "route_short_name", "route_long_name", "route_type")
    return stats.join(medians, "route_id").join(names, "route_id")


def high_speed_segments(speed_layer: DataFrame, above: float = 60.0, min_count: int = 3,
                        digits: int | None = None) -> DataFrame:
    """Speeds above a limit shared by several segments, grouped by the exact (or rounded) speed."""
    speed = F.col("speed_kmh") if digits is None else F.round("speed_kmh", digits)
    return (
        speed_layer.where(F.col("speed_kmh") > above)
        .groupBy("route_id", "route_short_name", speed.alias("speed_kmh"))
        .agg(F.count("*").alias("segment_count"))
        .where(F.col("segment_count") >= min_count)
    )


def speed_bands(speed_layer: DataFrame) -> DataFrame:
    v = F.col("speed_kmh")
    band = F.when(v < 20, "slow").when(v < 40, "medium").when(v < 60, "fast").otherwise("very fast")
    return share_of_total(speed_layer.where(v.isNotNull()).select(band.alias("band")), "band")


def share_of_total(df: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Rows per value and their percentage of all rows; NULL keys are left out."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("qty"))
    # the total is a sum of the same grouped counts, so a key of many values is not gathered in one task
    return counted.withColumn("perc", F.round(F.col("qty") * 100.0 / counted.agg(F.sum("qty")).scalar(), digits))


def route_type_share(routes: DataFrame) -> DataFrame:
    """Routes per mode with their percentage; modes without a name drop out of the list."""
    names = routes.sparkSession.createDataFrame(list(s.REPORT_MODE_NAMES.items()), "route_type string, name string")
    return share_of_total(routes, "route_type").join(names, "route_type").select("name", "qty", "perc")


def route_statistics(segments: DataFrame) -> DataFrame:
    """Distinct segments and total length per route, all modes."""
    rows = segments.where(F.col("seg_geom").isNotNull())
    return rows.groupBy("route_id").agg(
        F.countDistinct(s.segment_key("stop1_id", "stop2_id")).alias("total_segments"),
        (F.coalesce(F.sum("seg_length"), F.lit(0.0)) / 1000).alias("total_length_km"),
    )


# Routes of one segment that meet in one task, at most squared.
PIECE = 512


def route_pair_self_join(route_segments: DataFrame, piece: int = PIECE) -> DataFrame:
    """Shared segment counts of route pairs from distinct (route_id, segment_id) rows.

    Segments used by exactly the same routes are folded into one weighted representative first, so a
    corridor of many segments yields its pairs once. The routes of a hub are cut into pieces of about ``piece``, and every two pieces
    meet under a key of their own, so the pairs of one segment are spread over many tasks. Nearly all segments are
    one piece. Pairs are still made for each representative, and added up on the map side.
    """
    usage = route_segments.select("route_id", "segment_id").distinct()
    who = F.xxhash64("route_id")
    signed = usage.groupBy("segment_id").agg(
        F.count("*").alias("n_routes"),
        F.bit_xor(who).alias("h1"),
        F.bit_xor(F.xxhash64(F.col("route_id"), F.lit("second"))).alias("h2"),
    ).where(F.col("n_routes") > 1)
    folded = signed.groupBy("n_routes", "h1", "h2").agg(
        F.min("segment_id").alias("segment_id"), F.count("*").alias("weight")
    ).select("segment_id", "weight", F.ceil(F.col("n_routes") / piece).cast("int").alias("pieces"))
    kept = usage.join(folded, "segment_id").withColumn("piece", F.pmod(who, F.col("pieces")).cast("int"))
    left = kept.select("segment_id", "weight", F.col("route_id").alias("one"), F.col("piece").alias("a"),
                       F.explode(F.sequence(F.col("piece"), F.col("pieces") - 1)).alias("b"))
    right = kept.select("segment_id", F.col("route_id").alias("two"), F.col("piece").alias("b"),
                        F.explode(F.sequence(F.lit(0), F.col("piece"))).alias("a"))
    return (
        left.join(right, ["segment_id", "a", "b"]).where((F.col("a") < F.col("b")) | (F.col("one") < F.col("two")))
        .groupBy(F.least("one", "two").alias("route1"), F.greatest("one", "two").alias("route2"))
        .agg(F.sum("weight").alias("shared_segments"))
    )


def route_duplication(segments: DataFrame, routes: DataFrame) -> DataFrame:
    """Bus route pairs with shared and total segments; overlap is the share of the shorter route."""
    usage = bus_only(segments, routes).select("route_id", s.segment_key("stop1_id", "stop2_id").alias("segment_id")).distinct()
    totals = usage.groupBy("route_id").agg(F.count("*").alias("n"))
    one = totals.select(F.col("route_id").alias("route1"), F.col("n").alias("route1_total_segments"))
    two = totals.select(F.col("route_id").alias("route2"), F.col("n").alias("route2_total_segments"))
    shorter = F.least("route1_total_segments", "route2_total_segments")
    return route_pair_self_join(usage).join(one, "route1").join(two, "route2").withColumn(
        "overlap_percentage", F.col("shared_segments") * 100.0 / shorter
    )


def route_pairs_layer(pairs: DataFrame, routes: DataFrame) -> DataFrame:
    buses = _buses(routes)
    one = buses.select(F.col("route_id").alias("route1"), F.col("route_short_name").alias("route1_name"))
    two = buses.select(F.col("route_id").alias("route2"), F.col("route_short_name").alias("route2_name"))
    return pairs.join(one, "route1").join(two, "route2").select(
        "route1", "route2", "route1_name", "route2_name", "shared_segments",
        "route1_total_segments", "route2_total_segments", "overlap_percentage",
    )


def highly_duplicated_routes(pairs: DataFrame, min_pairs: int = 3) -> DataFrame:
    """Per route: how many pairs it is in, their highest and mean overlap, shared segments in total."""
    ends = pairs.select(F.explode(F.array("route1", "route2")).alias("route_id"), "overlap_percentage", "shared_segments")
    return ends.groupBy("route_id").agg(
        F.count("*").alias("num_duplicate_pairs"),
        F.max("overlap_percentage").alias("max_overlap_percentage"),
        F.avg("overlap_percentage").alias("avg_overlap_percentage"),
        F.sum("shared_segments").alias("total_shared_segments"),
    ).where(F.col("num_duplicate_pairs") >= min_pairs)


def pairs_for_routes(pairs: DataFrame, route_ids) -> DataFrame:
    """Pairs with either end in a list, or in a one-column table of route ids when the list is long."""
    if isinstance(route_ids, DataFrame):
        ids = route_ids.select("route_id").distinct()
        one = pairs.join(ids.withColumnRenamed("route_id", "route1"), "route1", "left_semi").select(*pairs.columns)
        two = pairs.join(ids.withColumnRenamed("route_id", "route2"), "route2", "left_semi").select(*pairs.columns)
        return one.unionByName(two).distinct()
    chosen = list(route_ids)
    return pairs.where(F.col("route1").isin(chosen) | F.col("route2").isin(chosen))


def overlap_proxy(shared: DataFrame, count: str = "num_routes_sharing") -> DataFrame:
    """Scale route counts to 30-80; 30 everywhere when all counts are equal."""
    lo = shared.agg(F.min(count)).scalar()
    hi = shared.agg(F.max(count)).scalar()
    scaled = F.try_divide(F.col(count) - lo, hi - lo) * 50 + 30
    return shared.withColumn(
        "max_overlap_percentage",
        F.coalesce(F.greatest(F.least(scaled, F.lit(80.0)), F.lit(30.0)), F.lit(30.0)),
    )
