"""Summaries over the base views, bus routes only unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.functions import scalars as s
from transitloom.functions.statistics import exact_percentiles
from transitloom.operators.ordering import tail_n, top_n


def _named(df: DataFrame, *keys: str) -> DataFrame:
    """Grouping drops rows whose key is missing."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def _bunched() -> F.Column:
    return s.headway_category("headway_minutes") == s.HEADWAY_CATEGORY[0]


def _rate(condition) -> F.Column:
    return F.count_if(condition) / F.count("*") * 100


def route_summary_stats(headways: DataFrame, min_obs: int = 10) -> DataFrame:
    return _named(headways, "route_short_name").groupBy("route_short_name").agg(
        F.avg("headway_minutes").alias("avg_headway"),
        F.stddev_samp("headway_minutes").alias("std_headway"),
        F.count("headway_minutes").alias("n"),
        _rate(_bunched()).alias("bunching_rate_pct"),
    ).where(F.col("n") >= min_obs)


def bunching_top_routes(headways: DataFrame, n: int = 20) -> DataFrame:
    return top_n(route_summary_stats(headways), n, "-bunching_rate_pct!", "route_short_name")


def on_time_by_route(schedule: DataFrame, min_obs: int = 10) -> DataFrame:
    rows = s.on_time_flags(_named(schedule, "route_short_name"))
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return rows.groupBy("route_short_name").agg(
        share("on_time"), share("early"), share("late"), F.count("delay_minutes").alias("samples")
    ).where(F.col("samples") >= min_obs)


def on_time_performance(schedule: DataFrame) -> DataFrame:
    """Counts and shares of the five punctuality classes, limits as in the on-time rate."""
    d = F.col("delay_minutes")
    label = (
        F.when(d < -7, "severe early").when(d < -3, "minor early").when(d <= 3, "on time")
        .when(d <= 7, "minor late").otherwise("severe late")
    )
    return category_counts(schedule.where(d.isNotNull()).withColumn("class", label), "class")


def period_means(df: DataFrame, value: str, key: str = "time_period") -> DataFrame:
    """Mean per period, with the fixed period order as a rank."""
    order = F.array_position(F.array(*[F.lit(p) for p in s.PERIOD_ORDER]), F.col(key))
    return _named(df, key).groupBy(key).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n")).withColumn(
        "period_rank", order.cast("int"))


def headway_by_day_type(headways: DataFrame) -> DataFrame:
    return headways.groupBy("day_type").agg(
        F.avg("headway_minutes").alias("avg_headway"),
        F.stddev_samp("headway_minutes").alias("std_headway"),
        _rate(_bunched()).alias("bunching_rate_pct"),
    )


def headway_by_period(headways: DataFrame) -> DataFrame:
    return period_means(headways, "headway_minutes").join(
        headways.groupBy("time_period").agg(_rate(_bunched()).alias("bunching_rate_pct")), "time_period")


def speed_by_day_type(speeds: DataFrame) -> DataFrame:
    return speeds.groupBy("day_type").agg(
        F.avg("scheduled_speed_kmh").alias("scheduled_speed"),
        F.avg("actual_speed_kmh").alias("actual_speed"),
        F.avg("speed_delta_kmh").alias("speed_delta"),
    )


def rush_vs_offpeak(delays: DataFrame) -> DataFrame:
    rush = F.col("time_period").isin("Morning Rush", "Evening Rush")
    return delays.agg(
        F.avg(F.when(rush, F.col("segment_delay_minutes"))).alias("rush_mean_delay"),
        F.avg(F.when(~rush, F.col("segment_delay_minutes"))).alias("offpeak_mean_delay"),
    )


def speed_summary(speeds: DataFrame) -> DataFrame:
    """Speeds per (route, stop pair); the segment length is that of the first trip in order."""
    keys = ["route_short_name", "from_stop_name", "to_stop_name"]
    return _named(speeds, *keys).groupBy(*keys).agg(
        F.avg("scheduled_speed_kmh").alias("sched_speed_mean"),
        F.stddev_samp("scheduled_speed_kmh").alias("sched_speed_std"),
        F.avg("actual_speed_kmh").alias("actual_speed_mean"),
        F.stddev_samp("actual_speed_kmh").alias("actual_speed_std"),
        F.avg("speed_delta_kmh").alias("speed_delta_mean"),
        F.stddev_samp("speed_delta_kmh").alias("speed_delta_std"),
        F.min("speed_delta_kmh").alias("speed_delta_min"),
        F.max("speed_delta_kmh").alias("speed_delta_max"),
        F.min_by("segment_length_m", F.struct("trip_instance_id", "stop_sequence")).alias("segment_length_m"),
        F.count("trip_instance_id").alias("sample_count"),
    )


def schedule_summary(schedule: DataFrame) -> DataFrame:
    keys = ["route_short_name", "stop_name"]
    return _named(schedule, *keys).groupBy(*keys).agg(
        F.avg("delay_minutes").alias("avg_delay"),
        F.stddev_samp("delay_minutes").alias("std_delay"),
        F.min("delay_minutes").alias("min_delay"),
        F.max("delay_minutes").alias("max_delay"),
        F.count("delay_minutes").alias("sample_count"),
        F.mode("hour_of_day", True).alias("most_common_hour"),
    )


def delay_summary(delays: DataFrame) -> DataFrame:
    keys = ["route_short_name", "from_stop_name", "to_stop_name", "time_period"]
    return _named(delays, *keys).groupBy(*keys).agg(
        F.avg("segment_delay_minutes").alias("avg_delay"),
        F.stddev_samp("segment_delay_minutes").alias("std_delay"),
        F.count("segment_delay_minutes").alias("sample_count"),
        F.avg("speed_reduction_pct").alias("speed_reduction_pct"),
    )


def headway_summary(headways: DataFrame) -> DataFrame:
    keys = ["route_short_name", "stop_name", "time_period"]
    return _named(headways, *keys).groupBy(*keys).agg(
        F.avg("headway_minutes").alias("avg_headway"),
        F.stddev_samp("headway_minutes").alias("std_headway"),
        F.min("headway_minutes").alias("min_headway"),
        F.max("headway_minutes").alias("max_headway"),
        F.count("headway_minutes").alias("n"),
        _rate(_bunched()).alias("bunching_rate_pct"),
    )


def headway_vs_schedule_summary(layer: DataFrame) -> DataFrame:
    """Per (route, stop) of the headway layer, rows with a schedule only."""
    rows = layer.where((F.col("observations") >= 3) & F.col("scheduled_headway_minutes").isNotNull())
    keys = ["route_short_name", "stop_name"]
    means = ["avg_actual_headway_min", "scheduled_headway_minutes", "headway_delta_min", "bunching_rate_pct", "gap_rate_pct"]
    return _named(rows, *keys).groupBy(*keys).agg(
        F.sum("observations").alias("observations"), *[F.avg(c).alias(c) for c in means])


def describe(df: DataFrame, values: list[str], distinct: list[str] = (), stage: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """One row per measure: count, mean, exact median, std, min, max; plus distinct counts of keys.

    The measures are stacked, so one aggregate and one ranking pass keyed by measure serve them all. ``stage`` stores
    the columns in use, after which the table itself is not read again.
    """
    rows = stage(df.select(*dict.fromkeys([*values, *distinct])))
    stacked = rows.select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")).select("m.*")
    x = F.col("value")
    stats = stacked.groupBy("measure").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    # an empty table still has a row for each measure, as counts of nothing are zero
    named = df.sparkSession.createDataFrame([(v,) for v in values], "measure string")
    medians = exact_percentiles(stacked, "value", {"median": 0.5}, ["measure"])
    out = named.join(stats, "measure", "left").join(medians, "measure", "left").select(
        "measure", F.coalesce("n", F.lit(0)).alias("n"), "mean", "median", "std", "min", "max")
    if distinct:
        counts = rows.agg(*[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct])
        # both sides are a handful of summary rows; the counts are a single one
        out = out.withColumns({c: counts.select(c).scalar() for c in counts.columns})
    return out


def category_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per class and their percentage of all rows."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    # the total is a sum of the same grouped counts, so a key of many values is not gathered in one task
    return _named(counted.withColumn("share_pct", F.col("n") * 100.0 / counted.agg(F.sum("n")).scalar()), key)


def speed_by_route(speeds: DataFrame, n: int = 20) -> DataFrame:
    """The fastest routes by observed speed, slowest of them first."""
    stats = _named(speeds, "route_short_name").groupBy("route_short_name").agg(
        F.avg("scheduled_speed_kmh").alias("scheduled_speed"),
        F.avg("actual_speed_kmh").alias("actual_speed"),
        F.count("trip_instance_id").alias("samples"),
    )
    return tail_n(stats, n, "actual_speed", "route_short_name")


def delay_by_route(schedule: DataFrame, n: int = 20) -> DataFrame:
    stats = _named(schedule, "route_short_name").groupBy("route_short_name").agg(F.avg("delay_minutes").alias("avg_delay"))
    return tail_n(stats, n, "avg_delay", "route_short_name")


def faster_slower(speeds: DataFrame) -> DataFrame:
    return speeds.agg(
        F.count_if(F.col("speed_delta_kmh") > 0).alias("faster"),
        F.count_if(F.col("speed_delta_kmh") < 0).alias("slower"),
        F.count("*").alias("n"),
    )


def worst_segments(delays: DataFrame, n: int = 20, min_obs: int = 3) -> DataFrame:
    keys = ["from_stop_name", "to_stop_name", "route_short_name"]
    stats = _named(delays, *keys).groupBy(*keys).agg(
        F.avg("segment_delay_minutes").alias("avg_delay"), F.count("segment_delay_minutes").alias("samples")
    ).where(F.col("samples") >= min_obs)
    label = F.concat(s.truncate_label("from_stop_name", 15), F.lit(" → "), s.truncate_label("to_stop_name", 15))
    return top_n(stats, n, "-avg_delay!", *keys).withColumn("segment", label)
