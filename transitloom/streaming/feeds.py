"""Structured Streaming over landed snapshot files."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitloom.functions import scalars as s
from transitloom.operators import moving as m
from transitloom.operators import realtime as r
from transitloom.operators.lines import segment_geometries
from transitloom.session import store_and_reload
from transitloom.sources import feed, landed, tables


def read_snapshots(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(feed.SNAPSHOT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def stream_positions(spark: SparkSession, folder: str, max_files: int | None = None, routes: DataFrame | None = None) -> DataFrame:
    """Positions as they land, of the given routes only if ``routes`` (route_id) is given."""
    return feed.land_vehicle_positions(read_snapshots(spark, folder, max_files), routes)


def stream_updates(spark: SparkSession, folder: str, max_files: int | None = None, routes: DataFrame | None = None) -> DataFrame:
    """Predictions as they land, of the given routes only if ``routes`` (route_id) is given."""
    return feed.land_trip_updates(read_snapshots(spark, folder, max_files), routes)


def trigger(once: bool = True, interval_s: int | None = None) -> dict:
    """Trigger arguments: everything that has landed, or one poll per interval."""
    return {"availableNow": True} if once or not interval_s else {"processingTime": f"{interval_s} seconds"}


def poll_count(interval_s: int, duration_s: int) -> int:
    return max(1, math.ceil(duration_s / interval_s))


def start_append(stream: DataFrame, path: str, checkpoint: str, ts: str = "entity_timestamp", **trigger_args):
    """Append a landed stream to a date-partitioned folder; exactly once per input file."""
    return (
        stream.withColumn(tables.DATE_COLUMN, F.to_date(ts))
        .writeStream.format("parquet").partitionBy(tables.DATE_COLUMN)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger_args or trigger())).start()
    )


def start_latest_updates(stream: DataFrame, path: str, checkpoint: str, **trigger_args):
    """Keep the latest fetch per (trip instance, stop sequence) as a versioned table.

    Each batch is merged into the hash buckets of its keys; a repeated batch changes nothing because
    the newest row wins either way. The table holds one row per key, not the history.
    """
    keys = ["trip_instance_id", "stop_sequence"]

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c not in keys and c != "fetch_timestamp"]
        last = F.max(F.struct("fetch_timestamp", *rest)).alias("__r")
        return old.unionByName(new).groupBy(*keys).agg(last).select(
            *keys, "__r.fetch_timestamp", *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*new.columns)

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col("arrival_time").isNotNull())
        rows = rows.withColumn("service_date", s.service_date("start_date", "entity_timestamp"))
        tables.merge_snapshot(rows, path, keys, newest)

    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(**(trigger_args or trigger())).start()
    )


def drop_repeats(stream: DataFrame, delay: str = "3 hours") -> DataFrame:
    """One sighting of each (trip instance, entity time) across polls, the first to come.

    State is dropped after the delay, and so are rows later than it, uncounted; `start_drop_repeats` writes those
    to a side table, `start_first_sightings` merges them.
    """
    return stream.where(F.col("trip_instance_id").isNotNull()).withWatermark(
        "entity_timestamp", delay).dropDuplicatesWithinWatermark(["trip_instance_id", "entity_timestamp"])


def start_drop_repeats(stream: DataFrame, path: str, checkpoint: str, delay: timedelta = timedelta(hours=3), **trigger_args):
    """Keep the first sighting to come of each (trip instance, entity time), with bounded state and no row lost unseen.

    Below ``path``, ``rows`` gets the sightings and ``late`` the rows more than ``delay`` older than the newest time of the batches
    before, which the state no longer covers; each in a folder of its batch, so a repeated batch overwrites itself. The state
    is the keys within the delay. It alternates between two folders, so the one a batch starts from stays
    until the next batch is done.
    """
    keys = ["trip_instance_id", "entity_timestamp"]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = store_and_reload(batch.where(F.col("trip_instance_id").isNotNull()), "sightings")
        state = spark.read.parquet(f"{path}/state/slot={(number - 1) % 2}") if number else rows.select(*keys).limit(0)
        high = state.agg(F.max("entity_timestamp")).first()[0]
        is_late = F.coalesce(F.col("entity_timestamp") < F.lit(high - delay), F.lit(False)) if high else F.lit(False)
        rows.where(is_late).write.mode("overwrite").parquet(f"{path}/late/batch={number:08d}")
        others = [c for c in rows.columns if c not in keys and c != "fetch_timestamp"]
        first = rows.where(~is_late).groupBy(*keys).agg(F.min(F.struct("fetch_timestamp", *others)).alias("__r")).select(
            *keys, "__r.fetch_timestamp", *[F.col(f"__r.{c}").alias(c) for c in others]).select(*rows.columns)
        known = state.select(*[F.col(c).alias(f"__{c}") for c in keys])
        seen = F.col("trip_instance_id").eqNullSafe(F.col("__trip_instance_id")) & F.col("entity_timestamp").eqNullSafe(F.col("__entity_timestamp"))
        new = store_and_reload(first.join(known, seen, "left_anti"), "sightings-new")
        new.write.mode("overwrite").parquet(f"{path}/rows/batch={number:08d}")
        held = state.unionByName(new.select(*keys))
        newest = held.agg(F.max("entity_timestamp")).first()[0]
        held = held.where(F.col("entity_timestamp").isNull() | (F.col("entity_timestamp") >= F.lit(newest - delay))) if newest else held
        held.write.mode("overwrite").parquet(f"{path}/state/slot={number % 2}")

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(**(trigger_args or trigger())).start()
    )


def start_first_sightings(stream: DataFrame, path: str, checkpoint: str, **trigger_args):
    """Keep the earliest fetch per (trip instance, entity time) as a versioned table, however late it comes."""
    keys = ["trip_instance_id", "entity_timestamp"]

    def earliest(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c not in keys and c != "fetch_timestamp"]
        first = F.min(F.struct("fetch_timestamp", *rest)).alias("__r")
        return old.unionByName(new).groupBy(*keys).agg(first).select(
            *keys, "__r.fetch_timestamp", *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*new.columns)

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col("trip_instance_id").isNotNull()).withColumn(tables.DATE_COLUMN, F.to_date("entity_timestamp"))
        tables.merge_snapshot(rows, path, keys, earliest)

    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(**(trigger_args or trigger())).start()
    )


def rebuild_window(positions: DataFrame, trips: DataFrame, shape_tracks: DataFrame, path: str,
                   end: datetime, hours: float = 3, start: datetime | None = None, **options) -> int:
    """Rebuild trajectories of the last hours from the landed table and upsert them as a new version."""
    begin = start or end - timedelta(hours=hours)
    fresh = m.actual_trajectories(positions, trips, shape_tracks, begin, end, **options)
    return tables.merge_snapshot(
        fresh, path, ["trip_instance_id"], lambda old, new: m.upsert_trips(old, new, truncate=False))


def start_rebuild(stream: DataFrame, positions_path: str, trips: DataFrame, shape_tracks: DataFrame, path: str,
                  checkpoint: str, hours: float = 3, head: timedelta | None = None, options: dict | None = None, **trigger_args):
    """After every micro-batch: append it, then rebuild the window that ends at the newest landed time.

    Positions lie in a folder for each date and batch. A small table beside them has the newest time of each date, so a batch
    opens the dates of its window only, however long the history. With ``head``, trips seen in the window keep
    what they did up to that long before it; without, a trip that began earlier loses its head. ``options`` go to
    `actual_trajectories`: scheduled paths, a route filter, ties.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark, date_column = batch.sparkSession, tables.DATE_COLUMN
        dated = store_and_reload(batch.withColumn(date_column, F.to_date("entity_timestamp")), "positions")
        # the batch number is part of the path, so a repeated batch overwrites itself
        dated.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            date_column, "batch").parquet(positions_path)
        # the newest times alternate between two folders, so those a batch starts from stay until the next is done
        seen = dated.groupBy(date_column).agg(F.max("entity_timestamp").alias("newest")).where("newest IS NOT NULL")
        if number:
            seen = spark.read.parquet(f"{positions_path}-dates/slot={(number - 1) % 2}").unionByName(seen).groupBy(date_column).agg(F.max("newest").alias("newest"))
        seen.write.mode("overwrite").parquet(f"{positions_path}-dates/slot={number % 2}")
        days = spark.read.parquet(f"{positions_path}-dates/slot={number % 2}").collect()
        if not days:
            return
        # the window ends at the newest landed time, so a late file never cuts a longer trip short
        newest = max(row["newest"] for row in days)
        begin = newest - timedelta(hours=hours)
        first = begin - (head or timedelta())
        opened = [landed.partition_path(positions_path, date_column, row[date_column]) for row in days if row[date_column] >= first.date()]
        window = spark.read.schema(dated.schema).option("basePath", positions_path).parquet(*opened).select(*batch.columns)
        if head:
            known = window.where(F.col("entity_timestamp") >= F.lit(begin)).select("trip_instance_id").distinct()
            window = window.join(known, "trip_instance_id", "left_semi").select(*batch.columns)
        rebuild_window(window, trips, shape_tracks, path, newest, start=first, **(options or {}))

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(**(trigger_args or trigger())).start()
    )


ARRIVAL_DAY = "arrival_date"
# The (route, stop) of a day are dealt over this many tasks, which is also the most files a day has.
DAY_SLICES = 16


def refresh_headways(updates: DataFrame, routes: DataFrame, stops: DataFrame, folder: str, service_dates: list | None = None) -> int:
    """Rebuild the headways, whole or for the days that vehicles of the given service dates arrive on.

    Two small tables carry over. ``arrival_instants`` has what a headway needs of the predictions, by day of arrival and service
    date; ``closing_vehicles`` has the last vehicle of each (route, stop) on each day. The predictions of the given service dates
    are read; then the instants of the days they arrive on, or did before, and of the days after these; and the
    closing vehicles of the days before. Other dates are not read. Headways lie in a folder for each day of arrival. The instants
    are moved once, to slices of their days: there they are combined, looked up and written.
    """
    spark, root = updates.sparkSession, folder.rstrip("/")
    held, closed, out = (f"{root}/{name}" for name in ("arrival_instants", "closing_vehicles", "headway_stats"))
    instants = r.arrival_instants(updates, "service_date").withColumn(ARRIVAL_DAY, F.to_date("arrival_time"))

    def sliced(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__slice", F.pmod(F.xxhash64("route_id", "stop_id"), F.lit(DAY_SLICES)))

    def headways_of(rows: DataFrame, before: DataFrame) -> DataFrame:
        combined = sliced(rows).repartition(ARRIVAL_DAY, "__slice").groupBy("route_id", "stop_id", "arrival_time", ARRIVAL_DAY, "__slice").agg(
            F.min("trip_instance_id").alias("trip_instance_id"), F.max("last_trip").alias("last_trip"))
        return r.headways(r.prev_vehicle_of_days(combined, sliced(before), ARRIVAL_DAY, "__slice"), routes, stops, ARRIVAL_DAY)

    def read(path: str, like: DataFrame) -> DataFrame:
        return spark.read.schema(like.schema).parquet(path)

    if service_dates is None:
        instants.hint("rebalance", ARRIVAL_DAY).write.mode("overwrite").partitionBy(ARRIVAL_DAY, "service_date").parquet(held)
        state = read(held, instants)
        last = r.closing_vehicles(state, ARRIVAL_DAY)
        last.hint("rebalance", ARRIVAL_DAY).write.mode("overwrite").partitionBy(ARRIVAL_DAY).parquet(closed)
        seen = tables.Observation()
        rows = headways_of(state, read(closed, last))
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(ARRIVAL_DAY).parquet(out)
        return int(seen.get["n"])
    pairs = lambda some: {(x[0], x[1]) for x in some.select(ARRIVAL_DAY, "service_date").distinct().collect()}
    fresh = store_and_reload(instants.where(F.col("service_date").isin(service_dates)), "instants")
    had, has = pairs(read(held, instants).where(F.col("service_date").isin(service_dates))), pairs(fresh)
    if has:
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(ARRIVAL_DAY, "service_date").parquet(held)
    for day, of in had - has:
        landed.replace_partitions(fresh.limit(0).drop(ARRIVAL_DAY), landed.partition_path(held, ARRIVAL_DAY, day), "service_date", [of])
    days = sorted({day for day, _ in had | has})
    affected = sorted({*days, *(day + timedelta(days=1) for day in days)})
    state = read(held, instants).where(F.col(ARRIVAL_DAY).isin(affected))
    last = r.closing_vehicles(state.where(F.col(ARRIVAL_DAY).isin(days)), ARRIVAL_DAY)
    landed.replace_partitions(last, closed, ARRIVAL_DAY, days)
    before = read(closed, last).where(F.col(ARRIVAL_DAY).isin([day - timedelta(days=1) for day in affected]))
    return landed.replace_partitions(headways_of(state, before), out, ARRIVAL_DAY, affected)


def refresh_views(updates: DataFrame, segments: DataFrame, ts: DataFrame, routes: DataFrame, stops: DataFrame,
                  folder: str, service_dates: list | None = None, ties: list[str] = ()) -> dict[str, int]:
    """Rebuild the base views, whole or only for the given service dates; returns the rows written of each.

    A service date whose rows are all gone is emptied. No dates, no work.
    """
    if service_dates is not None and not service_dates:
        return {}
    rows = updates if service_dates is None else updates.where(F.col("service_date").isin(service_dates))
    # three views start from the latest predictions and two from the observed segments; each is found once
    pairs = store_and_reload(r.next_stop(r.dedup_updates(rows, list(ties))), "latest")
    observed = store_and_reload(r.updates_to_segments(pairs, segments.drop("seg_geom")), "observed")
    lines = store_and_reload(segment_geometries(segments), "lines")
    views = {
        "speed_comparison": r.drawn_speeds(r.speeds_of(observed, routes, stops), lines),
        "delay_analysis": r.drawn_delays(r.delays_of(observed, routes, stops), lines),
        "schedule_times": r.schedule_times(pairs.drop(*r.NEXT), ts, routes, stops),
    }
    sizes = {}
    for name, view in views.items():
        path = f"{folder.rstrip('/')}/{name}"
        if service_dates is None:
            seen = tables.Observation()
            view.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("service_date").parquet(path)
            sizes[name] = int(seen.get["n"])
        else:
            sizes[name] = landed.replace_partitions(view, path, "service_date", service_dates)
    sizes["headway_stats"] = refresh_headways(updates, routes, stops, folder, service_dates)
    return sizes
