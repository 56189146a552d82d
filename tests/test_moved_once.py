"""What the shared steps move, read off their plans, and rows that repeat."""

import gzip
import os
import re

import pytest
from pyspark.sql import functions as F

from catalog import standins
from catalog.standins import TIES, Transit
from transitloom.operators import layers, lines, realtime, spatial, timetable
from transitloom.plans import timetable as plans

LINE = "array<struct<lon:double,lat:double>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


@pytest.fixture
def made(spark, tmp_path):
    """Line items and orders of its own: calls repeat, one order is there twice, keys are missing."""
    items = [(k, n, 10 * k + n + i, k + i, float(20 + i), f"2024-01-0{1 + i}") for k in range(1, 7) for n in (1, 2, 4) for i in range(2)]
    items += [(1, None, 5, 5, 3.0, "2024-01-01"), (None, 1, 5, 5, 3.0, "2024-01-01"), (99, 1, 5, 5, 3.0, "2024-01-01")]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, d string").select(
        "*", F.col("d").cast("timestamp").alias("l_shipdate")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, 3 * k, "1-X") for k in range(1, 7)] + [(2, 7, "1-X"), (None, 1, "1-X")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i,) for i in range(100)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield Transit(spark, str(tmp_path))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_predictions_are_dealt_out_once_and_repeats_count(made):
    pairs = realtime.next_stop(realtime.dedup_updates(made.updates, TIES))
    assert set(exchanges(pairs)) == {"trip_instance_id#" + e.split("#")[1] for e in exchanges(pairs)} and len(exchanges(pairs)) == 3
    rows = made.updates.collect()
    # a null line number takes the first place of trip 1; the order that is there twice is two calls and two trips
    assert sorted({r.stop_sequence for r in rows if r.trip_id == "1"}) == [2, 3, 4]
    assert len(rows) == 5 * 6 + 4 * 6
    assert {r.trip_id for r in rows} == {str(k) for k in range(1, 7)}
    assert {(r.route_id, r.stop_id) for r in rows if r.trip_id == "2" and r.stop_sequence == 1} == {
        (route, stop) for route in ("6", "7") for stop in ("45", "52")}
    calls = made.stop_times.collect()
    assert sorted(r.stop_sequence for r in calls if r.trip_id == "1") == [1, 2, 3, 4] and len([r for r in calls if r.trip_id == "2"]) == 6


def test_calls_are_dealt_out_once(made):
    calls = timetable.calls_lead(timetable.with_line(timetable.transit_stops(made.trips, made.stop_times)))
    assert all(e.startswith("trip_id#") for e in exchanges(calls)) and len(exchanges(calls)) == 3


def test_shuffles_start_in_many_partitions(made):
    # however few the session sets, so that a task's rows fit its memory
    made.spark.conf.set("spark.sql.shuffle.partitions", 3)
    found = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), ENSURE", plan(realtime.dedup_updates(made.updates, TIES)))
    made.spark.conf.unset("spark.sql.shuffle.partitions")
    assert found and set(found) == {"200"}


def test_shuffles_start_in_as_many_partitions_as_the_session_sets(made):
    from transitloom.session import START, configure

    start = lambda parts: (made.spark.conf.set("spark.sql.shuffle.partitions", parts), configure(made.spark).conf.get(START))[1]
    found = [start(n) for n in (600, 3, 250)]
    made.spark.conf.set(START, 50)
    found.append(start(600))
    made.spark.conf.unset("spark.sql.shuffle.partitions")
    made.spark.conf.unset(START)
    assert found == ["600", "200", "250", "50"] and configure(made.spark).conf.get(START) == "200"


def test_files_are_read_in_bounded_pieces(made):
    from transitloom.session import configure

    key = "spark.sql.files.maxPartitionBytes"
    before = made.spark.conf.get(key, None)
    made.spark.conf.unset(key)
    unset = configure(made.spark).conf.get(key)
    made.spark.conf.set(key, "8m")
    kept = configure(made.spark).conf.get(key)
    made.spark.conf.set(key, before or unset)
    assert (unset, kept) == ("32m", "8m")


def test_place_and_least_part_come_from_one_pass(made):
    assert plan(made.updates).count("Window [") == 1
    least = {(r.trip_id, r.stop_sequence, r.arrival_time) for r in made.updates.where("trip_id = '3' and stop_sequence = 2").collect()}
    # line 2 of order 3 is there with parts 32 and 33; the least of them is in both predictions
    scheduled = 1704700800 + 21600 + 21 * 60 + 2 * 240 + 32
    assert sorted(at.timestamp() for _, _, at in least) == [scheduled - 100, scheduled - 80]


def test_instants_are_found_once_for_all_days(made):
    # arrivals of one route at one stop on two days, some of them together
    rows = [("r", "s", f"2024-01-0{d} 0{h}:00:00", f"t{d}{h}{i}") for d in (1, 2) for h in (1, 2) for i in (0, 1)]
    updates = made.spark.createDataFrame(rows, "route_id string, stop_id string, at string, trip_instance_id string").withColumn(
        "arrival_time", F.to_timestamp("at"))
    found = realtime.prev_vehicle(updates)
    got = sorted((r.trip_instance_id, r.prev_trip_instance_id) for r in found.collect())
    assert got == [("t110", None), ("t120", "t111"), ("t210", "t121"), ("t220", "t211")]
    # the closing vehicles are read from the rows that were moved to their days, not aggregated again
    ran = plan(found).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in ran and len(re.findall(r"functions=\[min\(trip_instance_id", ran)) == 1
    packed = re.findall(r"Exchange hashpartitioning\(route_id#\d+, stop_id#\d+, __slice[^\n]*\n[^\n]*\n[^\n]*", ran)
    assert packed and not [p for p in packed if "struct(arrival_time" in p]


def test_scheduled_calls_meet_predictions_where_they_lie(made):
    scheduled = realtime.attach_schedule(realtime.dedup_updates(made.updates, TIES), timetable.transit_stops(made.trips, made.stop_times))
    # predictions are moved to their trips; the timetable is not moved again to trip and place
    assert not [e for e in exchanges(scheduled) if "trip_id" in e and "stop_sequence" in e]
    assert scheduled.where("trip_id = '2'").count() == 3 * 4 and scheduled.where("trip_id = '1'").count() == 3


def test_runs_of_several_dates_are_dealt_out_once(made):
    import __spark_entry__  # noqa: F401 - loads the catalog in its order
    from catalog.tables import _three_days

    before, after = _three_days(made)
    pairs = realtime.next_stop(realtime.dedup_updates(before, TIES))
    assert all(e.startswith("trip_instance_id#") and "stop_sequence" not in e for e in exchanges(pairs)) and len(exchanges(pairs)) == 3
    assert {(r.trip_instance_id, str(r.service_date), str(r.arrival_time.date())) for r in before.collect()} == {
        (f"{k}_{20240108 + k % 3}", f"2024-01-{8 + k % 3:02d}", f"2024-01-{8 + k % 3:02d}") for k in range(1, 7)}
    assert {r.trip_id for r in after.collect()} == {"2", "3", "5", "6"}


def test_headways_of_days_are_moved_once(spark):
    rows = [("r", "s", f"2024-01-0{d}", f"2024-01-0{d} 0{h}:00:00", f"t{d}{h}") for d in (1, 2) for h in (1, 2)]
    instants = spark.createDataFrame(rows, "route_id string, stop_id string, day string, at string, last_trip string").select(
        "route_id", "stop_id", F.to_date("day").alias("day"), F.to_timestamp("at").alias("arrival_time"), "last_trip", F.col("last_trip").alias("trip_instance_id"))
    part = F.pmod(F.xxhash64("route_id", "stop_id"), F.lit(16))
    closings = realtime.closing_vehicles(instants, "day").withColumn("__slice", part)
    instants = instants.withColumn("__slice", part)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    looked = realtime.prev_vehicle_of_days(instants.repartition("day", "__slice"), closings.repartition("day", "__slice"), "day", "__slice")
    moved = [e for e in exchanges(looked) if "route_id" in e]
    found = sorted((r.trip_instance_id, r.prev_trip_instance_id) for r in looked.collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == [("t11", None), ("t12", "t11"), ("t21", "t12"), ("t22", "t21")]
    assert len(moved) == 1  # of the closing vehicles, which are few


def test_partitions_are_replaced_by_one_write(spark, tmp_path, monkeypatch):
    from datetime import date

    from transitloom.sources import landed

    days = [date(2024, 1, d) for d in (1, 2, 3)]
    frame = lambda rows: spark.createDataFrame(rows, "x long, day date")
    path = f"{tmp_path}/held"
    frame([(i, day) for i, day in enumerate(days)] + [(9, None)]).write.partitionBy("day").parquet(path)
    monkeypatch.setattr(landed, "store_and_reload", None)
    n = landed.replace_partitions(frame([(7, days[0]), (8, days[0]), (5, days[2]), (6, None)]), path, "day", [days[0], days[1], None, None])
    assert n == 3
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == sorted([(7, days[0]), (8, days[0]), (2, days[2]), (6, None)], key=str)


def segments_of(spark):
    line = [(0.0, 0.0), (0.0, 1.0)]
    rows = [(f"t{i}", "r", "s", 1, 2, "a", "b", 0, 60, 500.0, 7, line if i else None) for i in range(4)]
    return spark.createDataFrame(
        rows, "trip_id string, route_id string, service_id string, stop1_sequence int, stop2_sequence int, stop1_id string, stop2_id string, "
        f"stop1_arrival int, stop2_arrival int, seg_length double, geom_key long, seg_geom {LINE}")


def test_picking_a_line_does_not_sort_all_segments(spark):
    segments = segments_of(spark)
    for made in (lines.segment_geometries(segments), lines.collect_lines(segments), spatial.segment_usage(segments), spatial.distinct_segments(segments)):
        # the first aggregate, which sees every segment, keeps a hash table
        bottom = [x for x in plan(made).splitlines() if "Aggregate" in x][-1]
        assert "HashAggregate" in bottom
        assert len(made.collect()) == 1
    assert lines.collect_lines(segments).first().copies == spatial.segment_usage(segments).first().copies == 3


def test_lines_are_not_moved_with_observed_pairs(spark):
    segments = segments_of(spark)
    at = F.timestamp_seconds(F.lit(1_704_700_000) + F.col("n") * 50)
    latest = spark.range(4).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat(F.lit("i"), F.col("id")).alias("trip_instance_id"), F.col("n").alias("stop_sequence"), F.concat(F.lit("t"), F.col("id")).alias("trip_id"),
        F.lit("r").alias("route_id"), F.lit("2024-01-08").cast("date").alias("service_date"), F.when(F.col("n") == 1, "a").otherwise("b").alias("stop_id"),
        at.alias("actual_arrival"), at.alias("actual_departure"), F.lit(5).alias("arrival_delay_seconds"), F.lit(5).alias("departure_delay_seconds"))
    routes = spark.createDataFrame([("r", "R", "R line", "3")], "route_id string, route_short_name string, route_long_name string, route_type string")
    stops = spark.createDataFrame([("a", "A", 49.0, -123.0), ("b", "B", 49.1, -123.0)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    pairs = realtime.updates_to_segments(realtime.next_stop(latest), segments.drop("seg_geom"))
    assert "seg_geom" not in pairs.columns and pairs.count() == 4
    delays = realtime.delay_analysis(latest, segments, routes, stops)
    assert [len(r.seg_geom) for r in delays.collect()] == [2] * 4 and "LineString" in delays.first().seg_geojson
    bare, speeds = realtime.delays_of(pairs, routes, stops), realtime.speeds_of(pairs, routes, stops)
    assert [c for c in delays.columns if c not in ("seg_geom", "seg_geojson")] == bare.columns
    drawn = realtime.speed_with_geometry(speeds, bare, lines.segment_geometries(segments))
    plain = realtime.speed_with_geometry(speeds, delays)
    assert drawn.columns == plain.columns and sorted(map(str, drawn.collect())) == sorted(map(str, plain.collect())) and drawn.count() == 4
    assert layers.delay_by_segment(bare).first().total_observations == 4


def test_stages_of_segments(spark, made):
    stops = spark.range(100).select(F.col("id").cast("string").alias("stop_id"), (F.lit(49.0) + F.col("id") / 1000).alias("stop_lat"), F.lit(-123.0).alias("stop_lon"))
    shapes = spark.createDataFrame([], "shape_id string, shape_pt_sequence int, shape_pt_lon double, shape_pt_lat double")
    staged = []

    def stage(df):
        staged.append(df.columns)
        return df.localCheckpoint()

    rows = plans.route_segments(made.trips.withColumn("shape_id", F.lit(None).cast("string")), made.stop_times, stops, shapes, stage)
    # calls are written once, with the next call beside them; trips that are left out have been found before the segments move
    assert len(staged) == 4 and "stop2_sequence" in staged[0] and staged[-1] == ["trip_id"]
    assert rows.count() > 0 and "__place" not in rows.columns


def packed(folder):
    """Documents of each file of a folder; every file is packed."""
    files = [f for f in os.listdir(folder) if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
    return [len(gzip.open(f"{folder}/{f}").read().splitlines()) for f in files]


def test_landed_predictions_are_packed_in_small_files(made, tmp_path, monkeypatch):
    path = f"{tmp_path}/packed"
    monkeypatch.setattr(standins, "scratch_path", lambda spark, label: path)
    folder = made.landed(made.update_snapshots.coalesce(1), "any", 10)
    assert sorted(packed(folder)) == [4, *[10] * 5]
    assert sorted(made.spark.read.text(folder).collect()) == sorted(made.update_snapshots.collect())


@pytest.fixture
def streams(made, tmp_path, monkeypatch):
    """The registered queries on the rows of `made`, with what they write below a folder of its own."""
    from __spark_entry__ import queries

    from catalog import tables

    for of in (standins, tables):
        monkeypatch.setattr(of, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    return queries()


def test_latest_predictions_come_from_packed_documents(made, streams, tmp_path):
    got = streams["st04_latest_update_state"](made.spark, made.folder).collect()
    assert sum(packed(f"{tmp_path}/latest")) == 54
    latest = made.updates.groupBy("trip_instance_id", "stop_sequence").agg(F.unix_micros(F.max("fetch_timestamp"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, latest))


def test_predictions_are_streamed_from_packed_documents(made, streams, tmp_path):
    got = streams["st02_stream_updates"](made.spark, made.folder).collect()
    assert sum(packed(f"{tmp_path}/updates")) == 54 == len(got)
    wanted = made.updates.select("trip_instance_id", F.col("stop_sequence").cast("long"), "stop_id", F.unix_micros("fetch_timestamp"), F.unix_micros("arrival_time"))
    assert sorted((r.trip_instance_id, r.stop_sequence, r.stop_id, r.fetch_timestamp, r.arrival_time) for r in got) == sorted(map(tuple, wanted.collect()))
