"""Scalar helpers against hand-written values."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from transitloom.functions import scalars as s
from transitloom.operators import timetable as t
from transitloom.sources import census, gtfs


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_clock_text_is_normalised_or_left_alone(spark):
    rows = [(" 6:16:00",), ("6:16",), ("25:10:00",), ("006:1",), ("",), (None,), ("  ",)]
    got = values(spark, rows, "v string", s.normalise_time("v"))
    assert [g[0] for g in got] == ["06:16:00", "06:16:00", "25:10:00", "006:1", "", None, ""]


def test_service_seconds_pass_midnight(spark):
    got = values(spark, [("25:10:01",), ("06:00:00",), ("soon",)], "v string", s.service_seconds("v"))
    assert [g[0] for g in got] == [90601, 21600, None]


def test_service_instant_adds_an_offset_beyond_a_day(spark):
    rows = spark.createDataFrame([(date(2024, 1, 8), 90000)], "d date, n int").select(s.service_instant("d", "n").alias("t"))
    assert rows.first()[0] == datetime(2024, 1, 9, 1, 0)


@pytest.mark.parametrize("hour,label", [
    (7, "Morning Rush"), (9, "Morning Rush"), (10, "Midday"), (15, "Midday"), (16, "Evening Rush"), (18, "Evening Rush"),
    (19, "Evening"), (22, "Evening"), (23, "Night"), (0, "Night"), (6, "Night")])
def test_period_takes_the_first_match(spark, hour, label):
    assert values(spark, [(hour,)], "h int", s.time_period("h")) == [(label,)]


def test_local_time_over_both_clock_changes(spark):
    stamps = [datetime(2025, 12, 7, 15), datetime(2024, 3, 10, 9, 59), datetime(2024, 3, 10, 10), datetime(2024, 11, 3, 8, 30), datetime(2024, 11, 3, 9, 30)]
    rows = [(t_.replace(tzinfo=timezone.utc),) for t_ in stamps]
    got = values(spark, rows, "t timestamp", s.local_hour("t"), s.local_dow("t"), s.day_type(s.local_dow("t")))
    assert got == [(7, 0, "Weekend"), (1, 0, "Weekend"), (3, 0, "Weekend"), (1, 0, "Weekend"), (1, 0, "Weekend")]


def test_bins_are_right_closed_while_flags_are_not(spark):
    rows = [(v,) for v in (3.0, -3.0, -7.0, 7.0, 3.01)]
    bins = values(spark, rows, "v double", s.bin_right_closed("v", s.DELAY_EDGES, s.DELAY_SEVERITY))
    assert [b[0] for b in bins] == [s.DELAY_SEVERITY[i] for i in (2, 1, 0, 3, 3)]
    flags = s.on_time_flags(spark.createDataFrame(rows, "delay_minutes double")).collect()
    assert [(f.on_time, f.early, f.late) for f in flags[:3]] == [(True, False, False), (True, False, False), (False, True, False)]
    heads = values(spark, [(0.0,), (3.0,), (10.0,), (20.0,), (20.5,)], "v double", s.headway_category("v"))
    assert [h[0] for h in heads] == [None, *s.HEADWAY_CATEGORY]


def test_speed_does_not_fail_on_zero_seconds(spark):
    assert values(spark, [(10.0, 0), (10.0, 2)], "m double, s int", s.speed_kmh("m", "s")) == [(None,), (18.0,)]


def test_concatenated_key_collides_and_struct_key_does_not(spark):
    df = spark.createDataFrame([("1", "23"), ("12", "3"), (None, "3")], "a string, b string")
    assert df.select(F.countDistinct(s.segment_key("a", "b"))).first()[0] == 1
    assert df.where("a is not null").select(s.segment_struct("a", "b").alias("k")).distinct().count() == 2


def test_trip_instance_from_the_parts_at_hand(spark):
    rows = [("t1", date(2024, 1, 8), "06:30:00", "v"), ("t1", None, None, "v"), (None, None, None, "v"), ("", None, "", None)]
    at = F.lit("2024-01-08 06:31:02").cast("timestamp")
    got = values(spark, rows, "a string, b date, c string, d string", s.trip_instance_id(F.col("a"), F.col("b"), F.col("c"), F.col("d"), at))
    assert [g[0] for g in got] == ["t1_20240108_063000", "t1", "v_20240108T063102", "trip_20240108T063102"]


def test_dates_and_iso_text(spark):
    assert values(spark, [("20240108",), ("20241399",), ("2024",)], "v string", s.parse_service_date("v")) == [(date(2024, 1, 8),), (None,), (None,)]
    got = values(spark, [("2024-01-08",), ("2024-01-08T01:00:00+01:00",), ("x",)], "v string", s.parse_iso("v"))
    assert got == [(datetime(2024, 1, 8),), (datetime(2024, 1, 8),), (None,)]


def test_route_filter_with_unknown_name_lets_nothing_pass(spark):
    routes = spark.createDataFrame([("r1", "99"), ("r2", "4")], "route_id string, route_short_name string")
    rows = spark.createDataFrame([("r1",), ("r2",), (None,)], "route_id string")
    assert t.route_filter(rows, routes).count() == 3
    assert t.route_filter(rows, routes, short_names=["no such"]).count() == 0
    assert [r[0] for r in t.route_filter(rows, routes, ids=[" r2 "], short_names=["99"]).orderBy("route_id").collect()] == ["r1", "r2"]


def test_column_names_are_made_plain():
    assert census.plain_name("65+ Name/-x.") == "_65_plus_name_x"
    assert len(census.plain_name("a" * 80)) == 63
    assert census.plain_name("()", 4) == "col_4"


def test_pruning_needs_one_known_column(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert gtfs.prune_columns(df, ["b", "z"]).columns == ["b"]
    assert gtfs.column_report(df, ["b", "z"]) == {"missing": ["z"], "extra": ["a"]}
    with pytest.raises(ValueError):
        gtfs.prune_columns(df, ["z"])
