"""Timetable jobs on small hand-made feeds."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from transitloom.operators import timetable as t
from transitloom.plans import timetable as pt
from transitloom.sources import gtfs

CALENDAR = "service_id string, sunday int, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, start_date date, end_date date"


@pytest.fixture(scope="module")
def feed(spark):
    """One shape with a bend, a trip on it, a trip without shape, and one that runs backwards."""
    stops = spark.createDataFrame(
        [("a", "A", 0.0, 0.0), ("b", "B", 0.0, 0.01), ("c", "C", 0.0, 0.02), ("d", "D", 0.01, 0.02)],
        "stop_id string, stop_name string, stop_lat double, stop_lon double")
    shapes = spark.createDataFrame(
        [("s", 1, 0.0, 0.0), ("s", 2, 0.0, 0.02), ("s", 3, 0.01, 0.02)],
        "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double")
    trips = spark.createDataFrame(
        [("on", "r", "1", "s"), ("bare", "r", "1", None), ("blank", "r", "1", ""), ("back", "r", "1", "s"), ("lost", "r", "1", "s"), ("zero", "r", "1", "s")],
        "trip_id string, route_id string, service_id string, shape_id string")
    calls = []
    for trip, ids in {"on": "abcd", "bare": "abd", "blank": "ad", "back": "acbd", "lost": "axd"}.items():
        calls += [(trip, i + 1, stop, 100 * i) for i, stop in enumerate(ids)]
    calls += [("zero", i, stop, 100 * i) for i, stop in enumerate("abd")]
    stop_times = spark.createDataFrame(calls, "trip_id string, stop_sequence int, stop_id string, arrival_seconds int")
    return trips, stop_times, stops, shapes


@pytest.fixture(scope="module")
def segments(feed):
    return pt.route_segments(*feed)


def rows_of(df, trip):
    return df.where(F.col("trip_id") == trip).orderBy("stop1_sequence").collect()


def test_a_trip_with_one_bad_segment_is_dropped_whole(segments):
    kept = {r[0] for r in segments.select("trip_id").distinct().collect()}
    # backwards order and an unknown stop leave a segment without geometry
    assert kept == {"on", "bare", "blank", "zero"}


def test_segments_follow_the_shape_and_add_up(segments):
    on = rows_of(segments, "on")
    assert [(round(r.perc1, 6), round(r.perc2, 6)) for r in on] == [(0.0, 0.333333), (0.333333, 0.666667), (0.666667, 1.0)]
    assert [r.no_points for r in on] == [2, 2, 2]
    assert sum(r.seg_length for r in on) == pytest.approx(2 * 1113.194908 + 1105.742, rel=1e-5)
    assert rows_of(segments, "blank")[0].no_points == 2


def test_a_sequence_from_zero_misses_the_first_rule(segments):
    zero = rows_of(segments, "zero")
    # sequence 1 is forced to 0 although it is the second stop, and the first segment shrinks to a point
    assert [(r.perc1, r.perc2) for r in zero] == [(0.0, 0.0), (0.0, 1.0)]
    assert zero[0].no_points is None and zero[0].seg_length == 0.0
    assert zero[1].no_points == 3


def test_inner_points_use_metres_or_degrees(spark, segments):
    bent = segments.where("trip_id = 'zero'")
    points = pt.trip_points(bent).orderBy("point_sequence").collect()
    assert [p.point_sequence for p in points] == [1, 2, 3]
    assert points[0].point_arrival == 100 and points[2].point_arrival == 200
    assert points[1].point_arrival == pytest.approx(100 + 100 * 2226.39 / (2226.39 + 1105.742), rel=1e-4)
    degrees = pt.trip_points(bent, "degrees").where("point_sequence = 2").first()
    assert 100 < degrees.point_arrival < 100.01


def test_last_vertex_is_kept_only_at_the_end_of_the_trip(segments):
    points = pt.trip_points(segments.where("trip_id = 'on'")).orderBy("stop1_sequence", "point_sequence").collect()
    assert [(p.stop1_sequence, p.point_sequence) for p in points] == [(1, 1), (2, 1), (3, 1), (3, 2)]


def test_stop_fraction_matches_the_segments(feed, segments):
    trips, stop_times, stops, shapes = feed
    perc = t.stop_fraction(t.transit_stops(trips, stop_times), t.trip_edges(trips, stop_times, stops, shapes), stops)
    got = {(r.trip_id, r.stop_sequence): r.perc for r in perc.collect()}
    for r in segments.collect():
        assert got[(r.trip_id, r.stop1_sequence)] == r.perc1 and got[(r.trip_id, r.stop2_sequence)] == r.perc2
    assert got[("lost", 2)] is None


def test_removed_days_hit_every_service_or_only_their_own(spark):
    calendar = spark.createDataFrame([
        ("A", 1, 1, 1, 1, 1, 1, 1, date(2024, 1, 1), date(2024, 1, 3)), ("B", 0, 1, 0, 0, 0, 0, 0, date(2024, 1, 1), date(2024, 1, 9))], CALENDAR)
    changes = spark.createDataFrame([("A", date(2024, 1, 1), 2), ("B", date(2024, 1, 5), 1), ("B", None, 2)], "service_id string, date date, exception_type int")
    whole = {(r[0], r[1].day) for r in pt.service_dates(calendar, changes).collect()}
    assert whole == {("A", 2), ("A", 3), ("B", 5), ("B", 8)}
    own = {(r[0], r[1].day) for r in pt.service_dates(calendar, changes, "service").collect()}
    assert own == whole | {("B", 1)}


def test_scheduled_trips_on_the_first_day_only(spark, segments):
    days = spark.createDataFrame([("1", date(2024, 1, 2)), ("1", date(2024, 1, 3))], "service_id string, date date")
    points = pt.trip_points(segments)
    one = pt.scheduled_trajectories(points, days)
    assert {str(r.date) for r in one.collect()} == {"2024-01-02"}
    two = pt.scheduled_trajectories(points, days, [date(2024, 1, 2), date(2024, 1, 3)])
    assert two.count() == 2 * one.count()
    trip = one.where("trip_id = 'on'").first()
    assert len(trip.trip) == 4 and trip.starttime == trip.trip[0].t
    track = pt.scheduled_tracks(one).where("trip_id = 'on'").first()
    assert len(track.scheduled_track) == 3


def test_scheduled_headway_ignores_ties_and_mixes_services(spark):
    routes = spark.createDataFrame([("r", "R", "3"), ("m", "M", "1")], "route_id string, route_short_name string, route_type string")
    ts = spark.createDataFrame(
        [("r", "x", "1", v) for v in (0, 600, 600, 1800)] + [("r", "x", "2", 300), ("r", "y", "1", 0), ("r", "y", "1", 8000), ("m", "x", "1", 5)],
        "route_id string, stop_id string, service_id string, arrival_seconds int")
    got = {(r.route_id, r.stop_id): r.scheduled_headway_minutes for r in t.scheduled_headway(ts, routes).collect()}
    assert got == {("r", "x"): pytest.approx((5 + 5 + 20) / 3)}
    only = t.scheduled_headway(ts, routes, spark.createDataFrame([("1",)], "service_id string")).collect()
    assert [r.scheduled_headway_minutes for r in only] == [pytest.approx(15.0)]


def test_cleaning_keeps_what_is_referenced(spark):
    text = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    tables = {
        "stops": text([("in", "I", "49.2", "-123.0", "x"), ("out", "O", "50.2", "-123.0", "x")], "stop_id stop_name stop_lat stop_lon junk"),
        "stop_times": text([("t1", " 6:16", "6:17", "in", "1"), ("t1", "7:00:00", "7:00:00", "out", "2"), ("t2", "7:00:00", "7:00:00", "out", "1"), ("ghost", "7:00", "7:00", "in", "1")],
                           "trip_id arrival_time departure_time stop_id stop_sequence"),
        "trips": text([("r1", "s1", "t1", "0", " "), ("r2", "s2", "t2", "0", "sh")], "route_id service_id trip_id direction_id shape_id"),
        "routes": text([("r1", "a1", "1", "One", "3"), ("r2", "a2", "2", "Two", "3")], "route_id agency_id route_short_name route_long_name route_type"),
        "agency": text([("a1", "A", "u", "z"), ("a2", "B", "u", "z")], "agency_id agency_name agency_url agency_timezone"),
        "calendar_dates": text([("s1", "20240101", "1"), ("s2", "20240101", "1")], "service_id date exception_type"),
    }
    clean = pt.clean_timetable(tables)
    assert [tuple(r) for r in clean["stop_times"].collect()] == [("t1", "06:16:00", "06:17:00", "in", "1")] or \
        [r.arrival_time for r in clean["stop_times"].select("trip_id", "arrival_time").collect()] == ["06:16:00"]
    assert clean["stops"].columns == gtfs.KEEP["stops"] and clean["stops"].count() == 1
    assert [r.shape_id for r in clean["trips"].collect()] == [None]
    assert {n: clean[n].count() for n in ("routes", "agency", "calendar_dates")} == {"routes": 1, "agency": 1, "calendar_dates": 1}
    no_agency = dict(tables, routes=tables["routes"].withColumn("agency_id", F.lit(None).cast("string")))
    assert pt.clean_timetable(no_agency)["agency"].count() == 2


def test_missing_text_is_read_as_null_and_never_written(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "routes.txt").write_text("﻿route_id,agency_id,route_short_name,route_long_name,route_type\nr1,a,nan,Rail,2\n")
    tables, missing = gtfs.read_gtfs(spark, str(folder))
    assert "stops" in missing and "routes" not in missing
    row = tables["routes"].first()
    assert row.route_id == "r1" and row.route_short_name is None
    gtfs.write_gtfs(tables, str(tmp_path / "out"), backup_of=str(folder))
    text = "".join(p.read_text() for p in (tmp_path / "out" / "routes.txt").glob("part*"))
    assert "nan" not in text and "r1,a,,Rail,2" in text
    assert (tmp_path / "out_backup" / "routes.txt").exists()


def test_trips_without_a_shape_share_the_line_of_their_stops(spark):
    """A feed without shapes: six trips, three orders of stops, whatever their sequence numbers."""
    stops = spark.createDataFrame([(c, 49.0 + i / 100, -123.0 + i * i / 1000) for i, c in enumerate("abcd")], "stop_id string, stop_lat double, stop_lon double")
    runs = {"t1": "abcd", "t2": "abcd", "t3": "dcba", "t4": "abd", "t5": "abcd", "t6": "dcba"}
    trips = spark.createDataFrame([(k, "r", "s", None if k != "t5" else "") for k in runs], "trip_id string, route_id string, service_id string, shape_id string")
    rows = [(k, (n + 1) * (10 if k == "t2" else 1), c, 60 * n) for k, order in runs.items() for n, c in enumerate(order)]
    stop_times = spark.createDataFrame(rows, "trip_id string, stop_sequence int, stop_id string, arrival_seconds int")
    shapes = spark.createDataFrame([], "shape_id string, shape_pt_sequence int, shape_pt_lon double, shape_pt_lat double")
    calls = t.with_line(t.transit_stops(trips, stop_times))
    lines = {r.trip_id: r.line_id for r in calls.collect()}
    assert lines["t1"] == lines["t2"] == lines["t5"] and lines["t3"] == lines["t6"] and len(set(lines.values())) == 3
    assert t.pattern_edges(calls, stops).select("line_id").distinct().count() == 3
    made = pt.route_segments(trips, stop_times, stops, shapes).collect()
    assert len(made) == sum(len(x) - 1 for x in runs.values())
    old = t.pattern_geometry(t.with_pattern(t.segments_lead(t.transit_stops(trips, stop_times))), t.trip_edges(trips, stop_times, stops, shapes), stops)
    per_trip = {(r.line_id.removeprefix("trip:"), r.stop1_id, r.stop2_id): (r.seg_geom, r.seg_length) for r in old.collect()}
    assert all(per_trip[r.trip_id, r.stop1_id, r.stop2_id] == (r.seg_geom, r.seg_length) for r in made)
    assert all(len(r.run_m) == len(r.run_deg) == len(r.seg_geom) and r.run_m[0] == 0 and abs(r.run_m[-1] - r.seg_length) < 1e-6 for r in made)
