"""Snapping line by line, and what the streams pass on."""

from pyspark.sql import functions as F

from catalog.standins import Transit
from transitloom.functions import scalars as s
from transitloom.operators import moving
from transitloom.plans import timetable
from transitloom.session import store_and_reload
from transitloom.sources import census, feed

FOLDER = "/root/testdata/sf0.001"


def test_lines_used_one_by_one_give_the_same_points(spark):
    T = Transit(spark, FOLDER)
    rows = T.positions.withColumn("service_date", s.service_date("start_date", "entity_timestamp"))
    days = store_and_reload(timetable.scheduled_tracks(timetable.scheduled_trajectories(T.points, T.service_days)), "tracks")
    want = moving.snap_positions(moving.trip_to_line(rows, T.trips, T.shape_tracks, days))
    got = moving.snap_to_lines(rows, T.trips, T.shape_tracks, days)
    point = lambda df: sorted((r.tie1, r.lon, r.lat) for r in df.select("tie1", "lon", "lat").collect())
    assert point(got) == point(want)
    assert point(moving.snap_to_lines(rows, T.trips, T.shape_tracks)) == point(
        moving.snap_positions(moving.trip_to_line(rows, T.trips, T.shape_tracks)))


def test_the_route_filter_leaves_the_columns_in_place(spark):
    T = Transit(spark, FOLDER)
    snapshots, routes = T.parsed(T.position_snapshots), T.routes.where("route_type = '1'")
    whole, some = feed.land_vehicle_positions(snapshots), feed.land_vehicle_positions(snapshots, routes)
    assert some.columns == whole.columns
    ids = [r.route_id for r in routes.collect()]
    assert some.count() == whole.where(F.col("route_id").isin(ids)).count() > 0


def test_headers_that_become_the_same_name_stay_apart(spark):
    made = census.normalise_columns(spark.createDataFrame([(1, 2, 3)], ["a b", "a-b", "a_b_2"]))
    assert made.columns == ["a_b", "a_b_2", "a_b_2_2"] and tuple(made.first()) == (1, 2, 3)
