"""Rows that must not get lost: missing partition values, late and repeated sightings, quoted text."""

from datetime import date

from pyspark.sql import functions as F

from transitloom.session import scratch_path
from transitloom.sources import gtfs, tables
from transitloom.streaming import feeds


def test_rows_without_a_partition_value_stay(spark):
    path = scratch_path(spark, "null-part")
    rows = spark.createDataFrame([("a", date(2025, 1, 1), 1), ("b", None, 2)], "k string, service_date date, n int")
    keep_new = lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new)
    tables.merge_snapshot(rows, path, ["k"], keep_new)
    tables.merge_snapshot(spark.createDataFrame([("c", None, 3)], rows.schema), path, ["k"], keep_new)
    got = {(r.k, r.n) for r in tables.read_snapshot(spark, path).collect()}
    assert got == {("a", 1), ("b", 2), ("c", 3)}


def test_retention_of_a_stored_table(spark):
    path = scratch_path(spark, "retain")
    rows = spark.createDataFrame([("a", date(2025, 1, 1), 1), ("b", date(2025, 1, 1), 2), ("c", date(2025, 1, 2), 3), ("d", date(2025, 1, 2), None),
                                  ("e", None, 1), ("f", date(2025, 1, 3), 9)], "k string, service_date date, n int")
    tables.write_snapshot(rows, path, ["k"])
    left = lambda: {r.k for r in tables.read_snapshot(spark, path).collect()}
    told = tables.retain_snapshot(spark, path, F.col("n") < 4, dry_run=True)
    assert {tuple(r) for r in told.collect()} == {(date(2025, 1, 1), 2), (date(2025, 1, 2), 1), (None, 1)} and left() == set("abcdef")
    tables.retain_snapshot(spark, path, F.col("n") < 4)
    assert left() == {"d", "f"}
    assert tables.retain_snapshot(spark, path, F.col("n") < 4).isEmpty() and left() == {"d", "f"}
    tables.retain_snapshot(spark, path, F.lit(True))
    assert left() == set()
    tables.merge_snapshot(rows.limit(1), path, ["k"], lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new))
    assert len(left()) == 1


def test_no_dates_leave_the_views_alone(spark):
    assert feeds.refresh_views(None, None, None, None, None, "/nowhere", service_dates=[]) == {}


def test_earliest_fetch_wins_and_late_rows_stay(spark, tmp_path):
    polls = [(1, "t", "2025-01-01 20:00:00", "2025-01-01 20:02:00"), (2, "t", "2025-01-01 20:00:00", "2025-01-01 20:01:00"),
             (3, "t", "2025-01-01 11:00:00", "2025-01-01 20:03:00")]
    schema = "n int, trip_instance_id string, entity_timestamp timestamp, fetch_timestamp timestamp"
    for n, *row in polls:
        frame = spark.createDataFrame([(n, *row)], "n int, trip_instance_id string, e string, f string")
        frame.select("n", "trip_instance_id", F.to_timestamp("e").alias("entity_timestamp"), F.to_timestamp("f").alias("fetch_timestamp")).write.mode(
            "append").parquet(str(tmp_path / "in"))
    path = scratch_path(spark, "sightings")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.start_first_sightings(stream, path, scratch_path(spark, "sightings-cp")).awaitTermination()
    got = {(str(r.entity_timestamp)[11:16], r.n) for r in tables.read_snapshot(spark, path).collect()}
    assert {n for _, n in got} == {2, 3}


def test_doubled_quotes_and_line_breaks_round_trip(spark, tmp_path):
    name = 'Foo "Bar, Baz" St \\ end'
    rows = spark.createDataFrame([("1", name, "49.1", "-123.1"), ("2", "two\nlines", "49.2", "-123.2")], "stop_id string, stop_name string, stop_lat string, stop_lon string")
    folder = str(tmp_path / "gtfs")
    gtfs.write_gtfs({"stops": rows}, folder)
    got = {tuple(r) for r in gtfs.read_gtfs(spark, folder, line_breaks=True)[0]["stops"].collect()}
    assert got == {tuple(r) for r in rows.collect()}
    text = "".join(p.read_text() for p in (tmp_path / "gtfs" / "stops.txt").glob("part-*"))
    assert '"Foo ""Bar, Baz"" St' in text
