"""Keyed tables in hash buckets, retention of landed folders, first sightings with bounded state."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from transitloom.session import scratch_path
from transitloom.sources import landed, tables
from transitloom.streaming import feeds

T0 = datetime(2025, 1, 10, 12, tzinfo=timezone.utc)


def newer(old, new):
    return old.join(new.select("k"), "k", "left_anti").unionByName(new)


def test_a_merge_opens_no_more_files_with_every_version(spark):
    path = scratch_path(spark, "buckets")
    tables.merge_snapshot(spark.range(400).selectExpr("id AS k", "0 AS n"), path, ["k"], newer, buckets=8)
    opened, want = [], dict.fromkeys(range(400), 0)
    for n in range(1, 7):
        fresh = spark.createDataFrame([(3, n), (400 + n, n)], "k long, n int")
        runs, schema, buckets = tables._manifest(spark, path)
        assert buckets == 8
        touched = {r[0] for r in fresh.select(tables._bucket(["k"], 8)).collect()}
        opened.append((len(touched), len(tables._rows(spark, path, {b: runs[b] for b in touched}, schema).inputFiles())))
        tables.merge_snapshot(fresh, path, ["k"], newer)
        want |= {3: n, 400 + n: n}
    # a bucket is one file here, and only the buckets of the new keys are opened
    assert all(files <= 2 for _, files in opened) and {files for of, files in opened if of == 2} == {2}
    assert dict(map(tuple, tables.read_snapshot(spark, path).collect())) == want
    assert len(tables.read_snapshot(spark, path).inputFiles()) <= 8


def test_a_broken_version_is_passed_over(spark):
    path = scratch_path(spark, "broken")
    rows = spark.createDataFrame([(1, 1)], "k int, n int")
    assert tables.write_snapshot(rows, path, ["k"]) == 1
    rows.write.parquet(f"{path}/manifest/version=00000002")
    os.remove(f"{path}/manifest/version=00000002/_SUCCESS")
    assert [tuple(r) for r in tables.read_snapshot(spark, path).collect()] == [(1, 1)]
    assert tables.merge_snapshot(rows.withColumn("n", F.lit(5)), path, ["k"], newer) == 3
    assert [tuple(r) for r in tables.read_snapshot(spark, path).collect()] == [(1, 5)]
    assert tables.merge_snapshot(rows.limit(0), path, ["k"], newer) == 3


def landed_folder(spark):
    path = scratch_path(spark, "landed")
    hours = [(n, T0 - timedelta(hours=6 * n)) for n in range(20)] + [(99, None)]
    tables.append_sink(spark.createDataFrame(hours, "id int, entity_timestamp timestamp"), path)
    return path, dict(hours)


def bytes_of(path):
    return {d: sum(os.path.getsize(os.path.join(d, f)) for f in files) for d, _, files in os.walk(path) if "=" in os.path.basename(d)}


def test_retention_frees_whole_dates_and_rewrites_the_boundary(spark):
    path, rows = landed_folder(spark)
    ids = lambda: {r.id for r in spark.read.parquet(path).collect()}
    stamps = {f: os.stat(f).st_mtime_ns for d in bytes_of(path) for f in [os.path.join(d, x) for x in os.listdir(d) if x.startswith("part-")]}
    cutoff = T0 - timedelta(days=2)
    told = landed.retain_landed_by_age(spark, path, "entity_timestamp", timedelta(days=2), T0, dry_run=True)
    assert sum(r.rows_to_delete for r in told.collect()) == sum(t is not None and t < cutoff for t in rows.values()) and ids() == set(rows)
    before = sum(bytes_of(path).values())
    landed.retain_landed_by_age(spark, path, "entity_timestamp", timedelta(days=2), T0)
    assert ids() == {n for n, t in rows.items() if t is None or t >= cutoff} and sum(bytes_of(path).values()) < before
    # dates after the cutoff and rows without a time keep their files as they were
    kept = {f: at for f, at in stamps.items() if "2025-01-09" in f or "2025-01-10" in f or landed.NO_VALUE in f}
    assert len(kept) >= 3 and all(os.stat(f).st_mtime_ns == at for f, at in kept.items())
    assert landed.retain_landed_by_age(spark, path, "entity_timestamp", timedelta(days=2), T0).isEmpty()


def test_a_range_is_deleted_and_a_folder_emptied(spark):
    path, rows = landed_folder(spark)
    start, end = T0 - timedelta(days=3), T0 - timedelta(days=1)
    landed.retain_landed_by_range(spark, path, "entity_timestamp", start, end)
    assert {r.id for r in spark.read.parquet(path).collect()} == {n for n, t in rows.items() if t is None or not start <= t <= end}
    with pytest.raises(ValueError, match="confirm"):
        landed.truncate_landed(spark, path)
    landed.truncate_landed(spark, path, confirm=True)
    assert spark.read.parquet(path).collect() == []
    tables.append_sink(spark.createDataFrame([(1, T0)], "id int, entity_timestamp timestamp"), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [1]


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    polls = [[("a", 0, 1), ("a", 0, 2), ("b", -1, 1)], [("a", 0, 3), ("c", 0, 4), ("d", -5, 4), ("b", -1, 5), (None, 0, 5)], [("d", -5, 6), ("a", 1, 7), ("e", -2, 7)]]
    schema = "trip_instance_id string, entity_timestamp timestamp, fetch_timestamp timestamp, n int"
    for k, poll in enumerate(polls):
        rows = [(t, T0 + timedelta(hours=h), T0 + timedelta(minutes=f), k) for t, h, f in poll]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = scratch_path(spark, "bounded")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.start_drop_repeats(stream, path, scratch_path(spark, "bounded-cp")).awaitTermination()
    hour = lambda r: round((r.entity_timestamp.replace(tzinfo=timezone.utc) - T0).total_seconds() / 3600)
    got = sorted((r.trip_instance_id, hour(r), r.n) for r in spark.read.parquet(f"{path}/rows").collect())
    late = sorted((r.trip_instance_id, hour(r), r.n) for r in spark.read.parquet(f"{path}/late").collect())
    assert got == [("a", 0, 0), ("a", 1, 2), ("b", -1, 0), ("c", 0, 1), ("e", -2, 2)]
    # too old for the state, but written and there to be counted
    assert late == [("d", -5, 1), ("d", -5, 2)]
    state = spark.read.parquet(f"{path}/state/slot=0").select("trip_instance_id").collect()
    assert {r[0] for r in state} == {"a", "b", "c", "e"}


def test_a_hub_of_many_routes_is_spread_over_tasks(spark):
    """One stop pair with 5,000 routes, and some pairs of its own for a few of them."""
    from transitloom.operators.layers import route_pair_self_join

    hub = spark.range(5000).select(F.format_string("r%05d", "id").alias("route_id"), F.lit("hub").alias("segment_id"))
    few = spark.range(40).select(F.format_string("r%05d", F.col("id") % 8).alias("route_id"), F.format_string("s%d", F.col("id") % 5).alias("segment_id"))
    pairs = route_pair_self_join(hub.unionByName(few))
    seen = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("shared_segments") > 1).alias("more"), F.max("shared_segments").alias("most"), F.count_if(F.col("route1") >= F.col("route2")).alias("odd")).first()
    assert (seen.n, seen.more, seen.most, seen.odd) == (5000 * 4999 // 2, 28, 6, 0)
    small = [tuple(r) for r in route_pair_self_join(few, piece=2).orderBy("route1", "route2").collect()]
    assert small == [tuple(r) for r in route_pair_self_join(few).orderBy("route1", "route2").collect()] and len(small) == 28


@pytest.mark.parametrize("mark", ['{"type":"Feature"', '{ "type": "Feature"', '{\n  "type" : "Feature"'])
def test_one_collection_is_read_by_several_tasks(spark, tmp_path, mark):
    from transitloom.sources import census

    feature = lambda n: mark + f', "properties": {{"id": "{n}", "pop": "{n * 10}", "a": "2", "said": "a \\"Feature\\" , ]}}"}}, "geometry": {{"type": "Polygon", "coordinates": [[[0, 0], [1, {n}], [1, 1], [0, 0]]]}}}}'
    (tmp_path / "areas.json").write_text('{"type": "FeatureCollection", "crs": {"type": "name"}, "features": [\n' + ",\n".join(map(feature, range(1, 3001))) + "\n], \"end\": {}}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = census.read_census(spark, str(tmp_path))
        assert len({r[0] for r in got.select(F.spark_partition_id()).collect()}) > 3
        rows = sorted((int(r.id), r.pop, r.geom[0][0][1].lat) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == [(n, n * 10.0, float(n)) for n in range(1, 3001)]
    (tmp_path / "areas.json").write_text('{"type": "FeatureCollection", "features": [' + feature(1) + "," + feature(2).replace('"type"', ' "type" ', 1) + "]}")
    with pytest.raises(Exception, match="spaced differently"):
        census.read_census(spark, str(tmp_path)).collect()
    (tmp_path / "areas.json").write_text('{"features": [{"geometry": null, "properties": {"id": "7", "pop": "1", "a": "1"}, "type": "Feature"}], "type": "FeatureCollection"}')
    assert [r.id for r in census.read_census(spark, str(tmp_path)).collect()] == ["7"]
