"""Live-feed operators on hand-made rows, hot keys against brute force, streams against batch."""

import os
import random
from collections import defaultdict
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitloom.functions.statistics import exact_percentiles, histogram
from transitloom.functions.windows import sliced_lag
from transitloom.operators import layers as y
from transitloom.operators import metrics as k
from transitloom.operators import moving as m
from transitloom.operators import ordering as o
from transitloom.operators import realtime as rt
from transitloom.operators import spatial as sp
from transitloom.session import scratch_path
from transitloom.sources import census, feed, tables
from transitloom.streaming import feeds

UPDATES = ("trip_instance_id string, trip_id string, route_id string, service_date date, stop_sequence int, stop_id string, arrival_time timestamp, departure_time timestamp, "
           "arrival_delay_seconds int, departure_delay_seconds int, fetch_timestamp timestamp")
T0 = datetime(2025, 12, 8, 15, 0, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def update(trip, seq, stop, arrival, fetched, delay=60, route="r"):
    return (trip, trip, route, date(2025, 12, 8), seq, stop, None if arrival is None else at(arrival), None, delay, None, at(fetched))


@pytest.fixture(scope="module")
def names(spark):
    routes = spark.createDataFrame([("r", "R", "Line R", "3"), ("m", "M", "Metro", "1")], "route_id string, route_short_name string, route_long_name string, route_type string")
    stops = spark.createDataFrame([(s, s.upper(), 49.0, -123.0) for s in "abcd"], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    return routes, stops


def test_latest_fetch_wins_and_dedup_is_idempotent(spark):
    df = spark.createDataFrame([update("t", 1, "a", 10, 1), update("t", 1, "a", 20, 3), update("t", 1, "a", 30, 2), update("t", 2, "b", None, 9)], UPDATES)
    once = rt.dedup_updates(df)
    assert [r.actual_arrival for r in once.collect()] == [at(20).replace(tzinfo=None)]
    again = rt.dedup_updates(once.withColumnsRenamed({"actual_arrival": "arrival_time", "actual_departure": "departure_time"}).withColumn("fetch_timestamp", F.lit(T0)))
    assert again.collect() == once.collect()


def test_headways_read_raw_updates(spark, names):
    # trip t1 is predicted twice in a row, and t2 ties with t1 at 600
    df = spark.createDataFrame([update("t1", 1, "a", 0, 1), update("t1", 1, "a", 300, 2), update("t1", 1, "a", 600, 3), update("t2", 1, "a", 600, 3),
                                update("t3", 1, "a", 900, 3), update("t4", 1, "a", 900 + 7200, 3), update("t5", 1, "a", 8200, 3, route="x")], UPDATES)
    got = [(r.trip_instance_id, r.prev_trip_instance_id, r.headway_minutes) for r in rt.headway_stats(df, *names).orderBy("arrival_time").collect()]
    assert got == [("t3", "t2", 5.0)]


def test_a_missing_stop_spans_segments_unless_adjacency_is_asked(spark, names):
    latest = rt.dedup_updates(spark.createDataFrame([update("t", 1, "a", 0, 1), update("t", 3, "c", 600, 1)], UPDATES))
    segments = spark.createDataFrame(
        [("t", 1, 2, "a", "b", 0, 200, 1000.0, [(-123.0, 49.0), (-123.0, 49.01)], 5), ("t", 2, 3, "b", "c", 200, 400, 1000.0, [(-123.0, 49.01), (-123.0, 49.02)], 6)],
        "trip_id string, stop1_sequence int, stop2_sequence int, stop1_id string, stop2_id string, stop1_arrival int, stop2_arrival int, seg_length double, "
        "seg_geom array<struct<lon:double,lat:double>>, geom_key long")
    row = rt.speed_comparison(latest, segments, *names).first()
    assert (row.scheduled_seconds, row.actual_seconds, row.next_stop_sequence) == (200, 600.0, 3)
    assert row.scheduled_speed_kmh == pytest.approx(18.0)
    assert rt.speed_comparison(latest, segments, *names, require_adjacent=True).count() == 0
    delay = rt.delay_analysis(latest, segments, *names).first()
    assert delay.segment_delay_minutes == pytest.approx(400 / 60) and delay.time_period == "Morning Rush"


def test_missing_delay_leaves_the_schedule_view(spark, names):
    latest = rt.dedup_updates(spark.createDataFrame([update("t", 1, "a", 0, 1, delay=None), update("t", 2, "b", 60, 1, delay=120)], UPDATES))
    ts = spark.createDataFrame([("t", 2, 55)], "trip_id string, stop_sequence int, arrival_seconds int")
    rows = rt.schedule_times(latest, ts, *names).collect()
    assert [(r.stop_sequence, r.delay_minutes, r.scheduled_arrival_seconds) for r in rows] == [(2, 2.0, 55)]


def test_a_hot_stop_gives_the_same_headways_as_a_plain_scan(spark, names):
    rng = random.Random(1)
    rows = [update(f"t{rng.randint(0, 400)}", 1, "a", rng.randint(0, 5 * 86400), n) for n in range(6000)]
    rows += [update(f"t{rng.randint(0, 400)}", 1, rng.choice("bcd"), rng.randint(0, 86400), n) for n in range(600)]
    got = {(r.stop_id, r.arrival_time, r.trip_instance_id, r.prev_trip_instance_id, round(r.headway_minutes, 6)) for r in rt.headway_stats(spark.createDataFrame(rows, UPDATES), *names).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[5]].append((r[6].replace(tzinfo=None), r[0]))
    want = set()
    for stop, items in groups.items():
        items.sort()
        for (t1, a), (t2, b) in zip(items, items[1:]):
            gap = (t2 - t1).total_seconds()
            if a != b and 0 < gap < 7200:
                want.add((stop, t2, b, a, round(gap / 60, 6)))
    assert got == want


def test_sliced_lag_equals_a_plain_window(spark):
    from pyspark.sql import Window

    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("k"), (F.col("id") * 37 % 5000).alias("v"), F.col("id").alias("w"))
    got = sliced_lag(df, ["k"], ["v"], F.floor(F.col("v") / 13), {"w": "prev"})
    want = df.withColumn("prev", F.lag("w").over(Window.partitionBy("k").orderBy("v")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("keyed", [True, False])
def test_exact_percentiles_with_a_hot_group_and_repeats(spark, keyed):
    rng = random.Random(2)
    data = [("hot", round(rng.gauss(0, 5), 2)) for _ in range(9000)] + [("flat", 3.0)] * 2000 + [("one", 1.5)] + [("two", v) for v in (1.0, 2.0)] + [("hot", None)]
    df = spark.createDataFrame(data, "k string, v double")
    shares = {"q1": 0.25, "md": 0.5, "p95": 0.95}
    rows = exact_percentiles(df, "v", shares, ["k"] if keyed else []).collect()
    for r in rows:
        pool = [v for g_, v in data if v is not None and (not keyed or g_ == r.k)]
        for name, share in shares.items():
            assert r[name] == pytest.approx(np.quantile(pool, share), abs=1e-9)
    assert len(rows) == (4 if keyed else 1)


def test_histogram_matches_numpy_and_lists_empty_bins(spark):
    data = [0.0, 0.1, 0.2, 9.9, 10.0, 10.0]
    rows = histogram(spark.createDataFrame([(v,) for v in data] + [(None,)], "v double"), "v", 10).orderBy("bin").collect()
    assert [r.n for r in rows] == np.histogram(data, 10)[0].tolist()
    assert [r.n for r in histogram(spark.createDataFrame([(5.0,)], "v double"), "v", 4).orderBy("bin").collect()] == np.histogram([5.0], 4)[0].tolist()


def test_route_pairs_on_a_shared_corridor(spark):
    rng = random.Random(4)
    rows = [(f"r{n:02d}", f"corridor{s}") for n in range(30) for s in range(20)] + [(f"r{rng.randint(0, 59):02d}", f"s{rng.randint(0, 80)}") for _ in range(900)]
    got = {(r.route1, r.route2): r.shared_segments for r in y.route_pair_self_join(spark.createDataFrame(rows, "route_id string, segment_id string")).collect()}
    by_segment = defaultdict(set)
    for route, seg in rows:
        by_segment[seg].add(route)
    want = defaultdict(int)
    for members in by_segment.values():
        for a in members:
            for b in members:
                if a < b:
                    want[(a, b)] += 1
    assert got == dict(want)


def test_row_numbers_are_consecutive_along_the_order(spark):
    df = spark.range(0, 3000, 1, 7).select((F.col("id") % 100).alias("a"), F.col("id").alias("b"))
    rows = sorted(tables.number_rows(df, ["-a", "b"]).collect())
    assert [r.gid for r in rows] == list(range(1, 3001))
    assert [(r.a, r.b) for r in rows] == sorted(((i % 100, i) for i in range(3000)), key=lambda p: (-p[0], p[1]))


def test_null_order_follows_the_source_database(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    col = lambda *key: [r.v for r in o.order_nulls(df, *key).collect()]
    assert col("v") == [1, 2, None] and col("-v") == [None, 2, 1] and col("-v!") == [2, 1, None]


def test_summaries_drop_missing_keys_and_list_empty_classes(spark):
    rows = spark.createDataFrame([("R", 2.0), ("R", 3.0), ("R", 30.0), (None, 1.0)], "route_short_name string, headway_minutes double")
    got = k.route_summary_stats(rows, min_obs=1).collect()
    # 3.0 counts as bunched in the class, although the layer tests for less than 3
    assert [(r.route_short_name, r.n, round(r.bunching_rate_pct, 3)) for r in got] == [("R", 3, 66.667)]
    cover = spark.createDataFrame([(500.0, 2.0, 1), (20000.0, 4.0, 3)], "population_density double, route_density_km_per_km2 double, num_segments int")
    stats = {r.density_category: r.mean_segments for r in sp.density_category_stats(cover).collect()}
    assert list(stats.values()).count(None) == 2 and len(stats) == 4


# ---- moving points ------------------------------------------------------------------------
POSITIONS = ("trip_instance_id string, trip_id string, route_id string, vehicle_id string, start_date date, entity_timestamp timestamp, fetch_timestamp timestamp, "
             "longitude double, latitude double")


def test_trajectories_take_the_first_fetch_and_snap_by_preference(spark):
    from transitloom.functions import geometry as g
    from transitloom.operators import lines as l

    rows = [("i1", "on", "r", "v", None, at(0), at(5), 0.5, 0.3), ("i1", "on", "r", "v", None, at(0), at(9), 9.0, 9.0), ("i1", "on", None, "v", None, at(60), at(65), 0.7, 0.3),
            ("i2", "sched", "r", "v", None, at(0), at(5), 0.5, 0.9), ("i2", "sched", "r", "v", None, at(60), at(5), 0.6, 0.9),
            ("i3", "raw", "r", "v", None, at(0), at(5), 0.5, 0.9), ("i3", "raw", "r", "v", None, at(60), at(5), 0.5, 0.9), ("i4", "raw", "r", "v", None, at(0), at(5), 0.5, 0.9),
            (None, "raw", "r", "v", None, at(0), at(5), 0.5, 0.9)]
    trips = spark.createDataFrame([("on", "s"), ("sched", None), ("raw", "")], "trip_id string, shape_id string")
    edge = lambda yy: l.tracks(l.edge_table(spark.createDataFrame([("shape:s", 1, 0.0, yy), ("shape:s", 2, 1.0, yy)], "line_id string, i int, lon double, lat double"), "line_id", "i"), "line_id")
    scheduled = edge(1.0).select(F.lit("sched").alias("trip_id"), F.lit(date(2025, 12, 8)).alias("date"), F.col("track").alias("scheduled_track"))
    built = m.actual_trajectories(spark.createDataFrame(rows, POSITIONS), trips, edge(0.0), at(-10), at(100), scheduled)
    out = {r.trip_instance_id: r for r in built.collect()}
    assert sorted(out) == ["i1", "i2", "i3"]
    assert [(p.lon, p.lat) for p in out["i1"].trip] == [(0.5, 0.0), (0.7, 0.0)] and out["i1"].route_id == "r"
    assert [p.lat for p in out["i2"].trip] == [1.0, 1.0]
    assert len(out["i3"].trip) == 2 and len(out["i3"].path) == 1
    with pytest.raises(ValueError):
        m.time_window(spark.createDataFrame(rows, POSITIONS), at(1), at(1))
    assert g.SRID == 4326


def test_matched_shape_is_preferred_over_the_path(spark):
    rows = [("i", "t", "r", date(2025, 12, 8), "v", at(s), float(s), 1.0) for s in (0, 60, 60)]
    matched = spark.createDataFrame(rows, "trip_instance_id string, trip_id string, route_id string, service_date date, vehicle_id string, entity_timestamp timestamp, longitude double, latitude double")
    shapes = spark.createDataFrame([("i", [(0.0, 0.0), (5.0, 5.0), (6.0, 6.0)])], "trip_instance_id string, shape array<struct<lon:double,lat:double>>")
    row = m.matched_trajectories(matched, shapes).first()
    assert len(row.trip) == 2 and len(row.path) == 3


def test_upsert_keeps_the_first_trip_id_and_twice_is_once(spark):
    cols = "trip_instance_id string, trip_id string, service_date date, n int"
    day = lambda d: date(2025, 12, d)
    old = spark.createDataFrame([("a", "t1", day(8), 1), ("b", None, day(8), 1), ("c", "t3", day(7), 1)], cols)
    new = spark.createDataFrame([("a", "other", day(8), 2), ("b", "x", day(9), 2), ("d", "t4", day(9), 2)], cols)
    want = {("a", "t1", day(8), 2), ("b", None, day(9), 2), ("c", "t3", day(7), 1), ("d", "t4", day(9), 2)}
    once = m.upsert_trips(old, new, truncate=False)
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in m.upsert_trips(once, new, truncate=False).collect()} == want
    assert m.upsert_trips(old, new).collect() == new.collect()
    # the same through the stored table: only the touched days are rewritten, and "b" changes its day
    path = scratch_path(spark, "test-upsert")
    merge = lambda a, b: m.upsert_trips(a, b, truncate=False)
    for batch in (old, new, new):
        tables.merge_snapshot(batch, path, ["trip_instance_id"], merge)
    assert {(r.trip_instance_id, r.trip_id, r.service_date, r.n) for r in tables.read_snapshot(spark, path).collect()} == want


def test_retention_keeps_missing_times(spark):
    df = spark.createDataFrame([(1, at(0)), (2, at(-3600)), (3, at(-3601)), (4, None)], "id int, t timestamp")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(tables.retain_by_age(df, "t", timedelta(hours=1), T0)) == [1, 2, 4]
    assert tables.retain_by_age(df, "t", timedelta(hours=1), T0, dry_run=True).first()[0] == 1
    assert ids(tables.retain_by_range(df, "t", at(-3601), at(-3600))) == [1, 4]
    with pytest.raises(ValueError):
        tables.truncate(df)
    assert tables.truncate(df, confirm=True).count() == 0


# ---- landing and streams ------------------------------------------------------------------
def document(fetched, *entities, header=None):
    import json

    return json.dumps({"fetched_at": fetched, "header": {"timestamp": header}, "entity": list(entities)})


def vehicle(trip, ts, lat=49.2, lon=-123.1):
    return {"id": "v", "vehicle": {"trip": {"trip_id": trip, "route_id": "r", "start_date": "20251208"}, "vehicle": {"id": "bus"}, "position": {"latitude": lat, "longitude": lon}, "timestamp": ts}}


def prediction(trip, seq, time, delay):
    return {"id": "u", "trip_update": {"trip": {"trip_id": trip, "route_id": "r", "start_date": "20251208"},
                                       "stop_time_update": [{"stop_sequence": seq, "stop_id": "a", "arrival": {"time": time, "delay": delay}}]}}


def test_landing_rules(spark):
    docs = [document(1000, vehicle("t", 0), vehicle("t", 900, lat=0.0), vehicle("", 950), prediction("t", 1, 2000, 0), prediction("t", 2, 0, 30), header=990)]
    parsed = spark.createDataFrame([(d,) for d in docs], "value string").select(F.from_json("value", feed.SNAPSHOT_SCHEMA).alias("d")).select("d.*")
    seconds = lambda c: F.unix_seconds(c)
    rows = feed.land_vehicle_positions(parsed).select("trip_id", "trip_instance_id", seconds("entity_timestamp").alias("t")).orderBy("t").collect()
    assert [tuple(r) for r in rows] == [(None, "20251208", 950), ("t", "t_20251208", 990)]
    updates = feed.land_trip_updates(parsed).orderBy("stop_sequence").collect()
    assert [(u.arrival_time is None, u.arrival_delay_seconds) for u in updates] == [(False, None), (True, 30)]
    assert feed.land_trip_updates(parsed, zero_delay_is_null=False).orderBy("stop_sequence").first().arrival_delay_seconds == 0
    assert feed.land_trip_updates(parsed, spark.createDataFrame([("z",)], "route_id string")).count() == 0


def test_streams_equal_batch_with_repeats_and_late_files(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    base = int(T0.timestamp())
    # the second file repeats part of the first one, and the third one is older than both
    polls = [(base + 60, [1, 2]), (base + 120, [2, 3]), (base, [1])]
    for n, (fetched, seqs) in enumerate(polls):
        entities = [prediction("t", q, fetched + 100 * q, 10 * n + q) for q in seqs] + [vehicle("t", base + 10 * q) for q in seqs]
        (folder / f"{n}.json").write_text(document(fetched, *entities, header=fetched))
    # files are picked up by age: the longest trip is seen before the last, late file
    for age, n in enumerate((1, 2, 0)):
        os.utime(folder / f"{n}.json", (base + age, base + age))
    batch = spark.read.schema(feed.SNAPSHOT_SCHEMA).json(str(folder))
    shared = lambda name: scratch_path(spark, name)

    path = shared("updates")
    feeds.start_append(feeds.stream_updates(spark, str(folder), 1), path, shared("cp")).awaitTermination()
    landed = feed.land_trip_updates(batch)
    assert sorted(map(str, spark.read.parquet(path).select(*landed.columns).collect())) == sorted(map(str, landed.collect()))

    path = shared("latest")
    feeds.start_latest_updates(feeds.stream_updates(spark, str(folder), 1), path, shared("cp")).awaitTermination()
    want = rt.dedup_updates(feed.as_updates(landed)).select("stop_sequence", "actual_arrival").collect()
    got = tables.read_snapshot(spark, path).select("stop_sequence", F.col("arrival_time").alias("actual_arrival")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 3

    path = shared("unique")
    feeds.start_append(feeds.drop_repeats(feeds.stream_positions(spark, str(folder), 1)), path, shared("cp")).awaitTermination()
    assert spark.read.parquet(path).count() == 3

    path = shared("trips")
    trips = spark.createDataFrame([("t", None)], "trip_id string, shape_id string")
    tracks = spark.createDataFrame([], "line_id string, track array<struct<edge_no:int,x1:double,y1:double,dx:double,dy:double,len:double,start:double>>")
    feeds.start_rebuild(feeds.stream_positions(spark, str(folder), 1), shared("positions"), trips, tracks, path, shared("cp")).awaitTermination()
    row = tables.read_snapshot(spark, path).first()
    assert row.trip_instance_id == "t_20251208" and len(row.trip) == 3
    assert feeds.poll_count(30, 1200) == 40 and feeds.trigger(False, 15) == {"processingTime": "15 seconds"}


def test_census_numbers_and_points_of_interest(spark, tmp_path):
    import json

    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    feature = lambda i, pop, a, kind, c: {"type": "Feature", "properties": {"id": i, "pop": pop, "a": a}, "geometry": {"type": kind, "coordinates": c}}
    doc = {"type": "FeatureCollection", "features": [feature("a", 100, "2", "Polygon", [ring]), feature("b", "n/a", 2, "Polygon", [ring]), feature("c", 5, 0, "MultiPolygon", [[ring], [ring]])]}
    (tmp_path / "areas.json").write_text(json.dumps(doc, indent=1))
    rows = {r.id: r for r in census.read_census(spark, str(tmp_path / "areas.json")).collect()}
    assert sorted(rows) == ["a", "c"] and rows["a"].population_density == 50.0 and rows["c"].population_density == float("inf")
    assert len(rows["c"].geom) == 2 and rows["a"].geom[0][0][1].lon == 1.0
    base = census.poi_table(spark)
    name = base.orderBy("poi_id").first().name
    extra = spark.createDataFrame([(7, name, "new", 1.0, 2.0), (8, name, "newer", 1.0, 2.0)], census.POI_SCHEMA)
    merged = census.poi_table(spark, extra)
    assert merged.count() == base.count() and merged.where(F.col("name") == name).first().team == "newer"
