"""Sinks and table maintenance on Parquet folders."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitloom.operators.ordering import order_nulls
from transitloom.session import scratch_path, store_and_reload

DATE_COLUMN = "entity_date"


def append_sink(df: DataFrame, path: str, ts: str = "entity_timestamp") -> int:
    """Append rows to a folder partitioned by date; returns the row count of the same pass.

    The rebalance hint lets AQE size the files and split a date that holds most of the rows.
    """
    seen = Observation()
    dated = df.withColumn(DATE_COLUMN, F.to_date(ts)).observe(seen, F.count(F.lit(1)).alias("n"))
    dated.hint("rebalance", DATE_COLUMN).write.mode("append").partitionBy(DATE_COLUMN).parquet(path)
    return int(seen.get["n"])


def number_rows(df: DataFrame, keys: list[str], name: str = "gid") -> DataFrame:
    """Consecutive row numbers along an ordering, without a single-task window.

    The sorted rows are stored once with their place inside their partition; offsets come from one
    count per partition (as many rows as there were sort partitions).
    """
    spark = df.sparkSession
    staged = scratch_path(spark, "numbered")
    placed = order_nulls(df, *keys).withColumn("__place", F.monotonically_increasing_id())
    placed.write.mode("errorifexists").parquet(staged)
    rows = spark.read.parquet(staged).withColumn("__part", F.shiftrightunsigned("__place", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__part").agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__place") - F.shiftleft(F.col("__part"), 33)
    numbered = rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + inside + 1)
    return numbered.select(name, *df.columns)


def materialise(df: DataFrame, name: str, folder: str, keys: list[str] | None = None) -> tuple[DataFrame, int]:
    """Store a view (numbered along ``keys`` if given), register it under its name, return it and its size.

    Each call writes a folder of its own below the view's, and the name is switched when that is done: a failed write leaves the
    old view, and a view may be built from itself.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{name}/{uuid.uuid4().hex[:12]}"
    seen = Observation()
    out = df if keys is None else number_rows(df, keys)
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(path)
    stored = spark.read.schema(out.schema).parquet(path)
    stored.createOrReplaceTempView(name)
    return stored, int(seen.get["n"])


def table_stats(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def _kept(df: DataFrame, doomed: Column, dry_run: bool) -> DataFrame:
    if dry_run:
        return df.agg(F.count_if(doomed).alias("rows_to_delete"))
    return df.where(~F.coalesce(doomed, F.lit(False)))


def retain_by_age(df: DataFrame, ts: str, older_than: timedelta, now: datetime | None = None, dry_run: bool = False) -> DataFrame:
    """Rows not strictly older than the cutoff; a missing time is kept. A dry run only counts."""
    cutoff = (now or datetime.now(timezone.utc)) - older_than
    return _kept(df, F.col(ts) < F.lit(cutoff), dry_run)


def retain_by_range(df: DataFrame, ts: str, start: datetime, end: datetime, dry_run: bool = False) -> DataFrame:
    """Rows outside a closed range; a missing time is kept."""
    return _kept(df, F.col(ts).between(F.lit(start), F.lit(end)), dry_run)


def truncate(df: DataFrame, confirm: bool = False) -> DataFrame:
    if not confirm:
        raise ValueError("pass confirm=True to drop every row")
    return df.limit(0)


# ---- versioned keyed tables ---------------------------------------------------------------
BUCKET = "hash_bucket_"
BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """Complete versions of a table, and the highest number in use; one without its success marker is still being written or broken."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return [], 0
    done, highest = [], 0
    for item in fs.listStatus(base):
        label = item.getPath().getName()
        if label.startswith("version="):
            number = int(label.split("=")[1])
            highest = max(highest, number)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(item.getPath(), "_SUCCESS")):
                done.append(number)
    return sorted(done), highest


def _manifest(spark: SparkSession, path: str) -> tuple[dict[int, str | None], T.StructType, int] | None:
    """Of the newest version: the run that wrote each bucket, the schema, and the number of buckets.

    One row for each bucket, so as small as the table was laid out.
    """
    done, _ = _versions(spark, path)
    if not done:
        return None
    rows = spark.read.parquet(f"{path}/manifest/version={done[-1]:08d}").collect()
    return {r["bucket"]: r["run"] for r in rows}, T.StructType.fromJson(json.loads(rows[0]["schema"])), len(rows)


def _rows(spark: SparkSession, path: str, runs: dict[int, str | None], schema: T.StructType) -> DataFrame:
    """The rows of the given buckets with their bucket; only the folders that hold them are opened."""
    full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    held = [f"{path}/rows/run={run}/{BUCKET}={bucket}" for bucket, run in runs.items() if run]
    if not held:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/rows").parquet(*held).select(*full.names)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, old: dict[int, str | None], schema: T.StructType, touched: list[int]) -> int:
    """Write the next version: the new rows of the touched buckets, then the list of all buckets.

    The list is written last and makes the version visible. A second writer of the same version fails.
    """
    spark = rows.sparkSession
    run = uuid.uuid4().hex[:12]
    rows.hint("rebalance", BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{path}/rows/run={run}")
    held = {r[0] for r in spark.read.schema(rows.schema).parquet(f"{path}/rows/run={run}").select(BUCKET).distinct().collect()}
    runs = {b: (run if b in held else None) if b in touched else r for b, r in old.items()}
    number = _versions(spark, path)[1] + 1
    told = [(b, r, schema.json()) for b, r in sorted(runs.items())]
    spark.createDataFrame(told, "bucket int, run string, schema string").coalesce(1).write.mode("errorifexists").parquet(
        f"{path}/manifest/version={number:08d}")
    return number


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """Current state of a keyed table; none before its first version."""
    found = _manifest(spark, path)
    return None if found is None else _rows(spark, path, found[0], found[1]).drop(BUCKET)


def write_snapshot(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Write a whole keyed table as its next version, laid out in hash buckets of the key."""
    empty = dict.fromkeys(range(buckets))
    return _write(df.withColumn(BUCKET, _bucket(keys, buckets)), path, empty, df.schema, list(empty))


def merge_snapshot(fresh: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame],
                   buckets: int = BUCKETS) -> int:
    """Merge new rows into a keyed table, reading and rewriting only the buckets of their keys.

    A key's bucket never changes, so the old rows it replaces are in the same one: neither the other
    buckets nor superseded versions are opened. A new table gets ``buckets`` of them, an old one keeps its own.
    """
    spark = fresh.sparkSession
    found = _manifest(spark, path)
    runs, schema, buckets = found or (dict.fromkeys(range(buckets)), fresh.schema, buckets)
    placed = store_and_reload(fresh.withColumn(BUCKET, _bucket(keys, buckets)), "merge")
    touched = [r[0] for r in placed.select(BUCKET).distinct().collect()]
    if not touched:
        return max(_versions(spark, path)[0], default=0)
    current = _rows(spark, path, {b: runs[b] for b in touched}, schema).drop(BUCKET)
    merged = merge(current, placed.drop(BUCKET)).select(*schema.names)
    return _write(merged.withColumn(BUCKET, _bucket(keys, buckets)), path, runs, schema, touched)


def retain_snapshot(spark: SparkSession, path: str, doomed: Column, by: str = "service_date", dry_run: bool = False) -> DataFrame:
    """Delete the rows of a stored keyed table for which a condition holds; returns the rows deleted by the values of a column.

    Buckets that lose rows are rewritten, the others are read but not written. A condition that is null keeps
    its row. A dry run only counts.
    """
    found = _manifest(spark, path)
    if found is None:
        raise ValueError(f"no table at {path}")
    runs, schema, _ = found
    gone = F.coalesce(doomed, F.lit(False))
    lost = store_and_reload(_rows(spark, path, runs, schema).where(gone).groupBy(by, BUCKET).agg(F.count("*").alias("n")), "retained")
    touched = [r[0] for r in lost.select(BUCKET).distinct().collect()]
    if not dry_run and touched:
        _write(_rows(spark, path, {b: runs[b] for b in touched}, schema).where(~gone), path, runs, schema, touched)
    return lost.groupBy(by).agg(F.sum("n").alias("rows_to_delete"))


def export_summary(summaries: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Write summaries as CSV folders, each in its order."""
    for name, (df, keys) in summaries.items():
        order_nulls(df, *keys).write.mode("overwrite").csv(f"{path.rstrip('/')}/{name}", header=True)
