"""Replacement and retention of whole partitions of a plain Parquet folder.

These work on folders that batch writers fill (``append_sink``, the live views). A folder that a streaming file
sink writes keeps a log of its files; it must not be changed under the sink.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from transitloom.session import store_and_reload
from transitloom.sources.tables import DATE_COLUMN

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def partition_path(path: str, column: str, value: date | None) -> str:
    return f"{path.rstrip('/')}/{column}={NO_VALUE if value is None else value}"


def _empty_partition(schema_of: DataFrame, path: str, column: str, value: date | None) -> None:
    """Leave one file without rows in a partition; its old files are deleted by the same write."""
    schema_of.drop(column).limit(0).write.mode("overwrite").parquet(partition_path(path, column, value))


def replace_partitions(df: DataFrame, path: str, column: str, values: list[date | None]) -> int:
    """Give each listed partition of a folder the rows ``df`` has for it, also if it has none; returns the rows written.

    Rows of other partitions are not written. They are written once, by the tasks that make them, and counted on the way. The
    number of jobs is one, and one for each partition that is emptied.
    """
    values = list(dict.fromkeys(values))
    at = F.col(column)
    wanted = F.coalesce(at.isin([v for v in values if v is not None]), F.lit(None in values))
    seen = Observation()
    counts = [F.count_if(at.isNull() if v is None else at == F.lit(v)).alias(f"n{i}") for i, v in enumerate(values)]
    rows = df.where(wanted).observe(seen, F.count(F.lit(1)).alias("n"), *counts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    found = seen.get
    for i, value in enumerate(values):
        if not found[f"n{i}"]:
            _empty_partition(df, path, column, value)
    return int(found["n"])


def _delete(spark: SparkSession, path: str, dates: Column, doomed: Column, dry_run: bool) -> DataFrame:
    """Delete rows of the given dates: those that lose all rows are emptied, those that lose some are rewritten without them.

    A condition that is null keeps its row. Returns the rows deleted by date.
    """
    landed = spark.read.parquet(path)
    counted = landed.where(dates).groupBy(DATE_COLUMN).agg(F.count_if(doomed).alias("rows_to_delete"), F.count("*").alias("rows_held"))
    lost = store_and_reload(counted.where("rows_to_delete > 0"), "retained")
    if not dry_run:
        for value, n, held in lost.collect():
            if n == held:
                _empty_partition(landed, path, DATE_COLUMN, value)
            else:
                kept = landed.where((F.col(DATE_COLUMN) == F.lit(value)) & ~F.coalesce(doomed, F.lit(False)))
                store_and_reload(kept.drop(DATE_COLUMN), "boundary").write.mode("overwrite").parquet(partition_path(path, DATE_COLUMN, value))
        spark.catalog.refreshByPath(path)
    return lost.drop("rows_held")


def retain_landed_by_age(spark: SparkSession, path: str, ts: str, older_than: timedelta, now: datetime | None = None,
                         dry_run: bool = False) -> DataFrame:
    """Delete what is strictly older than the cutoff from a folder that ``append_sink`` has dated by ``ts``; a missing time is kept.

    Dates before the cutoff lose their files, of which only the times are read. The date of the cutoff is
    rewritten; later dates are not opened. A dry run only counts.
    """
    cutoff = F.lit((now or datetime.now(timezone.utc)) - older_than)
    return _delete(spark, path, F.col(DATE_COLUMN) <= F.to_date(cutoff), F.col(ts) < cutoff, dry_run)


def retain_landed_by_range(spark: SparkSession, path: str, ts: str, start: datetime, end: datetime, dry_run: bool = False) -> DataFrame:
    """Delete a closed range of times from a folder that ``append_sink`` has dated by ``ts``; only the dates at its ends are rewritten."""
    start, end = F.lit(start), F.lit(end)
    return _delete(spark, path, F.col(DATE_COLUMN).between(F.to_date(start), F.to_date(end)), F.col(ts).between(start, end), dry_run)


def truncate_landed(spark: SparkSession, path: str, confirm: bool = False) -> None:
    """Delete every row of a date-partitioned folder; the folder stays readable and can be appended to."""
    if not confirm:
        raise ValueError("pass confirm=True to drop every row")
    landed = spark.read.parquet(path)
    landed.limit(0).write.mode("overwrite").partitionBy(DATE_COLUMN).parquet(path)
    _empty_partition(landed, path, DATE_COLUMN, None)
    spark.catalog.refreshByPath(path)
