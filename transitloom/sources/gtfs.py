"""Timetable files: read, prune, type, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitloom.functions import scalars as s

# ---- fixed values: files and the columns kept from each ------------------------------------
KEEP = {
    "agency": ["agency_id", "agency_name", "agency_url", "agency_timezone"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "routes": ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type"],
    "trips": ["route_id", "service_id", "trip_id", "direction_id", "shape_id"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
    "calendar": [
        "service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
        "start_date", "end_date",
    ],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence", "shape_dist_traveled"],
}
MISSING_TEXT = "nan"
# -------------------------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line; Spark plans this as a limit-one read."""
    first = spark.read.option("encoding", "UTF-8").csv(path, header=False).first()
    return [] if first is None else [(v or "").lstrip("﻿").strip() for v in first]


def read_gtfs(spark: SparkSession, path: str, line_breaks: bool = False) -> tuple[dict[str, DataFrame], list[str]]:
    """All timetable files under a folder as text columns, and the names of those missing.

    A quote within quotes is doubled. `line_breaks` allows quoted line ends, at the cost that a file is read by one task.
    """
    tables, missing = {}, []
    for name in KEEP:
        file = f"{path.rstrip('/')}/{name}.txt"
        if not _exists(spark, file):
            missing.append(name)
            continue
        schema = T.StructType([T.StructField(c, T.StringType()) for c in _header(spark, file)])
        tables[name] = spark.read.schema(schema).option("nullValue", MISSING_TEXT).option("escape", '"').option(
            "multiLine", line_breaks).csv(file, header=True, enforceSchema=True)
    return tables, missing


def column_report(df: DataFrame, keep: list[str]) -> dict[str, list[str]]:
    return {
        "missing": [c for c in keep if c not in df.columns],
        "extra": [c for c in df.columns if c not in keep],
    }


def prune_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    present = [c for c in keep if c in df.columns]
    if not present:
        raise ValueError("none of the wanted columns is present")
    return df.select(*present)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


_AS_IS = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_gtfs(tables: dict[str, DataFrame], path: str, backup_of: str | None = None) -> None:
    """Write every table as CSV below a new folder; missing values stay empty. Sources can be copied first."""
    base = path.rstrip("/")
    if backup_of is not None:
        spark = next(iter(tables.values())).sparkSession
        for name, df in read_gtfs(spark, backup_of)[0].items():
            df.write.mode("errorifexists").csv(f"{base}_backup/{name}.txt", **_AS_IS)
    for name, df in tables.items():
        df.write.mode("errorifexists").csv(f"{base}/{name}.txt", **_AS_IS)


# ---- typed tables -------------------------------------------------------------------------
def typed_stops(stops: DataFrame) -> DataFrame:
    return stops.withColumns({c: F.col(c).try_cast("double") for c in ("stop_lat", "stop_lon")})


def typed_stop_times(stop_times: DataFrame) -> DataFrame:
    """Sequence as integer, arrival as seconds of the service day."""
    return stop_times.withColumns({
        "stop_sequence": F.col("stop_sequence").try_cast("int"),
        "arrival_seconds": s.service_seconds(s.normalise_time("arrival_time")),
    })


def typed_shapes(shapes: DataFrame) -> DataFrame:
    return shapes.withColumns({
        "shape_pt_sequence": F.col("shape_pt_sequence").try_cast("int"),
        "shape_pt_lat": F.col("shape_pt_lat").try_cast("double"),
        "shape_pt_lon": F.col("shape_pt_lon").try_cast("double"),
    })


def typed_calendar(calendar: DataFrame) -> DataFrame:
    days = KEEP["calendar"][1:8]
    return calendar.withColumns({
        **{d: F.col(d).try_cast("int") for d in days},
        **{d: s.parse_service_date(d) for d in ("start_date", "end_date")},
    })


def typed_calendar_dates(calendar_dates: DataFrame) -> DataFrame:
    return calendar_dates.withColumns({
        "date": s.parse_service_date("date"), "exception_type": F.col("exception_type").try_cast("int"),
    })
