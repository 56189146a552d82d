"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on. The cluster keeps its own values for memory, cores
# and shuffle partitions; AQE sizes and splits shuffle partitions at run time.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows that lie by trip meet others by trip and place without being moved again
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}
# Used where the session does not say otherwise. Shuffles start in many partitions, however few the cluster sets, and AQE joins them to
# pieces that a task sorts in memory, several at once: what spills is moved twice and grows faster than the input. Up to 200 of them
# are written without a sort; a session that sets more for a larger input gets as many, and a task then sorts what it reads: files are
# read in pieces of which the rows, many times larger than the file, fit its memory.
START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
LEAST_START = 200
SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.parquet.compression.codec": "zstd",
}


_started: dict[str, str] = {}


def _set_start(spark: SparkSession) -> None:
    """Partitions that shuffles start in; a value that is not from here is the session's own and is kept."""
    app, have = spark.sparkContext.applicationId, spark.conf.get(START, None)
    if have is None or have == _started.get(app):
        _started[app] = str(max(LEAST_START, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        spark.conf.set(START, _started[app])


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in SIZES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    _set_start(spark)
    return spark


def local_session(cores: int | str = 8, name: str = "transitloom", shared: str | None = None) -> SparkSession:
    """A single-JVM session for tests and the bench; ``shared`` is its folder for staged data."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in (REQUIRED | ({"spark.checkpoint.dir": shared} if shared else {})).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder the session names in spark.checkpoint.dir.

    Executors must see what is written here, so a machine-local folder is only used for
    a local master that names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = os.path.join(tempfile.gettempdir(), "transitloom-scratch")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def store_and_reload(df, label: str):
    """Write a frame to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
