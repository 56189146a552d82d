"""Neighbour lookups that split a long group over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliced_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column,
               carry: dict[str, str]) -> DataFrame:
    """LAG of some columns per key, exact, without one task per key.

    ``slice_by`` must not decrease along ``order`` (a day, an hour, a block of numbers). Rows are
    windowed per (key, slice). Only the first row of a slice needs the slice before: its value
    comes from a table with one closing row per (key, slice).
    """
    # every column takes part, so that both branches need the same input and share its shuffle: ``df`` is not made again for the
    # closing rows, and the packed copy of a row is not moved with it
    cols = list(dict.fromkeys([*order, *carry, *[c for c in df.columns if c not in keys]]))
    rows = df.withColumn("__slice", slice_by).repartition(*keys, "__slice")
    here = Window.partitionBy(*keys, "__slice").orderBy(*order)
    closing = (
        rows.groupBy(*keys, "__slice")
        .agg(F.max(F.struct(*cols)).alias("__last"))
        .withColumn("__before", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__slice")))
        .where(F.col("__before").isNotNull())
        .select(*keys, "__slice", "__before")
    )
    packed = F.struct(*cols)
    joined = (
        rows.withColumn("__near", F.lag(packed).over(here))
        .join(closing, [*keys, "__slice"], "left")
        .withColumn("__prev", F.coalesce("__near", "__before"))
    )
    return joined.select(
        *df.columns, *[F.col(f"__prev.{src}").alias(out) for src, out in carry.items()]
    )
