"""Exact order statistics and histograms that do not gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def exact_percentiles(df: DataFrame, value: str, shares: dict[str, float],
                      keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated percentiles (PERCENTILE_CONT) per key, exact for any group size.

    Equal values are counted first. Each group is then cut into value slices at approximate
    quantiles, so a hot group is ranked by many tasks; the slices only steer the work, the ranks
    are exact. Without keys the cut points and slice totals are one row and at most
    ``SLICES + 1`` rows, which is what makes broadcasting them safe.
    """
    keys = list(keys)
    group = keys or ["__all"]
    src = df.where(F.col(value).isNotNull())
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    if not keys:
        src = src.withColumn("__all", F.lit(0))
    counted = src.groupBy(*group, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    marks = [i / SLICES for i in range(1, SLICES)]
    cuts = counted.groupBy(*group).agg(F.percentile_approx("__v", marks, 1000).alias("__cuts"))
    if not keys:
        cuts = F.broadcast(cuts)
    sliced = counted.join(cuts, group).select(
        *group, "__v", "__n",
        F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__slice"),
    )
    totals = sliced.groupBy(*group, "__slice").agg(F.sum("__n").alias("__m"))
    by_group = Window.partitionBy(*group)
    before = by_group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *group, "__slice",
        F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"),
        F.sum("__m").over(by_group).alias("__total"),
    )
    if not keys:
        totals = F.broadcast(totals)
    running = Window.partitionBy(*group, "__slice").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = (
        sliced.join(totals, [*group, "__slice"])
        .withColumn("__hi", F.col("__before") + F.sum("__n").over(running))
        .withColumn("__lo", F.col("__hi") - F.col("__n"))
    )
    picks, outs = [], []
    for name, share in shares.items():
        pos = F.lit(float(share)) * (F.col("__total") - 1)
        low = F.floor(pos)
        high = F.least(low + 1, F.col("__total") - 1)
        for end, rank in (("a", low), ("b", high)):
            hit = (F.col("__lo") <= rank) & (rank < F.col("__hi"))
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{name}_{end}"))
        picks.append(F.max(pos - low).alias(f"__{name}_f"))
        a, b = F.col(f"__{name}_a"), F.col(f"__{name}_b")
        outs.append((a + (b - a) * F.col(f"__{name}_f")).alias(name))
    return ranked.groupBy(*group).agg(*picks).select(*keys, *outs)


def percentile_value(df: DataFrame, value: str, share: float):
    """One percentile of a whole column as a scalar subquery."""
    return exact_percentiles(df, value, {"p": share}).scalar()


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width counts between the column's minimum and maximum, last bin closed; empty bins listed."""
    src = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v"))
    span = src.agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    span = span.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo = span.select("lo").scalar()
    hi = span.select("hi").scalar()
    at = F.least(F.floor((F.col("__v") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counts = src.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    # the bin list is `bins` rows long, whatever the input
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    return frame.join(counts, "bin", "left").select(
        "bin",
        (lo + width * F.col("bin")).alias("bin_start"),
        (lo + width * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
