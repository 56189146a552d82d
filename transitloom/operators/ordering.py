"""Ordering with the NULL placement of the source queries, and top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_key(name: str) -> Column:
    """``col``, ``-col`` (descending, NULL first) or ``-col!`` (descending, NULL last)."""
    if name.startswith("-"):
        return F.col(name[1:-1]).desc_nulls_last() if name.endswith("!") else F.col(name[1:]).desc_nulls_first()
    return F.col(name).asc_nulls_last()


def order_nulls(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*[order_key(k) for k in keys])


def top_n(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """First n rows of an ordering; give tie keys for a stable result."""
    return order_nulls(df, *keys).limit(n)


def tail_n(df: DataFrame, n: int, key: str, *ties: str) -> DataFrame:
    """Last n rows of an ascending ordering, shown ascending."""
    return top_n(df.where(F.col(key).isNotNull()), n, f"-{key}!", *ties).orderBy(order_key(key), *map(order_key, ties))
