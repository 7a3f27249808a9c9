"""Sorted and first-or-last results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_output(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total order of a final result; within a pipeline it only costs a shuffle."""
    return df.orderBy(*keys)


def first_by(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Values of `cols` in each key's first row along `order`."""
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in cols], F.min(order).alias(order))


def last_by(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Values of `cols` in each key's last row along `order`."""
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in cols], F.max(order).alias(order))


def top_rows(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first n rows of a total order, for display."""
    return df.orderBy(*keys).limit(n)
