"""Expensive column work once for each distinct value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once_per_value(df: DataFrame, column: str, work: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """df with the columns that work adds to a table of the distinct values of column.

    The distinct values are found with partial aggregation and joined back by
    value; the plan decides whether to broadcast them by their measured size. A
    null value takes part like any other.
    """
    key = f"_{column}_value"
    values = work(df.select(F.col(column).alias(key)).distinct(), key)
    return df.join(values, F.col(column).eqNullSafe(F.col(key)), "left").drop(key)
