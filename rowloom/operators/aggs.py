"""Counts and places of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.order import OBS


def group_counts(data: DataFrame, column: str) -> DataFrame:
    """How often each value occurs; null and NaN are values, -0.0 is 0.0."""
    return data.groupBy(column).agg(F.count("*").alias("count"))


def group_indices(data: DataFrame, column: str) -> DataFrame:
    """The ascending observation numbers of each value, as an array: for values of few rows.

    A value with very many rows makes an array of as many; ``groupobs`` keeps them as rows.
    """
    return data.groupBy(column).agg(F.sort_array(F.collect_list(OBS)).alias("indices"))
