"""Counts that describe a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series_counts(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    return panel.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def panel_profile(panel: DataFrame, keys: Sequence[str], ds: str = "ds") -> DataFrame:
    """First and last date, number of series, longest series in distinct dates, rows.

    Distinct (series, date) pairs come from a partial aggregation, so a hot series is reduced before the
    shuffle; the rest is sums over them.
    """
    pairs = panel.groupBy(*keys, ds).agg(F.count("*").alias("n"))
    per = pairs.groupBy(*keys).agg(
        F.min(ds).alias("lo"), F.max(ds).alias("hi"), F.count(ds).alias("dates"), F.sum("n").alias("n")
    )
    return per.agg(
        F.min("lo").alias("min_date"),
        F.max("hi").alias("max_date"),
        F.count("*").alias("n_series"),
        F.max("dates").alias("longest_series"),
        F.sum("n").alias("n_rows"),
    )


def missing_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows and missing values per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_missing"))


def train_test_bounds(flagged: DataFrame, ds: str = "ds") -> DataFrame:
    """Latest training and test date."""
    test = F.col("is_test")
    return flagged.agg(F.max(F.when(~test, F.col(ds))).alias("train_end"), F.max(F.when(test, F.col(ds))).alias("test_end"))
