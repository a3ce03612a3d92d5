"""Joins of facts with their dimensions and of forecasts with actuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratocast.operators.hierarchy import drop_null_keys
from stratocast.operators.models import null_safe_on


def join_calendar(fact: DataFrame, cal: DataFrame, on: str = "date") -> DataFrame:
    """Attributes of a day. The planner broadcasts the calendar while its measured size allows it."""
    return fact.join(cal, on, "left")


def join_prices(fact: DataFrame, prices: DataFrame, on: Sequence[str], quantity: str, price: str, name: str) -> DataFrame:
    """Prices grow with the data: no hint. Rows without a price get null revenue, which sums ignore."""
    out = fact.join(prices.select(*on, price), list(on), "left")
    return out.withColumn(name, F.col(quantity).cast("double") * F.col(price))


def keep_horizon_dates(df: DataFrame, forecast: DataFrame, ds: str = "ds") -> DataFrame:
    """Rows whose date was forecast."""
    return df.join(forecast.select(ds).distinct(), ds, "left_semi")


def lump_rare_series(panel: DataFrame, keys: Sequence[str], min_rows: int = 1000, y: str = "y", ds: str = "ds") -> DataFrame:
    """Series with fewer than min_rows rows are merged: their keys become `<key>Other`, values add up.

    The panel is one row per series and date, so a count per series joined back is enough.
    """
    n = panel.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = panel.alias("p").join(n.alias("n"), null_safe_on(keys, "p", "n"))
    rare = F.col("_n") < min_rows
    out = both.select(
        *[F.when(rare, F.lit(f"{k}Other")).otherwise(F.col(f"p.{k}")).alias(k) for k in keys],
        F.col(f"p.{ds}").alias(ds), F.col(f"p.{y}").alias(y),
    )
    return out.groupBy(*keys, ds).agg(F.sum(y).alias(y))


def ffill_keys(df: DataFrame, cols: Sequence[str], series: Sequence[str], ds: str = "ds") -> DataFrame:
    """Last non-null value so far within the series. A series is at most one calendar long."""
    w = Window.partitionBy(*series).orderBy(ds).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(c, ignorenulls=True).over(w) for c in cols}
    return df.withColumns(filled)


def merge_methods(frames: dict[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer match of any number of one-value tables on the same unique keys.

    `frames` maps output column to a table `on + value`; the value column is the last one. Rows are stacked
    and grouped, which costs one shuffle instead of one per join and lets null keys match.
    """
    out = None
    for name, df in frames.items():
        value = [c for c in df.columns if c not in on][-1]
        part = df.select(*on, F.lit(name).alias("_m"), F.col(value).cast("decimal(38,6)").alias("_v"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*on).agg(*[F.max(F.when(F.col("_m") == n, F.col("_v"))).alias(n) for n in frames])


def duplicate_free_dim(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Static attributes: one row per key tuple."""
    return drop_null_keys(df, keys).select(*keys).distinct()
