"""Complete calendars and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.functions.dates import period_end, period_index
from stratocast.operators.hierarchy import drop_null_keys, leaf_sum
from stratocast.operators.ids import attach_series_id


def date_bounds(df: DataFrame, ds: str = "ds") -> DataFrame:
    """One row: first and last date."""
    return df.agg(F.min(ds).alias("lo"), F.max(ds).alias("hi"))


def _first_end(lo, freq):
    return period_index(lo, freq)


def _last_end(hi, freq):
    """Index of the last period that ends on or before `hi`."""
    idx = period_index(hi, freq)
    return F.when(period_end(idx, freq) == hi, idx).otherwise(idx - 1)


def _indexes(first, last):
    """Integer sequence, empty when last < first (Spark's own would count down)."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def calendar(df: DataFrame, freq: str, ds: str = "ds") -> DataFrame:
    """All period ends between the panel's first and last date."""
    idx = _indexes(_first_end(F.col("lo"), freq), _last_end(F.col("hi"), freq))
    return date_bounds(df, ds).select(F.explode(idx).alias("i")).select(period_end(F.col("i"), freq).alias("ds"))


def fill_gaps(
    panel: DataFrame, keys: Sequence[str], freq: str, bounds: DataFrame | None = None, copy: Sequence[str] = ()
) -> DataFrame:
    """Insert every missing period end of the panel's date range with value 0, per series.

    Each row brings the gap before it and the last row also the tail: one window over the series, no grid
    and no join. Rows off the calendar stay. Columns in `copy` take the value of the series' last row.
    `bounds` (one row: lo, hi) replaces the panel's own range. Asking for the values along with the dates
    keeps the range subquery's plan equal to the panel's, so both read the same shuffle.
    """
    if bounds is None:
        bounds = panel.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"), F.count("y").alias("n"))
        bounds = bounds.filter("n >= 0")
    span = bounds.select(F.struct("lo", "hi")).scalar()
    y_type = panel.schema["y"].dataType
    series = Window.partitionBy(*keys).orderBy("ds")
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = panel.select(
        *keys,
        "ds",
        "y",
        *copy,
        F.lag("ds").over(series).alias("_prev"),
        F.lead("ds").over(series).alias("_next"),
        *[F.last(c).over(whole).alias(f"_last_{c}") for c in copy],
        span.alias("_span"),
    )
    prev_idx = period_index(F.col("_prev"), freq)
    first = F.when(F.col("_prev").isNull(), _first_end(F.col("_span.lo"), freq)).otherwise(
        F.when(period_end(prev_idx, freq) == F.col("_prev"), prev_idx + 1).otherwise(prev_idx)
    )
    own = period_index(F.col("ds"), freq)
    after = F.when(period_end(own, freq) == F.col("ds"), own + 1).otherwise(own)
    tail = F.when(F.col("_next").isNull(), _indexes(after, _last_end(F.col("_span.hi"), freq))).otherwise(
        F.array().cast("array<int>")
    )
    missing = F.concat(_indexes(first, own - 1), tail)
    zero = F.lit(0).cast(y_type)
    rows = F.concat(
        F.array(F.struct("ds", "y", *copy)),
        F.transform(
            missing,
            lambda i: F.struct(
                period_end(i, freq).alias("ds"), zero.alias("y"), *[F.col(f"_last_{c}").alias(c) for c in copy]
            ),
        ),
    )
    return row.select(*keys, F.inline(rows))


def filled_arrays(panel: DataFrame, keys: Sequence[str], freq: str, bounds: DataFrame) -> DataFrame:
    """One row per series, its gaps filled with 0 inside the row: `y` has the value of the row without a date, then one
    value for each period between the dates of `bounds` (one row: lo, hi), in which all dates have to lie. `dated` and
    `undated` tell whether there are rows with and without a date; without them the values are null.

    A series has at most one row per date. A date that is no period end is an error.
    """
    y_type = panel.select(F.sum("y")).schema[0].dataType
    own = period_index(F.col("ds"), freq)
    off = F.raise_error(F.lit(f"a date is no period end of frequency {freq}")).cast("int")
    at = F.when(F.col("ds").isNull(), 0).when(period_end(own, freq) == F.col("ds"), own - period_index(F.col("_span.lo"), freq) + 1).otherwise(off)
    cells = panel.withColumn("_span", bounds.select(F.struct("lo", "hi")).scalar())
    cells = cells.select(*keys, F.struct(at.alias("at"), F.col("y").cast(y_type).alias("y")).alias("_c"))
    span = bounds.select(F.coalesce(period_index(F.col("hi"), freq) - period_index(F.col("lo"), freq) + 1, F.lit(0))).scalar()
    rows = cells.groupBy(*keys).agg(F.sort_array(F.collect_list("_c")).alias("_c")).withColumn("_n", span)
    first, last = F.get("_c", F.lit(0)).getField("at"), F.try_element_at("_c", F.lit(-1)).getField("at")
    rows = rows.select(*keys, "_c", "_n", (last > 0).alias("dated"), (first == 0).alias("undated"), last.alias("_last"))
    zero, none = F.lit(0).cast(y_type), F.lit(None).cast(y_type)
    before = lambda i: F.coalesce(F.get("_c", i - 1).getField("at"), F.lit(0))
    filled = F.flatten(
        F.transform("_c", lambda c, i: F.concat(F.array_repeat(zero, c["at"] - before(i) - 1), F.array(c["y"])))
    )
    tail = F.array_repeat(F.when(F.col("dated"), zero), F.col("_n") - F.col("_last"))
    head = F.when(F.col("undated"), F.array().cast(T.ArrayType(y_type))).otherwise(F.array(none))
    return rows.select(*keys, "dated", "undated", F.concat(head, filled, tail).alias("y"))


def dated_arrays(filled: DataFrame, series: Sequence[str], freq: str, bounds: DataFrame) -> DataFrame:
    """`filled_arrays` or their sums as series: `ds` and `y` arrays in date order, a row without a date first."""
    idx = _indexes(_first_end(F.col("lo"), freq), _last_end(F.col("hi"), freq))
    dates = F.concat(F.array(F.lit(None).cast("date")), F.transform(idx, lambda i: period_end(i, freq)))
    rows = filled.withColumn("_ds", bounds.select(dates).scalar())
    start = F.when(F.col("undated"), 1).otherwise(2)
    n = F.when(F.col("dated"), F.size("y")).otherwise(1) - start + 1
    return rows.select(*series, F.slice("_ds", start, n).alias("ds"), F.slice("y", start, n).alias("y"))


def fill_gaps_levels(levels: DataFrame, keys: Sequence[str], freq: str, bounds: DataFrame | None = None) -> DataFrame:
    """The same on the long table of all levels, with one date range for all of them."""
    return fill_gaps(levels, ["level_id", *keys], freq, bounds)


def zero_fill(df: DataFrame, col: str = "y") -> DataFrame:
    return df.withColumn(col, F.coalesce(col, F.lit(0).cast(df.schema[col].dataType)))


def cutoff(df: DataFrame, upto=None, after=None, ds: str = "ds") -> DataFrame:
    """Upper bound inclusive, lower bound exclusive."""
    if upto is not None:
        df = df.filter(F.col(ds) <= F.lit(upto).cast("date"))
    if after is not None:
        df = df.filter(F.col(ds) > F.lit(after).cast("date"))
    return df


def prepare_panel(
    raw: DataFrame,
    keys: Sequence[str],
    freq: str,
    cutoff_date=None,
    fill_missing: bool = True,
    with_id: bool = True,
) -> DataFrame:
    """Cut off, sum to leaves, fill gaps, replace null values by 0, number the series."""
    if not keys:
        raise ValueError("a panel needs at least one key column")
    raw = drop_null_keys(cutoff(raw, cutoff_date), keys)
    panel = leaf_sum(raw, keys)
    if fill_missing:
        panel = zero_fill(fill_gaps(panel, keys, freq))
    if not with_id:
        return panel
    return attach_series_id(panel, keys, dim=raw).select("ts_id", "ds", "y", *keys)
