"""The main steps on a panel whose number of series grows with the data: suppliers, return flags, line states."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratocast.operators import calendar, hierarchy, ids, models, reconcile
from stratocast.operators.folds import fold_table
from stratocast.plans import inputs
from stratocast.plans import reference_sql as ref
from stratocast.plans.registry import query

KEYS = list(inputs.WIDE.keys)
SERIES = ["level_id", *KEYS]
K, S = ", ".join(KEYS), ", ".join(SERIES)
H = 12
PANEL = "WITH " + ref.panel(KEYS, ref.WIDE_ROWS)
MODELS = ["SeasonalNaive", "SeasonalAverage"]


def leaf(spark, sf_dir):
    return hierarchy.leaf_sum(inputs.wide_rows(spark, sf_dir), KEYS)


def bounds(spark, sf_dir):
    return calendar.date_bounds(inputs.wide_rows(spark, sf_dir))


def arrays(spark, sf_dir):
    """Every series of every level as one row. Gaps are filled and levels summed inside rows: only leaf values move."""
    span = bounds(spark, sf_dir)
    leaves = calendar.filled_arrays(hierarchy.drop_null_keys(leaf(spark, sf_dir), KEYS), KEYS, "ME", span)
    return calendar.dated_arrays(hierarchy.cube_arrays(leaves, KEYS), SERIES, "ME", span)


def levels(spark, sf_dir):
    return arrays(spark, sf_dir).select(*SERIES, F.inline(F.arrays_zip("ds", "y")))


@query("wide_fill_gaps", f"{PANEL} SELECT {K}, ds, CAST(y AS DOUBLE) AS y FROM panel")
def _(spark, sf_dir):
    return calendar.fill_gaps(leaf(spark, sf_dir), KEYS, "ME").select(*KEYS, "ds", "y")


@query("wide_cube_levels", f"{PANEL} SELECT {S}, ds, CAST(y AS DOUBLE) AS y FROM levels")
def _(spark, sf_dir):
    return levels(spark, sf_dir).select(*SERIES, "ds", "y")


@query("wide_series_id", f"WITH {ref.WIDE_ROWS} SELECT CAST(row_number() OVER (ORDER BY {K}) AS INTEGER) AS ts_id, {K} FROM (SELECT DISTINCT {K} FROM rows_)")
def _(spark, sf_dir):
    return ids.dense_ids(inputs.wide_rows(spark, sf_dir), KEYS).select("ts_id", *KEYS)


@query(
    "wide_backtest",
    f"""{PANEL}, {ref.fold_forecasts(KEYS, 12, H, H, MODELS)}
    SELECT model, fold, {S}, ds, CAST(y AS DOUBLE) AS y, CAST(pred AS DOUBLE) AS pred FROM bt""",
    ordered=True,
)
def _(spark, sf_dir):
    dates = calendar.calendar(inputs.wide_rows(spark, sf_dir), "ME")  # every series has all of them
    out = models.backtest_levels(arrays(spark, sf_dir), SERIES, fold_table(dates, H, skip_last=H), MODELS, H, 12)
    return out.select("model", "fold", *SERIES, "ds", "y", "pred")


@query(
    "wide_bottom_up",
    f"""{PANEL}, {ref.folds(H, H)}, {ref.horizon(KEYS, 12, H, H, ["SeasonalAverage"])}
    SELECT CAST(grouping({K}) AS INTEGER) AS level_id, {K}, ds, CAST(sum(pred) AS DOUBLE) AS pred FROM fc WHERE level_id = 0 GROUP BY ds, CUBE({K})""",
)
def _(spark, sf_dir):
    fc = models.create_forecasts(arrays(spark, sf_dir), SERIES, ["SeasonalAverage"], H, "ME", 12, H)
    return reconcile.bottom_up(fc, KEYS, ["model"]).select(*SERIES, "ds", "pred")
