"""Train/test splits and expanding-window folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: share of the training periods used for validation.
VALIDATION_SHARE = 0.45


def flag_last_n(df: DataFrame, series: Sequence[str], n: int, ds: str = "ds") -> DataFrame:
    """is_test marks the last n rows of each series. A series has at most one row per calendar period."""
    w = Window.partitionBy(*series).orderBy(F.col(ds).desc())
    return df.withColumn("is_test", F.row_number().over(w) <= n)


def split_last_n(df: DataFrame, series: Sequence[str], n: int, ds: str = "ds") -> tuple[DataFrame, DataFrame]:
    """(train, test): both read the same flag, so no anti join is needed."""
    flagged = flag_last_n(df, series, n, ds)
    return flagged.filter(~F.col("is_test")).drop("is_test"), flagged.filter("is_test").drop("is_test")


def fold_count(n_train: Column, fold_length: int, share: float = VALIDATION_SHARE) -> Column:
    return F.floor(n_train * F.lit(share) / fold_length).cast("int")


def fold_table(
    dates: DataFrame, fold_length: int, share: float = VALIDATION_SHARE, n_splits: int | None = None, skip_last: int = 0
) -> DataFrame:
    """Expanding folds over the distinct dates of the top series: fold, cutoff_ds, test_from, test_to, n_train.

    `skip_last` leaves out the test period. The dates of one calendar fit in one row.
    """
    d = dates.select("ds").distinct().agg(F.sort_array(F.collect_list("ds")).alias("ds"))
    if skip_last:
        d = d.select(F.slice("ds", 1, F.greatest(F.size("ds") - skip_last, F.lit(0))).alias("ds"))
    n = F.size("ds")
    k = fold_count(n, fold_length, share) if n_splits is None else F.lit(n_splits)
    d = d.select("ds", n.alias("n"), k.alias("k")).filter("k > 0")
    d = d.select("ds", "n", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("fold"))
    start = F.col("n") - (F.col("k") - F.col("fold") + 1) * fold_length
    return d.select(
        "fold",
        F.try_element_at("ds", start).alias("cutoff_ds"),
        F.try_element_at("ds", start + 1).alias("test_from"),
        F.try_element_at("ds", start + fold_length).alias("test_to"),
        start.alias("n_train"),
    ).filter("cutoff_ds is not null")


def fold_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Every panel row once per fold that uses it, marked train or test. Folds are a handful of rows and
    ride along as an array, so this is a map over the panel."""
    spans = folds.agg(F.collect_list(F.struct("fold", "cutoff_ds", "test_from", "test_to")).alias("f"))
    wide = panel.withColumn("_folds", spans.select("f").scalar())
    return (
        wide.select(*panel.columns, F.inline("_folds"))
        .filter(F.col("ds") <= F.col("test_to"))
        .select(*panel.columns, "fold", (F.col("ds") >= F.col("test_from")).alias("is_test"))
    )


def last_dates(df: DataFrame, h: int, ds: str = "ds") -> DataFrame:
    """The last h distinct dates."""
    return df.select(ds).distinct().orderBy(F.desc(ds)).limit(h)


def naive_scale(train: DataFrame, series: Sequence[str], y: str = "y", ds: str = "ds") -> DataFrame:
    """Mean absolute and mean squared one-step difference per series: denominators of the scaled errors."""
    w = Window.partitionBy(*series).orderBy(ds)
    diff = train.select(*series, (F.col(y) - F.lag(y).over(w)).cast("double").alias("d"))
    return diff.groupBy(*series).agg(F.avg(F.abs("d")).alias("mae_scale"), F.avg(F.col("d") * F.col("d")).alias("mse_scale"))
