"""Forecast accuracy of the top series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Metric names.
METRICS = ("MASE", "WAPE", "RMSSE", "SMAPE")

METHODS = (
    "base",
    "equal_weights_pred",
    "BottomUp",
    "MinTrace_method-wls_struct",
    "MinTrace_method-ols",
    "weighted_pred",
)


def metric_slices(df: DataFrame, by: Sequence[str], test_period: int, future_periods: int) -> DataFrame:
    """part = train | test | null: the last `future_periods` rows are the horizon, its first `test_period`
    rows have known actuals. One series per group, so a group is at most one calendar."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ds")))
    part = F.when(back > future_periods, "train").when(back > future_periods - test_period, "test")
    return df.withColumn("part", part)


def errors(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Sums from which every metric is a ratio; rows without actual or prediction do not count."""
    a, p = F.col(y).cast("double"), F.col(pred).cast("double")
    e = F.abs(F.col(y) - F.col(pred))
    scale = F.greatest(F.abs(a) + F.abs(p), F.lit(2.220446049250313e-16))
    return df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(e).cast("double").alias("abs_err"),
        F.sum(F.pow(e.cast("double"), F.lit(2.0))).alias("sq_err"),
        F.sum(2 * e.cast("double") / scale).alias("sym_err"),
        F.sum(F.abs(F.col(y))).cast("double").alias("abs_y"),
    )


def metric_columns(df: DataFrame) -> DataFrame:
    """errors() joined with naive_scale() to one column per metric; a zero denominator gives null."""
    return (
        df.withColumn("mae", F.col("abs_err") / F.col("n"))
        .withColumn("MASE", F.try_divide(F.col("mae"), F.col("mae_scale")))
        .withColumn("WAPE", F.try_divide(F.col("abs_err"), F.col("abs_y")))
        .withColumn("RMSSE", F.sqrt(F.try_divide(F.col("sq_err") / F.col("n"), F.col("mse_scale"))))
        .withColumn("SMAPE", F.col("sym_err") / F.col("n"))
    )


def scale_columns(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Naive in-sample scale of the train part of each group."""
    w = Window.partitionBy(*by).orderBy("ds")
    diff = df.filter("part = 'train'").select(*by, (F.col("y") - F.lag("y").over(w)).cast("double").alias("d"))
    return diff.groupBy(*by).agg(
        F.avg(F.abs("d")).alias("mae_scale"), F.avg(F.col("d") * F.col("d")).alias("mse_scale")
    )


def score(
    results: DataFrame, by: Sequence[str], methods: Sequence[str], test_period: int, future_periods: int,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """by, method, metric, value for a table by, ds, y, <one column per method> holding the top series of
    every experiment with its whole history."""
    for m in metrics:
        if m not in METRICS:
            raise ValueError(f"unknown metric {m!r}; use one of {METRICS}")
    parts = metric_slices(results, by, test_period, future_periods)
    long = parts.filter("part = 'test'").select(
        *by, "y", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"`{m}`").alias("pred")) for m in methods]))
    )
    err = errors(long, [*by, "method"])
    # one row per experiment on either side
    both = err.join(scale_columns(parts, by), list(by))
    wide = metric_columns(both)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return wide.select(*by, "method", F.inline(pairs))


def metrics_table(
    results: DataFrame, by: Sequence[str], test_period: int, future_periods: int, private: Sequence[str] = (),
    methods: Sequence[str] = METHODS, metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """The table that reports read. `by` holds the experiment columns: dataset, model, forecast_method,
    time_limit, optim_method and optionally elapsed_time."""
    out = score(results, by, methods, test_period, future_periods, metrics)
    kind = F.when(F.col("dataset").isin(list(private)), "private").otherwise("public") if private else F.lit("public")
    elapsed = F.col("elapsed_time") if "elapsed_time" in by else F.lit(None).cast("double")
    label = [F.col(c).cast("string") for c in ("model", "forecast_method", "time_limit", "optim_method")]
    return out.select(
        F.concat_ws("_", *label).alias("Model"), "optim_method", "forecast_method",
        F.col("model").alias("forecast_model"), elapsed.alias("elapsed_time"), "method", "metric", "dataset",
        kind.alias("dataset_type"), "time_limit", "value",
    )
