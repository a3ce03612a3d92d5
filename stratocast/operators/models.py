"""Forecasting models as column expressions.

A series is one row with its values as an array ordered by date. A model turns the history array into an
array of predictions, so back-testing any number of folds, models and series is a map after the one
shuffle that builds the arrays. Simple models are JVM expressions; the others are numpy kernels that get
Arrow batches of many series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.functions.dates import period_end, period_index
from stratocast.operators import kernels, searched
from stratocast.operators.hierarchy import collapse_forecast

# Predictions are kept as exact decimals: sums over nodes do not depend on the order of tasks.
PRED_TYPE = "decimal(28,6)"


@dataclass(frozen=True)
class Model:
    """`predict(history, h, season)` gives an array column of h predictions. `tier` orders models by cost."""

    name: str
    tier: int
    predict: Callable[[Column, int, int], Column]


MODELS: dict[str, Model] = {}


def register_model(name: str, kernel: Callable[[np.ndarray, int, int], np.ndarray], tier: int = 2) -> Model:
    """Add a user model: `kernel(y, h, season)` maps an (n_series, n_periods) array to (n_series, h)."""

    def predict(hist: Column, h: int, m: int) -> Column:
        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for y in batches:
                yield _by_length(y, h, m, kernel)

        return run(hist.cast("array<double>"))

    MODELS[name] = Model(name, tier, predict)
    return MODELS[name]


def _by_length(y: pd.Series, h: int, m: int, kernel) -> pd.Series:
    """Series of equal length go through the kernel together."""
    out = pd.Series([None] * len(y), index=y.index, dtype=object)
    for n, part in y.groupby(y.map(lambda v: 0 if v is None else len(v))):
        if n:
            pred = kernel(np.stack(part.to_list()).astype(float), h, m)
            for i, row in zip(part.index, pred):
                out[i] = row
    return out


# ---- JVM models. Sums are taken in the type of the values, so exact types stay exact until one division. ----


def _sum_type(el: T.DataType) -> T.DataType:
    return T.DecimalType(38, el.scale) if isinstance(el, T.DecimalType) else T.DoubleType()


def _sum(arr: Column, el: T.DataType) -> Column:
    kind = _sum_type(el)
    return F.aggregate(arr, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind)).cast("double")


def _mean(arr: Column, el: T.DataType) -> Column:
    return _sum(arr, el) / F.nullif(F.size(arr), F.lit(0))


def _steps(h: int) -> Column:
    return F.sequence(F.lit(1), F.lit(h))


def _back(s: Column, m: int) -> Column:
    """How many periods before the last one the youngest value with the season position of step s lies."""
    return (F.lit(m) - s % m) % m


def _naive(hist, h, m, el):
    return F.transform(_steps(h), lambda s: F.try_element_at(hist, F.lit(-1)).cast("double"))


def _zero(hist, h, m, el):
    return F.transform(_steps(h), lambda s: F.lit(0.0))


def _average(hist, h, m, el):
    return F.array_repeat(_mean(hist, el), h)


def _seasonal_naive(hist, h, m, el):
    return F.transform(_steps(h), lambda s: F.try_element_at(hist, -1 - _back(s, m)).cast("double"))


def _seasonal_average(hist, h, m, el):
    # one mean per season position, of the values at its places alone, then repeated along the horizon
    kind = _sum_type(el)

    def mean(s: Column) -> Column:
        last = F.size(hist) - _back(s, m)
        places = F.when(last > 0, F.sequence((last - 1) % m + 1, last, F.lit(m))).otherwise(F.array().cast("array<int>"))
        total = F.aggregate(places, F.lit(0).cast(kind), lambda a, i: (a + F.try_element_at(hist, i)).cast(kind))
        return F.when(last > 0, total.cast("double") / F.floor((last - 1) / m + 1))

    one = F.transform(F.sequence(F.lit(1), F.lit(min(h, m))), mean)
    return F.slice(F.flatten(F.array_repeat(one, -(-h // m))), 1, h)


JVM_MODELS = {
    "Naive": _naive,
    "Zero": _zero,
    "Average": _average,
    "SeasonalNaive": _seasonal_naive,
    "SeasonalAverage": _seasonal_average,
}
BASELINES = tuple(JVM_MODELS)

for _name, _kernel, _tier in (
    ("Theta", kernels.theta, 2),
    ("CrostonSBA", kernels.croston_sba, 2),
    ("ADIDA", kernels.adida, 2),
    ("IMAPA", kernels.imapa, 2),
    ("HoltWinters", searched.holt_winters, 2),
    ("AutoETS", searched.auto_ets, 3),
    ("AutoARIMA", searched.auto_arima, 3),
):
    register_model(_name, _kernel, _tier)


def predict(model: str, hist: Column, h: int, season: int, el: T.DataType) -> Column:
    """Array of h predictions of `model` for a history array with elements of type `el`."""
    if model in JVM_MODELS:
        out = JVM_MODELS[model](hist, h, season, el)
    elif model in MODELS:
        out = MODELS[model].predict(hist, h, season)
    else:
        raise ValueError(f"unknown model {model!r}; known: {sorted([*JVM_MODELS, *MODELS])}")
    return out.cast(f"array<{PRED_TYPE}>")


def model_table(spark: SparkSession) -> DataFrame:
    """Registry with cost tiers: 1 closed form, 2 one pass, 3 search."""
    rows = [(n, 1) for n in JVM_MODELS] + [(m.name, m.tier) for m in MODELS.values()]
    return spark.createDataFrame(rows, "model string, tier int")


def model_filter(models: DataFrame, include=None, exclude=None, max_tier: int | None = None) -> DataFrame:
    if include:
        models = models.filter(F.col("model").isin([include] if isinstance(include, str) else list(include)))
    if exclude:
        models = models.filter(~F.col("model").isin([exclude] if isinstance(exclude, str) else list(exclude)))
    if max_tier is not None:
        models = models.filter(F.col("tier") <= max_tier)
    return models


def model_names(include=None, exclude=None, max_tier: int | None = None) -> list[str]:
    """The same choice as a driver-side list, for building plans."""
    tiers = {**{n: 1 for n in JVM_MODELS}, **{m.name: m.tier for m in MODELS.values()}}
    include = [include] if isinstance(include, str) else include
    exclude = [exclude] if isinstance(exclude, str) else (exclude or [])
    for n in [*(include or []), *exclude]:
        if n not in tiers:
            raise ValueError(f"unknown model {n!r}")
    return [
        n
        for n, t in tiers.items()
        if (not include or n in include) and n not in exclude and (max_tier is None or t <= max_tier)
    ]


# ---- series arrays, back-test, horizon ----


def series_arrays(levels: DataFrame, series: Sequence[str]) -> DataFrame:
    """One row per series: `ds` and `y` arrays in date order. A row holds at most one calendar."""
    pts = F.array_sort(F.collect_list(F.struct("ds", "y")))
    return levels.groupBy(*series).agg(pts.alias("_p")).select(*series, F.col("_p.ds").alias("ds"), F.col("_p.y").alias("y"))


def hold_out(arrays: DataFrame, series: Sequence[str], n: int) -> DataFrame:
    """History without the last n periods, which go to ds_test / y_test."""
    size = F.size("ds")
    train = F.greatest(size - n, F.lit(0))
    return arrays.select(
        *series,
        F.slice("ds", 1, train).alias("ds"),
        F.slice("y", 1, train).alias("y"),
        F.slice("ds", train + 1, n).alias("ds_test"),
        F.slice("y", train + 1, n).alias("y_test"),
    )


def _element(arrays: DataFrame) -> T.DataType:
    return arrays.schema["y"].dataType.elementType


def fold_histories(arrays: DataFrame, series: Sequence[str], folds: DataFrame) -> DataFrame:
    """One row per series and fold: `hist` up to the cutoff, `ds` and `y` of the test part. Dates are sorted,
    so both are slices; the folds are a handful of rows and ride along as an array."""
    spans = folds.agg(F.collect_list(F.struct("fold", "cutoff_ds", "test_to")).alias("f")).select("f").scalar()
    f = arrays.withColumn("_folds", spans).select(*series, "ds", "y", F.inline("_folds"))
    f = f.withColumn("_n", F.size(F.filter("ds", lambda d: d <= F.col("cutoff_ds"))))
    f = f.withColumn("_t", F.size(F.filter("ds", lambda d: d <= F.col("test_to"))) - F.col("_n"))
    return f.filter("_n > 0 and _t > 0").select(
        *series,
        "fold",
        F.slice("y", 1, F.col("_n")).alias("hist"),
        F.slice("ds", F.col("_n") + 1, F.col("_t")).alias("ds"),
        F.slice("y", F.col("_n") + 1, F.col("_t")).alias("y"),
    )


def backtest_levels(
    arrays: DataFrame, series: Sequence[str], folds: DataFrame, models: Sequence[str], fold_length: int, season: int
) -> DataFrame:
    """Out-of-fold predictions of every model for every series: model, fold, series, ds, y, pred."""
    el = _element(arrays)
    f = dealt(fold_histories(arrays, series, folds), models, [*series, "fold"])
    f = f.select(*series, "fold", "ds", "y", *_preds(models, F.col("hist"), fold_length, season, el))
    return _explode_models(f, [*series, "fold"], models, ["ds", "y"])


def dealt(histories: DataFrame, models: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Histories spread evenly over tasks if a model searches: that costs far more than one more shuffle of them, and
    small tables would else be searched by one task."""
    if all(m not in MODELS or MODELS[m].tier < 3 for m in models):
        return histories
    return histories.repartition(int(histories.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def searched_rows(histories: DataFrame, series: Sequence[str], hist: str, model: str, h: int, season: int) -> DataFrame:
    """(series, pred): a search as rows of (series, candidate), dealt over tasks, the best candidate by `min_by`. The same
    forecasts as the model's own, for few long series, of which a batch would hold a task for long."""
    @F.pandas_udf("struct<score double, pred array<double>>")
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for y, number in batches:
            score, pred = pd.Series(np.inf, index=y.index), pd.Series([None] * len(y), index=y.index, dtype=object)
            for (c, n), part in y.groupby([number, y.map(len)]):
                if n:
                    values, paths = searched.one_candidate(model, int(c), np.stack(part.to_list()).astype(float), h, season)
                    score[part.index] = values
                    for i, row in zip(part.index, paths):
                        pred[i] = row
            yield pd.DataFrame({"score": score, "pred": pred})

    last = len(searched.candidates(model, season)) - 1
    rows = histories.select(*series, F.col(hist).cast("array<double>").alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("_c"))
    fitted = dealt(rows, [model], [*series, "_c"]).select(*series, "_c", fit("_y", "_c").alias("_f"))
    best = fitted.groupBy(*series).agg(F.min_by("_f.pred", F.struct("_f.score", "_c")).alias("pred"))
    return best.select(*series, F.col("pred").cast(f"array<{PRED_TYPE}>").alias("pred"))


def _preds(models, hist, h, season, el):
    return [predict(m, hist, h, season, el).alias(f"_m{i}") for i, m in enumerate(models)]


def _explode_models(df, cols, models, parallel):
    """Arrays to rows, once per model."""
    per_model = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_m{i}").alias("p")) for i, m in enumerate(models)])
    df = df.select(*cols, *parallel, F.inline(per_model))
    zipped = F.arrays_zip(*[F.col(c) for c in parallel], F.slice("p", 1, F.size(parallel[0])).alias("pred"))
    return df.select("model", *cols, F.inline(zipped))


def forecast_horizon(
    arrays: DataFrame, series: Sequence[str], models: Sequence[str], h: int, freq: str, season: int, train_end=None
) -> DataFrame:
    """Predictions for the h periods after the last date: model, series, ds, pred."""
    el = _element(arrays)
    if train_end is not None:
        end = F.lit(train_end).cast("date")
        n = F.size(F.filter("ds", lambda d: d <= end))
        arrays = arrays.select(*series, F.slice("ds", 1, n).alias("ds"), F.slice("y", 1, n).alias("y"))
    arrays = dealt(arrays.filter(F.size("ds") > 0), models, series)
    last = period_index(F.try_element_at("ds", F.lit(-1)), freq)
    f = arrays.select(
        *series, F.col("y").alias("hist"), F.transform(_steps(h), lambda s: period_end(last + s, freq)).alias("ds")
    )
    f = f.select(*series, "ds", *_preds(models, F.col("hist"), h, season, el))
    return _explode_models(f, list(series), models, ["ds"])


def create_forecasts(
    arrays: DataFrame,
    series: Sequence[str],
    models: Sequence[str],
    h: int,
    freq: str,
    season: int,
    test_period: int = 0,
    train_end=None,
) -> DataFrame:
    """Horizon forecasts next to the held-out actuals (null beyond them): model, series, ds, y, pred.

    With test_period 0 the whole history is training data and all actuals are null.
    """
    el = _element(arrays)
    none = lambda t: F.array().cast(f"array<{t}>")
    if test_period:
        held = hold_out(arrays, series, test_period)
    else:
        held = arrays.select(
            *series, "ds", "y", none("date").alias("ds_test"), none(el.simpleString()).alias("y_test")
        )
    if train_end is not None:
        n = F.size(F.filter("ds", lambda d: d <= F.lit(train_end).cast("date")))
        held = held.withColumns({"y": F.slice("y", 1, n), "ds": F.slice("ds", 1, n)})
    held = dealt(held.filter(F.size("ds") > 0), models, series)
    last = period_index(F.try_element_at("ds", F.lit(-1)), freq)
    ahead = F.transform(_steps(h), lambda s: period_end(last + s, freq))
    f = held.select(*series, F.col("y").alias("hist"), ahead.alias("ds_h"), "ds_test", "y_test")
    f = f.select(*series, "ds_h", "ds_test", "y_test", *_preds(models, F.col("hist"), h, season, el))
    per_model = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_m{i}").alias("p")) for i, m in enumerate(models)])
    f = f.select(*series, "ds_h", "ds_test", "y_test", F.inline(per_model))
    # forecast and actual dates meet inside the row: no join
    f = f.select(
        "model", *series, F.array_union("ds_h", "ds_test").alias("_d"),
        F.map_from_arrays("ds_test", "y_test").alias("_y"), F.map_from_arrays("ds_h", "p").alias("_p"),
    )
    rows = F.transform(
        "_d",
        lambda d: F.struct(
            d.alias("ds"), F.try_element_at("_y", d).alias("y"), F.try_element_at("_p", d).alias("pred")
        ),
    )
    return f.select("model", *series, F.inline(rows))


def merge_forecast_actuals(forecast: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer match on unique keys. Both sides are stacked and grouped: one shuffle, and null keys
    (rolled-up levels) match by themselves."""
    y_type = actual.schema["y"].dataType
    p_type = forecast.schema["pred"].dataType
    both = forecast.select(*on, F.lit(None).cast(y_type).alias("y"), "pred").unionByName(
        actual.select(*on, "y", F.lit(None).cast(p_type).alias("pred"))
    )
    return both.groupBy(*on).agg(F.max("y").alias("y"), F.max("pred").alias("pred"))


# ---- model choice ----


def leaderboard(fold_forecasts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Validation error of every model, overall or per group."""
    err = F.abs(F.col("y") - F.col("pred"))
    return fold_forecasts.groupBy(*by, "model").agg((F.sum(err).cast("double") / F.count(err)).alias("mae"))


def best_model(board: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lowest error wins; equal errors go to the name that sorts first."""
    return board.groupBy(*by).agg(F.min(F.struct("mae", "model")).alias("_b")).select(
        *by, F.col("_b.model").alias("model"), F.col("_b.mae").alias("mae")
    )


def simple_ensemble(board: DataFrame, forecasts: DataFrame, by: Sequence[str], top_n: int) -> DataFrame:
    """Mean of the forecasts of the top_n models of each group. A group has one row per model."""
    ranked = board.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("mae", "model"))), 1, top_n).alias("_r"))
    chosen = ranked.select(*by, F.explode("_r.model").alias("model"))
    cond = null_safe_on(by, "f", "c") & (F.col("f.model") == F.col("c.model"))
    keep = forecasts.alias("f").join(chosen.alias("c"), cond, "left_semi")
    cols = [c for c in forecasts.columns if c not in ("model", "pred", "y")]
    return keep.groupBy(*cols).agg(
        (F.sum("pred").cast("double") / F.count("pred")).cast(PRED_TYPE).alias("pred")
    )


def null_safe_on(cols: Sequence[str], left: str, right: str) -> Column:
    """Equality on columns that may be null; still a hash-partitioned equi join."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def choose_forecasts(forecasts: DataFrame, best: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Forecasts of the chosen model of each group, relabelled as one model."""
    if by:
        cond = null_safe_on([*by, "model"], "f", "b")
        out = forecasts.alias("f").join(best.alias("b"), cond, "left_semi")
    else:
        out = forecasts.join(best.select("model"), "model", "left_semi")
    return out.withColumn("model", F.lit(name))


def fold_totals(fold_forecasts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per level and date the summed actuals and predictions: input of the level weights."""
    return collapse_forecast(fold_forecasts, [*by, "fold"])
