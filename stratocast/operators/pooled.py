"""One linear model on lagged values for many series, per level or for all levels together.

The normal equations are sums of products, so every level of every fold is fitted in one aggregation with
map-side combine. Solving a system of a few dozen unknowns and rolling the forecast forward are the only
Python steps, on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocast.operators.models import PRED_TYPE, null_safe_on


def _scale(hist: Column) -> Column:
    """Mean absolute value of a history: makes series of different size comparable."""
    total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.greatest(total / F.size(hist), F.lit(1e-9))


def lag_features(arrays: DataFrame, carry: Sequence[str], hist: str, lags: Sequence[int]) -> DataFrame:
    """carry, x (lags and an intercept), z: one row per series and time with all lags present, scaled."""
    deep = max(lags)
    df = arrays.select(*carry, F.col(hist).cast("array<double>").alias("h"))
    df = df.withColumn("s", _scale(F.col("h"))).filter(F.size("h") > deep)
    df = df.select(*carry, "h", "s", F.explode(F.sequence(F.lit(deep + 1), F.size("h"))).alias("t"))
    x = F.array(*[F.element_at("h", F.col("t") - k) / F.col("s") for k in lags], F.lit(1.0))
    return df.select(*carry, x.alias("x"), (F.element_at("h", F.col("t")) / F.col("s")).alias("z"))


def gram(features: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Sums of products of the n features and the target, as one flat array."""
    x = [F.col("x")[i] for i in range(n)]
    sums = [F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)] + [F.sum(v * F.col("z")) for v in x]
    return features.groupBy(*by).agg(F.array(*sums).alias("g"))


def solve(grams: DataFrame, by: Sequence[str], n: int, ridge: float = 1e-6) -> DataFrame:
    """Coefficients per group."""

    @F.pandas_udf("array<double>")
    def coefficients(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        upper = np.triu_indices(n)
        for col in batches:
            out = []
            for g in col:
                a = np.zeros((n, n))
                a[upper] = g[: len(upper[0])]
                a = a + np.triu(a, 1).T
                a = a + ridge * (np.trace(a) / n + 1e-12) * np.eye(n)
                out.append(np.linalg.solve(a, g[len(upper[0]) :]))
            yield pd.Series(out)

    return grams.select(*by, coefficients("g").alias("coef"))


def roll_forward(hist: Column, coef: Column, lags: Sequence[int], h: int) -> Column:
    """h steps of the recursion, each prediction feeding the next."""

    @F.pandas_udf("array<double>")
    def roll(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        back = np.array(lags)
        for y, c in batches:
            out = [None] * len(y)
            size = y.map(len).to_numpy()
            fitted = c.notna().to_numpy() & (size >= back.max())
            for k in np.flatnonzero(~fitted):  # no coefficients or too short: the last value
                out[k] = np.full(h, y.iloc[k][-1])
            for n in np.unique(size[fitted]):  # series of one length together
                rows = np.flatnonzero(fitted & (size == n))
                path = np.concatenate([np.stack(y.iloc[rows].to_list()), np.zeros((len(rows), h))], axis=1)
                w = np.stack(c.iloc[rows].to_list())
                scale = np.maximum(np.abs(path[:, :n]).mean(axis=1), 1e-9)
                for t in range(n, n + h):
                    path[:, t] = (path[:, t - back] * w[:, :-1]).sum(axis=1) + w[:, -1] * scale
                for k, row in zip(rows, path[:, n:]):
                    out[k] = row
            yield pd.Series(out)

    return roll(hist.cast("array<double>"), coef)


def pooled_forecast(
    histories: DataFrame, series: Sequence[str], hist: str, h: int, season: int, mode: str = "global",
    fold: Sequence[str] = (), n_lags: int = 3,
) -> DataFrame:
    """Adds `pred` (array of h). `series` is level_id, the keys and possibly the fold. mode "level" fits every level alone, "global" fits all levels at once."""
    if mode not in ("level", "global"):
        raise ValueError(f"unknown training mode {mode!r}; use 'level' or 'global'")
    lags = sorted({*range(1, n_lags + 1), season})
    by = [*fold, *(["level_id"] if mode == "level" else [])]
    n = len(lags) + 1
    coefs = solve(gram(lag_features(histories, by, hist, lags), by, n), by, n)
    on = [*fold, "level_id"]
    if mode == "global":  # the same coefficients for every level
        top = (1 << (len(series) - 1 - len([c for c in fold if c in series]))) - 1
        coefs = coefs.select(*fold, F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level_id"), "coef")
    both = histories.alias("h").join(coefs.alias("c"), null_safe_on(on, "h", "c"), "left")
    return both.select(
        "h.*", roll_forward(F.col(f"h.{hist}"), F.col("coef"), lags, h).cast(f"array<{PRED_TYPE}>").alias("pred")
    )
