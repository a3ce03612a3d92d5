"""A linear model per step ahead, on lagged values and key features, for many series at once.

A series is one row, and within it the keys are constant. So a series gives each step's sums of products of its own lags
in one pass over its array, and what the keys add to the normal equations follows from these sums: nothing is multiplied
out into one row per time and step. A key value is known to the model by how much its series change over the step, drawn
towards no change where there is little to go by.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocast.operators.models import PRED_TYPE, null_safe_on
from stratocast.operators.pooled import solve
from stratocast.session import cut_lineage

#: Rows of no change that every key value counts besides its own.
PRIOR = 20.0


def own_features(y: np.ndarray, h: int, m: int, n_lags: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each step (step, x, z, change, x of the last time): features (s, times, k), targets and changes (s, times) of the
    scaled series y (s, n). The features are the last values, the youngest value of the target's season position, and 1."""
    n, back = y.shape[1], max(n_lags, m)
    for step in range(1, h + 1):
        young = m * -(-step // m) - step  # how far before the last value the target's season position lies
        ends = np.arange(back - 1, n)  # the last known place
        x = np.stack([*(y[:, ends - lag] for lag in range(n_lags)), y[:, ends - young], np.ones((len(y), len(ends)))], axis=2)
        known = ends + step < n
        z = y[:, ends[known] + step]
        yield step, x[:, known], z, z - y[:, ends[known]], x[:, -1]


def _sums(hist: Column, h: int, m: int, n_lags: int) -> Column:
    """Per step the flat sums of a series: n, sum z, sum change, then of its k features sum x, upper triangle of sum xx',
    sum xz, the features of the last time, and the scale. Too short series have no rows and no last features."""
    k = n_lags + 2
    upper = np.triu_indices(k)

    @F.pandas_udf("array<array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for col in batches:
            out: list = [None] * len(col)
            size = col.map(len).to_numpy()
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                y = np.stack(col.iloc[rows].to_list())
                scale = np.maximum(np.abs(y).mean(axis=1), 1e-9) if n else np.full(len(rows), 1e-9)
                if n < max(n_lags, m):
                    blank = np.zeros((len(rows), h, 3 + 2 * k + len(upper[0]) + k + 1))
                    blank[:, :, -k - 1 : -1] = np.nan  # null in the column
                    blank[:, :, -1] = scale[:, None]
                    for i, part in zip(rows, blank):
                        out[i] = list(part)
                    continue
                parts = []
                for _, x, z, change, last in own_features(y / scale[:, None], h, m, n_lags):
                    xx = np.einsum("stk,stl->skl", x, x)[:, upper[0], upper[1]]
                    head = np.stack([np.full(len(rows), float(z.shape[1])), z.sum(axis=1), change.sum(axis=1)], axis=1)
                    parts.append(np.concatenate([head, x.sum(axis=1), xx, np.einsum("stk,st->sk", x, z), last, scale[:, None]], axis=1))
                for i, part in zip(rows, np.stack(parts, axis=1)):
                    out[i] = list(part)
            yield pd.Series(out, index=col.index)

    return run(hist.cast("array<double>"))


def step_sums(histories: DataFrame, series: Sequence[str], hist: str, h: int, m: int, n_lags: int) -> DataFrame:
    """(series, last, step, s): one row per series and step."""
    last = F.try_element_at(F.col(hist), F.lit(-1)).cast("double").alias("last")
    return histories.select(*series, last, F.posexplode(_sums(F.col(hist), h, m, n_lags))).select(*series, "last", (F.col("pos") + 1).alias("step"), F.col("col").alias("s"))


def key_codes(sums: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by, step, key, code): how much the series of a key value change over the step, in units of their size."""
    changed, n = F.sum(F.col("s")[2]), F.sum(F.col("s")[0])
    return sums.groupBy(*by, "step", key).agg((changed / (n + PRIOR)).alias("code"))


def with_codes(sums: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The rows with `codes`, one for each key."""
    out = sums.withColumn("codes", F.array().cast("array<double>"))
    for key in keys:
        cond = null_safe_on([*by, "step", key], "r", "c")
        out = out.alias("r").join(key_codes(sums, by, key).alias("c"), cond).select("r.*", F.col("c.code").alias("_code"))
        out = out.withColumn("codes", F.concat("codes", F.array("_code"))).drop("_code")
    return out


def normal_equations(coded: DataFrame, by: Sequence[str], k: int, n_keys: int) -> DataFrame:
    """(by, step, g): the upper triangle of the sums of products of lags and codes, then those with the target."""
    s, n = F.col("s"), k + n_keys
    code = lambda i: F.col("codes")[i - k]
    at = {pair: 3 + k + j for j, pair in enumerate(zip(*(x.tolist() for x in np.triu_indices(k))))}

    def product(i: int, j: int) -> Column:
        if j < k:
            return s[at[i, j]]
        return code(j) * s[3 + i] if i < k else code(i) * code(j) * s[0]

    target = 3 + k + k * (k + 1) // 2
    terms = [product(i, j) for i in range(n) for j in range(i, n)]
    terms += [s[target + i] if i < k else code(i) * s[1] for i in range(n)]
    return coded.groupBy(*by, "step").agg(F.array(*[F.sum(t) for t in terms]).alias("g"))


def direct_forecast(
    histories: DataFrame, series: Sequence[str], hist: str, h: int, season: int, keys: Sequence[str] = (), mode: str = "global",
    fold: Sequence[str] = (), n_lags: int = 3,
) -> DataFrame:
    """(series, pred): forecasts of h steps, each by its own coefficients. `series` is level_id, the keys and possibly the
    fold; `keys` are those of its columns that are features. mode "level" fits every level alone, "global" all at once. A
    series too short for the lags repeats its last value."""
    if mode not in ("level", "global"):
        raise ValueError(f"unknown training mode {mode!r}; use 'level' or 'global'")
    by = [*fold, *(["level_id"] if mode == "level" else [])]
    keys = [k for k in keys if k not in by]
    k = n_lags + 2
    # every key reads the sums once more
    coded = with_codes(cut_lineage(step_sums(histories, series, hist, h, season, n_lags)), by, keys)
    coefs = solve(normal_equations(coded, by, k, len(keys)), [*by, "step"], k + len(keys))
    both = coded.alias("r").join(coefs.alias("c"), null_safe_on([*by, "step"], "r", "c"), "left")
    x = F.concat(F.slice("r.s", F.size("r.s") - k, k), F.col("r.codes"))
    value = F.aggregate(F.zip_with(x, F.col("c.coef"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) * F.element_at("r.s", -1)
    fits = F.col("c.coef").isNotNull() & F.element_at("r.s", -2).isNotNull()
    pred = F.when(fits, value).otherwise(F.col("r.last"))
    rows = both.select(*[F.col(f"r.{c}").alias(c) for c in series], F.struct(F.col("r.step").alias("step"), pred.cast(PRED_TYPE).alias("p")).alias("_p"))
    return rows.groupBy(*series).agg(F.transform(F.array_sort(F.collect_list("_p")), lambda v: v["p"]).alias("pred"))
