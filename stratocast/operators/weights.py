"""Trust in aggregation levels: one weight per level, learnt on out-of-fold forecasts of the total.

Tables here have at most (validation dates x levels) rows per experiment, so an experiment fits one task;
experiments are the unit of parallelism.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.operators import optimisers
from stratocast.operators.hierarchy import cube_levels, depth, has_key
from stratocast.operators.models import PRED_TYPE, null_safe_on


def candidates(totals: DataFrame, by: Sequence[str], n_keys: int) -> DataFrame:
    """Level totals with the top series' actual on every row: by, ds, level_id, y_top, y, pred."""
    top = (1 << n_keys) - 1
    w = Window.partitionBy(*by, "ds")  # one row per level
    y_top = F.max(F.when(F.col("level_id") == top, F.col("y"))).over(w)
    return totals.filter("pred is not null").select(*by, "ds", "level_id", y_top.alias("y_top"), "y", "pred")


def candidate_matrix(cands: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per date: the target and a map from level to its prediction."""
    entry = F.struct("level_id", "pred")
    return cands.groupBy(*by, "ds").agg(
        F.max("y_top").alias("y_top"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("preds")
    )


def include_levels(cands: DataFrame, keys: Sequence[str], include: str | Sequence[str] | None) -> DataFrame:
    """Only levels that contain all the given keys."""
    for k in [include] if isinstance(include, str) else include or []:
        cands = cands.filter(has_key(F.col("level_id"), keys, k))
    return cands


def level_errors(cands: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean absolute error of every level against its own total."""
    err = F.abs(F.col("y") - F.col("pred"))
    return cands.groupBy(*by, "level_id").agg((F.sum(err).cast("double") / F.count(err)).alias("mae"))


def prune_weak_levels(cands: DataFrame, by: Sequence[str], n_keys: int) -> DataFrame:
    """Surviving levels with their error. From the shallowest depth on: drop levels worse than the mean of
    all shallower ones, then shallower ones worse than the mean of what is left up to this depth."""
    w = Window.partitionBy(*by)
    out = level_errors(cands, by).withColumn("depth", depth(F.col("level_id"), n_keys)).withColumn("ok", F.lit(True))
    ok, mae, dep = F.col("ok"), F.col("mae"), F.col("depth")
    limit = F.col("_m") * (1 + optimisers.TIE)
    for d in range(1, n_keys + 1):
        out = out.withColumn("_m", F.avg(F.when(ok & (dep < d), mae)).over(w))
        out = out.withColumn("ok", ok & ~F.coalesce((dep == d) & (mae > limit), F.lit(False)))
        out = out.withColumn("_m", F.avg(F.when(ok & (dep <= d), mae)).over(w))
        out = out.withColumn("ok", ok & ~F.coalesce((dep < d) & (mae > limit), F.lit(False)))
    return out.filter("ok").select(*by, "level_id", "mae")


def validation_sets(cands: DataFrame, by: Sequence[str], n_sets: int) -> DataFrame:
    """set_id 0..n_sets-1: consecutive parts of the validation dates, the last one takes the remainder."""
    if n_sets == 1:
        return cands.withColumn("set_id", F.lit(0))
    w = Window.partitionBy(*by)
    rank = F.dense_rank().over(w.orderBy("ds"))
    n = F.size(F.collect_set("ds").over(w))
    out = cands.withColumn("_r", rank).withColumn("_n", n)
    part = F.floor((F.col("_r") - 1) / F.greatest(F.floor(F.col("_n") / n_sets), F.lit(1)))
    return out.withColumn("set_id", F.least(part, F.lit(n_sets - 1)).cast("int")).drop("_r", "_n")


def fit_weights(
    cands: DataFrame, by: Sequence[str], n_keys: int, methods: Sequence[str] = optimisers.METHODS,
    n_sets: int = 1, rounds: int = 200,
) -> DataFrame:
    """All optimisers for all experiments in one job: by, optim_method, level_id, weight (zeros left out)."""
    for m in methods:
        if m not in optimisers.METHODS:
            raise ValueError(f"unknown optimiser {m!r}; use one of {optimisers.METHODS}")
    group = [*by, "optim_method", "set_id"]
    rows = validation_sets(cands, by, n_sets).select(
        *by, "set_id", F.explode(F.array(*[F.lit(m) for m in methods])).alias("optim_method"),
        "ds", "level_id", depth(F.col("level_id"), n_keys).alias("depth"),
        F.col("y_top").cast("double").alias("y_top"), F.col("pred").cast("double").alias("pred"),
    )
    fields = {f.name: f for f in rows.schema}
    schema = T.StructType([*[fields[c] for c in group], fields["level_id"], T.StructField("weight", T.DoubleType())])

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="ds", columns=["depth", "level_id"], values="pred").sort_index(axis=1)
        y = pdf.groupby("ds")["y_top"].max().to_numpy()
        method = key[group.index("optim_method")]
        w = optimisers.fit_present(method, y, wide.to_numpy(), rounds, "|".join(map(str, key)))
        out = pd.DataFrame([key] * len(w), columns=group)
        return out.assign(level_id=wide.columns.get_level_values("level_id"), weight=w)[[f.name for f in schema]]

    per_set = rows.groupBy(*group).applyInPandas(kernel, schema)
    return average_sets(per_set, [*by, "optim_method"])


def average_sets(per_set: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean weight over the sets, normalised again; no weight at all means equal weights."""
    w = Window.partitionBy(*by)
    total = per_set.groupBy(*by, "level_id").agg(F.sum("weight").alias("weight"))
    whole, n = F.sum("weight").over(w), F.count("*").over(w)
    total = total.withColumn("weight", F.when(whole > 0, F.col("weight") / whole).otherwise(F.lit(1.0) / n))
    return total.filter("weight != 0")


def best_single_level(cands: DataFrame, by: Sequence[str], n_keys: int) -> DataFrame:
    """Ensemble selection with one round: weight 1 on the level with the lowest error against the total."""
    err = F.abs(F.col("y_top") - F.col("pred"))
    loss = cands.groupBy(*by, "level_id").agg((F.sum(err).cast("double") / F.count(err)).alias("loss"))
    pick = F.min(F.struct("loss", depth(F.col("level_id"), n_keys).alias("depth"), "level_id"))
    return loss.groupBy(*by).agg(pick.alias("_b")).select(
        *by, F.col("_b.level_id").alias("level_id"), F.lit(1.0).alias("weight"), F.col("_b.loss").alias("loss")
    )


def equal_weights(forecasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same weight for every level that has forecasts."""
    levels = forecasts.select(*by, "level_id").distinct()
    return levels.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(*by)))


def common_keys(weights: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bitmap of the keys that some weighted level rolls up: the keys left are common to all of them."""
    return weights.groupBy(*by).agg(F.bit_or("level_id").alias("rolled"))


def apply_weights(
    weights: DataFrame, forecasts: DataFrame, keys: Sequence[str], by: Sequence[str],
    match: Sequence[str] | None = None, name: str = "weighted_pred",
) -> DataFrame:
    """Weighted forecasts of every level made of keys that all weighted levels share.

    `by` identifies a weight set, `match` (part of it) the forecasts it applies to. There is one row of
    weights per experiment, however large the panel: it is broadcast, and forecasts stay where they are.
    """
    match = list(by) if match is None else list(match)
    sets = weights.groupBy(*by).agg(
        F.bit_or("level_id").alias("rolled"),
        F.map_from_entries(F.collect_list(F.struct("level_id", "weight"))).alias("w"),
    )
    f = forecasts.alias("f").join(sets.alias("s"), null_safe_on(match, "f", "s"))
    common = lambda k: has_key(F.col("rolled"), keys, k)
    usable = F.lit(True)
    for k in keys:
        usable = usable & (~common(k) | has_key(F.col("f.level_id"), keys, k))
    weight = F.coalesce(F.try_element_at("w", F.col("f.level_id")), F.lit(0.0))
    part = f.filter(usable).select(
        *[F.col(f"s.{c}").alias(c) for c in by], "rolled", F.col("f.ds").alias("ds"),
        *[F.when(common(k), F.col(f"f.{k}")).alias(k) for k in keys],
        (F.col("f.pred") * weight).cast(PRED_TYPE).alias(name),
    )
    part = part.groupBy(*by, "rolled", "ds", *keys).agg(F.sum(name).alias(name))
    out = cube_levels(part, keys, by=[*by, "rolled", "ds"], measures=[name], null_keys="keep")
    # levels with a key that is not common repeat coarser ones
    return out.filter(F.col("level_id").bitwiseAND(F.col("rolled")) == F.col("rolled")).select(
        *by, "level_id", *keys, "ds", name
    )


def weighted_loss(weights: DataFrame, totals: DataFrame, by: Sequence[str], match: Sequence[str] | None = None) -> DataFrame:
    """Mean absolute difference of weighted predictions and weighted actuals, per weight set."""
    match = list(by) if match is None else list(match)
    t = totals.filter("pred is not null").alias("t")
    both = t.join(weights.alias("w"), null_safe_on([*match, "level_id"], "t", "w"))
    exact = lambda c: (F.col(f"t.{c}") * F.col("w.weight")).cast(PRED_TYPE)
    daily = both.groupBy(*[F.col(f"w.{c}").alias(c) for c in by], F.col("t.ds").alias("ds")).agg(
        F.sum(exact("pred")).alias("p"), F.sum(exact("y")).alias("a")
    )
    err = F.abs(F.col("p") - F.col("a"))
    return daily.groupBy(*by).agg((F.sum(err).cast("double") / F.count(err)).alias("loss"))


def sort_losses(losses: DataFrame, *ties: str) -> DataFrame:
    return losses.orderBy("loss", *ties)


def match_weights_forecasts(
    weight_sets: DataFrame, forecast_sets: DataFrame, match: Sequence[str], extra: Sequence[str] = ("optim_method",)
) -> DataFrame:
    """Pair weight sets (weights_key, loss, ...) with forecasts (forecast_key, ...) on `match`, nulls
    matching nulls, and keep the lowest loss per configuration. Equal losses go to the smaller key."""
    both = weight_sets.alias("w").join(forecast_sets.alias("f"), null_safe_on(match, "w", "f"))
    cols = [*match, *extra]
    loss = F.coalesce(F.col("w.loss"), F.lit(float("inf")))
    pick = F.min(F.struct(loss.alias("loss"), F.col("w.weights_key"), F.col("f.forecast_key")))
    return both.groupBy(*[F.col(f"w.{c}").alias(c) for c in cols]).agg(pick.alias("_b")).select(
        *cols, F.col("_b.weights_key").alias("weights_key"), F.col("_b.forecast_key").alias("forecast_key"),
        F.col("_b.loss").alias("loss"),
    )
