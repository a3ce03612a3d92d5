"""The whole experiment: panel, levels, back-test, weights, forecasts, reconciliation, scores.

Stages hand over DataFrames. With a store every stage is written and read back, so a later stage never
recomputes an earlier one and a rerun starts where the last one stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.operators import boosted, direct, joins, metrics, models, pooled, reconcile, weights
from stratocast.operators import folds as fo
from stratocast.operators.calendar import prepare_panel
from stratocast.operators.hierarchy import cube_levels
from stratocast.operators.optimisers import METHODS
from stratocast.session import cut_lineage
from stratocast.sources.store import ArtifactStore
from stratocast.spec import PanelSpec

#: Models that many series share: one recursion, one regression per step ahead, boosted trees.
POOLED, DIRECT, BOOSTED = SHARED = ("PooledLags", "DirectLags", "BoostedLags")
LEADERBOARD = "Leaderboard"


@dataclass(frozen=True)
class Settings:
    """Settings of one run. `time_limit` is a label of the budget and stands for the cost tier of models."""

    test_period: int = 12
    fold_length: int = 12
    future_periods: int = 12
    models: Sequence[str] = ("SeasonalAverage",)
    forecast_methods: Sequence[str] = ("global",)
    time_limit: int | None = None
    optim_methods: Sequence[str] = METHODS
    remove_groups: Sequence[bool] = (False,)
    include_groups: Sequence[str] | None = None
    hillclimb_sets: int = 1
    max_iterations: int = 200
    cutoff_date: str | None = None
    use_test_data: bool = True
    pool: Sequence[str] = field(default_factory=lambda: ("Naive", "Average", "SeasonalNaive", "SeasonalAverage", "Theta"))


def series_cols(spec: PanelSpec) -> list[str]:
    return ["level_id", *spec.keys]


def build_levels(raw: DataFrame, spec: PanelSpec, cfg: Settings) -> DataFrame:
    panel = prepare_panel(raw, spec.keys, spec.freq, cfg.cutoff_date, with_id=False)
    return cube_levels(panel, spec.keys)


def _folds(arrays: DataFrame, spec: PanelSpec, cfg: Settings) -> DataFrame:
    top = arrays.filter(F.col("level_id") == spec.top_level).select(F.explode("ds").alias("ds"))
    return fo.fold_table(top, cfg.fold_length, skip_last=cfg.test_period if cfg.use_test_data else 0)


def pool_backtest(arrays: DataFrame, spec: PanelSpec, cfg: Settings) -> DataFrame:
    """Fold predictions of the models that the leaderboard chooses from."""
    folds = _folds(arrays, spec, cfg)
    return models.backtest_levels(arrays, series_cols(spec), folds, list(cfg.pool), cfg.fold_length, spec.season)


def _leaders(pool: DataFrame, forecasts: DataFrame, way: str) -> DataFrame:
    """`forecasts` of the model with the lowest validation error, of each level or of all levels together."""
    by = ["level_id"] if way == "level" else []
    best = models.best_model(models.leaderboard(pool, by), by)
    return models.choose_forecasts(forecasts, best, by, LEADERBOARD).withColumn("forecast_method", F.lit(way))


def shared_forecast(name: str, histories: DataFrame, series: Sequence[str], hist: str, h: int, season: int, way: str, folds: Sequence[int] | None = None) -> DataFrame:
    """The histories with the `pred` of a model that series share. With `folds` the rows have a column fold, and every
    fold has a model of its own."""
    by = ["fold"] if folds is not None else []
    if name == POOLED:
        return pooled.pooled_forecast(histories, [*series, *by], hist, h, season, way, by)
    if name == DIRECT:
        out = direct.direct_forecast(histories, [*series, *by], hist, h, season, series, way, by)
        return histories.alias("h").join(out.alias("o"), models.null_safe_on([*series, *by], "h", "o")).select("h.*", "o.pred")
    if name != BOOSTED:
        raise ValueError(f"unknown shared model {name!r}; use one of {SHARED}")
    parts = [histories] if folds is None else [histories.filter(F.col("fold") == k) for k in folds]
    return _union([boosted.boosted_forecast(part, series, hist, h, season, series, way)[0] for part in parts])


def backtest(arrays: DataFrame, spec: PanelSpec, cfg: Settings, pool: DataFrame | None = None) -> DataFrame:
    """Fold predictions of all requested models: model, forecast_method, fold, series, ds, y, pred.
    `pool` is the stored pool_backtest, where there is one."""
    series = series_cols(spec)
    folds = _folds(arrays, spec, cfg)
    out = []
    plain = [m for m in cfg.models if m not in (*SHARED, LEADERBOARD)]
    if plain:
        bt = models.backtest_levels(arrays, series, folds, plain, cfg.fold_length, spec.season)
        out += [bt.withColumn("forecast_method", F.lit(w)) for w in _ways(cfg, plain)]
    shared = [m for m in cfg.models if m in SHARED]
    if shared:
        hist = models.fold_histories(arrays, series, folds)
        numbers = [r.fold for r in folds.select("fold").distinct().orderBy("fold").collect()]
        for name, way in product(shared, cfg.forecast_methods):
            p = shared_forecast(name, hist, series, "hist", cfg.fold_length, spec.season, way, numbers)
            zipped = F.arrays_zip("ds", "y", F.slice("pred", 1, F.size("ds")).alias("pred"))
            p = p.select(F.lit(name).alias("model"), *series, "fold", F.inline(zipped))
            out.append(p.withColumn("forecast_method", F.lit(way)))
    if LEADERBOARD in cfg.models:
        pool = pool_backtest(arrays, spec, cfg) if pool is None else pool
        out += [_leaders(pool, pool, way) for way in cfg.forecast_methods]
    cols = ["model", "forecast_method", "fold", *series, "ds", "y", "pred"]
    return _union([d.select(*cols) for d in out])


def _ways(cfg: Settings, plain: Sequence[str]) -> list[str]:
    """Models that fit series one by one give the same result either way: they run once."""
    return ["global"] if "global" in cfg.forecast_methods else ["level"]


def forecast(arrays: DataFrame, spec: PanelSpec, cfg: Settings, pool: DataFrame | None = None) -> DataFrame:
    """Horizon forecasts of all requested models: model, forecast_method, series, ds, pred."""
    series = series_cols(spec)
    held = models.hold_out(arrays, series, cfg.test_period).select(*series, "ds", "y") if cfg.use_test_data else arrays
    run = lambda names: models.forecast_horizon(
        held, series, names, cfg.future_periods, spec.freq, spec.season
    )
    out = []
    plain = [m for m in cfg.models if m not in (*SHARED, LEADERBOARD)]
    if plain:
        f = run(plain)
        out += [f.withColumn("forecast_method", F.lit(w)) for w in _ways(cfg, plain)]
    shared = [m for m in cfg.models if m in SHARED]
    if shared:
        dates_only = run(["Zero"]).drop("pred", "model")
        horizon = dates_only.groupBy(*series).agg(F.sort_array(F.collect_list("ds")).alias("fds"))
        for name, way in product(shared, cfg.forecast_methods):
            p = shared_forecast(name, held, series, "y", cfg.future_periods, spec.season, way)
            p = p.alias("p").join(horizon.alias("h"), models.null_safe_on(series, "p", "h")).select(
                F.lit(name).alias("model"), *[F.col(f"p.{c}").alias(c) for c in series],
                F.inline(F.arrays_zip(F.col("fds").alias("ds"), F.col("p.pred").alias("pred"))),
            )
            out.append(p.withColumn("forecast_method", F.lit(way)))
    if LEADERBOARD in cfg.models:
        f = run(list(cfg.pool))
        pool = pool_backtest(arrays, spec, cfg) if pool is None else pool
        out += [_leaders(pool, f, way) for way in cfg.forecast_methods]
    cols = ["model", "forecast_method", *series, "ds", "pred"]
    return _union([d.select(*cols) for d in out])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fit(fold_forecasts: DataFrame, spec: PanelSpec, cfg: Settings) -> DataFrame:
    """model, forecast_method, optim_method, remove_groups, level_id, weight."""
    by = ["model", "forecast_method"]
    totals = cut_lineage(models.fold_totals(fold_forecasts, by))  # small, and read more than once
    cands = weights.candidates(totals, by, len(spec.keys))
    cands = weights.include_levels(cands, spec.keys, cfg.include_groups)
    prune = F.explode(F.array(*[F.lit(p) for p in cfg.remove_groups])).alias("remove_groups")
    if any(cfg.remove_groups):
        kept = weights.prune_weak_levels(cands, by, len(spec.keys)).select(*by, "level_id", F.lit(True).alias("kept"))
        cands = cands.join(kept, [*by, "level_id"], "left").select("*", prune)
        cands = cands.filter(~F.col("remove_groups") | F.col("kept")).drop("kept")
    else:
        cands = cands.select("*", prune)
    return weights.fit_weights(
        cands, [*by, "remove_groups"], len(spec.keys), cfg.optim_methods, cfg.hillclimb_sets, cfg.max_iterations
    )


def best_weight_sets(fitted: DataFrame, fold_forecasts: DataFrame) -> DataFrame:
    """Of the pruned and unpruned weight sets of a configuration the one with the lower validation loss."""
    by = ["model", "forecast_method", "optim_method", "remove_groups"]
    totals = models.fold_totals(fold_forecasts, ["model", "forecast_method"])
    loss = weights.weighted_loss(fitted, totals, by, ["model", "forecast_method"])
    best = loss.groupBy("model", "forecast_method", "optim_method").agg(
        F.min(F.struct("loss", "remove_groups")).alias("_b")
    )
    best = best.select("model", "forecast_method", "optim_method", F.col("_b.remove_groups").alias("remove_groups"))
    return fitted.join(best, by, "left_semi").drop("remove_groups")


def combine(forecasts: DataFrame, fitted: DataFrame, spec: PanelSpec, balanced: bool) -> DataFrame:
    """Every method's forecast of every node: model, forecast_method, optim_method, method, level_id, keys, ds, pred.
    Methods that do not depend on the optimiser have optim_method null."""
    by = ["model", "forecast_method"]
    keys = list(spec.keys)
    cols = [*by, "optim_method", "method", "level_id", *keys, "ds", "pred"]
    none = F.lit(None).cast("string").alias("optim_method")
    base = forecasts.select("*", none, F.lit("base").alias("method")).select(*cols)
    rec = reconcile.reconcile_all(forecasts, keys, by, balanced).select("*", none).select(*cols)
    weighted = weights.apply_weights(fitted, forecasts, keys, [*by, "optim_method"], by, "pred")
    weighted = weighted.withColumn("method", F.lit("weighted_pred")).select(*cols)
    equal = weights.apply_weights(weights.equal_weights(forecasts, by), forecasts, keys, by, by, "pred")
    equal = equal.select("*", none, F.lit("equal_weights_pred").alias("method")).select(*cols)
    return _union([base, rec, weighted, equal])


def results_table(combined: DataFrame, levels: DataFrame, spec: PanelSpec, optim_methods: Sequence[str]) -> DataFrame:
    """One row per experiment, node and date: actual and one column per method. Actuals cover the whole
    history, as the scaled errors need it."""
    exp = ["model", "forecast_method", "optim_method"]
    series = ["level_id", *spec.keys]
    optims = F.array(*[F.lit(o) for o in optim_methods])
    # methods without an optimiser belong to all of them
    rows = combined.withColumn(
        "optim_method", F.explode(F.when(F.col("optim_method").isNull(), optims).otherwise(F.array("optim_method")))
    )
    experiments = F.collect_set(F.struct(*exp)).alias("e")
    grid = fitted_experiments(rows, exp).agg(experiments).select("e").scalar()
    actual = levels.withColumn("_e", grid).select(*series, "ds", "y", F.inline("_e"))
    on = [*exp, *series, "ds"]
    frames = {"y": actual.select(*on, "y")}
    for m in metrics.METHODS:
        frames[m] = rows.filter(F.col("method") == m).select(*on, "pred")
    return joins.merge_methods(frames, on)


def fitted_experiments(rows: DataFrame, exp: Sequence[str]) -> DataFrame:
    """Distinct experiments: as many rows as the grid has."""
    return rows.select(*exp).distinct()


def evaluate(
    results: DataFrame, spec: PanelSpec, cfg: Settings, dataset: str, private: Sequence[str] = (),
    elapsed: float | None = None,
) -> DataFrame:
    top = results.filter(F.col("level_id") == spec.top_level).withColumns(
        {"dataset": F.lit(dataset), "time_limit": F.lit(cfg.time_limit).cast("int")}
    )
    by = ["dataset", "model", "forecast_method", "time_limit", "optim_method"]
    # a null budget must not be lost in equi joins
    top = top.withColumn("time_limit", F.coalesce("time_limit", F.lit(-1)))
    out = metrics.metrics_table(top, by, cfg.test_period, cfg.future_periods, private)
    return out.withColumns(
        {"time_limit": F.nullif(F.col("time_limit"), F.lit(-1)), "elapsed_time": F.lit(elapsed).cast("double")}
    )


def stored(store: ArtifactStore, raw: DataFrame, spec: PanelSpec, cfg: Settings, version: str | None = None) -> ArtifactStore:
    """The part of a store that holds the run of these settings on this input."""
    return store.of(spec, cfg, raw.schema.simpleString(), raw.semanticHash() if version is None else version)


def run_experiment(
    raw: DataFrame, spec: PanelSpec, cfg: Settings, balanced: bool | None = None,
    store: ArtifactStore | None = None, rerun: bool = False, version: str | None = None,
) -> dict[str, DataFrame]:
    """All tables of one dataset. In a store they lie apart by panel, settings and input; `version` names the
    input, and where it is missing the input's plan stands for it. Without a store the stages stay one lazy plan (fit for small panels).
    The elapsed time of an experiment is that of back-test, weights and forecasts, shared by all
    experiments of the run since they are one set of jobs."""
    seconds = {}
    if store is not None:
        store = stored(store, raw, spec, cfg, version)

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if store is None:
            return make()
        start = time.monotonic()
        out = store.reuse(f"{spec.name}/{name}", make, rerun)
        seconds[name] = time.monotonic() - start
        return out

    levels = stage("levels", lambda: build_levels(raw, spec, cfg))
    if balanced is None:
        balanced = reconcile.is_balanced(levels.filter("level_id = 0"), spec.keys)
    arrays = stage("series", lambda: models.series_arrays(levels, series_cols(spec)))
    pool = stage("pool_backtest", lambda: pool_backtest(arrays, spec, cfg)) if LEADERBOARD in cfg.models else None
    folds = stage("fold_forecasts", lambda: backtest(arrays, spec, cfg, pool))
    fitted = stage("weights", lambda: fit(folds, spec, cfg))
    fc = stage("forecasts", lambda: forecast(arrays, spec, cfg, pool))
    combined = stage("combined", lambda: combine(fc, best_weight_sets(fitted, folds), spec, balanced))
    results = stage("results", lambda: results_table(combined, levels, spec, cfg.optim_methods))
    timed = ("pool_backtest", "fold_forecasts", "weights", "forecasts")
    elapsed = sum(seconds.get(n, 0.0) for n in timed) if seconds else None
    scores = stage("metrics", lambda: evaluate(results, spec, cfg, spec.name, elapsed=elapsed))
    return {
        "levels": levels, "fold_forecasts": folds, "weights": fitted, "forecasts": fc,
        "combined": combined, "results": results, "metrics": scores,
    }
