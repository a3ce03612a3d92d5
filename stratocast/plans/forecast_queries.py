"""Back-tests, forecasts, level weights, reconciliation and accuracy on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratocast.operators import boosted, calendar, direct, folds, hierarchy, joins, kernels, metrics, models, optimisers, pooled, reconcile, weights
from stratocast.operators.models import BASELINES, PRED_TYPE
from stratocast.plans import experiment, inputs
from stratocast.plans import reference_sql as ref
from stratocast.plans.cleaning_queries import K, KEYS, PANEL, SERIES, crossed_arrays, crossed_levels, scratch
from stratocast.plans.panel_queries import DK, DKEYS, DPANEL, FC15, H, NK, NKEYS, crossed_folds
from stratocast.plans.registry import query
from stratocast.sources.store import ArtifactStore

S = ", ".join(SERIES)
DSERIES = ["level_id", *DKEYS]
N = len(KEYS)
BT = f"{PANEL}, {ref.fold_forecasts(KEYS, 12, H, H)}"
FC = f"{PANEL}, {ref.folds(H, H)}, {ref.horizon(KEYS, 12, H, H)}"
ALL = f"{BT}, {ref.horizon(KEYS, 12, H, H).replace('hist', 'hist2').replace('step AS', 'step2 AS').replace('JOIN step', 'JOIN step2').replace('stat', 'stat2').replace('spos', 'spos2').replace('pred AS MATERIALIZED (', 'pred2 AS MATERIALIZED (').replace('FROM pred ', 'FROM pred2 ')}"


def backtest(spark, sf_dir, names=BASELINES):
    arrays = crossed_arrays(spark, sf_dir)
    return models.backtest_levels(arrays, SERIES, crossed_folds(spark, sf_dir), list(names), H, 12)


def forecasts(spark, sf_dir, names=BASELINES):
    """Forecasts of the held-out months next to the actuals."""
    return models.create_forecasts(crossed_arrays(spark, sf_dir), SERIES, list(names), H, "ME", 12, H)


# ---- back-test and models ----


@query("backtest_levels", f"{BT} SELECT model, fold, {S}, ds, CAST(y AS DOUBLE) AS y, CAST(pred AS DOUBLE) AS pred FROM bt", ordered=True)
def _(spark, sf_dir):
    return backtest(spark, sf_dir)


DBT = f"{DPANEL}, {ref.fold_forecasts(DKEYS, 7, 5, 5)}"


@query(
    "backtest_daily",
    f"{DBT} SELECT model, fold, level_id, {DK}, ds, CAST(y AS DOUBLE) AS y, CAST(pred AS DOUBLE) AS pred FROM bt",
    ordered=True,
)
def _(spark, sf_dir):
    panel = calendar.prepare_panel(inputs.daily_rows(spark, sf_dir), DKEYS, "D", with_id=False)
    arrays = models.series_arrays(hierarchy.cube_levels(panel, DKEYS), DSERIES)
    fold = folds.fold_table(inputs.daily_rows(spark, sf_dir), 5, skip_last=5)
    return models.backtest_levels(arrays, DSERIES, fold, list(BASELINES), 5, 7)


@query("forecast_horizon", f"{FC15} SELECT model, {S}, ds, CAST(pred AS DOUBLE) AS pred FROM ahead")
def _(spark, sf_dir):
    train = models.hold_out(crossed_arrays(spark, sf_dir), SERIES, H)
    return models.forecast_horizon(train, SERIES, ["SeasonalNaive"], 15, "ME", 12)


def _baseline_query(name: str, model: str):
    sql = f"""{PANEL}, {ref.folds(H, H)}, {ref.horizon(KEYS, 12, H, H, [model])}
    SELECT {S}, ds, CAST(y AS DOUBLE) AS y, CAST(pred AS DOUBLE) AS pred FROM fc"""

    @query(name, sql, ordered=True)
    def _(spark, sf_dir):
        return forecasts(spark, sf_dir, [model]).drop("model")


for _name, _model in (
    ("f_naive", "Naive"), ("f_zero", "Zero"), ("f_average", "Average"),
    ("f_seasonal_naive", "SeasonalNaive"), ("f_seasonal_average", "SeasonalAverage"),
):
    _baseline_query(_name, _model)


def _kernel_query(name: str, model: str):
    """Search and smoothing models have no SQL twin; their kernels are tested on hand-made series."""

    @query(name)
    def _(spark, sf_dir):
        return forecasts(spark, sf_dir, [model]).drop("model")


for _name, _model in (
    ("f_theta", "Theta"),
    ("f_ets", "AutoETS"), ("f_arima", "AutoARIMA"),
):
    _kernel_query(_name, _model)


# demand size, interval and periods since the last demand, one recursion step per period
CROSTON = f"""{(PANEL + ", " + ref.folds(H, H)).replace('WITH', 'WITH RECURSIVE', 1)},
ob AS (SELECT {S}, i, CAST(y AS DOUBLE) AS y FROM levels JOIN dates USING (ds) WHERE i <= (SELECT n FROM train_n)),
st AS (
  SELECT {S}, 0 AS t, CAST(0 AS DOUBLE) AS size, CAST(1 AS DOUBLE) AS gap, CAST(1 AS DOUBLE) AS since, false AS seen FROM ob WHERE i = 1
  UNION ALL
  SELECT {", ".join("st." + c for c in SERIES)}, t + 1,
    CASE WHEN ob.y = 0 THEN size WHEN seen THEN size + 0.1::DOUBLE * (ob.y - size) ELSE ob.y END,
    CASE WHEN ob.y = 0 THEN gap WHEN seen THEN gap + 0.1::DOUBLE * (since - gap) ELSE since END,
    CASE WHEN ob.y = 0 THEN since + 1 ELSE 1 END, seen OR ob.y <> 0
  FROM st JOIN ob ON ob.i = st.t + 1 AND {ref.null_join('ob', 'st', SERIES)}),
fin AS (SELECT {S}, CAST(0.95::DOUBLE * size / gap AS DECIMAL(28,6)) AS pred FROM st WHERE t = (SELECT n FROM train_n))"""


@query(
    "f_croston_sba",
    f"""{CROSTON} SELECT {", ".join("l." + c for c in SERIES)}, l.ds, CAST(l.y AS DOUBLE) AS y, CAST(pred AS DOUBLE) AS pred
    FROM fin JOIN levels l ON {ref.null_join('fin', 'l', SERIES)} JOIN dates d ON l.ds = d.ds WHERE d.i > (SELECT n FROM train_n)""",
)
def _(spark, sf_dir):
    return forecasts(spark, sf_dir, ["CrostonSBA"]).drop("model")


# exponential smoothing of bucket sums for every bucket length up to the mean demand interval and every alpha
BUCKETS = f"""{(PANEL + ", " + ref.folds(H, H)).replace('WITH', 'WITH RECURSIVE', 1)},
ob AS (SELECT {S}, i, CAST(y AS DOUBLE) AS y FROM levels JOIN dates USING (ds) WHERE i <= (SELECT n FROM train_n)),
iv AS (SELECT {S}, max(i) AS n, least(greatest(CAST(round_even(CASE WHEN count(*) FILTER (y <> 0) > 1
    THEN (max(i) FILTER (y <> 0) - min(i) FILTER (y <> 0)) / (count(*) FILTER (y <> 0) - 1) ELSE 1 END, 0) AS INTEGER), 1), max(i) // 2) AS k FROM ob GROUP BY ALL),
kj AS (SELECT *, CAST(unnest(generate_series(1, k)) AS INTEGER) AS j FROM iv),
bk AS (SELECT {", ".join("kj." + c for c in SERIES)}, k, j, (i - 1 - (n - n // j * j)) // j + 1 AS t, sum(y) AS y
  FROM kj JOIN ob ON {ref.null_join('kj', 'ob', SERIES)} AND i > n - n // j * j GROUP BY ALL),
sm AS (
  SELECT {S}, k, j, t, unnest([{", ".join(f"{a!r}::DOUBLE" for a in map(float, kernels.ALPHAS))}]) AS alpha, y AS level, CAST(0 AS DOUBLE) AS sse FROM bk WHERE t = 1
  UNION ALL
  SELECT {", ".join("sm." + c for c in SERIES)}, sm.k, sm.j, bk.t, alpha, level + alpha * (bk.y - level), sse + (bk.y - level) * (bk.y - level)
  FROM sm JOIN bk ON bk.t = sm.t + 1 AND bk.j = sm.j AND {ref.null_join('bk', 'sm', SERIES)}),
fin AS (SELECT {S}, k, j, arg_min(level, {{'sse': sse, 'alpha': alpha}}) / j AS level FROM sm
  WHERE t = (SELECT n FROM train_n) // j GROUP BY {S}, k, j)"""


def _bucket_query(name: str, model: str, pick: str):
    sql = f"""{BUCKETS}, fc AS ({pick}) SELECT {", ".join("l." + c for c in SERIES)}, l.ds, CAST(l.y AS DOUBLE) AS y,
      round(CAST(CAST(fc.pred AS DECIMAL(28,6)) AS DOUBLE), 4) AS pred
    FROM fc JOIN levels l ON {ref.null_join('fc', 'l', SERIES)} JOIN dates d ON l.ds = d.ds WHERE d.i > (SELECT n FROM train_n)"""

    @query(name, sql)
    def _(spark, sf_dir):
        out = forecasts(spark, sf_dir, [model]).drop("model")
        return out.withColumn("pred", F.round(F.col("pred").cast("double"), 4))


_bucket_query("f_adida", "ADIDA", f"SELECT {S}, level AS pred FROM fin WHERE j = k")
_bucket_query("f_imapa", "IMAPA", f"SELECT {S}, sum(level ORDER BY j) / any_value(k) AS pred FROM fin GROUP BY {S}")


# level, slope and factors per series, one recursion step per period; the factor of a period is appended to the list
HOLT_WINTERS = f"""{(PANEL + ", " + ref.folds(H, H)).replace('WITH', 'WITH RECURSIVE', 1)},
ob AS (SELECT {S}, list(CAST(y AS DOUBLE) ORDER BY i) AS y FROM levels JOIN dates USING (ds) WHERE i <= (SELECT n FROM train_n) GROUP BY {S}),
ini AS (SELECT *, list_sum(y[1:12]) / 12 AS level0 FROM ob),
hw AS (
  SELECT {S}, y, 12 AS t, level0 AS level, (list_sum(y[13:24]) / 12 - level0) / 12 AS slope,
    list_transform(y[1:12], lambda v: CASE WHEN level0 > 0 THEN v / level0 ELSE 1::DOUBLE END) AS f FROM ini
  UNION ALL
  SELECT {S}, y, t + 1, base + 0.3::DOUBLE * part, slope + 0.3::DOUBLE * 0.1::DOUBLE * part,
    list_append(f, CASE WHEN base > 0 THEN cell + 0.2::DOUBLE * (e / base) ELSE cell END)
  FROM (SELECT *, CASE WHEN cell > 0 THEN e / cell ELSE e END AS part FROM (
    SELECT *, y[t + 1] - base * cell AS e FROM (
      SELECT *, level + slope AS base, f[t - 11] AS cell FROM hw WHERE t < len(y))))),
fin AS (SELECT * FROM hw WHERE t = len(y)),
fc AS (
  SELECT {S}, d.i - t AS step, d.ds, CAST(CAST((level + (d.i - t) * slope) * f[t - 12 + (d.i - t - 1) % 12 + 1] AS DECIMAL(28,6)) AS DOUBLE) AS pred
  FROM fin, dates d WHERE d.i > t)"""


@query(
    "f_holt_winters",
    f"""{HOLT_WINTERS} SELECT {", ".join("l." + c for c in SERIES)}, l.ds, CAST(l.y AS DOUBLE) AS y, round(fc.pred, 3) AS pred
    FROM fc JOIN levels l ON l.ds = fc.ds AND {ref.same_series('fc', 'l', SERIES)}""",
    ordered=True,
)
def _(spark, sf_dir):
    """One fixed form of exponential smoothing: additive trend, multiplicative season."""
    out = forecasts(spark, sf_dir, ["HoltWinters"]).drop("model")
    return out.withColumn("pred", F.round(F.col("pred").cast("double"), 3))


def pooled_forecasts(spark, sf_dir, mode):
    train = models.hold_out(crossed_arrays(spark, sf_dir), SERIES, H)
    out = pooled.pooled_forecast(train, SERIES, "y", H, 12, mode)
    rows = F.arrays_zip(F.col("ds_test").alias("ds"), F.col("y_test").alias("y"), F.col("pred"))
    return out.select(*SERIES, F.inline(rows))


@query("f_pooled_lags")
def _(spark, sf_dir):
    return pooled_forecasts(spark, sf_dir, "global")


@query("f_direct_lags")
def _(spark, sf_dir):
    """One regression per month ahead on lags and key features, for all levels together."""
    train = models.hold_out(crossed_arrays(spark, sf_dir), SERIES, H)
    out = direct.direct_forecast(train, SERIES, "y", H, 12, SERIES)
    rows = F.arrays_zip(F.col("ds_test").alias("ds"), F.col("y_test").alias("y"), F.col("pred"))
    on = models.null_safe_on(SERIES, "t", "o")
    return train.alias("t").join(out.alias("o"), on).select("t.*", "o.pred").select(*SERIES, F.inline(rows))


@query("f_boosted_lags")
def _(spark, sf_dir):
    """Boosted trees on lags and key features, for all levels together."""
    train = models.hold_out(crossed_arrays(spark, sf_dir), SERIES, H)
    out, _ = boosted.boosted_forecast(train, SERIES, "y", H, 12, SERIES, rounds=4)
    rows = F.arrays_zip(F.col("ds_test").alias("ds"), F.col("y_test").alias("y"), F.col("pred"))
    return out.select(*SERIES, F.inline(rows))


@query("forecast_level_vs_global")
def _(spark, sf_dir):
    """Error per level of one model for everything and of one model per level."""
    out = [
        pooled_forecasts(spark, sf_dir, m).groupBy("level_id").agg(
            F.sum(F.abs(F.col("y") - F.col("pred"))).alias("abs_err"), F.count("*").alias("n")
        ).withColumn("forecast_method", F.lit(m))
        for m in ("global", "level")
    ]
    return out[0].unionByName(out[1])


@query(
    "create_forecasts",
    f"{FC} SELECT model, {S}, ds, CAST(y AS DOUBLE) AS y, CAST(pred AS DOUBLE) AS pred FROM fc",
    ordered=True,
)
def _(spark, sf_dir):
    return forecasts(spark, sf_dir)


@query(
    "create_forecasts_oos",
    f"""{PANEL}, {ref.folds(H, 0)}, {ref.baselines(KEYS, 6, 12, False, 0, ['SeasonalAverage'])}
    SELECT model, {S}, last_day(CAST((SELECT max(ds) FROM cal) + to_months(step) AS DATE)) AS ds, CAST(NULL AS DOUBLE) AS y,
      CAST(pred AS DOUBLE) AS pred FROM pred""",
)
def _(spark, sf_dir):
    return models.create_forecasts(crossed_arrays(spark, sf_dir), SERIES, ["SeasonalAverage"], 6, "ME", 12)


BOARD = "board AS (SELECT model, CAST(sum(abs(y - pred)) AS DOUBLE) / count(*) AS mae FROM bt GROUP BY model)"
LBOARD = "lboard AS (SELECT level_id, model, CAST(sum(abs(y - pred)) AS DOUBLE) / count(*) AS mae FROM bt GROUP BY ALL)"


@query("model_filter", f"{BT}, {BOARD} SELECT * FROM board WHERE model IN ('Naive', 'SeasonalAverage')")
def _(spark, sf_dir):
    """The chosen models' validation errors."""
    include, exclude = ["Naive", "SeasonalAverage", "Average", "AutoETS"], "Average"
    names = models.model_names(include, exclude, max_tier=1)
    chosen = models.model_filter(models.model_table(spark), include, exclude, max_tier=1)
    return models.leaderboard(backtest(spark, sf_dir, names)).join(chosen.select("model"), "model")


@query("leaderboard", f"{BT}, {LBOARD} SELECT * FROM lboard")
def _(spark, sf_dir):
    return models.leaderboard(backtest(spark, sf_dir), ["level_id"])


@query(
    "best_model",
    f"{BT}, {LBOARD} SELECT level_id, model, mae FROM (SELECT *, row_number() OVER (PARTITION BY level_id ORDER BY mae, model) AS r FROM lboard) WHERE r = 1",
)
def _(spark, sf_dir):
    return models.best_model(models.leaderboard(backtest(spark, sf_dir), ["level_id"]), ["level_id"])


@query(
    "leaderboard_ensemble",
    f"""{ALL}, {LBOARD},
    top AS (SELECT level_id, model FROM (SELECT *, row_number() OVER (PARTITION BY level_id ORDER BY mae, model) AS r FROM lboard) WHERE r <= 3)
    SELECT {', '.join('fc.' + c for c in SERIES)}, ds, CAST(CAST(CAST(sum(pred) AS DOUBLE) / count(*) AS DECIMAL(28,6)) AS DOUBLE) AS pred
    FROM fc JOIN top ON fc.level_id = top.level_id AND fc.model = top.model GROUP BY ALL""",
)
def _(spark, sf_dir):
    board = models.leaderboard(backtest(spark, sf_dir), ["level_id"])
    return models.simple_ensemble(board, forecasts(spark, sf_dir), ["level_id"], 3)


@query("median_interval", f"{FC} SELECT {S}, ds, CAST(pred AS DOUBLE) AS pred FROM fc WHERE model = 'Average'", ordered=True)
def _(spark, sf_dir):
    """Point forecasts after the end of training, from a table that also has fitted history."""
    arrays = models.hold_out(crossed_arrays(spark, sf_dir), SERIES, H)
    ahead = models.forecast_horizon(arrays, SERIES, ["Average"], H, "ME", 12).drop("model")
    history = arrays.select(*SERIES, F.explode("ds").alias("ds"), F.lit(0).cast(PRED_TYPE).alias("pred"))
    end = arrays.agg(F.max(F.try_element_at("ds", F.lit(-1)))).scalar()
    return ahead.unionByName(history).withColumn("_end", end).filter("ds > _end").drop("_end")


# ---- level totals and weights ----

TOTALS = """tot AS (SELECT model, fold, level_id, ds, sum(y) AS y, sum(pred) AS pred FROM bt GROUP BY ALL),
cand AS (SELECT t.model, t.ds, t.level_id, top.y AS y_top, t.y, t.pred FROM tot t
  JOIN (SELECT model, ds, y FROM tot WHERE level_id = 7) top ON t.model = top.model AND t.ds = top.ds)"""


def totals(spark, sf_dir, names=BASELINES):
    return models.fold_totals(backtest(spark, sf_dir, names))


def cands(spark, sf_dir, names=BASELINES):
    return weights.candidates(totals(spark, sf_dir, names), ["model"], N)


@query("collapse_forecast", f"{BT}, {TOTALS} SELECT model, fold, level_id, ds, CAST(y AS DOUBLE) AS y, CAST(pred AS DOUBLE) AS pred FROM tot")
def _(spark, sf_dir):
    return totals(spark, sf_dir)


@query(
    "candidate_matrix",
    f"""{BT}, {TOTALS} SELECT model, ds, CAST(max(y_top) AS DOUBLE) AS y_top,
      {", ".join(f"CAST(max(pred) FILTER (level_id = {i}) AS DOUBLE) AS p{i}" for i in range(8))} FROM cand GROUP BY model, ds""",
)
def _(spark, sf_dir):
    out = weights.candidate_matrix(cands(spark, sf_dir), ["model"])
    return out.select("model", "ds", "y_top", *[F.try_element_at("preds", F.lit(i)).alias(f"p{i}") for i in range(8)])


@query(
    "include_levels",
    f"""{BT}, {TOTALS} SELECT model, ds, level_id, CAST(y_top AS DOUBLE) AS y_top, CAST(y AS DOUBLE) AS y, CAST(pred AS DOUBLE) AS pred
    FROM cand WHERE level_id IN (0, 1, 2, 3)""",
)
def _(spark, sf_dir):
    return weights.include_levels(cands(spark, sf_dir), KEYS, "r_name")


def _prune_sql() -> str:
    """The pruning rule unrolled over three depths."""
    out = """l0 AS (SELECT model, level_id, 3 - bit_count(level_id) AS d, CAST(sum(abs(y - pred)) AS DOUBLE) / count(*) AS mae, true AS ok
      FROM cand GROUP BY model, level_id)"""
    prev = "l0"
    for d in (1, 2, 3):
        out += f""",
    l{d}a AS (SELECT model, level_id, d, mae, ok AND NOT coalesce(d = {d} AND mae > (1 + 1e-9) *
      avg(CASE WHEN ok AND d < {d} THEN mae END) OVER (PARTITION BY model), false) AS ok FROM {prev}),
    l{d} AS (SELECT model, level_id, d, mae, ok AND NOT coalesce(d < {d} AND mae > (1 + 1e-9) *
      avg(CASE WHEN ok AND d <= {d} THEN mae END) OVER (PARTITION BY model), false) AS ok FROM l{d}a)"""
        prev = f"l{d}"
    return out


LEVEL_CHOICE = f"""mix AS (SELECT b.fold, b.level_id, {", ".join("b." + k for k in KEYS)}, b.ds, b.y, b.pred FROM bt b JOIN (
      SELECT level_id, model FROM (SELECT *, row_number() OVER (PARTITION BY level_id ORDER BY mae, model) AS r FROM lboard) WHERE r = 1
    ) c ON b.level_id = c.level_id AND b.model = c.model)"""


@query("prune_weak_levels", f"{BT}, {TOTALS}, {_prune_sql()} SELECT model, level_id, mae FROM l3 WHERE ok")
def _(spark, sf_dir):
    return weights.prune_weak_levels(cands(spark, sf_dir), ["model"], N)


FITTED = ("SeasonalAverage", "Theta")


def level_choice(spark, sf_dir):
    """Fold predictions of the best model of each level: levels then really differ."""
    bt = backtest(spark, sf_dir)
    best = models.best_model(models.leaderboard(bt, ["level_id"]), ["level_id"])
    return models.choose_forecasts(bt, best, ["level_id"], "Leaderboard")


def fitted(spark, sf_dir, method, n_sets=1):
    names = [*FITTED, "AutoETS"]
    c = weights.candidates(totals(spark, sf_dir, names), ["model"], N)
    return weights.fit_weights(c, ["model"], N, [method], n_sets=n_sets, rounds=200)




@query("w_nnls")
def _(spark, sf_dir):
    return fitted(spark, sf_dir, "optimize_nnls")


@query("w_differential_evolution")
def _(spark, sf_dir):
    return fitted(spark, sf_dir, "differential_evolution")


LOSS1 = f"""{BT}, {LBOARD}, {LEVEL_CHOICE},
    mtot AS (SELECT fold, level_id, ds, sum(y) AS y, sum(pred) AS pred FROM mix GROUP BY ALL),
    mc AS (SELECT t.ds, t.level_id, top.y AS y_top, t.y, t.pred FROM mtot t JOIN (SELECT ds, y FROM mtot WHERE level_id = 7) top ON t.ds = top.ds)"""


@query(
    "w_best_single_level",
    f"""{LOSS1}, l AS (SELECT level_id, CAST(sum(abs(y_top - pred)) AS DOUBLE) / count(*) AS loss FROM mc GROUP BY 1)
    SELECT 'Leaderboard' AS model, level_id, CAST(1 AS DOUBLE) AS weight, loss FROM l ORDER BY loss, 3 - bit_count(level_id), level_id LIMIT 1""",
)
def _(spark, sf_dir):
    c = weights.candidates(models.fold_totals(level_choice(spark, sf_dir)), ["model"], N)
    return weights.best_single_level(c, ["model"], N)


# greedy selection as a recursion: the state is the running sum per date, every round tries all levels; of the losses
# within the tie limit of the lowest the coarsest level wins
GREEDY = f"""v AS (SELECT level_id, 3 - bit_count(level_id) AS d, list(CAST(pred AS DOUBLE) ORDER BY ds) AS p, list(CAST(y_top AS DOUBLE) ORDER BY ds) AS y FROM mc GROUP BY level_id),
g AS (
  SELECT 0 AS r, -1 AS pick, list_transform(any_value(y), lambda x: CAST(0 AS DOUBLE)) AS s FROM v
  UNION ALL
  SELECT t.r, t.best.id, t.best.s FROM (
    SELECT b.r, list_sort(list_filter(b.o, lambda x: x.l <= list_min(list_transform(b.o, lambda z: z.l)) * (1 + {optimisers.TIE!r}::DOUBLE)))[1] AS best FROM (
      SELECT g.r + 1 AS r, list({{'d': v.d, 'id': v.level_id,
        'l': list_avg(list_transform(range(1, len(v.p) + 1), lambda i: abs(v.y[i] - (g.s[i] + v.p[i]) / (g.r + 1)))),
        's': list_transform(range(1, len(v.p) + 1), lambda i: g.s[i] + v.p[i])}}) AS o
      FROM g, v WHERE g.r < 200 GROUP BY g.r) b) t)"""


@query(
    "w_ensemble_selection",
    f"""{LOSS1.replace('WITH', 'WITH RECURSIVE', 1)}, {GREEDY}
    SELECT 'Leaderboard' AS model, 'ensemble_selection' AS optim_method, pick AS level_id, count(*) / 200 AS weight FROM g WHERE r > 0 GROUP BY pick""",
)
def _(spark, sf_dir):
    c = weights.candidates(models.fold_totals(level_choice(spark, sf_dir)), ["model"], N)
    return weights.fit_weights(c, ["model"], N, ["ensemble_selection"], rounds=200)


@query(
    "hillclimb_sets",
    f"""{BT}, {TOTALS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY ds) AS rk,
      (SELECT count(DISTINCT ds) FROM cand) AS n FROM cand)
    SELECT model, ds, level_id, CAST(least(floor((rk - 1) / floor(n / 5)), 4) AS INTEGER) AS set_id FROM r""",
)
def _(spark, sf_dir):
    return weights.validation_sets(cands(spark, sf_dir), ["model"], 5).select("model", "ds", "level_id", "set_id")


@query(
    "nan_weight_fallback",
    f"""{BT}, {TOTALS}, w AS (SELECT model, level_id, CASE WHEN model = 'Zero' THEN 0.0 ELSE level_id * 1.0 END AS weight FROM cand GROUP BY ALL)
    SELECT model, level_id, CASE WHEN model = 'Zero' THEN 1.0 / 8 ELSE CAST(weight AS DOUBLE) / 28 END AS weight FROM w WHERE model = 'Zero' OR level_id > 0""",
)
def _(spark, sf_dir):
    """Weights that are all zero become equal weights."""
    w = F.when(F.col("model") == "Zero", 0.0).otherwise(F.col("level_id").cast("double"))
    one = cands(spark, sf_dir).select("model", "level_id").distinct()
    return weights.average_sets(one.withColumn("weight", w), ["model"])


@query("equal_weights", f"{FC} SELECT model, level_id, 1.0 / count(*) OVER (PARTITION BY model) AS weight FROM (SELECT DISTINCT model, level_id FROM fc)")
def _(spark, sf_dir):
    return weights.equal_weights(forecasts(spark, sf_dir), ["model"])


@query(
    "common_keys",
    f"""{BT}, {TOTALS}, {_prune_sql()} SELECT model, CAST(bit_or(level_id) AS INTEGER) AS rolled FROM l3 WHERE ok GROUP BY model""",
)
def _(spark, sf_dir):
    kept = weights.prune_weak_levels(cands(spark, sf_dir), ["model"], N)
    return weights.common_keys(kept, ["model"])


# r_name alone and r_name x c_mktsegment: r_name is common
TWO_LEVELS = "SELECT model, level_id, CASE level_id WHEN 3 THEN 0.25 ELSE 0.75 END AS weight FROM (SELECT DISTINCT model, level_id FROM fc) WHERE level_id IN (1, 3)"


def two_levels(fc):
    w = F.when(F.col("level_id") == 3, 0.25).otherwise(0.75)
    return fc.filter("level_id in (1, 3)").select("model", "level_id").distinct().withColumn("weight", w)


NAIVES = ["Naive", "SeasonalNaive"]
FCN = f"{PANEL}, {ref.folds(H, H)}, {ref.horizon(KEYS, 12, H, H, NAIVES)}"


@query(
    "apply_weights",
    f"""{FCN}, w AS ({TWO_LEVELS}), p AS (SELECT fc.model, r_name, ds, sum(CAST(pred * weight AS DECIMAL(28,6))) AS pred
      FROM fc JOIN w ON fc.model = w.model AND fc.level_id = w.level_id GROUP BY ALL)
    SELECT model, CASE WHEN grouping(r_name) = 0 THEN 3 ELSE 7 END AS level_id, r_name, CAST(NULL AS VARCHAR) AS c_mktsegment,
      CAST(NULL AS VARCHAR) AS o_orderpriority, ds, CAST(sum(pred) AS DOUBLE) AS weighted_pred
    FROM p GROUP BY model, ds, CUBE(r_name)""",
)
def _(spark, sf_dir):
    fc = forecasts(spark, sf_dir, NAIVES)
    return weights.apply_weights(two_levels(fc), fc, KEYS, ["model"])


@query(
    "apply_equal_weights",
    f"""{FCN} SELECT model, 7 AS level_id, {", ".join(f"CAST(NULL AS VARCHAR) AS {k}" for k in KEYS)}, ds,
      CAST(sum(CAST(pred * 0.125 AS DECIMAL(28,6))) AS DOUBLE) AS equal_weights_pred FROM fc GROUP BY model, ds""",
)
def _(spark, sf_dir):
    fc = forecasts(spark, sf_dir, NAIVES)
    return weights.apply_weights(weights.equal_weights(fc, ["model"]), fc, KEYS, ["model"], name="equal_weights_pred")


BTN = f"{PANEL}, {ref.fold_forecasts(KEYS, 12, H, H, NAIVES)}"
LOSSES = """w AS (SELECT model, level_id, CASE WHEN level_id IN (1, 3, 7) THEN 0.25 ELSE 0.05 END AS weight FROM cand GROUP BY ALL),
d AS (SELECT c.model, c.ds, sum(CAST(c.pred * w.weight AS DECIMAL(28,6))) AS p, sum(CAST(c.y * w.weight AS DECIMAL(28,6))) AS a
  FROM cand c JOIN w ON c.model = w.model AND c.level_id = w.level_id GROUP BY ALL),
loss AS (SELECT model, CAST(sum(abs(p - a)) AS DOUBLE) / count(*) AS loss FROM d GROUP BY model)"""


def losses(spark, sf_dir):
    t = totals(spark, sf_dir, NAIVES)
    w = F.when(F.col("level_id").isin(1, 3, 7), 0.25).otherwise(0.05)
    sets = t.select("model", "level_id").distinct().withColumn("weight", w)
    return weights.weighted_loss(sets, t, ["model"])


@query("weighted_loss", f"{BTN}, {TOTALS}, {LOSSES} SELECT * FROM loss")
def _(spark, sf_dir):
    return losses(spark, sf_dir)


@query("sort_losses", f"{BTN}, {TOTALS}, {LOSSES} SELECT * FROM loss ORDER BY loss, model")
def _(spark, sf_dir):
    return weights.sort_losses(losses(spark, sf_dir), "model")


# every level of every model as a weight set of its own, matched with nation-free experiment settings
SETS = f"""sets AS (SELECT model || '_' || level_id AS weights_key, model, 'global' AS forecast_method,
      CASE WHEN model = 'Zero' THEN NULL ELSE 600 END AS time_limit, CASE WHEN level_id < 4 THEN 'ensemble_selection' ELSE 'optimize_nnls' END AS optim_method,
      mae AS loss FROM lboard),
fsets AS (SELECT DISTINCT 'F_' || model AS forecast_key, model, 'global' AS forecast_method, CASE WHEN model = 'Zero' THEN NULL ELSE 600 END AS time_limit FROM lboard)"""


def weight_sets(spark, sf_dir):
    board = models.leaderboard(backtest(spark, sf_dir), ["level_id"])
    limit = F.when(F.col("model") != "Zero", 600).alias("time_limit")
    optim = F.when(F.col("level_id") < 4, "ensemble_selection").otherwise("optimize_nnls").alias("optim_method")
    method = F.lit("global").alias("forecast_method")
    sets = board.select(
        F.concat_ws("_", "model", "level_id").alias("weights_key"), "model", method, limit, optim, F.col("mae").alias("loss")
    )
    fc = board.select(F.concat(F.lit("F_"), F.col("model")).alias("forecast_key"), "model", method, limit).distinct()
    return sets, fc


MATCH = f"""{BT}, {LBOARD}, {SETS}, m AS (SELECT s.model, s.forecast_method, s.time_limit, s.optim_method, weights_key, forecast_key, loss,
      row_number() OVER (PARTITION BY s.model, s.forecast_method, s.time_limit, s.optim_method ORDER BY loss, weights_key) AS r
    FROM sets s JOIN fsets f ON s.model = f.model AND s.forecast_method = f.forecast_method AND s.time_limit IS NOT DISTINCT FROM f.time_limit)
    SELECT model, forecast_method, time_limit, optim_method, weights_key, forecast_key, loss FROM m WHERE r = 1"""


@query("match_weights_forecasts", MATCH)
def _(spark, sf_dir):
    sets, fc = weight_sets(spark, sf_dir)
    return weights.match_weights_forecasts(sets, fc, ["model", "forecast_method", "time_limit"])


@query(
    "best_per_match",
    f"""{BT}, {LBOARD}, {SETS} SELECT model, 'F_' || model AS forecast_key, arg_min(weights_key, loss) AS weights_key, min(loss) AS loss FROM sets GROUP BY model""",
)
def _(spark, sf_dir):
    sets, fc = weight_sets(spark, sf_dir)
    return weights.match_weights_forecasts(sets, fc, ["model"], extra=()).select("model", "forecast_key", "weights_key", "loss")


@query("fit_weights")
def _(spark, sf_dir):
    """All optimisers, with and without pruning, for models that differ between levels."""
    cfg = experiment.Settings(remove_groups=(False, True), max_iterations=200)
    bt = backtest(spark, sf_dir, ["SeasonalAverage", "Theta"]).withColumn("forecast_method", F.lit("global"))
    bt = bt.unionByName(level_choice(spark, sf_dir).withColumn("forecast_method", F.lit("level")))
    return experiment.fit(bt, inputs.CROSSED, cfg)


# ---- reconciliation ----


@query(
    "rec_bottom_up",
    f"""{FC} SELECT model, CAST(grouping({K}) AS INTEGER) AS level_id, {K}, ds, CAST(sum(pred) AS DOUBLE) AS pred
    FROM fc WHERE level_id = 0 GROUP BY model, ds, CUBE({K})""",
)
def _(spark, sf_dir):
    return reconcile.bottom_up(forecasts(spark, sf_dir), KEYS, ["model"])


# the mix of models by level is not coherent, so reconciliation has something to do
MIX = f"""{PANEL}, {ref.folds(H, H)}, {ref.horizon(KEYS, 12, H, H, ['SeasonalNaive', 'Naive'])},
mixed AS (SELECT 'mixed' AS model, {S}, ds, pred FROM fc WHERE model = CASE WHEN bit_count(level_id) % 2 = 0 THEN 'SeasonalNaive' ELSE 'Naive' END)"""


def mixed_forecasts(spark, sf_dir):
    want = F.when(F.bit_count("level_id") % 2 == 0, "SeasonalNaive").otherwise("Naive")
    fc = forecasts(spark, sf_dir, NAIVES).filter(F.col("model") == want)
    return fc.withColumn("model", F.lit("mixed"))


def _mint_query(name: str, method: str):
    sql = f"{MIX}, {ref.mint(KEYS, ['model'], method, 'mixed', 'rec')} SELECT model, {S}, ds, round(pred, 3) + 0.0 AS pred FROM rec"

    @query(name, sql)
    def _(spark, sf_dir):
        out = reconcile.mint_balanced(mixed_forecasts(spark, sf_dir), KEYS, ["model"], method)
        return out.withColumn("pred", F.round("pred", 3) + 0.0)  # no negative zero


_mint_query("rec_ols", "ols")
_mint_query("rec_wls_struct", "wls_struct")


@query(
    "reconcile_all",
    f"""{MIX}, {ref.mint(KEYS, ['model'], 'ols', 'mixed', 'r_ols')}, {ref.mint(KEYS, ['model'], 'wls_struct', 'mixed', 'r_wls')},
    r_bu AS (SELECT model, CAST(grouping({K}) AS INTEGER) AS level_id, {K}, ds, sum(pred) AS pred FROM mixed WHERE level_id = 0 GROUP BY model, ds, CUBE({K}))
    SELECT 'MinTrace_method-ols' AS method, model, {S}, ds, round(pred, 3) + 0.0 AS pred FROM r_ols
    UNION ALL SELECT 'MinTrace_method-wls_struct', model, {S}, ds, round(pred, 3) + 0.0 FROM r_wls
    UNION ALL SELECT 'BottomUp', model, {S}, ds, round(CAST(pred AS DOUBLE), 3) + 0.0 FROM r_bu""",
)
def _(spark, sf_dir):
    out = reconcile.reconcile_all(mixed_forecasts(spark, sf_dir), KEYS, ["model"], True)
    return out.withColumn("pred", F.round(F.col("pred").cast("double"), 3) + 0.0)


# Where every region has as many nations and every nation every segment (as on all but the smallest data) the
# nested solution has a closed form: means over region, nation and segment, each contrast scaled by its eigenvalue.
NS = ["level_id", *NKEYS]
NESTED = f"""WITH {ref.panel(NKEYS)}, {ref.folds(H, H)}, {ref.horizon(NKEYS, 12, H, H, NAIVES)},
mx AS (SELECT {", ".join(NS)}, ds, CAST(pred AS DOUBLE) AS pred FROM fc WHERE model = CASE WHEN bit_count(level_id) % 2 = 0 THEN 'SeasonalNaive' ELSE 'Naive' END),
size AS (SELECT {NK}, CAST(grouping({NK}) AS INTEGER) AS level_id, count(*) AS n FROM dim GROUP BY CUBE({NK})),
w AS (SELECT mx.*, mx.pred / size.n AS v FROM mx JOIN size ON {ref.null_join('mx', 'size', NS)}),
leafs AS (SELECT d.*, c.ds FROM dim d CROSS JOIN (SELECT DISTINCT ds FROM mx) c),
z AS (SELECT l.r_name, l.n_name, l.c_mktsegment, l.ds, sum(v) AS z FROM leafs l JOIN w ON w.ds = l.ds AND (w.r_name IS NULL OR w.r_name = l.r_name)
  AND (w.n_name IS NULL OR w.n_name = l.n_name) AND (w.c_mktsegment IS NULL OR w.c_mktsegment = l.c_mktsegment) GROUP BY ALL),
m AS (SELECT *, avg(z) OVER (PARTITION BY ds) AS m0, avg(z) OVER (PARTITION BY ds, r_name) AS mr, avg(z) OVER (PARTITION BY ds, n_name) AS mn,
  avg(z) OVER (PARTITION BY ds, c_mktsegment) AS ms, avg(z) OVER (PARTITION BY ds, r_name, c_mktsegment) AS mrs FROM z),
b AS (SELECT *, m0 / 8 + (mr - m0) / 6 + (mn - mr) / 4 + (ms - m0) / 4 + (mrs - mr - ms + m0) / 3 + (z - mrs - mn + mr) / 2 AS pred FROM m)"""


@query(
    "rec_nested_cg",
    f"""{NESTED} SELECT 'mixed' AS model, CAST(grouping({NK}) AS INTEGER) AS level_id, {NK}, ds, round(sum(pred) + 0.0123456, 0) AS pred
    FROM b GROUP BY ds, CUBE({NK})""",
)
def _(spark, sf_dir):
    """Nested keys repeat levels, so passes over single keys do not solve it: conjugate gradients."""
    panel = calendar.prepare_panel(inputs.nested_rows(spark, sf_dir), NKEYS, "ME", with_id=False)
    arrays = models.series_arrays(hierarchy.cube_levels(panel, NKEYS), NS)
    fc = models.create_forecasts(arrays, NS, NAIVES, H, "ME", 12, H)
    want = F.when(F.bit_count("level_id") % 2 == 0, "SeasonalNaive").otherwise("Naive")
    mixed = fc.filter(F.col("model") == want).withColumn("model", F.lit("mixed"))
    out = reconcile.mint_cg(mixed, NKEYS, ["model"], "wls_struct")
    return out.withColumn("pred", F.round(F.col("pred") + 0.0123456, 0))  # shifted away from exact halves


# ---- results and accuracy ----

TOP = f"""{ALL}, top AS (SELECT l.ds, m.model, l.y, f.pred AS base, b.pred AS "BottomUp"
    FROM (SELECT ds, y FROM levels WHERE level_id = 7) l CROSS JOIN (SELECT DISTINCT model FROM fc) m
    LEFT JOIN (SELECT model, ds, pred FROM fc WHERE level_id = 7) f ON f.model = m.model AND f.ds = l.ds
    LEFT JOIN (SELECT model, ds, sum(pred) AS pred FROM fc WHERE level_id = 0 GROUP BY ALL) b ON b.model = m.model AND b.ds = l.ds)"""


def top_results(spark, sf_dir, names=BASELINES):
    """Whole history of the top series with base and bottom-up forecasts of every model."""
    fc = forecasts(spark, sf_dir, names).filter("level_id in (0, 7)")
    level = F.col("level_id")
    both = fc.groupBy("model", "ds").agg(
        F.max(F.when(level == 7, F.col("pred"))).alias("base"), F.sum(F.when(level == 0, F.col("pred"))).alias("BottomUp")
    )
    actual = crossed_levels(spark, sf_dir).filter("level_id = 7").select("ds", "y")
    runs = actual.select(F.explode(F.array(*[F.lit(m) for m in names])).alias("model"), "ds", "y")
    return runs.join(both, ["model", "ds"], "left")


ON = ["model", *SERIES, "ds"]


@query(
    "join_weighted_reconciled",
    f"""{FCN}, w AS ({TWO_LEVELS}), p AS (SELECT fc.model, r_name, ds, sum(CAST(pred * weight AS DECIMAL(28,6))) AS pred
      FROM fc JOIN w ON fc.model = w.model AND fc.level_id = w.level_id GROUP BY ALL),
    wt AS (SELECT model, CASE WHEN grouping(r_name) = 0 THEN 3 ELSE 7 END AS level_id, r_name, ds, sum(pred) AS pred FROM p GROUP BY model, ds, CUBE(r_name)),
    eq AS (SELECT model, ds, sum(CAST(pred * 0.125 AS DECIMAL(28,6))) AS pred FROM fc GROUP BY model, ds),
    bu AS (SELECT model, CAST(grouping({K}) AS INTEGER) AS level_id, {K}, ds, sum(pred) AS pred FROM fc WHERE level_id = 0 GROUP BY model, ds, CUBE({K}))
    SELECT m.model, {", ".join("l." + c for c in SERIES)}, l.ds, CAST(l.y AS DOUBLE) AS y, CAST(fc.pred AS DOUBLE) AS base, CAST(bu.pred AS DOUBLE) AS "BottomUp",
      CAST(wt.pred AS DOUBLE) AS weighted_pred, CAST(eq.pred AS DOUBLE) AS equal_weights_pred
    FROM levels l CROSS JOIN (SELECT DISTINCT model FROM fc) m
    LEFT JOIN fc ON fc.model = m.model AND fc.ds = l.ds AND {ref.null_join('fc', 'l', SERIES)}
    LEFT JOIN bu ON bu.model = m.model AND bu.ds = l.ds AND {ref.null_join('bu', 'l', SERIES)}
    LEFT JOIN wt ON wt.model = m.model AND wt.ds = l.ds AND wt.level_id = l.level_id AND wt.r_name IS NOT DISTINCT FROM l.r_name
    LEFT JOIN eq ON eq.model = m.model AND eq.ds = l.ds AND l.level_id = 7""",
)
def _(spark, sf_dir):
    """Actuals of the whole history with base, bottom-up, weighted and equal-weight forecasts of every node."""
    fc = forecasts(spark, sf_dir, NAIVES)
    runs = F.explode(F.array(*[F.lit(m) for m in NAIVES])).alias("model")
    frames = {
        "y": crossed_levels(spark, sf_dir).select(runs, *SERIES, "ds", "y"),
        "base": fc.select(*ON, "pred"),
        "BottomUp": reconcile.bottom_up(fc, KEYS, ["model"]),
        "weighted_pred": weights.apply_weights(two_levels(fc), fc, KEYS, ["model"]),
        "equal_weights_pred": weights.apply_weights(weights.equal_weights(fc, ["model"]), fc, KEYS, ["model"]),
    }
    return joins.merge_methods(frames, ON)


@query(
    "metric_slices",
    f"{PANEL} SELECT ds, CASE WHEN r > 15 THEN 'train' WHEN r > 3 THEN 'test' END AS part FROM (SELECT ds, row_number() OVER (ORDER BY ds DESC) AS r FROM levels WHERE level_id = 7)",
)
def _(spark, sf_dir):
    """A horizon of 15 periods of which the first 12 have known actuals."""
    top = crossed_levels(spark, sf_dir).filter("level_id = 7")
    return metrics.metric_slices(top, ["level_id"], 12, 15).select("ds", "part")


SCORES = f"""{TOP}, long AS (SELECT model, ds, y, 'base' AS method, base AS pred FROM top UNION ALL SELECT model, ds, y, 'BottomUp', "BottomUp" FROM top),
    train AS (SELECT CAST(y - lag(y) OVER (ORDER BY ds) AS DOUBLE) AS d FROM levels WHERE level_id = 7 AND ds IN (SELECT ds FROM dates WHERE i <= (SELECT n FROM train_n))),
    scale AS (SELECT avg(abs(d)) AS mae_scale, avg(d * d) AS mse_scale FROM train),
    e AS (SELECT model, method, count(*) AS n, CAST(sum(abs(y - pred)) AS DOUBLE) AS ae, sum(CAST(y - pred AS DOUBLE) ^ 2) AS se,
        sum(2 * CAST(abs(y - pred) AS DOUBLE) / (CAST(abs(y) AS DOUBLE) + CAST(abs(pred) AS DOUBLE))) AS sm, CAST(sum(abs(y)) AS DOUBLE) AS ay
      FROM long WHERE pred IS NOT NULL AND ds IN (SELECT ds FROM dates WHERE i > (SELECT n FROM train_n)) GROUP BY ALL),
    scores AS (SELECT model, method, unnest(['MASE', 'WAPE', 'RMSSE', 'SMAPE']) AS metric,
      unnest([ae / n / mae_scale, ae / ay, sqrt(se / n / mse_scale), sm / n]) AS value FROM e, scale)"""


def scores(spark, sf_dir, names=BASELINES):
    return metrics.score(top_results(spark, sf_dir, names), ["model"], ["base", "BottomUp"], H, H)


def _metric_query(name: str, metric: str):
    @query(name, f"{SCORES} SELECT model, method, round(value, 9) AS {metric.lower()} FROM scores WHERE metric = '{metric}'")
    def _(spark, sf_dir):
        out = metrics.score(top_results(spark, sf_dir), ["model"], ["base", "BottomUp"], H, H, [metric])
        return out.select("model", "method", F.round("value", 9).alias(metric.lower()))


for _m in metrics.METRICS:
    _metric_query(_m.lower(), _m)


@query("mae", f"{BT}, {TOTALS} SELECT model, level_id, CAST(sum(abs(y - pred)) AS DOUBLE) / count(*) AS mae FROM cand GROUP BY ALL")
def _(spark, sf_dir):
    return weights.level_errors(cands(spark, sf_dir), ["model"])


@query(
    "metrics_table",
    f"""{SCORES} SELECT model || '_global_600_none' AS "Model", 'none' AS optim_method, 'global' AS forecast_method, model AS forecast_model,
      CAST(NULL AS DOUBLE) AS elapsed_time, method, metric, 'crossed' AS dataset, 'private' AS dataset_type, 600 AS time_limit, round(value, 9) AS value FROM scores""",
)
def _(spark, sf_dir):
    tags = {"dataset": F.lit("crossed"), "forecast_method": F.lit("global"), "time_limit": F.lit(600), "optim_method": F.lit("none")}
    by = ["dataset", "model", "forecast_method", "time_limit", "optim_method"]
    top = top_results(spark, sf_dir).withColumns(tags)
    out = metrics.metrics_table(top, by, H, H, private=["crossed"], methods=["base", "BottomUp"])
    return out.withColumn("value", F.round("value", 9))


@query(
    "score_top",
    f"""{SCORES} SELECT method, metric, round(value, 9) AS value FROM scores WHERE model = 'SeasonalAverage'""",
)
def _(spark, sf_dir):
    """Panel, levels, seasonal average, accuracy: the shortest complete run."""
    out = scores(spark, sf_dir, ["SeasonalAverage"])
    return out.select("method", "metric", F.round("value", 9).alias("value"))


def experiment_metrics(spark, sf_dir, cfg):
    store = ArtifactStore(spark, scratch(spark))
    raw = inputs.crossed_rows(spark, sf_dir)
    return experiment.run_experiment(raw, inputs.CROSSED, cfg, store=store)["metrics"]


@query(
    "run_experiment_seasonal",
    f"""{SCORES} SELECT 'SeasonalAverage_global_600_' || o AS "Model", o AS optim_method, 'global' AS forecast_method, 'SeasonalAverage' AS forecast_model,
      m AS method, metric, 'crossed' AS dataset, 'public' AS dataset_type, 600 AS time_limit, round(value, 6) AS value
    FROM scores, (SELECT unnest({list(metrics.METHODS)}) AS m), (SELECT unnest(['ensemble_selection', 'optimize_nnls']) AS o)
    WHERE model = 'SeasonalAverage' AND method = 'base'""",
)
def _(spark, sf_dir):
    """The whole run for a linear model: sums of averages are averages of sums, so every level tells the
    same total and every method must reach the same accuracy."""
    cfg = experiment.Settings(time_limit=600, optim_methods=("ensemble_selection", "optimize_nnls"))
    out = experiment_metrics(spark, sf_dir, cfg)
    return out.withColumn("value", F.round("value", 6)).drop("elapsed_time")


@query("run_experiment")
def _(spark, sf_dir):
    """Everything for one dataset, ending in its metrics table."""
    cfg = experiment.Settings(
        models=("SeasonalAverage", "Theta", experiment.LEADERBOARD), forecast_methods=("global", "level"),
        remove_groups=(False, True), time_limit=600,
    )
    return experiment_metrics(spark, sf_dir, cfg)


# ---- what holds for models and searches that have no SQL twin ----

SEARCHED = ("Theta", "HoltWinters", "AutoETS", "AutoARIMA")


@query(
    "searched_models_cover",
    f"""{PANEL}, {ref.folds(H, H)}, names AS (SELECT unnest({[*SEARCHED, "PooledLags"]}) AS model)
    SELECT model, level_id, count(*) AS n_rows, count(*) AS n_finite FROM levels l JOIN dates d ON l.ds = d.ds, names
    WHERE d.i > (SELECT n FROM train_n) GROUP BY model, level_id""",
)
def _(spark, sf_dir):
    """Every series of every level gets a finite forecast for every held-out month."""
    some = forecasts(spark, sf_dir, SEARCHED).select("model", *SERIES, "ds", "pred")
    lags = pooled_forecasts(spark, sf_dir, "global").select(F.lit("PooledLags").alias("model"), *SERIES, "ds", "pred")
    value = F.col("pred").cast("double")
    finite = F.count(F.when(F.abs(value) < F.lit(float("inf")), value))
    return some.unionByName(lags).groupBy("model", "level_id").agg(F.count("*").alias("n_rows"), finite.alias("n_finite"))


def seasonal_histories(spark, sf_dir):
    """A multiplicative year and a trend on the mean of each series, with a fifth of its own ups and downs; last year
    held out."""
    total = F.aggregate("y", F.lit(0.0), lambda a, v: a + v.cast("double"))
    arrays = crossed_arrays(spark, sf_dir).withColumn("_mean", total / F.size("y"))
    calm = lambda v: 0.8 * F.col("_mean") + 0.2 * v.cast("double")
    wave = F.transform("y", lambda v, i: calm(v) * (1 + 0.02 * i) * (1 + 0.5 * F.sin(i * F.lit(3.141592653589793 / 6))))
    return models.hold_out(arrays.withColumn("y", wave), SERIES, H)


@query(
    "searched_models_follow",
    f"""{PANEL} SELECT model, level_id, true AS follows FROM (SELECT unnest(['AutoETS', 'AutoARIMA', 'HoltWinters']) AS model),
      (SELECT DISTINCT level_id FROM levels WHERE level_id > 0)""",
)
def _(spark, sf_dir):
    """On sums with a clear season and trend, the held-out error of each searched model is below 0.7 of that of the mean
    of the history, at every level above the leaves."""
    names = ["AutoETS", "AutoARIMA", "HoltWinters", "Average"]
    held = models.dealt(seasonal_histories(spark, sf_dir).filter("level_id > 0"), names, SERIES)
    kind = held.schema["y"].dataType.elementType
    preds = [models.predict(m, F.col("y"), H, 12, kind).alias(m) for m in names]
    off = lambda m: F.aggregate(F.zip_with("y_test", m, lambda y, p: F.abs(y - p.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    errors = held.select("level_id", "y_test", *preds).groupBy("level_id").agg(*[F.sum(off(m)).alias(m) for m in names])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) < 0.7 * F.col("Average")).alias("follows")) for m in names[:-1]])
    return errors.select("level_id", F.inline(rows)).select("model", "level_id", "follows")


@query(
    "searched_rows_agree",
    f"""{PANEL} SELECT model, level_id, count(DISTINCT concat_ws('|', {S})) AS n_series, count(DISTINCT concat_ws('|', {S})) AS n_equal
    FROM levels, (SELECT unnest(['AutoETS', 'AutoARIMA']) AS model) WHERE level_id > 0 GROUP BY model, level_id""",
)
def _(spark, sf_dir):
    """A search as rows of (series, candidate) forecasts what the search of whole batches does."""
    held = models.hold_out(crossed_arrays(spark, sf_dir), SERIES, H).filter("level_id > 0").select(*SERIES, "y")
    kind = held.schema["y"].dataType.elementType
    out = []
    for name in ("AutoETS", "AutoARIMA"):
        whole = models.dealt(held, [name], SERIES).select(*SERIES, models.predict(name, F.col("y"), H, 12, kind).alias("pred"), F.lit(0).alias("way"))
        rows = models.searched_rows(held, SERIES, "y", name, H, 12).withColumn("way", F.lit(1))
        both = whole.unionByName(rows).groupBy(*SERIES).agg(F.max_by("pred", "way").alias("a"), F.min_by("pred", "way").alias("b"))
        near = F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y) <= 0.001 + 1e-6 * F.abs(y)), lambda ok: ok)
        out.append(both.groupBy("level_id").agg(F.count("*").alias("n_series"), F.count(F.when(near, 1)).alias("n_equal")).withColumn("model", F.lit(name)))
    return out[0].unionByName(out[1]).select("model", "level_id", "n_series", "n_equal")


@query(
    "weights_sound",
    f"""SELECT model, optim_method, CAST(1 AS DOUBLE) AS total, true AS in_range, true AS known_levels
    FROM (SELECT unnest({[*FITTED, "AutoETS"]}) AS model), (SELECT unnest({list(optimisers.METHODS)}) AS optim_method)""",
)
def _(spark, sf_dir):
    """The weights of each search sum to one, lie in (0, 1] and belong to levels of the panel."""
    c = weights.candidates(totals(spark, sf_dir, [*FITTED, "AutoETS"]), ["model"], N)
    w = weights.fit_weights(c, ["model"], N, optimisers.METHODS, rounds=200)
    return w.groupBy("model", "optim_method").agg(
        F.round(F.sum("weight"), 9).alias("total"),
        F.bool_and((F.col("weight") > 0) & (F.col("weight") <= 1 + 1e-9)).alias("in_range"),
        F.bool_and(F.col("level_id").between(0, (1 << N) - 1)).alias("known_levels"),
    )


@query(
    "pooled_equations_hold",
    f"""{PANEL}, {ref.folds(H, H)} SELECT level_id, true AS solved FROM (SELECT DISTINCT level_id FROM levels)""",
)
def _(spark, sf_dir):
    """The coefficients of each level's pooled model leave residuals that no lag explains: the normal equations hold."""
    lags = [1, 2, 3, 12]
    train = models.hold_out(crossed_arrays(spark, sf_dir), SERIES, H)
    rows = pooled.lag_features(train, ["level_id"], "y", lags)
    coefs = pooled.solve(pooled.gram(rows, ["level_id"], 5), ["level_id"], 5)
    fit = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    resid = rows.join(coefs, "level_id").withColumn("e", F.col("z") - fit)
    sums = [F.abs(F.sum(F.col("e") * F.col("x")[i])) / F.sum(F.abs(F.col("z") * F.col("x")[i])) for i in range(5)]
    return resid.groupBy("level_id").agg((F.greatest(*sums) < 1e-4).alias("solved"))


@query(
    "direct_equations_hold",
    f"""{PANEL}, {ref.folds(H, H)} SELECT level_id, CAST(unnest(generate_series(1, {H})) AS INTEGER) AS step, true AS solved FROM (SELECT DISTINCT level_id FROM levels)""",
)
def _(spark, sf_dir):
    """Each level's and step's residuals, on rows written out one by one, are explained by no lag: the normal equations
    that were put together from sums hold."""
    train = models.hold_out(crossed_arrays(spark, sf_dir), SERIES, H)
    k = 5
    coded = direct.with_codes(direct.step_sums(train, SERIES, "y", H, 12, 3), ["level_id"], KEYS)
    coefs = pooled.solve(direct.normal_equations(coded, ["level_id"], k, len(KEYS)), ["level_id", "step"], k + len(KEYS))
    size = F.greatest(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size("v"), F.lit(1e-9))
    v = train.withColumn("v", F.col("y").cast("array<double>")).withColumn("v", F.transform("v", lambda x: x / size)).select(*SERIES, "v")
    v = v.join(coded.select(*SERIES, "step", "codes").withColumnsRenamed({c: f"c_{c}" for c in SERIES}), models_on("", "c_", SERIES))
    rows = v.withColumn("t", F.explode(F.sequence(F.lit(12), F.size("v") - F.col("step"))))
    at = lambda back: F.element_at("v", F.col("t") - back)
    x = F.concat(F.array(at(0), at(1), at(2), at(F.lit(12) - F.col("step")), F.lit(1.0)), F.col("codes"))
    rows = rows.select("level_id", "step", x.alias("x"), F.element_at("v", F.col("t") + F.col("step")).alias("z"))
    fit = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    resid = rows.join(coefs, ["level_id", "step"]).withColumn("e", F.col("z") - fit)
    sums = [F.abs(F.sum(F.col("e") * F.col("x")[i])) / F.sum(F.abs(F.col("z") * F.col("x")[i])) for i in range(k)]
    return resid.groupBy("level_id", "step").agg((F.greatest(*sums) < 1e-4).alias("solved"))


@query(
    "boosting_lowers_loss",
    f"""{PANEL} SELECT level_id, CAST(unnest(generate_series(1, 3)) AS INTEGER) AS round, true AS lower FROM (SELECT DISTINCT level_id FROM levels)""",
)
def _(spark, sf_dir):
    """Each round of boosting lowers the squared error of every level's trees."""
    train = models.hold_out(crossed_arrays(spark, sf_dir), SERIES, H)
    _, losses = boosted.boosted_forecast(train, SERIES, "y", H, 12, KEYS, "level", rounds=3)
    rows = [(level, k, bool(losses[k, level] < losses[k - 1, level])) for k in range(1, 4) for level in range(losses.shape[1])]
    return spark.createDataFrame(rows, "level_id int, round int, lower boolean")


def models_on(left: str, right: str, cols):
    """Null-safe equality of columns that differ by a prefix."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}"))
    return cond


@query(
    "run_experiment_grid",
    f"""SELECT model AS forecast_model, way AS forecast_method, optim_method, metric, 6 AS n_methods, 6 AS n_values
    FROM (VALUES ('SeasonalAverage', 'global'), ('Theta', 'global'), ('Leaderboard', 'global'), ('Leaderboard', 'level')) a(model, way),
      (SELECT unnest({list(optimisers.METHODS)}) AS optim_method), (SELECT unnest(['MASE', 'WAPE', 'RMSSE', 'SMAPE']) AS metric)""",
)
def _(spark, sf_dir):
    """A whole run scores every method of every experiment in every metric."""
    cfg = experiment.Settings(models=("SeasonalAverage", "Theta", experiment.LEADERBOARD), forecast_methods=("global", "level"))
    out = experiment_metrics(spark, sf_dir, cfg).groupBy("forecast_model", "forecast_method", "optim_method", "metric")
    return out.agg(F.count_distinct("method").cast("int").alias("n_methods"), F.count("value").cast("int").alias("n_values"))
