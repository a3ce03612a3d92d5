"""The whole run on the given tables, reuse of stored stages, and user models."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.operators import folds, models, weights
from stratocast.plans import experiment, inputs
from stratocast.sources.store import ArtifactStore

SF = "/root/testdata/sf0.01"
CFG = experiment.Settings(models=("SeasonalAverage", experiment.LEADERBOARD), forecast_methods=("global", "level"), remove_groups=(False, True))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    store = ArtifactStore(spark, str(tmp_path_factory.mktemp("store")))
    raw = inputs.crossed_rows(spark, SF)
    return experiment.stored(store, raw, inputs.CROSSED, CFG, "v1"), experiment.run_experiment(raw, inputs.CROSSED, CFG, store=store, version="v1")


def test_sizes(run):
    _, out = run
    assert out["levels"].count() == 17280
    assert out["fold_forecasts"].groupBy("model", "forecast_method").count().filter("count != 2 * 12 * 216").count() == 0
    # 3 ways of training x 3 optimisers x 6 methods x 4 metrics
    assert out["metrics"].count() == 216
    assert out["metrics"].filter("value is null").count() == 0


def test_weights_sum_to_one(run):
    _, out = run
    by = ["model", "forecast_method", "optim_method", "remove_groups"]
    bad = out["weights"].groupBy(*by).agg(F.sum("weight").alias("w"), F.min("weight").alias("lo"))
    assert bad.filter("abs(w - 1) > 1e-9 or lo < 0").count() == 0


def test_methods_are_coherent(run):
    _, out = run
    c = out["combined"].filter("method in ('BottomUp', 'MinTrace_method-ols', 'MinTrace_method-wls_struct')")
    sums = c.groupBy("model", "forecast_method", "method", "level_id", "ds").agg(F.sum("pred").alias("s"))
    spread = sums.groupBy("model", "forecast_method", "method", "ds").agg((F.max("s") - F.min("s")).alias("gap"), F.count("*").alias("n"))
    assert spread.filter("gap > 0.001 or n != 8").count() == 0


def test_linear_model_agrees_on_all_levels(run):
    """Averages are linear: every method gives the base forecast of the total."""
    _, out = run
    v = out["metrics"].filter("forecast_model = 'SeasonalAverage' and metric = 'WAPE'")
    lo, hi = v.agg(F.min("value"), F.max("value")).first()
    assert 0 < lo < 0.2 and hi - lo < 1e-9, lo


def test_stored_stages_are_reused(spark, run):
    store, out = run
    files = sorted(store.read("crossed/levels").inputFiles())
    whole = ArtifactStore(spark, store.root.rpartition("/")[0])
    again = experiment.run_experiment(inputs.crossed_rows(spark, SF), inputs.CROSSED, CFG, balanced=True, store=whole, version="v1")
    assert sorted(store.read("crossed/levels").inputFiles()) == files
    assert again["metrics"].exceptAll(out["metrics"]).count() == 0


def test_runs_with_other_settings_or_input_are_kept_apart(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))
    raw = inputs.crossed_rows(spark, "/root/testdata/sf0.001")
    cfg = lambda *names: experiment.Settings(models=names, test_period=6, optim_methods=("optimize_nnls",))
    names = lambda out: {r.model for r in out["forecasts"].select("model").distinct().collect()}
    for wanted in (("SeasonalAverage",), ("Naive",), ("Naive", "Zero")):
        assert names(experiment.run_experiment(raw, inputs.CROSSED, cfg(*wanted), balanced=False, store=store, version="a")) == set(wanted)
    assert store.of(1) .root != store.of(2).root
    part = store.of("rerun")
    rows = spark.createDataFrame([("d", m, "global", 1.0) for m in ("a", "b")], "dataset string, model string, forecast_method string, y double")
    part.reuse("x", lambda: rows)
    assert part.reuse("x", lambda: rows.filter("model = 'a'"), rerun=True).count() == 1


def test_unfinished(spark, run):
    store, _ = run
    grid = spark.createDataFrame([("SeasonalAverage", "global"), ("AutoETS", "global")], "model string, forecast_method string")
    left = store.unfinished("crossed/forecasts", grid, ["model", "forecast_method"])
    assert [r.model for r in left.collect()] == ["AutoETS"]
    assert store.unfinished("crossed/nothing", grid, ["model"]).count() == 2


def test_results_do_not_depend_on_partitioning(spark):
    raw = inputs.crossed_rows(spark, SF)
    outs = []
    for n in (1, 13):
        levels = experiment.build_levels(raw.repartition(n), inputs.CROSSED, CFG)
        arrays = models.series_arrays(levels, experiment.series_cols(inputs.CROSSED))
        fc = models.create_forecasts(arrays, experiment.series_cols(inputs.CROSSED), ["SeasonalAverage", "Theta"], 12, "ME", 12, 12)
        outs.append({tuple(r) for r in models.collapse_forecast(fc, ["model"]).collect()})
    assert outs[0] == outs[1]


def test_user_model(spark):
    models.register_model("LastTwice", lambda y, h, m: np.repeat(2 * y[:, -1:], h, axis=1))
    rows = [("a", [datetime.date(2020, 1, 31)], [3.0]), ("b", [datetime.date(2020, 1, 31), datetime.date(2020, 2, 29)], [1.0, 5.0])]
    df = spark.createDataFrame(rows, "k string, ds array<date>, y array<double>")
    got = {(r.k, r.ds): float(r.pred) for r in models.forecast_horizon(df, ["k"], ["LastTwice"], 2, "ME", 12).collect()}
    assert got == {("a", datetime.date(2020, 2, 29)): 6.0, ("a", datetime.date(2020, 3, 31)): 6.0, ("b", datetime.date(2020, 3, 31)): 10.0, ("b", datetime.date(2020, 4, 30)): 10.0}
    with pytest.raises(ValueError):
        models.forecast_horizon(df, ["k"], ["NoSuchModel"], 2, "ME", 12)


def test_prune_by_hand(spark):
    """Depth 0 error 4; depth 1 errors 2 and 5 (5 > 4 dropped); mean of 4 and 2 is 3, so depth 0 goes too;
    depth 2 error 2.5 > 2 is dropped."""
    day = datetime.date(2020, 1, 31)
    rows = [("m", day, 3, 10.0, 10.0, 14.0), ("m", day, 1, 10.0, 10.0, 12.0), ("m", day, 2, 10.0, 10.0, 15.0), ("m", day, 0, 10.0, 10.0, 12.5)]
    c = spark.createDataFrame(rows, "model string, ds date, level_id int, y_top double, y double, pred double")
    assert [r.level_id for r in weights.prune_weak_levels(c, ["model"], 2).collect()] == [1]


def test_one_round_is_the_best_single_level(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(12):
        day = datetime.date(2020, 1, 1) + datetime.timedelta(i)
        y = float(rng.random() * 100)
        rows += [("m", day, lv, y, y, float(y + rng.normal() * (lv + 1))) for lv in range(4)]
    c = spark.createDataFrame(rows, "model string, ds date, level_id int, y_top double, y double, pred double")
    one = weights.fit_weights(c, ["model"], 2, ["ensemble_selection"], rounds=1).select("level_id", "weight")
    best = weights.best_single_level(c, ["model"], 2).select("level_id", "weight")
    assert one.collect() == best.collect()
    for sets in (1, 5):
        w = weights.fit_weights(c, ["model"], 2, n_sets=sets)
        assert w.groupBy("optim_method").agg(F.round(F.sum("weight"), 9).alias("s")).filter("s != 1").count() == 0
    with pytest.raises(ValueError):
        weights.fit_weights(c, ["model"], 2, ["magic"])


def test_match_nulls_and_ties(spark):
    w = spark.createDataFrame(
        [("w1", "a", None, "es", 2.0), ("w2", "a", None, "es", 1.0), ("w3", "a", None, "es", 1.0), ("w4", "a", 600, "es", 0.5), ("w5", "b", 600, "es", None)],
        "weights_key string, model string, time_limit int, optim_method string, loss double",
    )
    f = spark.createDataFrame([("f1", "a", None), ("f2", "b", 600)], "forecast_key string, model string, time_limit int")
    got = weights.match_weights_forecasts(w, f, ["model", "time_limit"]).orderBy("model").collect()
    assert [(r.weights_key, r.forecast_key) for r in got] == [("w2", "f1"), ("w5", "f2")]


def test_fold_rows_mark_train_and_test(spark):
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(20)]
    panel = spark.createDataFrame([(x, 1.0) for x in days], "ds date, y double")
    got = folds.fold_rows(panel, folds.fold_table(panel, 4)).groupBy("fold", "is_test").count().collect()  # floor(20*.45/4) = 2
    assert {(r.fold, r.is_test): r["count"] for r in got} == {(1, False): 12, (1, True): 4, (2, False): 16, (2, True): 4}


def test_models_that_series_share(spark):
    """Each of them covers every series, fold and date, alone or per level, and ends in scores."""
    raw = inputs.crossed_rows(spark, SF)
    cfg = experiment.Settings(models=(experiment.POOLED, experiment.DIRECT), forecast_methods=("global", "level"), optim_methods=("optimize_nnls",))
    out = experiment.run_experiment(raw, inputs.CROSSED, cfg, balanced=True)
    counts = out["fold_forecasts"].groupBy("model", "forecast_method").agg(F.count("*").alias("n"), F.count("pred").alias("p")).collect()
    assert {(r.model, r.forecast_method) for r in counts} == {(m, w) for m in cfg.models for w in cfg.forecast_methods}
    assert {(r.n, r.p) for r in counts} == {(2 * 12 * 216, 2 * 12 * 216)}
    assert out["forecasts"].filter("pred is not null").groupBy("model", "forecast_method").count().filter("count != 12 * 216").count() == 0
    assert out["metrics"].filter("value is null").count() == 0


def test_boosted_trees_of_every_fold(spark):
    rows = [(0, "a", k, [float(10 + i % 4 * 3 + k) for i in range(24 + 4 * k)]) for k in (1, 2)]
    hist = spark.createDataFrame(rows, "level_id int, key string, fold int, hist array<double>")
    out = experiment.shared_forecast(experiment.BOOSTED, hist, ["level_id", "key"], "hist", 3, 4, "global", [1, 2]).collect()
    assert sorted((r.fold, len(r.pred)) for r in out) == [(1, 3), (2, 3)]
    with pytest.raises(ValueError):
        experiment.shared_forecast("Other", hist, ["level_id", "key"], "hist", 3, 4, "global")
