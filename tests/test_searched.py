"""Seasonal ARIMA and exponential smoothing against simulated and noise-free series."""

import numpy as np
import pytest

from stratocast.operators import models, searched

T = np.arange(84)
SEASON = 1 + 0.4 * np.sin(2 * np.pi * T / 12) + 0.1 * np.cos(4 * np.pi * T / 12)


def simulated(seed, n, ar=0.0, seasonal_ar=0.0, ma=0.0, seasonal_ma=0.0, m=12):
    rng = np.random.default_rng(seed)
    e, z = rng.standard_normal(n + 300), np.zeros(n + 300)
    for t in range(m + 1, n + 300):
        z[t] = ar * z[t - 1] + seasonal_ar * z[t - m] - ar * seasonal_ar * z[t - m - 1]
        z[t] += e[t] + ma * e[t - 1] + seasonal_ma * e[t - m] + ma * seasonal_ma * e[t - m - 1]
    return z[300:]


def test_seasonal_autoregression_comes_back():
    w = np.stack([simulated(k, 900, ar=0.5, seasonal_ar=0.6) + 3 for k in range(6)])
    order = (1, 0, 1, 0, True)
    x, sse = searched.fit_arma(w, 12, order)
    got = searched.coefficients(x, order)
    assert np.abs(got["ar"] - 0.5).max() < 0.1 and np.abs(got["seasonal_ar"] - 0.6).max() < 0.1
    assert np.abs(sse / 900 - 1).max() < 0.15


def test_seasonal_moving_average_comes_back():
    w = np.stack([simulated(k, 900, ma=0.4, seasonal_ma=-0.5) for k in range(6)])
    order = (0, 1, 0, 1, False)
    got = searched.coefficients(searched.fit_arma(w, 12, order)[0], order)
    assert np.abs(got["ma"] - 0.4).max() < 0.1 and np.abs(got["seasonal_ma"] + 0.5).max() < 0.1


def test_errors_are_those_of_the_definition():
    w = simulated(1, 60, ar=0.3)[None]
    order = (2, 2, 1, 1, True)
    x = np.random.default_rng(2).normal(size=(1, 7)) / 2
    c = {k: v[0] for k, v in searched.coefficients(x, order).items()}
    z, e = w[0] - c["mean"], np.zeros(60)
    full = lambda low, high: np.polymul(np.r_[1, low], np.r_[1, np.zeros(11), high])
    ar, ma = full(-c["ar"], -c["seasonal_ar"]), full(c["ma"], c["seasonal_ma"])
    for t in range(60):
        e[t] = sum(a * z[t - k] for k, a in enumerate(ar) if k <= t) - sum(b * e[t - k] for k, b in enumerate(ma) if 0 < k <= t)
    np.testing.assert_allclose(searched._shocks(w, *searched._split(x, order, 12))[0], e, atol=1e-10)


def test_search_beats_a_model_without_seasonal_terms():
    """Held-out error over simulated series: with seasonal terms it is lower than with plain ones."""
    y = np.stack([simulated(k, 156, ar=0.5, seasonal_ar=0.7) for k in range(30)]) + 40
    plain = lambda m, n, constant: [o for o in searched.arma_orders(m, n, constant) if not o[2] and not o[3]]
    error = lambda f: np.abs(f - y[:, -12:]).mean()
    whole = error(searched.arima_search(y[:, :-12], 12, 12)[1])
    assert whole < 0.95 * error(searched.arima_search(y[:, :-12], 12, 12, plain)[1])
    assert whole < 0.8 * np.abs(y[:, :-12].mean(axis=1, keepdims=True) - y[:, -12:]).mean()


def test_differencing_by_tests():
    rng = np.random.default_rng(4)
    walk, noise = np.cumsum(rng.normal(size=(20, 120)), axis=1), rng.normal(size=(20, 120))
    season = 10 * np.sin(2 * np.pi * np.arange(120) / 12) + noise
    assert searched.differences(walk, 12)[:, 0].mean() > 0.8
    assert searched.differences(noise, 12).mean() < 0.15
    assert (searched.differences(season, 12)[:, 1] == 1).all()


@pytest.mark.parametrize("trend", [0.0, 3.0])
def test_multiplicative_series_without_noise_are_met_exactly(trend):
    y = ((100 + trend * T) * SEASON)[None]
    np.testing.assert_allclose(searched.auto_ets(y[:, :60], 24, 12), y[:, 60:], rtol=1e-6)


def test_additive_series_without_noise_are_met_exactly():
    y = (100 + 2 * T + 30 * SEASON)[None]
    np.testing.assert_allclose(searched.auto_ets(y[:, :60], 24, 12), y[:, 60:], rtol=1e-6)


def test_multiplicative_forms_win_on_growing_swings():
    rng = np.random.default_rng(3)
    y = (50 + 4 * T) * SEASON * np.exp(0.03 * rng.normal(size=(20, 84)))
    best = {}
    for form in searched.ets_forms(72, 12):
        score, path = searched.ets_forecast(y[:, :72], 12, 12, form)
        best[form] = (score, np.abs(path - y[:, 72:]).mean(axis=1))
    of = lambda season: np.stack([best[f][0] for f in best if f[2] == season]).min(axis=0)
    assert (of("M") < of("A")).mean() > 0.9
    assert np.abs(searched.auto_ets(y[:, :72], 12, 12) / y[:, 72:] - 1).mean() < 0.06


def test_multiplicative_forms_need_positive_series():
    y = np.array([[0.0, 5, 7, 3] * 6])
    assert np.isinf(searched.ets_forecast(y, 4, 4, (True, "", "M"))[0]).all()
    assert np.isfinite(searched.auto_ets(y, 4, 4)).all()


def test_least_squares_solves_each_problem_on_its_own():
    t = np.linspace(0, 1, 30)
    want = np.array([[1.0, -2.0], [0.5, 1.5], [2.0, 0.1]])
    y = want[:, :1] * np.exp(want[:, 1:] * t)
    got, sse = searched.least_squares(lambda x, rows: y[rows] - x[..., :1] * np.exp(x[..., 1:] * t), np.full((3, 2), 0.3))
    np.testing.assert_allclose(got, want, atol=1e-4)
    one, _ = searched.least_squares(lambda x, rows: y[1:2] - x[..., :1] * np.exp(x[..., 1:] * t), np.full((1, 2), 0.3))
    np.testing.assert_allclose(one[0], got[1], rtol=1e-9)
    assert (sse < 1e-8).all()


def test_holt_winters_by_hand():
    y = np.array([[10.0, 20, 12, 22, 15, 24]])
    # level 15, factors 2/3 and 4/3, slope ((12 + 22) / 2 - 15) / 2 = 1
    level, slope, f = 15.0, 1.0, [10 / 15, 20 / 15]
    for t in (2, 3, 4, 5):
        base, cell = level + slope, f[t % 2]
        e = y[0, t] - base * cell
        level, slope, f[t % 2] = base + 0.3 * e / cell, slope + 0.03 * e / cell, cell + 0.2 * e / base
    want = [(level + slope) * f[0], (level + 2 * slope) * f[1], (level + 3 * slope) * f[0]]
    np.testing.assert_allclose(searched.holt_winters(y, 3, 2)[0], want, rtol=1e-12)
    assert searched.holt_winters(np.zeros((1, 30)), 3, 12).tolist() == [[0.0, 0.0, 0.0]]
    assert searched.holt_winters(np.array([[4.0]]), 2, 12).tolist() == [[4.0, 4.0]]


@pytest.mark.parametrize("model", ["AutoETS", "AutoARIMA"])
def test_rows_of_candidates_give_the_same_forecasts(spark, model):
    rng = np.random.default_rng(8)
    rows = [(0, f"s{k}", [float(v) for v in 20 + 5 * SEASON[:n] + rng.normal(size=n)]) for k, n in enumerate((60, 60, 36, 10, 1))]
    rows.append((1, None, [0.0] * 48))
    df = spark.createDataFrame(rows, "level_id int, k string, y array<double>")
    out = models.searched_rows(df, ["level_id", "k"], "y", model, 6, 12)
    plan = out._jdf.queryExecution().toString()
    assert "min_by" in plan and "REPARTITION_BY_NUM" in plan
    got = {(r.level_id, r.k): [float(v) for v in r.pred] for r in out.collect()}
    kernel = searched.auto_ets if model == "AutoETS" else searched.auto_arima
    assert len(got) == len(rows)
    for level, k, y in rows:
        np.testing.assert_allclose(got[level, k], kernel(np.array([y]), 6, 12)[0], atol=2e-6)
