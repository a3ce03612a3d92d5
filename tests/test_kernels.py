"""Numpy kernels on hand-made series."""

import numpy as np
import pytest

from stratocast.operators import kernels, optimisers, searched

RNG = np.random.default_rng(0)
T = np.arange(72)


@pytest.mark.parametrize("kernel", [kernels.theta, kernels.croston_sba, kernels.adida, kernels.imapa, searched.auto_ets, searched.auto_arima])
def test_constant_series_stay_constant(kernel):
    out = kernel(np.full((3, 48), 7.0), 6, 12)
    assert out.shape == (3, 6)
    want = 7.0 * (0.95 if kernel is kernels.croston_sba else 1.0)
    np.testing.assert_allclose(out, want, rtol=1e-6)


@pytest.mark.parametrize("kernel", [kernels.theta, kernels.croston_sba, kernels.adida, kernels.imapa, searched.auto_ets, searched.auto_arima])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 11, 24, 30])
def test_short_and_empty_demand(kernel, n):
    y = np.vstack([np.zeros(n), RNG.random(n), np.r_[np.zeros(n - 1), 5.0]])
    out = kernel(y, 4, 12)
    assert out.shape == (3, 4) and np.isfinite(out).all()
    np.testing.assert_allclose(out[0], 0, atol=1e-9)


@pytest.mark.parametrize("kernel", [searched.auto_ets, searched.auto_arima])
def test_trend_and_season_are_followed(kernel):
    y = 100 + 2.0 * T + 10 * np.sin(2 * np.pi * T / 12)
    out = kernel(np.vstack([y[:60], 3 * y[:60]]), 12, 12)
    np.testing.assert_allclose(out[0], y[60:], rtol=0.03)
    np.testing.assert_allclose(out[1], 3 * y[60:], rtol=0.03)


def test_theta_follows_a_line_and_a_multiplicative_season():
    season = 1 + 0.3 * np.sin(2 * np.pi * T / 12)
    y = (100 + T) * season
    out = kernels.theta(y[None, :60], 12, 12)[0]
    np.testing.assert_allclose(out, y[60:], rtol=0.1)


def test_croston_by_hand():
    # sizes 4, 8 at periods 2 and 4: size 4 + 0.1*4 = 4.4, interval 2
    out = kernels.croston_sba(np.array([[0, 4.0, 0, 8.0]]), 2, 1)
    np.testing.assert_allclose(out, 0.95 * 4.4 / 2)


def test_adida_buckets_by_mean_gap():
    # one demand of 6 every third period: buckets of 3 hold 6 each
    y = np.array([[0, 0, 6.0] * 8])
    np.testing.assert_allclose(kernels.adida(y, 3, 1), 2.0)


def test_batch_equals_single_series():
    y = RNG.random((4, 48)) * 10
    for k in (kernels.theta, kernels.adida, kernels.imapa, searched.auto_ets, searched.auto_arima):
        whole = k(y, 5, 12)
        np.testing.assert_allclose(whole, np.vstack([k(y[i : i + 1], 5, 12) for i in range(4)]), rtol=1e-7)


# ---- optimisers ----


def naive_greedy(y, p, rounds):
    picks = []
    for _ in range(rounds):
        loss = [np.abs(y - p[:, picks + [j]].mean(axis=1)).mean() for j in range(p.shape[1])]
        picks.append(int(np.argmin(loss)))
    return np.bincount(picks, minlength=p.shape[1]) / rounds


def test_greedy_equals_definition():
    y, p = RNG.random(24) * 100, RNG.random((24, 6)) * 100
    np.testing.assert_allclose(optimisers.ensemble_selection(y, p, 40), naive_greedy(y, p, 40))


def test_exact_level_takes_all():
    y = RNG.random(10)
    p = np.column_stack([y + RNG.random(10), y, y - RNG.random(10)])
    np.testing.assert_allclose(optimisers.ensemble_selection(y, p, 50), [0, 1, 0])
    np.testing.assert_allclose(optimisers.clipped_least_squares(y, p), [0, 1, 0], atol=1e-6)
    np.testing.assert_allclose(optimisers.differential_evolution(y, p), [0, 1, 0], atol=0.1)


def test_ties_go_to_the_first_level():
    y = np.array([1.0, 2.0, 3.0])
    p = np.column_stack([y + 1, y + 1, y + 1])
    np.testing.assert_allclose(optimisers.ensemble_selection(y, p, 10), [1, 0, 0])


def test_negative_solutions_become_equal_weights():
    y = np.array([-1.0, -2.0, -3.0])
    np.testing.assert_allclose(optimisers.clipped_least_squares(y, np.column_stack([-y, -2 * y])), 0.5)


def test_underdetermined_least_squares_is_minimum_norm():
    y, p = RNG.random(5), RNG.random((5, 12))
    w = np.maximum(np.linalg.pinv(p) @ y, 0)
    np.testing.assert_allclose(optimisers.clipped_least_squares(y, p), w / w.sum(), rtol=1e-5)


@pytest.mark.parametrize("method", optimisers.METHODS)
def test_weights_are_a_distribution(method):
    y, p = RNG.random(24) * 100, RNG.random((24, 8)) * 100
    w = optimisers.fit(method, y, p, 30, "key")
    assert (w >= 0).all() and abs(w.sum() - 1) < 1e-9
    np.testing.assert_array_equal(w, optimisers.fit(method, y, p, 30, "key"))


def test_differential_evolution_beats_equal_weights():
    y, p = RNG.random(24) * 100, RNG.random((24, 4)) * 100
    loss = lambda w: np.abs(y - p @ w).mean()
    assert loss(optimisers.differential_evolution(y, p)) < loss(np.full(4, 0.25))


def test_unknown_optimiser():
    with pytest.raises(ValueError):
        optimisers.fit("magic", np.zeros(2), np.zeros((2, 2)), 1, "")


def test_fits_are_not_clipped():
    """A doubling series is not held at its last value; all autoregressions that are tried are stationary."""
    y = 2.0 ** np.arange(30)[None, :]
    out = searched.auto_arima(y, 4, 1)
    assert np.isfinite(out).all() and (np.diff(out[0]) > 0).all() and out[0, 0] > y[0, -1]


def test_theta_adds_the_season_where_values_are_not_positive():
    t = np.arange(72)
    y = 10 + 0.5 * t + 20 * np.sin(t * np.pi / 6)
    y[3] = 0
    out = kernels.theta(y[None, :60], 12, 12)[0]
    assert np.abs(out - y[60:]).mean() < 6
    flat = kernels.theta(np.maximum(y[None, :60], 0.01) * 0 + y[None, :60].mean(), 12, 12)[0]
    assert np.abs(out - y[60:]).mean() < np.abs(flat - y[60:]).mean()


@pytest.mark.parametrize("method", optimisers.METHODS)
def test_levels_without_a_prediction_get_no_weight(method):
    rng = np.random.default_rng(1)
    y = 10 + rng.random(24)
    preds = np.column_stack([y + 1, y, y + rng.normal(size=24)])
    preds[5, 1] = np.nan
    w = optimisers.fit_present(method, y, preds, 20, "k")
    assert w[1] == 0 and abs(w.sum() - 1) < 1e-9 and not np.isnan(w).any()
    every = preds.copy()
    every[0, 0] = every[1, 2] = np.nan
    w = optimisers.fit_present(method, y, every, 20, "k")
    assert abs(w.sum() - 1) < 1e-9 and w[1] > 0.5
    np.testing.assert_allclose(optimisers.fit_present(method, y, np.full((24, 3), np.nan), 20, "k"), 1 / 3)
