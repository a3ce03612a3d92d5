"""The pooled lag model against ordinary least squares."""

import numpy as np
import pytest

from stratocast.operators import pooled

RNG = np.random.default_rng(5)
Y = {(lv, f"s{i}"): 50 + 10 * RNG.random(40) + 5 * np.sin(np.arange(40) / 2 + i) for lv in (0, 1) for i in range(3)}
LAGS = [1, 2, 3, 4]


def by_hand(keys, h):
    """Forecasts from one numpy regression on the scaled lags of the given series."""
    x, z = [], []
    for k in keys:
        v = Y[k] / np.abs(Y[k]).mean()
        for t in range(4, len(v)):
            x.append([*(v[t - lag] for lag in LAGS), 1.0])
            z.append(v[t])
    w = np.linalg.lstsq(np.array(x), np.array(z), rcond=None)[0]
    out = {}
    for k in keys:
        scale = np.abs(Y[k]).mean()
        path = list(Y[k] / scale)
        for _ in range(h):
            path.append(sum(c * path[-lag] for c, lag in zip(w, LAGS)) + w[-1])
        out[k] = np.array(path[-h:]) * scale
    return out


@pytest.mark.parametrize("mode", ["global", "level"])
def test_equals_least_squares(spark, mode):
    rows = [(lv, k, [float(v) for v in y]) for (lv, k), y in Y.items()]
    df = spark.createDataFrame(rows, "level_id int, k string, y array<double>")
    got = {(r.level_id, r.k): np.array(r.pred, float) for r in pooled.pooled_forecast(df, ["level_id", "k"], "y", 5, 4, mode).collect()}
    groups = [list(Y)] if mode == "global" else [[k for k in Y if k[0] == lv] for lv in (0, 1)]
    for g in groups:
        for k, want in by_hand(g, 5).items():
            np.testing.assert_allclose(got[k], want, rtol=1e-3)


def test_short_series_repeat_their_last_value(spark):
    df = spark.createDataFrame([(0, "a", [1.0, 2.0]), *[(0, f"s{i}", [float(v) for v in Y[(0, f"s{i}")]]) for i in range(3)]], "level_id int, k string, y array<double>")
    got = {r.k: [float(v) for v in r.pred] for r in pooled.pooled_forecast(df, ["level_id", "k"], "y", 2, 4, "level").collect()}
    assert got["a"] == [2.0, 2.0]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        pooled.pooled_forecast(spark.createDataFrame([(0, [1.0])], "level_id int, y array<double>"), ["level_id"], "y", 1, 4, "local")
