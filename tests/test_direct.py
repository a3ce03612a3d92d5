"""The direct lag model against a regression on rows written out."""

import numpy as np
import pytest

from stratocast.operators import direct

RNG = np.random.default_rng(6)
M, H = 4, 6
Y = {(lv, g, f"s{i}"): 50 + 10 * RNG.random(40) + 5 * np.sin(np.arange(40) / 2 + i) + (0.8 if g == "up" else -0.3) * np.arange(40) for lv in (0, 1) for g in ("up", "down") for i in range(3)}


def frame(spark, data):
    rows = [(lv, g, k, [float(v) for v in y]) for (lv, g, k), y in data.items()]
    return spark.createDataFrame(rows, "level_id int, g string, k string, y array<double>")


def by_hand(data, keys):
    """Forecasts from one regression per step on rows of lags, season value, 1 and the codes of the keys."""
    out = {name: [] for name in data}
    for step in range(1, H + 1):
        young = M * -(-step // M) - step
        rows = []
        for name, y in data.items():
            v = y / np.abs(y).mean()
            rows += [(name, [v[t], v[t - 1], v[t - 2], v[t - young], 1.0], v[t + step], v[t + step] - v[t]) for t in range(M - 1, len(v) - step)]
        codes = []
        for at in keys:
            values = {name[at] for name in data}
            codes.append({x: sum(r[3] for r in rows if r[0][at] == x) / (sum(r[0][at] == x for r in rows) + direct.PRIOR) for x in values})
        full = lambda name, x: [*x, *(c[name[at]] for at, c in zip(keys, codes))]
        x, z = np.array([full(r[0], r[1]) for r in rows]), np.array([r[2] for r in rows])
        gram = x.T @ x
        w = np.linalg.solve(gram + 1e-6 * (np.trace(gram) / len(gram) + 1e-12) * np.eye(len(gram)), x.T @ z)
        for name, y in data.items():
            size = np.abs(y).mean()
            v = y / size
            last = len(v) - 1
            out[name].append(w @ full(name, [v[last], v[last - 1], v[last - 2], v[last - young], 1.0]) * size)
    return out


@pytest.mark.parametrize("mode", ["global", "level"])
@pytest.mark.parametrize("keys", [(), ("g",), ("g", "k")])
def test_equals_rows_written_out(spark, mode, keys):
    got = {(r.level_id, r.g, r.k): np.array(r.pred, float) for r in direct.direct_forecast(frame(spark, Y), ["level_id", "g", "k"], "y", H, M, keys, mode).collect()}
    assert len(got) == len(Y)
    groups = [Y] if mode == "global" else [{n: y for n, y in Y.items() if n[0] == lv} for lv in (0, 1)]
    place = {"g": 1, "k": 2}
    for group in groups:
        for name, want in by_hand(group, [place[k] for k in keys]).items():
            np.testing.assert_allclose(got[name], want, rtol=2e-5)


def test_key_features_matter(spark):
    """Walks that drift up in one group and down in the other: lags cannot tell the groups apart, the key can."""
    rng = np.random.default_rng(9)
    data = {(0, g, f"s{i}"): 200 + np.cumsum(rng.normal(2 if g == "up" else -2, 6, size=52)) for g in ("up", "down") for i in range(40)}
    train = {k: v[:46] for k, v in data.items()}

    def error(keys):
        out = direct.direct_forecast(frame(spark, train), ["level_id", "g", "k"], "y", 6, M, keys).collect()
        return np.mean([np.abs(np.array(r.pred, float) - data[r.level_id, r.g, r.k][46:]).mean() for r in out])

    assert error(["g"]) < 0.9 * error([])


def test_short_and_null_series(spark):
    data = {**Y, (1, None, "short"): np.array([1.0, 2.0]), (1, None, None): np.zeros(40), (0, "up", "none"): np.zeros(0)}
    got = {(r.level_id, r.g, r.k): r.pred for r in direct.direct_forecast(frame(spark, data), ["level_id", "g", "k"], "y", 3, M, ["g"], "level").collect()}
    assert len(got) == len(data)
    assert [float(v) for v in got[1, None, "short"]] == [2.0] * 3
    assert got[0, "up", "none"] == [None] * 3
    assert all(abs(float(v)) < 1e-6 for v in got[1, None, None])


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        direct.direct_forecast(frame(spark, Y), ["level_id", "g", "k"], "y", 1, M, mode="local")
