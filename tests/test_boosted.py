"""Boosted trees against a plain single-process version."""

import numpy as np
import pytest

from stratocast.operators import boosted

M, LAGS = 4, 3
RNG = np.random.default_rng(12)
Y = {(lv, g, f"s{i}"): np.abs(50 + 15 * RNG.random(44) + 20 * (np.arange(44) % 4 == i % 4) + (1.0 if g == "up" else -0.4) * np.arange(44)) for lv in (0, 1, 3) for g in ("up", "down") for i in range(4)}


def frame(spark, data):
    rows = [(lv, g, k, [float(v) for v in y]) for (lv, g, k), y in data.items()]
    return spark.createDataFrame(rows, "level_id int, g string, k string, y array<double>").repartition(5)


def plain_trees(rows, edges, rounds, depth, rate):
    """Predictions and losses of (bins, target) rows by recursive splitting."""
    bins = np.array([[int(np.sum(edges[j] < x[j])) for j in range(len(edges))] for x, _ in rows])
    z = np.array([t for _, t in rows])
    pred, losses = np.zeros(len(z)), []

    def grow(at, left, level):
        g, n = left[at].sum(), len(at)
        if level == depth:
            pred[at] += rate * g / (n + boosted.CALM)
            return
        best = (0.0, None)
        for j in range(bins.shape[1]):
            for cut in range(boosted.BINS - 1):
                low = at[bins[at, j] <= cut]
                if min(len(low), n - len(low)) < boosted.LEAST:
                    continue
                gl = left[low].sum()
                gain = gl**2 / (len(low) + boosted.CALM) + (g - gl) ** 2 / (n - len(low) + boosted.CALM) - g**2 / (n + boosted.CALM)
                if gain > best[0] + 1e-7 * abs(best[0]):
                    best = (gain, (j, cut))
        if best[1] is None:
            grow(at, left, level + 1)
            return
        right = bins[at, best[1][0]] > best[1][1]
        grow(at[~right], left, level + 1)
        grow(at[right], left, level + 1)

    for _ in range(rounds):
        left = z - pred
        losses.append((left**2).mean())
        grow(np.arange(len(z)), left, 0)
    return pred, [*losses, ((z - pred) ** 2).mean()]


@pytest.mark.parametrize("mode", ["global", "level"])
def test_same_as_recursive_splitting(spark, mode):
    rows = frame(spark, Y)
    keys = ["level_id", "g"] if mode == "global" else ["g"]
    out, losses = boosted.boosted_forecast(rows, ["level_id", "g", "k"], "y", 3, M, keys, mode, rounds=3, depth=2)
    assert out.count() == len(Y)
    coded = boosted.with_key_codes(rows, "y", keys, M)
    group = "level_id" if mode == "level" else "0"
    series = coded.selectExpr(f"cast({group} as long) as group", "codes", "_h as hist")
    edges = boosted.quantile_edges(series, LAGS + 2 + len(keys), M, LAGS)
    times = {}
    for r in series.collect():
        y = np.array(r.hist)
        x, z = boosted.times_of((y / np.abs(y).mean())[None], np.array([r.codes], dtype=float), M, LAGS)
        times.setdefault(r.group, []).extend(zip(x[0].tolist(), z[0].tolist()))
    for g, some in times.items():
        _, want = plain_trees(some, edges, 3, 2, 0.3)
        np.testing.assert_allclose(losses[:, g], want, rtol=1e-5)


def test_every_round_lowers_the_loss(spark):
    _, losses = boosted.boosted_forecast(frame(spark, Y), ["level_id", "g", "k"], "y", 3, M, ["g"], "level", rounds=5)
    used = losses[:, [0, 1, 3]]
    assert (np.diff(used, axis=0) < 0).all() and (used[-1] < 0.7 * used[0]).all()


def test_seasonal_jumps_are_forecast(spark):
    train = {name: y[:40] for name, y in Y.items()}
    out, _ = boosted.boosted_forecast(frame(spark, train), ["level_id", "g", "k"], "y", 4, M, ["g"], rounds=12)
    near = flat = 0.0
    for r in out.collect():
        y = Y[r.level_id, r.g, r.k]
        near += np.abs(np.array(r.pred, float) - y[40:]).sum()
        flat += np.abs(y[:40].mean() - y[40:]).sum()
    assert near < 0.75 * flat


def test_order_of_tasks_does_not_matter(spark):
    rows = frame(spark, Y)
    a, la = boosted.boosted_forecast(rows, ["level_id", "g", "k"], "y", 3, M, ["g"], rounds=2)
    b, lb = boosted.boosted_forecast(rows.repartition(2).sortWithinPartitions("k"), ["level_id", "g", "k"], "y", 3, M, ["g"], rounds=2)
    assert (la == lb).all()
    of = lambda df: {(r.level_id, r.g, r.k): r.pred for r in df.collect()}
    assert of(a) == of(b)


def test_short_series_and_no_series(spark):
    data = {**Y, (1, None, "short"): np.array([1.0, 2.0]), (0, "up", "zero"): np.zeros(30), (0, "up", "none"): np.zeros(0)}
    out, _ = boosted.boosted_forecast(frame(spark, data), ["level_id", "g", "k"], "y", 2, M, ["g", "k"], rounds=1)
    got = {(r.level_id, r.g, r.k): r.pred for r in out.collect()}
    assert len(got) == len(data)
    assert [float(v) for v in got[1, None, "short"]] == [2.0, 2.0]
    assert got[0, "up", "none"] == [None, None]
    none = spark.createDataFrame([], "level_id int, g string, k string, y array<double>")
    assert boosted.boosted_forecast(none, ["level_id", "g", "k"], "y", 2, M, ["g"], rounds=1)[0].count() == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        boosted.boosted_forecast(frame(spark, Y), ["level_id", "g", "k"], "y", 1, M, mode="local")
