"""Reconciliation against a dense solve."""

import datetime
import itertools

import numpy as np
import pytest

from stratocast.operators import hierarchy, reconcile

D = datetime.date(2020, 1, 31)


def nodes_of(leaves, n):
    """(level_id, masked keys) of every node and the dense summing matrix."""
    nodes = sorted(
        {(g, tuple(None if g >> (n - 1 - i) & 1 else v for i, v in enumerate(leaf))) for leaf in leaves for g in range(1 << n)},
        key=str,
    )
    s = np.array([[all(k is None or k == v for k, v in zip(key, leaf)) for leaf in leaves] for _, key in nodes], float)
    return nodes, s


def dense(s, yhat, method):
    w = np.ones(len(s)) if method == "ols" else s.sum(axis=1)
    a = s.T / w
    return s @ np.linalg.solve(a @ s, a @ yhat)


CROSSED = list(itertools.product("abc", "xy", "pqrs"))
# nested: the first key follows from the second; different numbers of children
NESTED = [("n" if int(s) < 3 else "s", s, c) for s in "01234" for c in "xy"][:-1]


def frame(spark, leaves, keys, seed=0, dates=(D,)):
    nodes, s = nodes_of(leaves, len(keys))
    rng = np.random.default_rng(seed)
    yhat = {d: rng.random(len(nodes)) * 100 for d in dates}
    rows = [("m", g, *key, d, float(yhat[d][i])) for d in dates for i, (g, key) in enumerate(nodes)]
    schema = "model string, level_id int, " + ", ".join(f"{k} string" for k in keys) + ", ds date, pred double"
    return spark.createDataFrame(rows, schema), nodes, s, yhat


def values(rows, keys, nodes, date):
    got = {(r["level_id"], tuple(r[k] for k in keys)): r["pred"] for r in rows if r["ds"] == date}
    assert len(got) == len(nodes)
    return np.array([got[n] for n in nodes])


@pytest.mark.parametrize("method, fn", [("ols", reconcile.mint_balanced), ("wls_struct", reconcile.mint_balanced), ("wls_struct", reconcile.mint_cg)])
def test_crossed(spark, method, fn):
    keys = ["a", "b", "c"]
    dates = (D, datetime.date(2020, 2, 29))
    df, nodes, s, yhat = frame(spark, CROSSED, keys, dates=dates)
    out = fn(df, keys, ["model"], method).collect()
    for d in dates:
        np.testing.assert_allclose(values(out, keys, nodes, d), dense(s, yhat[d], method), atol=1e-5)


@pytest.mark.parametrize("method", ["ols", "wls_struct"])
def test_nested_and_incomplete(spark, method):
    keys = ["state", "store", "cat"]
    df, nodes, s, yhat = frame(spark, NESTED, keys)
    out = reconcile.mint_cg(df, keys, ["model"], method).collect()
    np.testing.assert_allclose(values(out, keys, nodes, D), dense(s, yhat[D], method), atol=1e-5)


def test_passes_need_no_window(spark):
    keys = ["a", "b", "c"]
    df, *_ = frame(spark, CROSSED, keys)
    plan = reconcile.mint_balanced(df, keys, ["model"], "ols")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_unbalanced_input_is_refused(spark):
    keys = ["state", "store", "cat"]
    df, *_ = frame(spark, NESTED, keys)
    with pytest.raises(ValueError, match="not balanced"):
        reconcile.mint_balanced(df, keys, ["model"], "ols")


def test_coherent_input_is_a_fixed_point(spark):
    keys = ["a", "b", "c"]
    nodes, s = nodes_of(CROSSED, 3)
    y = s @ np.arange(len(CROSSED), dtype=float)
    rows = [("m", g, *key, D, float(v)) for (g, key), v in zip(nodes, y)]
    df = spark.createDataFrame(rows, "model string, level_id int, a string, b string, c string, ds date, pred double")
    for m in reconcile.METHODS:
        out = reconcile.reconcile_all(df, keys, ["model"], True, [m]).collect()
        np.testing.assert_allclose(values(out, keys, nodes, D).astype(float), y, atol=1e-6)


def test_balance_check(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b string, c string")
    assert reconcile.is_balanced(make(CROSSED), ["a", "b", "c"])
    assert not reconcile.is_balanced(make(NESTED), ["a", "b", "c"])


def test_unknown_methods(spark):
    df, *_ = frame(spark, CROSSED, ["a", "b", "c"])
    with pytest.raises(ValueError):
        reconcile.mint_balanced(df, ["a", "b", "c"], ["model"], "shrink")
    with pytest.raises(ValueError):
        reconcile.reconcile_all(df, ["a", "b", "c"], ["model"], True, ["TopDown"])


def test_many_keys_cube_in_steps(spark):
    """Five keys go through two Expands and must equal one grouping-sets pass."""
    keys = list("abcde")
    rng = np.random.default_rng(1)
    rows = [(D, *[str(v) for v in rng.integers(0, 3, 5)], int(rng.integers(0, 100))) for _ in range(200)]
    df = spark.createDataFrame(rows, "ds date, a string, b string, c string, d string, e string, y bigint")
    steps = hierarchy.cube_levels(df, keys)
    subsets = [list(c) for r in range(6) for c in itertools.combinations(keys, r)]
    once = hierarchy.cube_levels(df, keys, levels=subsets)
    assert steps.exceptAll(once).count() == 0 and once.exceptAll(steps).count() == 0
