"""Filled and summed levels inside rows, against the way over rows, on hand fixtures with odd rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from stratocast.operators import calendar, hierarchy, models
from stratocast.plans.catalogue import QUERIES

d = datetime.date
KEYS = ["a", "b", "c"]
SERIES = ["level_id", *KEYS]


def panel(spark, rows, y="decimal(18,2)"):
    df = spark.createDataFrame(rows, "a string, b string, c string, ds date, y double")
    return hierarchy.leaf_sum(df.withColumn("y", F.col("y").cast(y)), KEYS)


def by_rows(leaf, freq):
    levels = hierarchy.cube_levels(calendar.fill_gaps(leaf, KEYS, freq), KEYS)
    return models.series_arrays(levels, SERIES)


def by_arrays(leaf, freq):
    span = calendar.date_bounds(leaf)
    filled = calendar.filled_arrays(hierarchy.drop_null_keys(leaf, KEYS), KEYS, freq, span)
    return calendar.dated_arrays(hierarchy.cube_arrays(filled, KEYS), SERIES, freq, span)


def collected(df):
    assert df.columns == [*SERIES, "ds", "y"]
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [
    ("s1", "R", "O", d(2020, 1, 31), 1.25), ("s1", "R", "O", d(2020, 4, 30), 2.0), ("s1", "R", "O", d(2020, 4, 30), 3.0),
    ("s1", "R", "F", d(2020, 3, 31), None), ("s1", "N", "F", None, 7.0), ("s1", "N", "F", None, None),
    ("s2", "R", "O", d(2020, 1, 31), None), ("s2", "R", "O", None, None), ("s2", "N", "O", d(2020, 2, 29), -4.5),
    ("s3", "N", "O", None, None),
    (None, "R", "O", d(2019, 11, 30), 9.0), ("s1", None, "O", d(2020, 6, 30), 9.0), ("s1", "R", None, d(2020, 2, 29), 9.0),
]


@pytest.mark.parametrize("y", ["decimal(18,2)", "double"])
def test_levels_inside_rows_are_the_levels_of_rows(spark, y):
    leaf = panel(spark, ODD, y)
    old, new = by_rows(leaf, "ME"), by_arrays(leaf, "ME")
    assert [f.dataType.simpleString() for f in old.schema] == [f.dataType.simpleString() for f in new.schema]
    assert collected(old) == collected(new)


def test_other_frequencies_undated_and_empty_panels(spark):
    days = [(a, b, c, None if ds is None else d(2020, 1, ds.day), v) for a, b, c, ds, v in ODD]
    quarters = [(a, b, c, None if ds is None else d(2020 + ds.day % 2, 12, 31), v) for a, b, c, ds, v in ODD]
    undated = [(a, b, c, None, v) for a, b, c, _, v in ODD]
    for freq, rows in (("D", days), ("QE", quarters), ("ME", undated), ("ME", ODD[10:]), ("ME", [])):
        leaf = panel(spark, rows)
        assert collected(by_rows(leaf, freq)) == collected(by_arrays(leaf, freq))


def test_one_key(spark):
    for n in (3, 0):
        rows = [(f"k{i % 2}", d(2020, 1 + i, 1), float(i)) for i in range(n)]
        leaf = spark.createDataFrame(rows, "a string, ds date, y double").withColumn("ds", F.last_day("ds"))
        old = models.series_arrays(hierarchy.cube_levels(calendar.fill_gaps(leaf, ["a"], "ME"), ["a"]), ["level_id", "a"])
        span = calendar.date_bounds(leaf)
        new = hierarchy.cube_arrays(calendar.filled_arrays(leaf, ["a"], "ME", span), ["a"])
        new = calendar.dated_arrays(new, ["level_id", "a"], "ME", span)
        rows_of = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert rows_of(new) == (rows_of(old) if n else [])


def test_dates_inside_a_period_are_an_error(spark):
    with pytest.raises(Exception, match="no period end"):
        by_arrays(panel(spark, [("s1", "R", "O", d(2020, 1, 15), 1.0)]), "ME").collect()


def test_season_averages_of_short_and_odd_histories(spark):
    rows = [(list(range(1, 8)),), ([5, None, 7],), ([1],), ([],), (None,)]
    df = spark.createDataFrame(rows, "y array<int>").select(F.col("y").cast("array<decimal(18,2)>").alias("y"))
    el = df.schema["y"].dataType.elementType
    got = [r[0] for r in df.select(models.predict("SeasonalAverage", F.col("y"), 5, 3, el)).collect()]
    plain = [None if v is None else [float(x) if x is not None else None for x in v] for v in got]
    assert plain[0] == [3.5, 4.5, 4.0, 3.5, 4.5]
    assert plain[1:4] == [[5.0, None, 7.0, 5.0, None], [None, None, 1.0, None, None], [None] * 5]
    assert plain[4] in (None, [None] * 5)


def test_wide_series_move_once(spark, tmp_path):
    """Neither are rows filled one by one, nor copied for every level, nor the whole levels made for their dates alone."""
    rows = [(s, f, o, datetime.datetime(2000 + m // 12, m % 12 + 1, 3), 10.0 * m + s) for s in range(5) for f in "AN" for o in "FO" for m in range(s, 48)]
    df = spark.createDataFrame(rows, "l_suppkey bigint, l_returnflag string, l_linestatus string, l_shipdate timestamp, l_extendedprice double")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["wide_backtest"](spark, str(tmp_path))
    assert out.count() == (5 * 9 + 9) * 2 * 12
    for name in ("wide_backtest", "wide_cube_levels"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan and "Window" not in plan
