"""Cleaning, calendars, ids and builders on hand fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from stratocast.functions import dates, text
from stratocast.operators import calendar, folds, hierarchy, ids, profile, reports
from stratocast.sources import catalog, panels
from stratocast.spec import PanelSpec, season_length

d = datetime.date


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_dates(spark):
    lit = F.lit
    assert one(spark, dates.parse_date(lit("Jan-2020"), "MMM-yyyy")) == d(2020, 1, 1)
    assert one(spark, dates.parse_date(lit("3/7/2019"), "M/d/yyyy")) == d(2019, 3, 7)
    assert one(spark, dates.parse_date(lit("12/31/2019"), "M/d/yyyy")) == d(2019, 12, 31)
    assert one(spark, dates.parse_date(lit("nonsense"), "M/d/yyyy")) is None
    assert one(spark, dates.year_month_to_date(lit(2021), lit(2))) == d(2021, 2, 28)
    assert one(spark, dates.month_name_to_date(lit("FY 2024"), lit(" FEB "))) == d(2024, 2, 29)
    assert one(spark, dates.month_name_to_date(lit("2024"), lit("May"))) == d(2024, 5, 31)
    assert one(spark, dates.month_name_to_date(lit("FY"), lit("FEB"))) is None
    assert one(spark, dates.shift_months_end(lit("2020-01-31").cast("date"), 1)) == d(2020, 2, 29)


@pytest.mark.parametrize("freq", ["D", "ME", "QE"])
def test_period_index_is_invertible(spark, freq):
    ends = dates.period_end(F.col("i"), freq)
    start = {"D": 0, "ME": 12 * 2000, "QE": 4 * 2000}[freq]
    df = spark.range(start - 500, start + 500).select(F.col("id").cast("int").alias("i"))
    assert df.filter(dates.period_index(ends, freq) != F.col("i")).count() == 0


def test_text(spark):
    assert one(spark, text.sanitize_separator(F.lit("a/b"))) == "a_b"
    assert one(spark, text.decimal_comma(F.lit("12,5"))) == 12500.0
    row = spark.range(1).select(*text.prefix_hierarchy(F.lit("1234 Chef"))).first()
    assert tuple(row) == ("1234D", "123C", "12B", "1A")
    assert one(spark, text.elapsed_text(F.lit(3725.4))) == "01 h 02 m"
    assert one(spark, text.score_text(F.lit(None).cast("double"))) is None


def test_season_length():
    assert [season_length(f) for f in ("D", "ME", "M", "QE", "Q", "QS")] == [7, 12, 12, 4, 4, 4]
    with pytest.raises(ValueError):
        season_length("W")
    with pytest.raises(ValueError):
        PanelSpec("x", ())


def test_fill_gaps_keeps_off_calendar_rows_and_copies(spark):
    rows = [("a", d(2020, 1, 31), 1.0, "u"), ("a", d(2020, 4, 15), 2.0, "v"), ("b", d(2020, 3, 31), 3.0, "w"), ("b", d(2020, 6, 30), 4.0, "w")]
    df = spark.createDataFrame(rows, "k string, ds date, y double, note string")
    got = {(r.k, r.ds): (r.y, r.note) for r in calendar.fill_gaps(df, ["k"], "ME", copy=["note"]).collect()}
    a = {ds: v for (k, ds), v in got.items() if k == "a"}
    assert sorted(a) == [d(2020, 1, 31), d(2020, 2, 29), d(2020, 3, 31), d(2020, 4, 15), d(2020, 4, 30), d(2020, 5, 31), d(2020, 6, 30)]
    assert a[d(2020, 2, 29)] == (0.0, "v") and a[d(2020, 4, 15)] == (2.0, "v") and a[d(2020, 1, 31)] == (1.0, "u")
    assert sorted(ds for k, ds in got if k == "b") == [d(2020, m, x) for m, x in ((1, 31), (2, 29), (3, 31), (4, 30), (5, 31), (6, 30))]


def test_calendar_starting_in_february_does_not_drift(spark):
    df = spark.createDataFrame([(d(2021, 2, 28),), (d(2021, 6, 15),)], "ds date")
    got = [r.ds for r in calendar.calendar(df, "ME").orderBy("ds").collect()]
    assert got == [d(2021, 2, 28), d(2021, 3, 31), d(2021, 4, 30), d(2021, 5, 31)]


def test_prepare_panel_needs_keys(spark):
    with pytest.raises(ValueError):
        calendar.prepare_panel(spark.createDataFrame([(d(2021, 1, 31), 1.0)], "ds date, y double"), [], "ME")


def test_null_keys_do_not_look_like_totals(spark):
    df = spark.createDataFrame([("a", d(2020, 1, 31), 1.0), (None, d(2020, 1, 31), 5.0)], "k string, ds date, y double")
    got = {(r.level_id, r.k): r.y for r in hierarchy.cube_levels(df, ["k"]).collect()}
    assert got == {(0, "a"): 1.0, (1, None): 1.0}


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_dense_ids_whatever_the_ranges(spark, ranges):
    rows = [(f"k{i % 7}", i % 11) for i in range(200)] + [("hot", 1)] * 500
    df = spark.createDataFrame(rows, "a string, b int")
    got = [(r.a, r.b) for r in ids.dense_ids(df, ["a", "b"], ranges=ranges).orderBy("ts_id").collect()]
    assert got == sorted(set(rows))
    assert ids.dense_ids(df, ["a", "b"], first=0, ranges=ranges).agg(F.min("ts_id")).first()[0] == 0


def test_fold_table(spark):
    dates_ = spark.createDataFrame([(d(2020, 1, 1) + datetime.timedelta(i),) for i in range(30)], "ds date")
    rows = folds.fold_table(dates_, 5, skip_last=5).orderBy("fold").collect()  # floor(25*.45/5) = 2
    assert [(r.fold, r.n_train, r.test_from, r.test_to) for r in rows] == [
        (1, 15, d(2020, 1, 16), d(2020, 1, 20)), (2, 20, d(2020, 1, 21), d(2020, 1, 25)),
    ]
    assert folds.fold_table(dates_, 30).count() == 0


def test_worked_example_totals(spark):
    """Two products in two shops; the total is the sum of the leaves, not the printed one."""
    leaves = [(3, "Electronics", "Online", 45), (3, "Electronics", "Physical", 23), (3, "Clothing", "Online", 16), (3, "Clothing", "Physical", 30)]
    df = spark.createDataFrame([(d(2024, m, 1), p, s, y) for m, p, s, y in leaves], "ds date, product string, shop string, y int")
    got = {(r.level_id, r["product"], r.shop): r.y for r in hierarchy.cube_levels(df, ["product", "shop"]).collect()}
    assert got[(3, None, None)] == 114 and got[(1, "Electronics", None)] == 68 and got[(2, None, "Online")] == 61
    assert len(got) == 9


def test_profile(spark):
    rows = [("a", d(2020, 1, 1)), ("a", d(2020, 1, 2)), ("a", d(2020, 1, 2)), ("b", d(2020, 1, 5))]
    r = profile.panel_profile(spark.createDataFrame(rows, "k string, ds date"), ["k"]).first()
    assert tuple(r) == (d(2020, 1, 1), d(2020, 1, 5), 2, 2, 4)


def test_rank_ties_and_missing(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("x", 3.0), ("x", None)], "dataset string, value double")
    got = sorted((r.value is None, r.value or 0, r["rank"], r.wins) for r in reports.split_wins(reports.rank_min(df, ["dataset"]), ["dataset"]).collect())
    assert got == [(False, 1.0, 1, 0.5), (False, 1.0, 1, 0.5), (False, 3.0, 3, 0.0), (True, 0, None, 0.0)]


def test_check_counts(spark):
    df = spark.createDataFrame([("base", "a", 1.0), ("base", "b", 2.0), ("x", "a", 1.0)], "method string, dataset string, value double")
    reports.check_counts(df.filter("method = 'base'"), ["method"], [], 2)
    with pytest.raises(ValueError):
        reports.check_counts(df, ["method"], [], 2)


# ---- sources ----


def test_catalogue(spark):
    names = [r["name"] for r in catalog.select_datasets(catalog.catalogue(spark), False, True, include=["M5", "tourism"]).collect()]
    assert sorted(names) == ["M5", "tourism"]
    assert catalog.select_datasets(catalog.catalogue(spark), True, False).count() == 0
    assert catalog.panel_spec("tourism").season == 4
    with pytest.raises(ValueError):
        catalog.panel_spec("moon")


def test_cast_and_infer(spark):
    df = spark.createDataFrame([("1", "2.5", "x")], "ts_id string, total string, shop string")
    out = panels.cast_panel(df)
    assert dict(out.dtypes) == {"ts_id": "int", "total": "double", "shop": "string"}
    assert panels.infer_keys(out) == ["shop"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_build_m5(spark):
    sales = spark.createDataFrame(
        [("1", "i1", "D1", "C1", "S1", "CA", 2, 0, 1), ("2", "i2", "D1", "C1", "S1", "CA", 1, 1, 1)],
        "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, d_1 int, d_2 int, d_3 int",
    )
    cal = spark.createDataFrame([("2011-01-29", 1), ("2011-01-30", 1), ("2011-01-31", 2)], "date string, wm_yr_wk int")
    prices = spark.createDataFrame([("S1", "i1", 1, 3.0), ("S1", "i2", 1, 5.0), ("S1", "i1", 2, 4.0)], "store_id string, item_id string, wm_yr_wk int, sell_price double")
    got = rows(panels.build_m5(sales, cal, prices))
    assert got == [(1, d(2011, 1, 29), 11.0, "CA", "S1", "C1", "D1"), (1, d(2011, 1, 30), 5.0, "CA", "S1", "C1", "D1"), (1, d(2011, 1, 31), 4.0, "CA", "S1", "C1", "D1")]


def test_build_labour(spark):
    df = spark.createDataFrame(
        [("Feb-2020", "F", "NSW", "1234 Chef", "1,5"), ("Feb-2020", "F", "NSW", "1999 Cook", "0,5"), ("May-2020", "F", "NSW", "2111 X", "2")],
        "`Mid-quarter month` string, Sex string, `State and territory (STT): ASGS (2011)` string, `Occupation of main job: ANZSCO (2013) v1.2` string, `Employed total ('000)` string",
    )
    assert rows(panels.build_australian_labour_market(df)) == [
        (1, d(2020, 3, 31), 2000.0, "F", "NSW", "1A"), (2, d(2020, 6, 30), 2000.0, "F", "NSW", "2A"),
    ]


def test_build_electricity(spark):
    df = spark.createDataFrame([("3/7/2019", "DE", "net", "coal", "1.5"), ("3/1/2019", "DE", "net", "coal", "2")], "date string, country_name string, parameter string, product string, value string")
    assert rows(panels.build_global_electricity_production(df)) == [(1, d(2019, 3, 31), 3.5, "net", "coal", "DE")]


def test_build_grocery(spark):
    df = spark.createDataFrame([("2014-01-02", 1, None, 10), ("2014-01-03", 2, 5, 20)], "date string, QTY_B1_1 int, QTY_B1_2 int, QTY_B2_10 int")
    got = rows(panels.build_italian_grocery_store(df))
    assert len(got) == 6 and (3, d(2014, 1, 3), 20.0, "B2", "I10") in got and (2, d(2014, 1, 2), None, "B1", "I2") in [tuple(g) for g in got]


def test_build_gas(spark):
    df = spark.createDataFrame([(2021, 2, "A", "P", 1.0, "x"), (2021, 2, "A", "P", 2.0, "y")], "year int, month int, duoarea string, process string, value double, units string")
    assert rows(panels.build_natural_gas_usage(df)) == [(1, d(2021, 2, 28), 3.0, "A", "P")]


def test_build_prison(spark):
    df = spark.createDataFrame([("2005-03-01", "ACT", "F", "R", "A", 2)], "Date string, State string, Gender string, Legal string, Indigenous string, Count int")
    assert rows(panels.build_prison_population(df)) == [(1, d(2005, 3, 31), 2, "ACT", "F", "R", "A")]


def test_build_retail(spark):
    df = spark.createDataFrame(
        [("Jan-2012", "TN", "Rice/Raw", 3.0), ("Jan-2012", None, "Rice/Raw", 1.0), ("Dec-2010", "AP", None, 9.0), ("Jan-2012", "TN", "Rice/Raw", None)],
        "Date string, State string, Commodity string, `Retail Price` double",
    )
    assert rows(panels.build_retail_prices(df)) == [(2, d(2012, 1, 31), 1.0, "OtherStates", "Rice_Raw"), (3, d(2012, 1, 31), 3.0, "TN", "Rice_Raw")]


def test_build_store_item(spark):
    df = spark.createDataFrame([("2013-01-01", 2, 1, 5), ("2013-01-02", 2, 1, 6), ("2013-01-02", 10, 1, 1)], "date string, store int, item int, sales int")
    assert rows(panels.build_store_item_demand(df)) == [(1, d(2013, 1, 31), 11, "S2", "I1"), (2, d(2013, 1, 31), 1, "S10", "I1")]


def test_build_superstore(spark):
    df = spark.createDataFrame([("2015-02-03", "Air", "Home", "East", "Tech", 2.0)], "`Order Date` string, `Ship Mode` string, Segment string, Region string, Category string, sales double")
    assert rows(panels.build_superstore(df)) == [(1, d(2015, 2, 28), 2.0, "Air", "Home", "East", "Tech")]


def test_build_tourism(spark):
    df = spark.createDataFrame([("1998-01-01", "Adelaide", "SA", "Business", 135.0)], "Quarter string, Region string, State string, Purpose string, trips double")
    assert rows(panels.build_tourism(df)) == [(1, d(1997, 12, 31), 135.0, "Adelaide", "SA", "Business")]


def test_build_traffic(spark):
    data = [("2020-01-01", "desktop", "A", 5), ("2020-01-02", "desktop", "A", 6), ("2020-01-02", "tablet", "B", 1), ("2020-01-02", "mobile", "C", 2)]
    df = spark.createDataFrame(data, "Date string, `Device Category` string, Browser string, `# of Visitors` int")
    assert rows(panels.build_website_traffic(df, 2)) == [
        (1, d(2020, 1, 2), 3, "DeviceCategoryOther", "BrowserOther"), (2, d(2020, 1, 1), 5, "desktop", "A"), (2, d(2020, 1, 2), 6, "desktop", "A"),
    ]


def test_build_ledger(spark):
    df = spark.createDataFrame([("FY 2024", " FEB ", "a/b", 3.0), ("FY 2024", "MAR", "c", 4.0)], "Year string, Period string, unit string, Amount double")
    assert rows(panels.build_ledger(df)) == [(0, d(2024, 2, 29), 3.0, "a_b"), (1, d(2024, 3, 31), 4.0, "c")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, d(2020, 1, 31), 2.5, "x")], panels.panel_schema(["k"]))
    panels.write_csv(df, str(tmp_path / "p"))
    assert rows(panels.panel_from_csv(spark, str(tmp_path / "p"), ["k"], "demo")) == [(1, d(2020, 1, 31), 2.5, "x", "demo")]
