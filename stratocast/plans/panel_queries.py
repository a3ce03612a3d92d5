"""Joins, hierarchy sums, profiles, windows, splits and calendars on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratocast.functions.text import encode_id
from stratocast.operators import calendar, folds, hierarchy, ids, joins, profile, reconcile
from stratocast.operators.models import create_forecasts, merge_forecast_actuals
from stratocast.plans import inputs
from stratocast.plans import reference_sql as ref
from stratocast.plans.cleaning_queries import (
    IDS, K, KEYS, LEAF, MISSING, PANEL, SERIES, crossed_arrays, crossed_levels, crossed_panel,
)
from stratocast.plans.registry import query
from stratocast.session import table

DKEYS = list(inputs.DAILY.keys)
DK = ", ".join(DKEYS)
DPANEL = "WITH " + ref.panel(DKEYS, ref.DAILY_ROWS, "D")
NKEYS = list(inputs.NESTED.keys)
NK = ", ".join(NKEYS)
H = 12  # periods held out of the monthly panels


def crossed_leaf(spark, sf_dir):
    return hierarchy.leaf_sum(inputs.crossed_rows(spark, sf_dir), KEYS)


# ---- joins ----

WEEK = "CAST(floor(date_diff('day', DATE '1990-01-01', {d}) / 7) AS INTEGER)"


def ship_calendar(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    week = F.floor(F.datediff("date", F.lit("1990-01-01").cast("date")) / 7).cast("int")
    return d.withColumn("wm_yr_wk", week)


@query(
    "join_calendar",
    f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, c.wm_yr_wk FROM orders LEFT JOIN (
      SELECT d, {WEEK.format(d='d')} AS wm_yr_wk FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
    ) c ON CAST(o_orderdate AS DATE) = c.d""",
)
def _(spark, sf_dir):
    fact = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return joins.join_calendar(fact, ship_calendar(spark, sf_dir))


@query(
    "join_prices",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity * p.sell_price AS total
    FROM lineitem l LEFT JOIN (SELECT l_suppkey, l_partkey, l_returnflag, max(l_extendedprice) AS sell_price FROM lineitem GROUP BY ALL) p
    ON l.l_suppkey = p.l_suppkey AND l.l_partkey = p.l_partkey AND l.l_returnflag = p.l_returnflag""",
)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    on = ["l_suppkey", "l_partkey", "l_returnflag"]
    prices = li.groupBy(*on).agg(F.max("l_extendedprice").alias("sell_price"))
    out = joins.join_prices(li, prices, on, "l_quantity", "sell_price", "total")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "total")


@query("attach_series_id", f"{IDS} SELECT ts_id, {K}, ds, CAST(y AS DOUBLE) AS y FROM leaf JOIN ids USING ({K})")
def _(spark, sf_dir):
    raw = inputs.crossed_rows(spark, sf_dir)
    return ids.attach_series_id(hierarchy.leaf_sum(raw, KEYS), KEYS, dim=raw)


def forecasts_of(spark, sf_dir, models, h=H):
    return create_forecasts(crossed_arrays(spark, sf_dir), SERIES, models, h, "ME", 12, H)


FC2 = f"{PANEL}, {ref.folds(H, H)}, {ref.horizon(KEYS, 12, H, H, ['SeasonalNaive', 'Average'])}"
# a horizon three months longer than the known test period
FC15 = f"""{PANEL}, {ref.folds(H, H)}, {ref.baselines(KEYS, 15, 12, False, H, ['SeasonalNaive'])},
ahead AS (SELECT model, {", ".join(SERIES)}, last_day(CAST((SELECT ds FROM dates WHERE i = (SELECT n FROM train_n)) + to_months(step) AS DATE)) AS ds, pred FROM pred),
test AS (SELECT * FROM levels WHERE ds IN (SELECT ds FROM dates WHERE i > (SELECT n FROM train_n)))"""


@query(
    "join_forecast_actuals",
    f"""{FC15} SELECT coalesce(a.level_id, t.level_id) AS level_id, {", ".join(f"coalesce(a.{k}, t.{k}) AS {k}" for k in KEYS)},
      coalesce(a.ds, t.ds) AS ds, CAST(t.y AS DOUBLE) AS y, CAST(a.pred AS DOUBLE) AS pred
    FROM ahead a FULL OUTER JOIN test t ON a.ds = t.ds AND {ref.null_join('a', 't', SERIES)}""",
    ordered=True,
)
def _(spark, sf_dir):
    arrays = crossed_arrays(spark, sf_dir)
    both = create_forecasts(arrays, SERIES, ["SeasonalNaive"], 15, "ME", 12, H)
    pred = both.filter("pred is not null").select(*SERIES, "ds", "pred")
    actual = both.filter("y is not null").select(*SERIES, "ds", "y")
    return merge_forecast_actuals(pred, actual, [*SERIES, "ds"])


@query(
    "join_reconciled_actuals",
    f"""{FC2}, rec AS (SELECT model AS experiment, CAST(grouping({K}) AS INTEGER) AS level_id, {K}, ds, sum(pred) AS pred
      FROM fc WHERE level_id = 0 GROUP BY model, ds, CUBE({K})),
    act AS (SELECT experiment, {", ".join("l." + c for c in SERIES)}, l.ds, l.y FROM levels l, (SELECT DISTINCT model AS experiment FROM fc))
    SELECT a.experiment, {", ".join("a." + c for c in SERIES)}, a.ds, CAST(a.y AS DOUBLE) AS y, CAST(r.pred AS DOUBLE) AS "BottomUp"
    FROM act a FULL OUTER JOIN rec r ON a.experiment = r.experiment AND a.ds = r.ds AND {ref.null_join('a', 'r', SERIES)}""",
)
def _(spark, sf_dir):
    fc = forecasts_of(spark, sf_dir, ["SeasonalNaive", "Average"])
    rec = reconcile.bottom_up(fc, KEYS, ["model"]).withColumnRenamed("model", "experiment")
    runs = F.explode(F.array(F.lit("SeasonalNaive"), F.lit("Average"))).alias("experiment")
    actual = crossed_levels(spark, sf_dir).select(runs, *SERIES, "ds", "y")
    return joins.merge_methods({"y": actual, "BottomUp": rec}, ["experiment", *SERIES, "ds"])


@query(
    "keep_horizon_dates",
    f"{FC2} SELECT {', '.join(SERIES)}, ds, CAST(y AS DOUBLE) AS y FROM levels WHERE ds IN (SELECT ds FROM fc)",
    ordered=True,
)
def _(spark, sf_dir):
    fc = forecasts_of(spark, sf_dir, ["SeasonalNaive"])
    return joins.keep_horizon_dates(crossed_levels(spark, sf_dir), fc).select(*SERIES, "ds", "y")


USER_DAYS = """SELECT event_type, CAST(user_id AS VARCHAR) AS user_name, CAST(ts AS DATE) AS ds, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS y
    FROM events GROUP BY ALL"""


@query(
    "lump_rare_series",
    f"""WITH p AS ({USER_DAYS}), n AS (SELECT event_type, user_name, count(*) AS n FROM p GROUP BY ALL)
    SELECT CASE WHEN n < 12 THEN 'event_typeOther' ELSE event_type END AS event_type,
      CASE WHEN n < 12 THEN 'user_nameOther' ELSE user_name END AS user_name, ds, CAST(sum(y) AS DOUBLE) AS y
    FROM p JOIN n USING (event_type, user_name) GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_type", F.col("user_id").cast("string").alias("user_name"), F.to_date("ts").alias("ds"),
        F.col("value").cast(inputs.MONEY).alias("y"),
    )
    keys = ["event_type", "user_name"]
    return joins.lump_rare_series(hierarchy.leaf_sum(e, keys), keys, 12)


SPLIT = f"{PANEL}, s AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(SERIES)} ORDER BY ds DESC) AS back FROM levels)"


@query("split_last_n", f"{SPLIT} SELECT {', '.join(SERIES)}, ds, CAST(y AS DOUBLE) AS y FROM s WHERE back <= {H}")
def _(spark, sf_dir):
    return folds.split_last_n(crossed_levels(spark, sf_dir), SERIES, H)[1].select(*SERIES, "ds", "y")


@query("train_anti_test", f"{SPLIT} SELECT {', '.join(SERIES)}, ds, CAST(y AS DOUBLE) AS y FROM s WHERE back > {H}")
def _(spark, sf_dir):
    return folds.split_last_n(crossed_levels(spark, sf_dir), SERIES, H)[0].select(*SERIES, "ds", "y")


@query(
    "id_mismatch_report",
    """WITH f AS (SELECT DISTINCT n_name || '/' || c_custkey AS unique_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
    s AS (SELECT DISTINCT n_name || '/' || c_custkey AS unique_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      UNION SELECT DISTINCT n_name || '/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT unique_id, 'hierarchy' AS missing_in FROM (SELECT * FROM f EXCEPT SELECT * FROM s)
    UNION ALL SELECT unique_id, 'forecast' FROM (SELECT * FROM s EXCEPT SELECT * FROM f)""",
)
def _(spark, sf_dir):
    """Customers against buyers and suppliers: some customers have no orders, some suppliers share no id."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    of = lambda key: encode_id(["n_name", key]).alias("unique_id")
    places = customer.join(nation, customer.c_nationkey == nation.n_nationkey).withColumn("key", F.col("c_custkey").cast("string"))
    sellers = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).withColumn("key", F.col("s_suppkey").cast("string"))
    orders = table(spark, sf_dir, "orders")
    sold = orders.join(places, orders.o_custkey == places.c_custkey)
    return reconcile.id_mismatch_report(places.select(of("key")), sold.select(of("key")).unionByName(sellers.select(of("key"))))


# ---- sums and counts ----


@query("leaf_sum", f"{LEAF} SELECT {K}, ds, CAST(y AS DOUBLE) AS y FROM leaf")
def _(spark, sf_dir):
    return crossed_leaf(spark, sf_dir)


@query("cube_levels", f"{PANEL} SELECT level_id, ds, {K}, CAST(y AS DOUBLE) AS y FROM levels")
def _(spark, sf_dir):
    return crossed_levels(spark, sf_dir)


SIX = ["r_name", "n_name", "c_mktsegment", "o_orderpriority", "half", "o_orderstatus"]


@query(
    "cube_levels_six_keys",
    f"""SELECT CAST(grouping({', '.join(SIX)}) AS INTEGER) AS level_id, ds, {', '.join(SIX)}, CAST(sum(y) AS DOUBLE) AS y FROM (
      SELECT r_name, n_name, c_mktsegment, o_orderpriority, o_orderstatus, CAST(year(o_orderdate) % 2 AS VARCHAR) AS half,
        CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ds, CAST(o_totalprice AS DECIMAL(18,2)) AS y
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    GROUP BY ds, CUBE({', '.join(SIX)})""",
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = o.join(inputs.customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(
        "r_name", "n_name", "c_mktsegment", "o_orderpriority", "o_orderstatus",
        (F.year("o_orderdate") % 2).cast("string").alias("half"),
        F.trunc("o_orderdate", "quarter").alias("ds"), F.col("o_totalprice").cast(inputs.MONEY).alias("y"),
    )
    return hierarchy.cube_levels(hierarchy.leaf_sum(raw, SIX), SIX)


@query("cube_levels_long", f"{PANEL} SELECT level_id, concat_ws('/', {K}) AS unique_id, ds, CAST(y AS DOUBLE) AS y FROM levels")
def _(spark, sf_dir):
    return crossed_levels(spark, sf_dir).select("level_id", encode_id(KEYS).alias("unique_id"), "ds", "y")


@query(
    "summing_relation",
    f"""{PANEL}, m AS (SELECT CAST(unnest(generate_series(0, 7)) AS INTEGER) AS level_id)
    SELECT level_id, {", ".join(f"CASE WHEN level_id // {4 >> i} % 2 = 0 THEN {k} END AS {k}" for i, k in enumerate(KEYS))},
      {", ".join(f"{k} AS leaf_{k}" for k in KEYS)} FROM dim, m""",
)
def _(spark, sf_dir):
    return hierarchy.summing_relation(inputs.crossed_rows(spark, sf_dir), KEYS)


@query("collapse_to_top", f"{PANEL} SELECT level_id, ds, CAST(sum(y) AS DOUBLE) AS y FROM levels GROUP BY ALL")
def _(spark, sf_dir):
    return hierarchy.collapse_to_top(crossed_levels(spark, sf_dir))


@query(
    "subset_cardinality",
    f"""WITH {ref.ROWS} SELECT CAST(level_id AS INTEGER) AS level_id, count(*) AS n_nodes FROM (
      SELECT DISTINCT grouping({NK}) AS level_id, {NK} FROM rows_ GROUP BY CUBE({NK})) GROUP BY 1""",
)
def _(spark, sf_dir):
    return hierarchy.subset_cardinality(inputs.nested_rows(spark, sf_dir), NKEYS)


@query(
    "panel_profile",
    f"""WITH {ref.ROWS}, per AS (SELECT {NK}, count(DISTINCT ds) AS d FROM rows_ GROUP BY ALL)
    SELECT (SELECT min(ds) FROM rows_) AS min_date, (SELECT max(ds) FROM rows_) AS max_date, count(*) AS n_series,
      max(d) AS longest_series, (SELECT count(*) FROM rows_) AS n_rows FROM per""",
)
def _(spark, sf_dir):
    out = profile.panel_profile(inputs.nested_rows(spark, sf_dir), NKEYS)
    return out


@query(
    "missing_counts",
    f"SELECT c_mktsegment, count(*) AS n_rows, count(*) - count({MISSING}) AS n_missing FROM customer GROUP BY 1",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.expr(MISSING).alias("total"))
    return profile.missing_counts(c, ["c_mktsegment"], "total")


@query("series_counts", f"WITH {ref.DAILY_ROWS} SELECT {DK}, count(*) AS n_rows FROM rows_ GROUP BY ALL")
def _(spark, sf_dir):
    return profile.series_counts(inputs.daily_rows(spark, sf_dir), DKEYS)


@query("train_test_bounds", f"{SPLIT} SELECT max(ds) FILTER (back > {H}) AS train_end, max(ds) FILTER (back <= {H}) AS test_end FROM s")
def _(spark, sf_dir):
    return profile.train_test_bounds(folds.flag_last_n(crossed_levels(spark, sf_dir), SERIES, H))


# ---- ids and windows ----


@query("series_id", f"{IDS} SELECT * FROM ids")
def _(spark, sf_dir):
    return ids.dense_ids(inputs.crossed_rows(spark, sf_dir), KEYS)


@query(
    "series_id_rownumber",
    "SELECT CAST(row_number() OVER (ORDER BY l_suppkey, l_partkey) AS INTEGER) AS ts_id, * FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)",
)
def _(spark, sf_dir):
    return ids.dense_ids(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"])


@query(
    "ffill_keys",
    f"""{IDS}, o AS (SELECT {K}, ds, CASE WHEN ds <= DATE '1998-01-31' THEN ts_id END AS ts_id FROM leaf JOIN ids USING ({K}))
    SELECT {K}, ds, last_value(ts_id IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY ds) AS ts_id FROM o""",
)
def _(spark, sf_dir):
    raw = inputs.crossed_rows(spark, sf_dir)
    known = F.when(F.col("ds") <= F.lit("1998-01-31").cast("date"), F.col("ts_id"))
    df = ids.attach_series_id(hierarchy.leaf_sum(raw, KEYS), KEYS, dim=raw).withColumn("ts_id", known)
    return joins.ffill_keys(df, ["ts_id"], KEYS).select(*KEYS, "ds", "ts_id")


@query(
    "naive_scale",
    f"""{PANEL}, d AS (SELECT {', '.join(SERIES)}, CAST(y - lag(y) OVER (PARTITION BY {', '.join(SERIES)} ORDER BY ds) AS DOUBLE) AS d FROM levels)
    SELECT {', '.join(SERIES)}, round(avg(abs(d)) / 1e6, 9) AS mae_scale, round(avg(d * d) / 1e12, 9) AS mse_scale FROM d GROUP BY ALL""",
)
def _(spark, sf_dir):
    out = folds.naive_scale(crossed_levels(spark, sf_dir), SERIES)
    return out.withColumns({"mae_scale": F.round(F.col("mae_scale") / 1e6, 9), "mse_scale": F.round(F.col("mse_scale") / 1e12, 9)})


@query("last_dates", f"{PANEL} SELECT ds FROM cal ORDER BY ds DESC LIMIT 12")
def _(spark, sf_dir):
    return folds.last_dates(crossed_leaf(spark, sf_dir), H)


@query("drop_duplicates", f"WITH {ref.ROWS} SELECT DISTINCT {NK} FROM rows_")
def _(spark, sf_dir):
    return joins.duplicate_free_dim(inputs.nested_rows(spark, sf_dir), NKEYS)


@query(
    "union_frames",
    f"""{PANEL}, dl AS (SELECT 'daily' AS dataset, CAST(ts AS DATE) AS ds, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS y FROM events GROUP BY ALL)
    SELECT 'crossed' AS dataset, ds, CAST(y AS DOUBLE) AS y FROM levels WHERE level_id = 7 UNION ALL SELECT * FROM dl""",
)
def _(spark, sf_dir):
    monthly = hierarchy.leaf_sum(crossed_panel(spark, sf_dir), [], by=[F.lit("crossed").alias("dataset")])
    daily = hierarchy.leaf_sum(inputs.daily_rows(spark, sf_dir), [], by=[F.lit("daily").alias("dataset")])
    return monthly.unionByName(daily)


# ---- calendars and splits ----


@query(
    "calendar",
    f"""{PANEL} SELECT 'ME' AS freq, ds FROM cal UNION ALL
    SELECT 'QE', last_day(CAST(unnest(generate_series((SELECT date_trunc('quarter', min(ds)) + INTERVAL 2 MONTH FROM rows_),
      (SELECT max(ds) FROM rows_), INTERVAL 3 MONTH)) AS DATE)) UNION ALL
    SELECT 'D', CAST(unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events), (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY)) AS DATE)""",
)
def _(spark, sf_dir):
    rows = inputs.crossed_rows(spark, sf_dir)
    out = [calendar.calendar(rows, f).withColumn("freq", F.lit(f)) for f in ("ME", "QE")]
    out.append(calendar.calendar(inputs.daily_rows(spark, sf_dir), "D").withColumn("freq", F.lit("D")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("fill_gaps", f"{PANEL} SELECT {K}, ds, CAST(y AS DOUBLE) AS y FROM panel")
def _(spark, sf_dir):
    return calendar.fill_gaps(crossed_leaf(spark, sf_dir), KEYS, "ME")


@query("fill_gaps_daily", f"{DPANEL} SELECT {DK}, ds, CAST(y AS DOUBLE) AS y FROM panel")
def _(spark, sf_dir):
    return calendar.fill_gaps(hierarchy.leaf_sum(inputs.daily_rows(spark, sf_dir), DKEYS), DKEYS, "D")


@query("fill_gaps_levels", f"{PANEL} SELECT level_id, {K}, ds, CAST(y AS DOUBLE) AS y FROM levels")
def _(spark, sf_dir):
    sparse = hierarchy.cube_levels(crossed_leaf(spark, sf_dir), KEYS)
    return calendar.fill_gaps_levels(sparse, KEYS, "ME")


@query(
    "prepare_panel",
    f"""WITH {ref.panel(KEYS, ref.ROWS.removesuffix(")") + " WHERE o_orderdate < TIMESTAMP '2000-01-01')")}
    SELECT CAST(dense_rank() OVER (ORDER BY {K}) AS INTEGER) AS ts_id, ds, CAST(y AS DOUBLE) AS y, {K} FROM panel""",
)
def _(spark, sf_dir):
    return calendar.prepare_panel(inputs.crossed_rows(spark, sf_dir), KEYS, "ME", cutoff_date="1999-12-31")


def crossed_folds(spark, sf_dir):
    return folds.fold_table(crossed_leaf(spark, sf_dir), H, skip_last=H)


FOLDS = f"{PANEL}, {ref.folds(H, H)}"


@query("fold_count", f"{FOLDS} SELECT n AS n_train, k AS n_folds FROM train_n")
def _(spark, sf_dir):
    n = crossed_leaf(spark, sf_dir).select("ds").distinct().agg((F.count("*") - H).cast("int").alias("n_train"))
    return n.withColumn("n_folds", folds.fold_count(F.col("n_train"), H))


@query(
    "cv_folds",
    f"""{FOLDS} SELECT {K}, ds, CAST(y AS DOUBLE) AS y, fold, ds >= test_from AS is_test FROM panel JOIN fold ON ds <= test_to""",
)
def _(spark, sf_dir):
    return folds.fold_rows(crossed_panel(spark, sf_dir), crossed_folds(spark, sf_dir))
