"""Sources, projections, scalar functions and reshaping on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratocast.functions import dates, labels, text
from stratocast.operators import calendar, hierarchy, reshape
from stratocast.operators.models import create_forecasts, series_arrays
from stratocast.plans import inputs
from stratocast.plans import reference_sql as ref
from stratocast.plans.registry import query
from stratocast.session import shared_folder, table
from stratocast.sources import catalog, panels
from stratocast.sources.store import ArtifactStore

KEYS = list(inputs.CROSSED.keys)
K = ", ".join(KEYS)
SERIES = ["level_id", *KEYS]
PANEL = "WITH " + ref.panel(KEYS)
LEAF = f"WITH {ref.ROWS}, leaf AS (SELECT {K}, ds, sum(y) AS y FROM rows_ GROUP BY {K}, ds)"
IDS = f"{LEAF}, ids AS (SELECT {K}, CAST(row_number() OVER (ORDER BY {K}) AS INTEGER) AS ts_id FROM (SELECT DISTINCT {K} FROM leaf))"


def leaf_panel(spark, sf_dir):
    """Leaf sums under the names of the panel contract."""
    raw = inputs.crossed_rows(spark, sf_dir).withColumnsRenamed({"ds": "date", "y": "total"})
    return panels.finish(raw, KEYS)


def scratch(spark) -> str:
    """A fresh folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


PANEL_CONTRACT = f"{IDS} SELECT ts_id, ds AS date, CAST(y AS DOUBLE) AS total, {K} FROM leaf JOIN ids USING ({K})"


@query("panel_from_csv", PANEL_CONTRACT)
def _(spark, sf_dir):
    path = scratch(spark)
    panels.write_csv(leaf_panel(spark, sf_dir), path)
    return panels.panel_from_csv(spark, path, KEYS)


@query("write_csv", PANEL_CONTRACT)
def _(spark, sf_dir):
    path = scratch(spark)
    panels.write_csv(leaf_panel(spark, sf_dir), path)
    return spark.read.csv(path, header=True, schema=panels.panel_schema(KEYS))


@query("panel_from_table", "SELECT * FROM nation")
def _(spark, sf_dir):
    return panels.panel_from_table(spark, f"{sf_dir}/nation.parquet")


@query("tag_dataset", "SELECT event_id, event_type, 'daily' AS dataset FROM events")
def _(spark, sf_dir):
    return panels.tag_dataset(table(spark, sf_dir, "events").select("event_id", "event_type"), "daily")


@query(
    "cast_panel",
    """SELECT CAST(o_orderkey AS INTEGER) AS ts_id, o_totalprice AS total, TRY_CAST(o_orderpriority AS DOUBLE) AS Amount
    FROM orders""",
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = o.select(
        F.col("o_orderkey").cast("string").alias("ts_id"), F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("Amount"),
    )
    return panels.cast_panel(raw)


@query("infer_keys", f"{LEAF} SELECT DISTINCT {K} FROM leaf")
def _(spark, sf_dir):
    panel = leaf_panel(spark, sf_dir)
    return panel.select(*panels.infer_keys(panel)).distinct()


CATALOGUE = """SELECT n_name AS name, n_nationkey % 2 = 1 AS private, r_name AS area
    FROM nation JOIN region ON n_regionkey = r_regionkey"""


def nation_catalogue(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = n.join(r, n.n_regionkey == r.r_regionkey)
    return both.select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 1).alias("private"), F.col("r_name").alias("area"))


@query(
    "select_datasets",
    f"""SELECT * FROM ({CATALOGUE}) WHERE NOT private AND name NOT IN ('NATION_4', 'NATION_8')""",
)
def _(spark, sf_dir):
    return catalog.select_datasets(nation_catalogue(spark, sf_dir), False, True, exclude=["NATION_4", "NATION_8"])


@query("write_table", f"{LEAF} SELECT {K}, ds, CAST(y AS DOUBLE) AS y FROM leaf")
def _(spark, sf_dir):
    path = scratch(spark)
    panels.write_table(hierarchy.leaf_sum(inputs.crossed_rows(spark, sf_dir), KEYS), path, ["r_name"])
    return spark.read.parquet(path).select(*KEYS, "ds", "y")


@query(
    "artifact_store",
    f"""{LEAF} SELECT c_mktsegment AS dataset, o_orderpriority AS model, 'level' AS forecast_method, ds, CAST(sum(y) AS DOUBLE) AS y
    FROM leaf WHERE c_mktsegment = 'BUILDING' GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Two writes to one table, the second replacing only its own partitions; then a pruned read."""
    store = ArtifactStore(spark, scratch(spark))
    rows = inputs.crossed_rows(spark, sf_dir).withColumnsRenamed({"c_mktsegment": "dataset", "o_orderpriority": "model"})
    made = rows.groupBy("dataset", "model", "ds").agg(F.sum("y").alias("y")).withColumn("forecast_method", F.lit("level"))
    store.write("levels", made.withColumn("notes", F.lit("bulky")), drop=["notes"])
    store.write("levels", made.filter("dataset = 'MACHINERY'").withColumn("y", F.col("y") * 0))
    return store.reuse("levels", lambda: made).filter("dataset = 'BUILDING'").select(
        "dataset", "model", "forecast_method", "ds", "y"
    )


@query(
    "artifact_store_settings",
    f"""{LEAF}, made AS (SELECT c_mktsegment AS dataset, o_orderpriority AS model, ds, CAST(sum(y) AS DOUBLE) AS y FROM leaf GROUP BY ALL)
    SELECT 'one' AS setting, * FROM made WHERE model IN ('3-MEDIUM', '5-LOW')
    UNION ALL SELECT 'other', * FROM made WHERE model = '1-URGENT'""",
)
def _(spark, sf_dir):
    """Two settings under one root, each with its own models; a rerun with fewer models leaves none of the others."""
    store = ArtifactStore(spark, scratch(spark))
    rows = inputs.crossed_rows(spark, sf_dir).withColumnsRenamed({"c_mktsegment": "dataset", "o_orderpriority": "model"})
    made = rows.groupBy("dataset", "model", "ds").agg(F.sum("y").alias("y")).withColumn("forecast_method", F.lit("level"))
    run = lambda setting, models, rerun=False: store.of(setting).reuse(
        "levels", lambda: made.filter(F.col("model").isin(*models)), rerun
    )
    run("one", ["1-URGENT", "3-MEDIUM", "5-LOW"])
    other = run("other", ["1-URGENT"])
    one = run("one", ["3-MEDIUM", "5-LOW"], rerun=True)
    cols = ["setting", "dataset", "model", "ds", "y"]
    return one.withColumn("setting", F.lit("one")).select(*cols).unionByName(other.withColumn("setting", F.lit("other")).select(*cols))


@query(
    "experiment_grid",
    """SELECT r_name AS dataset, model, forecast_method, time_limit FROM region,
      (VALUES ('AutoARIMA'), ('AutoETS'), ('Leaderboard')) a(model), (VALUES ('global'), ('level')) b(forecast_method),
      (VALUES (600), (1800)) c(time_limit)
    WHERE NOT (forecast_method = 'level' AND model IN ('AutoETS', 'AutoARIMA'))
      AND NOT (time_limit = 1800 AND model IN ('AutoETS', 'AutoARIMA'))
      AND NOT (forecast_method = 'level' AND time_limit = 1800)""",
)
def _(spark, sf_dir):
    base = table(spark, sf_dir, "region").select(F.col("r_name").alias("dataset"))
    return catalog.experiment_grid(
        base, model=catalog.GRID_MODELS, forecast_method=catalog.FORECAST_METHODS, time_limit=catalog.TIME_LIMITS
    )


# ---- projections and scalar functions ----


@query("rename_cols", "SELECT event_type AS kind, value AS total FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    return panels.rename_cols(e, {"event_type": "kind", "value": "total"})


@query("drop_cols", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf_dir):
    return panels.drop_cols(table(spark, sf_dir, "customer"), "c_name", "c_acctbal", "no_such_column")


@query("project_panel", PANEL_CONTRACT)
def _(spark, sf_dir):
    return panels.project_panel(leaf_panel(spark, sf_dir), KEYS)


@query("sort_panel", f"{PANEL_CONTRACT} ORDER BY ts_id, date")
def _(spark, sf_dir):
    return panels.sort_panel(leaf_panel(spark, sf_dir))


# negative balances stand for missing targets
MISSING = "CASE WHEN c_acctbal >= 0 THEN c_acctbal END"


@query("filter_not_null_target", f"SELECT c_custkey, c_acctbal AS total FROM customer WHERE {MISSING} IS NOT NULL")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(MISSING).alias("total"))
    return panels.filter_not_null_target(c)


@query(
    "null_key_to_other",
    """SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'OtherSegments') AS segment, count(*) AS n_rows
    FROM customer GROUP BY 1""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return panels.null_key_to_other(c, {"segment": "OtherSegments"}).groupBy("segment").agg(F.count("*").alias("n_rows"))


@query("month_end", "SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS ds FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.month_end(F.col("o_orderdate")).alias("ds"))


@query(
    "parse_date",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS from_month, CAST(o_orderdate AS DATE) AS from_us,
      CAST(o_orderdate AS DATE) AS from_iso, CAST(NULL AS DATE) AS from_bad FROM orders""",
)
def _(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.parse_date(F.date_format(d, "MMM-yyyy"), "MMM-yyyy").alias("from_month"),
        dates.parse_date(F.date_format(d, "M/d/yyyy"), "M/d/yyyy").alias("from_us"),
        dates.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("from_iso"),
        dates.parse_date(F.col("o_orderpriority")).alias("from_bad"),
    )


@query("year_month_to_date", "SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS ds FROM orders")
def _(spark, sf_dir):
    y, m = F.year("o_orderdate").cast("string"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.year_month_to_date(y, m).alias("ds"))


@query(
    "month_name_to_date",
    "SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS ds, CAST(NULL AS DATE) AS bad_month, CAST(NULL AS DATE) AS bad_year FROM orders",
)
def _(spark, sf_dir):
    year = F.concat(F.lit("FY "), F.year("o_orderdate"))
    month = F.concat(F.lit(" "), F.upper(F.date_format("o_orderdate", "MMM")), F.lit(" "))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.month_name_to_date(year, month).alias("ds"),
        dates.month_name_to_date(year, F.col("o_orderpriority")).alias("bad_month"),
        dates.month_name_to_date(F.col("o_orderstatus"), month).alias("bad_year"),
    )


@query("shift_months_end", "SELECT o_orderkey, last_day(CAST(last_day(CAST(o_orderdate AS DATE)) + INTERVAL 1 MONTH AS DATE)) AS ds FROM orders")
def _(spark, sf_dir):
    d = dates.month_end(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.shift_months_end(d, 1).alias("ds"))


@query("shift_days", "SELECT o_orderkey, CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) - INTERVAL 1 DAY AS DATE) AS ds FROM orders")
def _(spark, sf_dir):
    quarter = F.trunc("o_orderdate", "quarter")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.shift_days(quarter, -1).alias("ds"))


@query("day_index_to_date", "SELECT p_partkey, CAST(DATE '2011-01-29' + CAST(p_partkey % 1941 AS INTEGER) AS DATE) AS ds FROM part")
def _(spark, sf_dir):
    pos = (F.col("p_partkey") % 1941).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", dates.day_index_to_date("2011-01-29", pos).alias("ds"))


@query("sanitize_separator", "SELECT page_id, replace(url, '/', '_') AS url FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_separator(F.col("url")).alias("url"))


@query("decimal_comma", "SELECT event_id, value * 1000 AS total FROM events")
def _(spark, sf_dir):
    as_text = F.translate(F.col("value").cast("string"), ".", ",")
    return table(spark, sf_dir, "events").select("event_id", text.decimal_comma(as_text).alias("total"))


@query(
    "prefix_hierarchy",
    """SELECT p_partkey, CAST(p_partkey + 1000 AS VARCHAR)[1:4] || 'D' AS hier_4, CAST(p_partkey + 1000 AS VARCHAR)[1:3] || 'C' AS hier_3,
      CAST(p_partkey + 1000 AS VARCHAR)[1:2] || 'B' AS hier_2, CAST(p_partkey + 1000 AS VARCHAR)[1:1] || 'A' AS hier_1 FROM part""",
)
def _(spark, sf_dir):
    code = F.concat_ws(" ", F.col("p_partkey") + 1000, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", *text.prefix_hierarchy(code))


@query("prefix_ids", "SELECT 'S' || s_suppkey AS store, 'I' || s_nationkey AS item FROM supplier")
def _(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        text.prefix_id("S", F.col("s_suppkey")).alias("store"), text.prefix_id("I", F.col("s_nationkey")).alias("item")
    )


@query(
    "cutoff_date",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds FROM orders
    WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-30' AND CAST(o_orderdate AS DATE) > DATE '1996-01-01'""",
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ds"))
    return calendar.cutoff(o, "1998-06-30", "1996-01-01")


@query("zero_fill", f"SELECT c_custkey, coalesce({MISSING}, 0) AS y FROM customer")
def _(spark, sf_dir):
    return calendar.zero_fill(table(spark, sf_dir, "customer").select("c_custkey", F.expr(MISSING).alias("y")))


def crossed_panel(spark, sf_dir):
    return calendar.prepare_panel(inputs.crossed_rows(spark, sf_dir), KEYS, "ME", with_id=False)


def crossed_levels(spark, sf_dir):
    return hierarchy.cube_levels(crossed_panel(spark, sf_dir), KEYS)


def crossed_arrays(spark, sf_dir):
    return series_arrays(crossed_levels(spark, sf_dir), SERIES)


@query("encode_id", f"{PANEL} SELECT level_id, concat_ws('/', {K}) AS unique_id, ds FROM levels")
def _(spark, sf_dir):
    return crossed_levels(spark, sf_dir).select("level_id", text.encode_id(KEYS).alias("unique_id"), "ds")


@query("decode_id", "SELECT page_id, split_part(url, '/', 1) AS a, split_part(url, '/', 3) AS c, nullif(split_part(url, '/', 9), '') AS i FROM pages")
def _(spark, sf_dir):
    a, _, c, *_, i = text.decode_id(F.col("url"), ["a", "b", "c", "d", "e", "f", "g", "h", "i"])
    return table(spark, sf_dir, "pages").select("page_id", a, c, i)


METHOD_CASE = """CASE o_custkey % 6 WHEN 0 THEN 'base' WHEN 1 THEN 'BottomUp' WHEN 2 THEN 'MinTrace_method-ols'
      WHEN 3 THEN 'MinTrace_method-wls_struct' WHEN 4 THEN 'equal_weights_pred' ELSE 'weighted_pred' END"""
OPTIM_CASE = "CASE o_orderkey % 3 WHEN 0 THEN 'ensemble_selection' WHEN 1 THEN 'optimize_nnls' ELSE 'differential_evolution' END"


@query("compose_row_label", f"""SELECT method, optim_method, count(*) AS n,
      CASE WHEN method = 'weighted_pred' THEN method || '_' || optim_method ELSE method END AS row_label,
      method || ',' || optim_method || ',600' AS full_label
    FROM (SELECT {METHOD_CASE} AS method, {OPTIM_CASE} AS optim_method FROM orders) GROUP BY 1, 2""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.expr(METHOD_CASE).alias("method"), F.expr(OPTIM_CASE).alias("optim_method"))
    m, p = F.col("method"), F.col("optim_method")
    return o.groupBy(m, p).agg(F.count("*").alias("n")).withColumns(
        {"row_label": labels.method_with_optimiser(m, p), "full_label": labels.compose_row_label(m, p, F.lit(600))}
    )


def _label_case(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.METHOD_LABELS.items())
    return f"CASE {col} {whens} ELSE {col} END"


NAMED = f"CASE WHEN method = 'weighted_pred' THEN method || '_' || optim_method ELSE method END"


@query("map_labels", f"""SELECT o_orderkey, {_label_case('m')} AS label,
      CASE s WHEN 'F' THEN 'multi-level' WHEN 'O' THEN 'single-level' ELSE s END AS way
    FROM (SELECT o_orderkey, {NAMED} AS m, o_orderstatus AS s FROM
      (SELECT o_orderkey, o_orderstatus, {METHOD_CASE} AS method, {OPTIM_CASE} AS optim_method FROM orders))""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = labels.method_with_optimiser(F.expr(METHOD_CASE), F.expr(OPTIM_CASE))
    ways = F.replace(F.replace(F.col("o_orderstatus"), F.lit("F"), F.lit("global")), F.lit("O"), F.lit("level"))
    return o.select(
        "o_orderkey", labels.map_labels(name, labels.METHOD_LABELS).alias("label"),
        labels.map_labels(ways, labels.FORECAST_METHOD_LABELS).alias("way"),
    )


@query(
    "format_scores",
    """SELECT event_id, printf('%.4f', value / 4) AS four, printf('%.2f', value) AS two,
      printf('%02d h %02d m', CAST(floor(s / 3600) AS INTEGER), CAST(floor((s % 3600) / 60) AS INTEGER)) AS elapsed
    FROM (SELECT event_id, value, CAST(round_even(value * 100, 0) AS INTEGER) AS s FROM events)""",
)
def _(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", text.score_text(v / 4).alias("four"), text.score_text(v, 2).alias("two"),
        text.elapsed_text(v * 100).alias("elapsed"),
    )


@query(
    "strip_forecast_prefix",
    """SELECT o_orderkey, CASE WHEN m LIKE 'pred/%' THEN m[6:] WHEN m = 'pred' THEN 'base' ELSE m END AS method
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'pred' ELSE 'pred/' || o_orderpriority END AS m FROM orders)""",
)
def _(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.lit("pred")).otherwise(F.concat(F.lit("pred/"), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.strip_forecast_prefix(raw).alias("method"))


# ---- reshape ----


def _wide_days(spark, sf_dir):
    """Line counts per part size class and shipping month as one column per month."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.month("l_shipdate").alias("m"))
    wide = li.groupBy("l_returnflag", "l_linestatus").pivot("m", list(range(1, 13))).count()
    return wide.select("l_returnflag", "l_linestatus", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"d_{i}") for i in range(1, 13)])


@query(
    "unpivot_days",
    """SELECT k.l_returnflag, k.l_linestatus, CAST(DATE '2011-01-29' + (k.m - 1) AS DATE) AS date, CAST(coalesce(n, 0) AS INTEGER) AS sales
    FROM (SELECT * FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem), (SELECT CAST(unnest(generate_series(1, 12)) AS INTEGER) AS m)) k
    LEFT JOIN (SELECT l_returnflag, l_linestatus, month(l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY ALL) c
      ON k.l_returnflag = c.l_returnflag AND k.l_linestatus = c.l_linestatus AND k.m = c.m""",
)
def _(spark, sf_dir):
    wide = _wide_days(spark, sf_dir)
    return reshape.unpivot_days(wide, ["l_returnflag", "l_linestatus"], [f"d_{i}" for i in range(1, 13)], "2011-01-29")


@query(
    "unpivot_named",
    """SELECT c_mktsegment, CAST(s AS VARCHAR) AS brand, CAST(n AS VARCHAR) AS item, CAST(sum(CASE WHEN c_nationkey % 2 = s AND c_custkey % 3 = n THEN 1 ELSE 0 END) AS BIGINT) AS total
    FROM customer, (VALUES (0), (1)) a(s), (VALUES (0), (1), (2)) b(n) GROUP BY ALL""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cells = [
        F.count_if((F.col("c_nationkey") % 2 == s) & (F.col("c_custkey") % 3 == n)).alias(f"QTY_B{s}_{n}")
        for s in range(2) for n in range(3)
    ]
    wide = c.groupBy("c_mktsegment").agg(*cells)
    return reshape.unpivot_named(wide, ["c_mktsegment"], r"QTY_B(\d+)_(\d+)", ["brand", "item"])


@query(
    "levels_to_long",
    f"{PANEL} SELECT level_id, concat_ws('/', 'crossed', nullif(concat_ws('/', {K}), '')) AS unique_id, ds, CAST(y AS DOUBLE) AS y FROM levels",
)
def _(spark, sf_dir):
    return reshape.levels_to_long(crossed_levels(spark, sf_dir), KEYS, "crossed")


@query(
    "long_to_levels",
    f"{PANEL} SELECT 'crossed' AS dataset, r_name, o_orderpriority, ds, CAST(y AS DOUBLE) AS y FROM levels WHERE level_id = 2",
)
def _(spark, sf_dir):
    long = reshape.levels_to_long(crossed_levels(spark, sf_dir), KEYS, "crossed")
    return reshape.long_to_levels(long, KEYS, 2, root=True)


@query(
    "stack_forecasts",
    f"""{PANEL}, {ref.folds(12, 12)}, {ref.horizon(KEYS, 12, 12, 12, ['Naive', 'Average'])}
    SELECT model AS experiment, level_id, concat_ws('/', {K}) AS unique_id, ds, CAST(pred AS DOUBLE) AS pred FROM fc""",
    ordered=True,
)
def _(spark, sf_dir):
    arrays = crossed_arrays(spark, sf_dir)
    fc = create_forecasts(arrays, SERIES, ["Naive", "Average"], 12, "ME", 12, 12)
    frames = {m: fc.filter(F.col("model") == m) for m in ("Naive", "Average")}
    return reshape.stack_forecasts(frames, KEYS, "ds")
