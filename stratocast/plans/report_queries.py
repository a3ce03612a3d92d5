"""Ranks, summaries and report tables over scores derived from the orders.

Every order lands in one cell of an experiment grid (region = dataset, segment = model, and so on); the
score of a cell is the mean price of its orders. That gives a metrics table of the usual shape whose
values follow the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratocast.functions.labels import FORECAST_METHOD_LABELS, METHOD_LABELS
from stratocast.operators import reports
from stratocast.plans import inputs
from stratocast.plans.cleaning_queries import METHOD_CASE, OPTIM_CASE, _label_case
from stratocast.plans.registry import query
from stratocast.session import table

MODEL_CASE = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AutoETS' WHEN 'BUILDING' THEN 'AutoARIMA'
      WHEN 'FURNITURE' THEN 'PooledLags' ELSE 'Leaderboard' END"""
WAY_CASE = f"CASE WHEN {MODEL_CASE} IN ('AutoETS', 'AutoARIMA') THEN 'global' WHEN o_orderstatus = 'F' THEN 'level' ELSE 'global' END"
METRIC_CASE = "CASE o_orderkey % 4 WHEN 0 THEN 'MASE' WHEN 1 THEN 'WAPE' WHEN 2 THEN 'RMSSE' ELSE 'SMAPE' END"
LIMIT_CASE = "CASE WHEN o_orderstatus = 'O' THEN 1800 ELSE 600 END"
CELL = ["dataset", "forecast_model", "forecast_method", "method", "optim_method", "metric", "time_limit"]

SCORES = f"""WITH cells AS (
  SELECT r_name AS dataset, {MODEL_CASE} AS forecast_model, {WAY_CASE} AS forecast_method, {METHOD_CASE} AS method,
    {OPTIM_CASE} AS optim_method, {METRIC_CASE} AS metric, {LIMIT_CASE} AS time_limit, CAST(o_totalprice AS DECIMAL(18,2)) AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
scores AS (
  SELECT forecast_model || '_' || forecast_method AS "Model", optim_method, forecast_method, forecast_model,
    CAST(count(*) * 100 AS DOUBLE) AS elapsed_time, method, metric, dataset,
    CASE WHEN dataset = 'ASIA' THEN 'private' ELSE 'public' END AS dataset_type, time_limit,
    CAST(sum(p) AS DOUBLE) / count(*) / 1000 AS value
  FROM cells GROUP BY {', '.join(CELL)}),
dup AS (SELECT * FROM scores UNION ALL SELECT * REPLACE ('level' AS forecast_method) FROM scores WHERE forecast_model IN ('AutoETS', 'AutoARIMA')),
uniq AS (SELECT * FROM dup WHERE method = 'weighted_pred' OR optim_method = 'ensemble_selection'),
named AS (SELECT *, {_label_case("CASE WHEN method = 'weighted_pred' THEN method || '_' || optim_method ELSE method END")} AS label,
  CASE forecast_method WHEN 'global' THEN 'multi-level' WHEN 'level' THEN 'single-level' END AS way FROM uniq)"""


def scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(inputs.customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    cells = o.select(
        F.col("r_name").alias("dataset"), F.expr(MODEL_CASE).alias("forecast_model"), F.expr(WAY_CASE).alias("forecast_method"),
        F.expr(METHOD_CASE).alias("method"), F.expr(OPTIM_CASE).alias("optim_method"), F.expr(METRIC_CASE).alias("metric"),
        F.expr(LIMIT_CASE).alias("time_limit"), F.col("o_totalprice").cast(inputs.MONEY).alias("p"),
    )
    out = cells.groupBy(*CELL).agg(F.sum("p").cast("double").alias("s"), F.count("*").alias("n"))
    return out.select(
        F.concat_ws("_", "forecast_model", "forecast_method").alias("Model"), "optim_method", "forecast_method", "forecast_model",
        (F.col("n") * 100).cast("double").alias("elapsed_time"), "method", "metric", "dataset",
        F.when(F.col("dataset") == "ASIA", "private").otherwise("public").alias("dataset_type"), "time_limit",
        (F.col("s") / F.col("n") / 1000).alias("value"),
    )


@query("duplicate_as_level", f"{SCORES} SELECT * FROM dup")
def _(spark, sf_dir):
    return reports.duplicate_as_level(scores(spark, sf_dir))


@query("dedupe_baselines", f"{SCORES} SELECT * FROM uniq")
def _(spark, sf_dir):
    return reports.dedupe_baselines(reports.duplicate_as_level(scores(spark, sf_dir)))


def unique_scores(spark, sf_dir):
    return reports.dedupe_baselines(reports.duplicate_as_level(scores(spark, sf_dir)))


RANKED = f"""{SCORES}, ranked AS (SELECT *, rank() OVER (PARTITION BY dataset, forecast_method ORDER BY value) AS rank FROM uniq WHERE metric = 'MASE'),
won AS (SELECT *, CASE WHEN rank = 1 THEN 1.0 / count(*) FILTER (rank = 1) OVER (PARTITION BY dataset, forecast_method) ELSE 0.0 END AS wins FROM ranked)"""
GROUP = ["dataset", "forecast_method"]


def ranked(spark, sf_dir):
    return reports.rank_min(unique_scores(spark, sf_dir).filter("metric = 'MASE'"), GROUP)


@query("rank_min", f"{RANKED} SELECT * FROM ranked")
def _(spark, sf_dir):
    return ranked(spark, sf_dir)


OWED = """SELECT c_mktsegment, n_name, CASE WHEN n % 5 > 0 THEN n END AS value FROM (
      SELECT c_mktsegment, n_name, count(*) FILTER (c_acctbal < 0) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


@query(
    "rank_with_ties_and_gaps",
    f"""WITH o AS ({OWED}), r AS (SELECT *, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY c_mktsegment ORDER BY value NULLS LAST) END AS rank FROM o)
    SELECT *, CASE WHEN rank = 1 THEN 1.0 / count(*) FILTER (rank = 1) OVER (PARTITION BY c_mktsegment) ELSE 0.0 END AS wins FROM r""",
)
def _(spark, sf_dir):
    """Counts per segment and nation make ties, those divisible by five are missing. A group has one row per nation."""
    places = inputs.customers(spark, sf_dir).select("c_custkey", "c_mktsegment", "n_name")
    debts = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    n = debts.join(places, "c_custkey").groupBy("c_mktsegment", "n_name").agg(F.count_if(F.col("c_acctbal") < 0).alias("n"))
    owed = n.select("c_mktsegment", "n_name", F.when(F.col("n") % 5 > 0, F.col("n")).alias("value"))
    return reports.split_wins(reports.rank_min(owed, ["c_mktsegment"]), ["c_mktsegment"])


@query("split_wins", f"{RANKED} SELECT * FROM won")
def _(spark, sf_dir):
    return reports.split_wins(ranked(spark, sf_dir), GROUP)


@query(
    "score_summary",
    f"""{RANKED} SELECT forecast_model, method, optim_method, round(avg(value), 9) AS avg_value, round(stddev_samp(value), 9) AS std_value, avg(rank) AS avg_rank,
      round(sum(wins), 9) AS total_wins, avg(elapsed_time) AS avg_elapsed_time FROM won GROUP BY ALL""",
)
def _(spark, sf_dir):
    out = reports.score_summary(reports.split_wins(ranked(spark, sf_dir), GROUP), ["forecast_model", "method", "optim_method"])
    return out.withColumns({c: F.round(c, 9) for c in ("avg_value", "std_value", "total_wins")})


@query("control_counts", f"{SCORES} SELECT method, optim_method, metric, forecast_model, count(value) AS n_scores FROM uniq GROUP BY ALL")
def _(spark, sf_dir):
    return reports.control_counts(unique_scores(spark, sf_dir), ["method", "optim_method", "metric"], ["forecast_model"])


def _position(col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(METHOD_LABELS.values())) + " END"


@query("ordered_labels", f"{SCORES}, a AS (SELECT DISTINCT label FROM named) SELECT label, {_position('label')} AS pos FROM a ORDER BY pos")
def _(spark, sf_dir):
    from stratocast.functions.labels import label_position, map_labels, method_with_optimiser

    name = method_with_optimiser(F.col("method"), F.col("optim_method"))
    df = unique_scores(spark, sf_dir).select(map_labels(name, METHOD_LABELS).alias("label")).distinct()
    return reports.ordered(df, "label").withColumn("pos", label_position(F.col("label")))


@query("drop_constant_columns", f"{SCORES} SELECT method, optim_method, dataset, value FROM uniq WHERE metric = 'MASE' AND forecast_model = 'PooledLags' AND forecast_method = 'level'")
def _(spark, sf_dir):
    df = unique_scores(spark, sf_dir).filter("metric = 'MASE' and forecast_model = 'PooledLags' and forecast_method = 'level'")
    return reports.drop_constant_columns(df.drop("elapsed_time", "Model", "dataset_type"))


# ---- tables ----

MODELS = ["AutoARIMA", "AutoETS", "Leaderboard", "PooledLags"]


def _pivot_sql(where: str, row: str, cells: dict[str, str], text: bool = True) -> str:
    """cells: output column -> condition on named rows."""
    shown = lambda e: f"CASE WHEN {e} IS NOT NULL THEN printf('%.4f', {e}) END" if text else e
    cols = ",\n      ".join(f'{shown(f"avg(value) FILTER ({c})")} AS "{n}"' for n, c in cells.items())
    return f"{SCORES} SELECT {row},\n      {cols} FROM named WHERE {where} GROUP BY 1"


def _way_cells() -> dict[str, str]:
    out = {m: f"forecast_model = '{m}' AND forecast_method = 'level'" for m in ("AutoARIMA", "AutoETS")}
    for way in ("single-level", "multi-level"):
        for m in ("Leaderboard", "PooledLags"):
            out[f"{m} ({way})"] = f"forecast_model = '{m}' AND way = '{way}'"
    return out


@query("pivot_model_metrics", _pivot_sql("metric = 'MASE'", "label AS method", _way_cells()))
def _(spark, sf_dir):
    return reports.pivot_model_metrics(scores(spark, sf_dir), "MASE", add_to_col_values="forecast_method", columns=list(_way_cells()))


@query("merge_pivots", _pivot_sql("metric = 'WAPE' AND dataset_type = 'public'", "label AS method", _way_cells()))
def _(spark, sf_dir):
    """One pivot on a composed label instead of merged pivots; here the columns are found from the data."""
    return reports.pivot_model_metrics(
        scores(spark, sf_dir), "WAPE", add_to_col_values="forecast_method", dataset_type="public"
    )


LABELS = list(METHOD_LABELS.values())


def _table_query(name: str, sql: str, **changes):
    @query(name, sql)
    def _(spark, sf_dir):
        return reports.published_table(scores(spark, sf_dir), name, **changes)


_table_query("table_7", _pivot_sql("metric = 'MASE' AND time_limit = 600", "label AS method", _way_cells()), columns=list(_way_cells()))

for _n, _way, _limit in (("table_13", "level", 600), ("table_14", "global", 600), ("table_16", "global", 1800)):
    _table_query(
        _n,
        _pivot_sql(
            f"metric = 'MASE' AND forecast_model = 'Leaderboard' AND forecast_method = '{_way}' AND time_limit = {_limit}",
            "dataset", {v: f"label = '{v}'" for v in LABELS},
        ),
        columns=LABELS,
    )


def _two(e: str) -> str:
    return f"CASE WHEN {e} IS NOT NULL THEN printf('%.2f', {e}) END"


def _rank_sql(where: str, group: str, spread: dict[str, str]) -> str:
    cols = []
    for v, cond in spread.items():
        for name, e in (("avg_value", "avg(value)"), ("std_value", "stddev_samp(value)"), ("avg_rank", "avg(rank)"), ("total_wins", "sum(wins)")):
            cols.append(f'{_two(f"{e} FILTER ({cond})")} AS "{name}_{v}"')
    return f"""{SCORES}, rk AS (SELECT *, rank() OVER (PARTITION BY dataset, {group} ORDER BY value) AS rank FROM named WHERE {where}),
    wn AS (SELECT *, CASE WHEN rank = 1 THEN 1.0 / count(*) FILTER (rank = 1) OVER (PARTITION BY dataset, {group}) ELSE 0.0 END AS wins FROM rk)
    SELECT label AS method, {', '.join(cols)} FROM wn GROUP BY 1"""


_table_query(
    "table_8",
    _rank_sql("metric = 'MASE' AND forecast_model = 'Leaderboard' AND time_limit = 600", "way", {v: f"way = '{v}'" for v in FORECAST_METHOD_LABELS.values()}),
    grouping_values=list(FORECAST_METHOD_LABELS.values()),
)
_table_query(
    "table_9",
    _rank_sql("metric = 'MASE' AND forecast_method = 'global' AND time_limit = 1800", "forecast_model", {m: f"forecast_model = '{m}'" for m in ("Leaderboard", "PooledLags")}),
    grouping_values=MODELS,
)


def _rank_plain_sql(where: str) -> str:
    return f"""{SCORES}, rk AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value) AS rank FROM named WHERE {where}),
    wn AS (SELECT *, CASE WHEN rank = 1 THEN 1.0 / count(*) FILTER (rank = 1) OVER (PARTITION BY dataset) ELSE 0.0 END AS wins FROM rk)
    SELECT forecast_model || ',' || optim_method || ',' || way || ',' || time_limit AS forecast_model, {_two('avg(value)')} AS avg_value,
      {_two('stddev_samp(value)')} AS std_value, {_two('avg(rank)')} AS avg_rank, {_two('sum(wins)')} AS total_wins,
      printf('%02d h %02d m', CAST(floor(round_even(avg(elapsed_time), 0) / 3600) AS INTEGER),
        CAST(floor((CAST(round_even(avg(elapsed_time), 0) AS BIGINT) % 3600) / 60) AS INTEGER)) AS avg_elapsed_time
    FROM wn GROUP BY 1"""


_table_query("table_10", _rank_plain_sql("metric = 'MASE' AND method = 'weighted_pred' AND optim_method = 'ensemble_selection'"))
_table_query("table_18", _rank_plain_sql("metric = 'MASE' AND method = 'base'"))


@query(
    "rank_models",
    f"""{SCORES}, rk AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value) AS rank FROM named WHERE metric = 'RMSSE'),
    wn AS (SELECT *, CASE WHEN rank = 1 THEN 1.0 / count(*) FILTER (rank = 1) OVER (PARTITION BY dataset) ELSE 0.0 END AS wins FROM rk)
    SELECT label AS method, round(avg(value), 9) AS avg_value, round(stddev_samp(value), 9) AS std_value, avg(rank) AS avg_rank,
      round(sum(wins), 9) AS total_wins, avg(elapsed_time) AS avg_elapsed_time FROM wn GROUP BY 1""",
)
def _(spark, sf_dir):
    out = reports.rank_models(scores(spark, sf_dir), "RMSSE", text=False)
    return out.withColumns({c: F.round(c, 9) for c in ("avg_value", "std_value", "total_wins")})


METRICS = ("MASE", "RMSSE", "SMAPE", "WAPE")


def _group_cells(column: str, values) -> dict[str, str]:
    return {f"{m}_{v}": f"metric = '{m}' AND {column} = '{v}'" for v in values for m in METRICS}


WAYS = _group_cells("way", ["single-level", "multi-level"])
_table_query("table_15", _pivot_sql("forecast_model = 'Leaderboard' AND time_limit = 600", "label AS method", WAYS), columns=list(WAYS))
_table_query("table_17", _pivot_sql("time_limit = 1800", "label AS method", _group_cells("forecast_model", ["Leaderboard", "PooledLags"])), columns=list(_group_cells("forecast_model", MODELS)))


@query("metrics_by_group", _pivot_sql("true", "label AS method", _group_cells("dataset_type", ["private", "public"])))
def _(spark, sf_dir):
    return reports.metrics_by_group(scores(spark, sf_dir), METRICS, "dataset_type")
