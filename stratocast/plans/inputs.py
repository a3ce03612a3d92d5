"""Panels derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.session import table
from stratocast.spec import PanelSpec

# Crossed keys, monthly.
CROSSED = PanelSpec("crossed", ("r_name", "c_mktsegment", "o_orderpriority"), "ME")
# A nested pair of keys and a crossed one, monthly.
NESTED = PanelSpec("nested", ("r_name", "n_name", "c_mktsegment"), "ME")
# Crossed keys whose number of series grows with the data, monthly.
WIDE = PanelSpec("wide", ("l_suppkey", "l_returnflag", "l_linestatus"), "ME")
# Daily.
DAILY = PanelSpec("daily", ("event_type", "user_group"), "D")

MONEY = "decimal(18,2)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer attributes used as keys. Nation and region have fixed, tiny sizes (25 and 5 rows)."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select(
        "c_custkey", "c_mktsegment", "n_name", "r_name"
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with every key, month-end date and exact money value."""
    orders = table(spark, sf_dir, "orders")
    return orders.join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(
        "r_name",
        "n_name",
        "c_mktsegment",
        "o_orderpriority",
        F.last_day("o_orderdate").alias("ds"),
        F.col("o_totalprice").cast(MONEY).alias("y"),
    )


def crossed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_rows(spark, sf_dir).select(*CROSSED.keys, "ds", "y")


def nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_rows(spark, sf_dir).select(*NESTED.keys, "ds", "y")


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("l_suppkey"),
        "l_returnflag",
        "l_linestatus",
        F.last_day("l_shipdate").alias("ds"),
        F.col("l_extendedprice").cast(MONEY).alias("y"),
    )


def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_type",
        (F.col("user_id") % 10).cast("string").alias("user_group"),
        F.to_date("ts").alias("ds"),
        F.col("value").cast(MONEY).alias("y"),
    )
