"""Panel sources and sinks, and the cleaning of each public raw table.

Every builder is a lazy DataFrame plan from raw columns to `ts_id, date, total, <keys>`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.functions import dates, text
from stratocast.operators.hierarchy import leaf_sum
from stratocast.operators.ids import attach_series_id
from stratocast.operators.joins import join_calendar, join_prices, lump_rare_series
from stratocast.operators.reshape import unpivot_days, unpivot_named
from stratocast.spec import RESERVED


def panel_schema(keys: Sequence[str]) -> T.StructType:
    head = [("ts_id", T.IntegerType()), ("date", T.DateType()), ("total", T.DoubleType())]
    return T.StructType([T.StructField(n, t) for n, t in [*head, *[(k, T.StringType()) for k in keys]]])


def panel_from_csv(spark: SparkSession, path: str, keys: Sequence[str], dataset: str | None = None) -> DataFrame:
    """A leaf panel file with a header, read with its schema (no inference pass)."""
    df = spark.read.schema(panel_schema(keys)).csv(path, header=True)
    return tag_dataset(df, dataset) if dataset else df


def panel_from_table(spark: SparkSession, name: str, dataset: str | None = None) -> DataFrame:
    """A catalog table or, when the name is a path, a Parquet folder."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return tag_dataset(df, dataset) if dataset else df


def tag_dataset(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("dataset", F.lit(name))


def cast_panel(df: DataFrame) -> DataFrame:
    """Id and values to their types where they exist; text that is no number becomes null."""
    types = {"ts_id": "int", "total": "double", "Amount": "double"}
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def infer_keys(df: DataFrame, reserved: Sequence[str] = RESERVED) -> list[str]:
    """Every column that is not reserved is a key. Reads the schema only."""
    return [c for c in df.columns if c not in reserved]


def rename_cols(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop_cols(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def project_panel(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select("ts_id", "date", "total", *keys)


def sort_panel(df: DataFrame) -> DataFrame:
    return df.orderBy("ts_id", "date")


def filter_not_null_target(df: DataFrame, target: str = "total") -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def null_key_to_other(df: DataFrame, other: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in other.items()})


def write_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a managed table or, when the name is a path, a Parquet folder."""
    w = df.write.mode("overwrite").partitionBy(*partition_by)
    w.parquet(name) if "/" in name else w.saveAsTable(name)


def write_csv(df: DataFrame, path: str) -> None:
    """Written by the executors, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def finish(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum to leaves, number the series, order the columns."""
    panel = leaf_sum(df, keys, "date", "total")
    return project_panel(attach_series_id(panel, keys, dim=df), keys)


# ---- builders ----


def build_m5(sales: DataFrame, cal: DataFrame, prices: DataFrame, start: str = "2011-01-29") -> DataFrame:
    """Revenue per store and department. Units are unpivoted, priced by week and summed."""
    keys = ["state_id", "store_id", "cat_id", "dept_id"]
    days = [c for c in sales.columns if c.startswith("d_") and c[2:].isdigit()]
    days.sort(key=lambda c: int(c[2:]))
    long = unpivot_days(sales, [*keys, "item_id"], days, start)
    long = join_calendar(long, cal.select(F.col("date").cast("date").alias("date"), "wm_yr_wk"))
    priced = join_prices(long, prices, ["store_id", "item_id", "wm_yr_wk"], "sales", "sell_price", "total")
    return finish(priced, keys)


def build_australian_labour_market(raw: DataFrame) -> DataFrame:
    keys = ["Sex", "state_and_territory", "hier_1"]
    period = F.col("Mid-quarter month")
    month = F.regexp_extract(period, r"([A-Za-z]+)", 1)
    df = raw.select(
        "Sex",
        F.col("`State and territory (STT): ASGS (2011)`").alias("state_and_territory"),
        text.prefix_hierarchy(F.col("`Occupation of main job: ANZSCO (2013) v1.2`"), (1,))[0],
        dates.shift_months_end(dates.month_name_to_date(period, month), 1).alias("date"),
        text.decimal_comma(F.col("`Employed total ('000)`")).alias("total"),
    )
    return finish(df, keys)


def build_global_electricity_production(raw: DataFrame) -> DataFrame:
    day = dates.month_end(dates.parse_date(F.col("date"), "M/d/yyyy"))
    df = raw.withColumn("date", day).withColumn("total", F.col("value").try_cast("double"))
    return finish(df, ["parameter", "product", "country_name"])


def build_italian_grocery_store(raw: DataFrame) -> DataFrame:
    cols = [c for c in raw.columns if c.startswith("QTY_")]
    long = unpivot_named(
        raw.select(F.col("date").cast("date").alias("date"), *[F.col(c).cast("double") for c in cols]),
        ["date"], r"QTY_B(\d+)_(\d+)", ["brand", "item"],
    )
    # ids follow the numbers, so they are given before the prefixes
    numbers = long.withColumns({"brand": F.col("brand").cast("int"), "item": F.col("item").cast("int")})
    out = attach_series_id(numbers, ["brand", "item"])
    return out.select(
        "ts_id", "date", "total",
        text.prefix_id("B", F.col("brand")).alias("brand"), text.prefix_id("I", F.col("item")).alias("item"),
    )


def build_natural_gas_usage(raw: DataFrame) -> DataFrame:
    df = raw.withColumn("date", dates.year_month_to_date(F.col("year"), F.col("month")))
    return finish(df.withColumn("total", F.col("value").try_cast("double")), ["duoarea", "process"])


def build_prison_population(raw: DataFrame) -> DataFrame:
    df = raw.withColumnsRenamed({"Date": "date", "Count": "total"})
    df = df.withColumn("date", F.last_day(F.col("date").cast("date")))
    return finish(df, ["State", "Gender", "Legal", "Indigenous"])


def build_retail_prices(raw: DataFrame, after: str = "2011-01-01") -> DataFrame:
    """Ids are numbered before the date filter, over all series."""
    keys = ["State", "Commodity"]
    df = filter_not_null_target(rename_cols(raw, {"Date": "date", "Retail Price": "total"}))
    df = null_key_to_other(df, {"Commodity": "OtherCommoditys", "State": "OtherStates"})
    df = df.withColumn("date", dates.month_end(dates.parse_date(F.col("date"), "MMM-yyyy")))
    out = finish(df, keys).filter(F.col("date") > F.lit(after).cast("date"))
    return out.withColumns({k: text.sanitize_separator(F.col(k)) for k in keys})


def build_store_item_demand(raw: DataFrame) -> DataFrame:
    df = raw.withColumn("date", dates.month_end(F.col("date").cast("date"))).withColumnRenamed("sales", "total")
    out = finish(df.withColumns({k: F.col(k).cast("int") for k in ("store", "item")}), ["store", "item"])
    return out.withColumns(
        {"store": text.prefix_id("S", F.col("store")), "item": text.prefix_id("I", F.col("item"))}
    )


def build_superstore(raw: DataFrame) -> DataFrame:
    df = raw.withColumnsRenamed({"sales": "total", "Ship Mode": "ShipMode"})
    df = df.withColumn("date", dates.month_end(F.col("Order Date").cast("date")))
    return finish(df, ["ShipMode", "Segment", "Region", "Category"])


def build_tourism(raw: DataFrame) -> DataFrame:
    """Quarters are given by their first day; a quarter end is the day before the next one."""
    df = raw.select(
        dates.shift_days(F.col("Quarter").cast("date"), -1).alias("date"),
        F.col("trips").alias("total"), "Region", "State", "Purpose",
    )
    keys = ["Region", "State", "Purpose"]
    return project_panel(attach_series_id(df, keys), keys)


def build_website_traffic(raw: DataFrame, min_rows: int = 1000) -> DataFrame:
    keys = ["DeviceCategory", "Browser"]
    names = {"Date": "date", "Device Category": "DeviceCategory", "# of Visitors": "total"}
    df = rename_cols(raw, names).withColumn("date", dates.parse_date(F.col("date").cast("string")))
    daily = leaf_sum(df, keys, "date", "total")
    return finish(lump_rare_series(daily, keys, min_rows, "total", "date"), keys)


def build_ledger(raw: DataFrame, target: str = "Amount") -> DataFrame:
    """Year and month-name columns; every other column is a key. Values may not contain the id separator."""
    df = raw.withColumns({c: text.sanitize_separator(F.col(c)) for c, t in raw.dtypes if t == "string"})
    df = df.withColumn("date", dates.month_name_to_date(F.col("Year").cast("string"), F.col("Period")))
    df = df.withColumnRenamed(target, "total").drop("Year", "Period")
    keys = infer_keys(df)
    return project_panel(attach_series_id(df.drop("ts_id"), keys, first=0), keys)


BUILDERS = {
    "australian_labour_market": build_australian_labour_market,
    "global_electricity_production": build_global_electricity_production,
    "italian_grocery_store": build_italian_grocery_store,
    "natural_gas_usage": build_natural_gas_usage,
    "prison_population": build_prison_population,
    "retail_prices": build_retail_prices,
    "store_item_demand": build_store_item_demand,
    "superstore": build_superstore,
    "tourism": build_tourism,
    "website_traffic": build_website_traffic,
}
