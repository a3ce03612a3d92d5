"""Shards by jump consistent hashing: stable keys, no ring table, the least movement when shards are added."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratocast.llm.common import documents, id_key, real_id, text_of
from stratocast.session import cut_lineage

#: The multiplier of the generator in the published algorithm (fixed value).
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. With one shard more, a key keeps its shard or moves into the new one."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.uint64, copy=True)
    shard = np.full(len(state), -1, dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * STEP + np.uint64(1)
        leap = (shard[live] + 1).astype(np.float64) * (float(1 << 31) / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        ahead[live] = leap.astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def spread(keys: np.ndarray) -> np.ndarray:
    """Ids that differ in a few bits become unrelated keys (a bijection, so distinct ids stay distinct)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key as a column."""

    @F.pandas_udf("int")
    def one(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(spread(ids.to_numpy(dtype=np.int64)), shards).astype(np.int32))

    return one(key)


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) for every row.

    The shard depends on the id and the number of shards alone. `slot` counts the rows of a shard from 0 without
    gaps, in the order of (id, checksum, size); rows that agree in all of these are interchangeable. Null ids are
    one key of their own; null texts have size 8 and checksum 0; other columns are not read.

    The texts are reduced to size and checksum in the scan. What is left is dealt by ranges of (shard, id), so that
    a large shard, or an id that holds many rows, is spread over many tasks; slots come from counts per task.
    """
    key = id_key(id_col)
    rows = docs.select(
        key.alias("id"), (F.octet_length(text_of(text_col)) + 8).cast("long").alias("size"), F.crc32(text_of(text_col).cast("binary")).alias("text_crc32")
    )
    rows = rows.withColumns({"shard": shard_of(F.col("id"), shards), "grown_shard": shard_of(F.col("id"), shards + 1)})
    order = ["shard", "id", "text_crc32", "size"]
    dealt = rows.withColumn("salt", F.rand(7)).repartitionByRange(*order, "salt").drop("salt").sortWithinPartitions(*order)
    # written once: ranges are sampled anew in every run, and the counts must be those of the rows they number
    dealt = cut_lineage(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("task", F.spark_partition_id()))
    counts = dealt.groupBy("shard", "task").agg(F.count("*").alias("rows"), F.min("place").alias("low"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "task", "low", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return dealt.join(starts, ["shard", "task"]).select(
        real_id().alias("doc_id"), "size", "text_crc32", "shard", (F.col("start") + F.col("place") - F.col("low")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 1_000_000) -> None:
    """The rows with all their columns under path/shard=<n>/, a shard in as many files as its rows need."""
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    placed = docs.withColumn(name, shard_of(id_key(id_col), shards))
    placed.repartition(name, F.pmod(F.xxhash64(id_key(id_col), text_of(text_col)), F.lit(8))).write.option("maxRecordsPerFile", rows_per_file).partitionBy(name).mode("overwrite").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(documents(spark, sf_dir), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
