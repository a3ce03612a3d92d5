"""Consecutive series ids without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratocast.session import cut_lineage


def dense_ids(dim: DataFrame, keys: Sequence[str], name: str = "ts_id", first: int = 1, ranges: int | None = None):
    """Rank of every distinct key tuple in key order, as an int; more tuples than an int has raise an error.

    The tuples are dealt by ranges of the key and sorted in their task. A tuple's id is its place in the task and the
    sizes of the tasks before. The ranges are sampled anew in every run, so the dealt tuples are written first.
    """
    tuples = dim.select(*keys).distinct()
    dealt = tuples.repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys)
    dealt = cut_lineage(dealt.withColumns({"_place": F.monotonically_increasing_id(), "_task": F.spark_partition_id()}))
    sizes = dealt.groupBy("_task").agg(F.count("*").alias("n"), F.min("_place").alias("_low"))
    # one row per task
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_task", "_low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.col("_place") - F.col("_low") + first
    return dealt.join(offsets, "_task").select(*keys, place.cast("int").alias(name))


def attach_series_id(
    df: DataFrame, keys: Sequence[str], name: str = "ts_id", first: int = 1, dim: DataFrame | None = None
) -> DataFrame:
    """Id of each row's series; rows whose keys are null get none. `dim` is any table with the same key
    tuples, where that is cheaper to read than `df`."""
    dim = df if dim is None else dim
    ids = dense_ids(dim.dropna(subset=list(keys)), keys, name, first)
    return df.join(ids, list(keys), "left")
