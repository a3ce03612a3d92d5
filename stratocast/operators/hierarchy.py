"""Sums over every subset of the keys. All levels live in one long table; `level_id` is the grouping
bitmap (first key is the highest bit, a set bit means that key is rolled up)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# level_id is an int, one bit for each key.
BITMAP_KEYS = 31
KEYS_PER_EXPAND = 4


def depth(level_id: Column, n_keys: int) -> Column:
    """Number of keys a level has; the top level has none."""
    return F.lit(n_keys) - F.bit_count(level_id)


def level_of(keys: Sequence[str], subset: Sequence[str]) -> int:
    """level_id of a key subset."""
    unknown = set(subset) - set(keys)
    if unknown:
        raise ValueError(f"not keys of this panel: {sorted(unknown)}")
    n = len(keys)
    return sum(1 << (n - 1 - i) for i, k in enumerate(keys) if k not in subset)


def keys_of(keys: Sequence[str], level_id: int) -> list[str]:
    n = len(keys)
    return [k for i, k in enumerate(keys) if not level_id >> (n - 1 - i) & 1]


def has_key(level_id: Column, keys: Sequence[str], key: str) -> Column:
    bit = 1 << (len(keys) - 1 - list(keys).index(key))
    return level_id.bitwiseAND(F.lit(bit)) == 0


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a key value belong to no series; a null would look like a rolled-up key."""
    return df.dropna(subset=list(keys))


def leaf_sum(df: DataFrame, keys: Sequence[str], ds: str = "ds", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Raw rows to one value per leaf and date. Summed partially before the shuffle, so a hot key costs no more."""
    return df.groupBy(*by, *keys, ds).agg(F.sum(y).alias(y))


def _cube_some(df, by, fixed, cubed, aggs, sets=None):
    """Grouping sets over `cubed`, always grouped by `by` and `fixed`; adds the bitmap of `cubed` as _gid."""
    cols = [*by, *fixed, *cubed]
    if sets is None:
        sets = [c for r in range(len(cubed) + 1) for c in combinations(cubed, r)]
    return df.groupingSets([[*by, *fixed, *s] for s in sets], *cols).agg(F.grouping_id().alias("_gid"), *aggs)


def cube_levels(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = ("ds",),
    measures: Sequence[str] = ("y",),
    levels: Sequence[Sequence[str]] | None = None,
    null_keys: str = "drop",
) -> DataFrame:
    """Sum the measures for every key subset (or for the listed ones) and every `by` group.

    Up to four keys go through one Expand. More keys are cubed four at a time: a sum of sums is the sum,
    and each step expands rows that the step before has already reduced.
    """
    keys = list(keys)
    if len(keys) > BITMAP_KEYS:
        raise ValueError(f"level_id has a bit for each of at most {BITMAP_KEYS} keys, not {len(keys)}")
    if null_keys == "drop":
        df = drop_null_keys(df, keys)
    if levels is not None:
        sets = [[k for k in keys if k in s] for s in levels]
        out = _cube_some(df, by, [], keys, [F.sum(m).alias(m) for m in measures], sets)
        return out.select(F.col("_gid").cast("int").alias("level_id"), *by, *keys, *measures)
    n = len(keys)
    out = df.select(*by, *keys, *measures, F.lit(0).cast("bigint").alias("_level"))
    for start in range(0, n, KEYS_PER_EXPAND):
        chunk = keys[start : start + KEYS_PER_EXPAND]
        rest = [k for k in keys if k not in chunk]
        shift = n - start - len(chunk)
        group = list(by) + (["_level"] if start else [])
        out = _cube_some(out, group, rest, chunk, [F.sum(m).alias(m) for m in measures])
        level = F.shiftleft(F.col("_gid"), shift)
        out = out.withColumn("_level", F.col("_level") + level if start else level).drop("_gid")
    return out.select(F.col("_level").cast("int").alias("level_id"), *by, *keys, *measures)


def cube_arrays(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`cube_levels` of rows that hold a whole series (calendar.filled_arrays): values are summed by their places.

    Only the first key may have many values. The leaves of one of its values are one row, so that they move once,
    whatever the number of levels.
    """
    leaves = drop_null_keys(leaves, keys)
    first, rest = keys[0], list(keys[1:])
    y_type = leaves.select(F.sum(F.get("y", F.lit(0)))).schema[0].dataType
    leaves = leaves.repartition(first)
    one = F.struct(*rest, "dated", "undated", "y")
    below = leaves.groupBy(first).agg(F.collect_list(one).alias("_l")).withColumn("_up", F.lit(0))
    cells = leaves.select(*rest, "dated", "undated", F.posexplode_outer("y").alias("_at", "y"))  # no filter: both read one shuffle
    cells = cells.groupBy(*rest, "_at").agg(F.max("dated").alias("dated"), F.max("undated").alias("undated"), F.sum("y").alias("y"))
    places = F.transform(F.sort_array(F.collect_list(F.struct("_at", "y"))), lambda c: c["y"].cast(y_type))
    top = cells.groupBy(*rest).agg(F.max("dated").alias("dated"), F.max("undated").alias("undated"), places.alias("y"))
    above = top.filter("dated is not null").agg(F.collect_list(one).alias("_l"))  # without keys left there is always a row
    above = above.select(F.lit(None).cast(leaves.schema[first].dataType).alias(first), "_l", F.lit(1 << len(rest)).alias("_up"))
    rows = below.unionByName(above)

    def added(members: Column) -> Column:
        plus = lambda a, b: F.zip_with(a, b, lambda p, q: F.coalesce(p + q, p, q).cast(y_type))
        return F.aggregate(members, F.array().cast(T.ArrayType(y_type)), lambda a, m: plus(a, m["y"]))

    def level(gid: int) -> Column:
        kept = keys_of(rest, gid)
        if kept == rest:
            return F.transform("_l", lambda m: row(gid, m, m["dated"], m["undated"], m["y"].cast(T.ArrayType(y_type))))
        name = lambda m: F.struct(F.lit(gid).alias("_gid"), *[m[k].alias(k) for k in kept])
        nodes = F.array_distinct(F.transform("_l", name))
        nodes = F.transform(nodes, lambda v: F.struct(v.alias("v"), F.filter("_l", lambda m: name(m) == v).alias("m")))
        some = lambda members, flag: F.exists(members, lambda m: m[flag])
        return F.transform(nodes, lambda g: row(gid, g["v"], some(g["m"], "dated"), some(g["m"], "undated"), added(g["m"])))

    def row(gid: int, of: Column, dated: Column, undated: Column, y: Column) -> Column:
        names = [(of[k] if k in keys_of(rest, gid) else F.lit(None)).cast(leaves.schema[k].dataType).alias(k) for k in rest]
        return F.struct(F.lit(gid).alias("_gid"), *names, dated.alias("dated"), undated.alias("undated"), y.alias("y"))

    nodes = F.concat(*[level(gid) for gid in range(1 << len(rest))])
    out = rows.select(first, "_up", F.inline(nodes))
    return out.select((F.col("_up") + F.col("_gid")).cast("int").alias("level_id"), *keys, "dated", "undated", "y")


def summing_relation(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Node to leaf incidence: one row per leaf and ancestor. `leaf_<key>` names the leaf."""
    n = len(keys)
    masks = F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("level_id")
    dim = drop_null_keys(leaves, keys).select(*keys).distinct()
    return dim.select(masks, *[F.col(k).alias(f"leaf_{k}") for k in keys]).select(
        "level_id",
        *[F.when(has_key(F.col("level_id"), keys, k), F.col(f"leaf_{k}")).alias(k) for k in keys],
        *[f"leaf_{k}" for k in keys],
    )


def level_nodes(leaves: DataFrame, keys: Sequence[str], measures: Sequence[str] = ()) -> DataFrame:
    """All nodes of all levels with the number of leaves below each."""
    dim = drop_null_keys(leaves, keys).select(*keys).distinct().withColumn("n_leaves", F.lit(1).cast("bigint"))
    return cube_levels(dim, keys, by=(), measures=("n_leaves",))


def subset_cardinality(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct value combinations of every key subset, in one job."""
    return level_nodes(leaves, keys).groupBy("level_id").agg(F.count("*").alias("n_nodes"))


def collapse_to_top(levels: DataFrame, by: Sequence[str] = (), value: str = "y") -> DataFrame:
    """Every level summed over its nodes per date: what that level says about the total."""
    return levels.groupBy(*by, "level_id", "ds").agg(F.sum(value).alias(value))


def collapse_forecast(forecasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same for predictions; actuals come along where the table has them."""
    sums = [F.sum(c).alias(c) for c in ("y", "pred") if c in forecasts.columns]
    return forecasts.groupBy(*by, "level_id", "ds").agg(*sums)
