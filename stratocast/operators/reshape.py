"""Wide to long and between the level table and single levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.functions.dates import day_index_to_date
from stratocast.functions.text import decode_id, encode_id
from stratocast.operators.hierarchy import keys_of


def unpivot_days(df: DataFrame, ids: Sequence[str], days: Sequence[str], start: str, value: str = "sales") -> DataFrame:
    """One column per day to one row per day; position 0 is the start date."""
    arr = F.array(*[F.col(c).cast("int") for c in days])
    return df.select(*ids, F.posexplode(arr).alias("_pos", value)).select(
        *ids, day_index_to_date(start, F.col("_pos")).alias("date"), value
    )


def unpivot_named(df: DataFrame, ids: Sequence[str], pattern: str, names: Sequence[str], value: str = "total") -> DataFrame:
    """Columns whose name matches the pattern to rows; the groups of the pattern become columns."""
    cols = [c for c in df.columns if c not in ids]
    long = df.unpivot(list(ids), cols, "_name", value)
    parts = [F.nullif(F.regexp_extract("_name", pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)]
    return long.select(*ids, *parts, value)


def levels_to_long(levels: DataFrame, keys: Sequence[str], root: str | None = None, include_all: bool = False) -> DataFrame:
    """Level table with ids: level_id, unique_id, ds, y (and the keys). `root` leads every id."""
    uid = encode_id(keys)
    if root:
        uid = F.concat_ws("/", F.lit(root), F.nullif(uid, F.lit("")))
    extra = [c for c in levels.columns if c not in ("level_id", "ds", "y")] if include_all else []
    return levels.select("level_id", uid.alias("unique_id"), "ds", "y", *extra)


def long_to_levels(long: DataFrame, keys: Sequence[str], level_id: int, root: bool = False) -> DataFrame:
    """Rows of one level with the keys read back from the ids."""
    names = (["dataset"] if root else []) + keys_of(keys, level_id)
    rest = [c for c in long.columns if c not in ("level_id", "unique_id")]
    return long.filter(F.col("level_id") == level_id).select(*decode_id(F.col("unique_id"), names), *rest)


def stack_forecasts(frames: dict[str, DataFrame], keys: Sequence[str], date_col: str = "date", value: str = "pred") -> DataFrame:
    """Labelled forecasts as one table: experiment, level_id, unique_id, ds, value."""
    out = None
    for label, df in frames.items():
        kind = dict(df.dtypes).get(value)
        if kind is None or not kind.startswith(("double", "float", "decimal", "int", "bigint")):
            raise ValueError(f"forecast {label!r} has no numeric column {value!r}")
        part = df.select(
            F.lit(label).alias("experiment"), "level_id", encode_id(keys).alias("unique_id"),
            F.col(date_col).alias("ds"), value,
        )
        out = part if out is None else out.unionByName(part)
    return out
