"""String expressions on keys, ids and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "/"


def sanitize_separator(value: Column) -> Column:
    """`/` joins key values into ids, so it may not be part of one."""
    return F.translate(value, SEPARATOR, "_")


def decimal_comma(value: Column, factor: int = 1000) -> Column:
    return F.translate(value, ",", ".").try_cast("double") * factor


def prefix_hierarchy(code: Column, digits: Sequence[int] = (4, 3, 2, 1)) -> list[Column]:
    """Leading digits of a code as hier_4..hier_1, each with its own suffix letter (1 is A)."""
    return [
        F.concat(F.regexp_extract(code, rf"^(\d{{{n}}})", 1), F.lit("ABCDEFGHI"[n - 1])).alias(f"hier_{n}")
        for n in digits
    ]


def prefix_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def encode_id(keys: Sequence[str]) -> Column:
    """Key values joined in key order; rolled-up (null) keys are left out."""
    return F.concat_ws(SEPARATOR, *[F.col(k).cast("string") for k in keys])


def decode_id(uid: Column, keys: Sequence[str]) -> list[Column]:
    """Inverse by position; null where the id is shorter than the key list."""
    parts = F.split(uid, SEPARATOR)
    return [F.try_element_at(parts, F.lit(i + 1)).alias(k) for i, k in enumerate(keys)]


def score_text(value: Column, digits: int = 4) -> Column:
    """Fixed number of decimals, rounded from the exact binary value; null stays null."""
    return F.translate(F.format_number(value.cast("double"), digits), ",", "")


def elapsed_text(seconds: Column) -> Column:
    """Seconds as `HH h MM m`, rounded half to even to whole seconds first."""
    whole = F.bround(seconds, 0).cast("bigint")
    return F.when(
        seconds.isNotNull(),
        F.format_string("%02d h %02d m", F.floor(whole / 3600), F.floor((whole % 3600) / 60)),
    )


def strip_forecast_prefix(method: Column) -> Column:
    """`pred/X` is method X, `pred` alone is the base forecast."""
    return F.when(method == "pred", F.lit("base")).otherwise(F.regexp_replace(method, "^pred/", ""))
