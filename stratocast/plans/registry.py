"""Named queries over the given tables and, where SQL can express them, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ordered: bool = False):
    """Register a query under its name; `sql` gives the same result in DuckDB. `ordered` sorts that result: without
    it some joins never end in DuckDB under a row limit on many threads."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = f"{sql}\n    ORDER BY ALL" if ordered else sql
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles in results."""
    wide = {f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(wide) if wide else df
