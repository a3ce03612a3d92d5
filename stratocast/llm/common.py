"""Shared pieces of the operators: row keys, Arrow mappers, text columns that are certain to exist."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratocast.session import cut_lineage, table

#: Stands for a null id wherever ids are ordered or joined: null comes first.
NULL_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return table(spark, sf_dir, name)


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_of(column: str = "text") -> Column:
    """The text; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """(id, th, text) and, if asked for, the other columns as `rest`: what a document is known by when results meet
    its text again. Rows that repeat an id are told apart by a hash of the text; whole copies of a row get the same
    results."""
    rows = [id_key(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text")]
    return docs.select(*rows, *([packed(docs, text_col).alias("rest")] if rest else []))


def packed(docs: DataFrame, text_col: str = "text") -> Column:
    """All columns but the text in one, so that no name of theirs can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.lit(0).alias("__none"))


def unpacked(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """The columns of `docs` from a frame with the columns `rest` (see `packed`) and `text`. A column n_chars
    follows the text."""

    def one(c: str) -> Column:
        if c == text_col:
            return F.col("text").alias(c)
        if c == "n_chars":
            return F.char_length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col(f"rest.`{c}`").alias(c)

    return [one(c) for c in docs.columns]


def unused(name: str, taken: list[str]) -> str:
    """The name, with underscores before it if a column has it already."""
    while name in taken:
        name = f"_{name}"
    return name


#: Keys up to which a counted list of rows to leave out is sent to every task.
SEND_KEYS = 1_000_000


def without_rows(rows: DataFrame, gone: DataFrame, send: int = SEND_KEYS) -> DataFrame:
    """The rows (id, th, ...) whose (id, th) is not in `gone`. A list of at most `send` keys, counted first, goes to the
    documents; a longer one meets them in a shuffle."""
    gone = cut_lineage(gone.select("id", "th").distinct())
    few = gone.limit(send + 1).count() <= send
    return rows.join(F.broadcast(gone) if few else gone, ["id", "th"], "left_anti")


#: Parts into which the rows of every key are dealt where a key may hold a large part of all rows.
SALTS = 16


def salted_join(rows: DataFrame, facts: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """Rows with what is known of their key. Rows of a key are dealt to SALTS tasks; each fact goes to all of them,
    so `facts` should hold only the keys that need it."""
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(copies, [key, "salt"], how).drop("salt")


def real_id(column: str = "id") -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


#: Bytes and rows of an Arrow batch of texts. Spark's own limits are rows alone or tens of megabytes, of which a task
#: and its Python worker hold several copies.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has its own setting."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Each Arrow batch through `work`."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
