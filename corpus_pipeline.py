"""A corpus of documents, cleaned and tokenised in stages that each write a table for the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratocast.llm.bpe import tokenised
from stratocast.llm.common import documents
from stratocast.llm.decontamination import decontaminated
from stratocast.llm.quality import quality_stage
from stratocast.llm.simhash import first_of_groups
from stratocast.llm.suffixes import without_repeats
from stratocast.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules reject go; lines that fail leave the others. Null and empty texts fall short
    of the ten words that a document needs; repeated rows are judged alike; no rows give no rows."""
    return quality_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: fingerprints of four-word shingles within four bits, linked
    over others. Null and empty texts are one group; of rows that repeat an id one stays; no rows give no rows."""
    return first_of_groups(docs, shingle=4)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go. Rows of one id are one document, null ids come
    first; null and empty texts stay as they are; no rows give no rows."""
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; repeated rows go or stay together; no
    rows give no rows."""
    return decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, none for null and empty ones; repeated rows stay; no rows give no rows."""
    return tokenised(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("tokenise", tokenise),
]

#: Windows of words, fingerprints and tokenizers are not expressible in SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of `sf_dir`, each written as Parquet and read again for the next one. Columns that
    the stages do not know stay; no documents give no rows."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
