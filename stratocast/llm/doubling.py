"""Substring deduplication by level-wise doubling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm import words as W
from stratocast.llm.common import documents, real_id
from stratocast.llm.passages import (
    Emit,
    keyed_rows,
    later_copies,
    later_places,
    own_texts,
    place_rows,
    repeated_places,
    seed_places,
    windows_of_seeds,
    with_all_places,
    with_places,
    without,
)
from stratocast.session import cut_lineage


def _pairs(half: int) -> Emit:
    """Windows of twice `half` words of which both halves are marked."""

    def emit(words: W.Words, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(W.inside(words, 2 * half))
        at = at[marked[at] & marked[at + half]]
        return at, W.windows(words.hashes(), 2 * half, 3)[at]

    return emit


def drop_windows(docs: DataFrame, length: int = 20, joined: bool = False) -> DataFrame:
    """(id, th, n_words, n_removed, spans, text): each document without the words that a window of `length` words
    covers whose words also start earlier: in a document with a smaller id, or further ahead in the same one.

    One step of doubling: windows of length / 2 words that represent a longer one (its minimisers, as in `suffixes`) are
    counted, and only where one repeats are the windows of `length` words that hold it judged. `repeated_lengths` goes
    on from there by pairs of halves until none survive. Copies of a whole text are settled first, by a digest. Windows are judged on the input, not on what is left. Null ids come first; rows
    with the same id are compared as one document with itself, so whole copies of a row stay. Null, empty and
    shorter texts lose nothing. Other columns are not read. Equality is that of 63-bit hashes of the words' bytes.
    """
    rows = keyed_rows(docs)
    copies = later_copies(rows)
    own = own_texts(rows, copies)
    half = max(1, length // 2)
    short = with_places(own, repeated_places(place_rows(own, seed_places(length, half), later=False)))
    long = place_rows(short, windows_of_seeds(length, half), later=True)
    return without(with_all_places(rows, copies, later_places(long)), length, joined)


def repeated_lengths(docs: DataFrame, length: int = 20) -> DataFrame:
    """(id, th, length, windows): how many windows of `length`, twice that, and so on each document shares with
    another place, level by level until no candidates survive. Documents without any have no row."""
    rows = keyed_rows(docs)
    half = max(1, length // 2)
    short = with_places(rows, repeated_places(place_rows(rows, seed_places(length, half), later=False)))
    found = cut_lineage(repeated_places(place_rows(short, windows_of_seeds(length, half), later=False)))
    counts = None
    while not found.isEmpty():
        level = found.groupBy("id", "th").agg(F.lit(length).alias("length"), F.count("*").alias("windows"))
        counts = level if counts is None else counts.unionByName(level)
        found = cut_lineage(repeated_places(place_rows(with_places(rows, found), _pairs(length), later=False)))
        length *= 2
    return counts if counts is not None else found.select("id", "th", F.lit(length).alias("length"), F.lit(0).cast("long").alias("windows"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_windows(documents(spark, sf_dir), length=20, joined=True)
    return out.select(real_id().alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
