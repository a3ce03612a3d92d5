"""Deduplication by sparse suffixes at minimisers, known by the hash of their first words, and the windows around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm.common import documents, real_id, unpacked
from stratocast.llm.passages import (
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

#: Words of a passage that must repeat, and words of its suffix that are sorted first.
LENGTH, SEED = 50, 25


def drop_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, joined: bool = False, rest: bool = False) -> DataFrame:
    """(id, th, n_words, n_removed, spans, text), and the other columns as `rest` if asked for: each document without passages of `length` or more words that
    occur earlier, which is in a document with a smaller id, or further ahead in the same one.

    1. Of all suffixes those are retained that start at a minimiser: the run of `seed` words with the smallest hash
       among those of some `length` words. A passage that repeats retains suffixes at the same places of each copy.
    2. The retained suffixes are grouped by a hash of their first `seed` words, which the shuffle sorts by; a suffix
       whose hash occurs once starts no match. They are not in the order of their words.
    3. Around each suffix that is left, the windows of `length` words that hold its seed are judged by their hashes in
       the same way, to the left and to the right; a longer match is the union of its windows. What they cover goes.

    Copies of a whole text are settled first, by a digest: all of it is earlier, and none of it is sorted.

    Passages are judged on the input, not on what is left. Null ids come first; rows with the same id are compared as
    one document with itself, so whole copies of a row stay. Null, empty and shorter texts lose nothing. Other columns
    are not read. Equality is that of 63-bit hashes of the words' bytes.
    """
    rows = keyed_rows(docs, rest=rest)  # in all steps, so that they share one shuffle of the documents
    copies = later_copies(rows)
    own = own_texts(rows, copies)
    suffixes = place_rows(own, seed_places(length, seed), later=False)
    matched = with_places(own, repeated_places(suffixes))
    extended = place_rows(matched, windows_of_seeds(length, seed), later=True)
    return without(with_all_places(rows, copies, later_places(extended)), length, joined)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, without the passages that `drop_repeats` finds. What is left keeps its
    white space; n_chars follows the text. A document goes that loses every word; others stay, with or without text."""
    return drop_repeats(docs, rest=True).where("n_words = 0 or n_removed < n_words").select(*unpacked(docs))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(documents(spark, sf_dir), joined=True)
    return out.select(real_id().alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "spans")
