"""The main text of web pages: a recurrent labeller decides on every block with the whole page in view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm import words as W
from stratocast.llm.blocks import TextBlock, split_blocks
from stratocast.llm.common import documents, map_arrow
from stratocast.llm.layouts import MARK, marked_page
from stratocast.llm.recurrent import Labeller

#: Buckets of the hashed path, of the innermost elements and of words, and the numbers of a block.
PATH, INNER, WORDS, NUMBERS = 128, 64, 32, 10
SIZE = PATH + INNER + WORDS + NUMBERS
#: The labeller's units a direction, and what it is fitted on: made-up pages (the bound of the sample) and passes.
HIDDEN, TRAIN_PAGES, EPOCHS, SEED = 24, 800, 10, 5
#: Pages that a task works on at once.
PAGES = 128


def _bucket(name: str, n: int) -> int:
    return zlib.crc32(name.encode()) % n


@lru_cache(maxsize=20_000)
def path_vector(path: tuple[tuple[str, str], ...]) -> np.ndarray:
    """The open elements with their names, hashed, and the three innermost ones once more in order."""
    out = np.zeros(PATH + INNER, dtype=np.float32)
    for tag, names in path:
        out[_bucket(tag, PATH)] = 1
        for name in names.split():
            out[_bucket("." + name, PATH)] = 1
            for part in name.replace("_", "-").split("-"):
                out[_bucket("." + part, PATH)] = 1
    for k, (tag, _) in enumerate(path[-3:][::-1]):
        out[PATH + _bucket(f"{k} {tag}", INNER)] = 1
    return out


def features(pages: list[list[TextBlock]]) -> list[np.ndarray]:
    """The input of each block of each page: tag path, hashed words, and numbers."""
    blocks = [b for page in pages for b in page]
    out = np.zeros((len(blocks), SIZE), dtype=np.float32)
    if blocks:
        for k, b in enumerate(blocks):
            out[k, : PATH + INNER] = path_vector(b.path)
        texts = pa.array([b.text for b in blocks], pa.large_string())
        counts = np.zeros(len(blocks))
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        for low, high, words in W.chunks(texts):
            hashes = W.range_hashes(W.CODES[lower[words.data]], words.starts, words.ends, 0)
            cell = words.doc_of() * WORDS + (hashes >> np.uint64(59)).astype(np.int64) % WORDS
            n = np.maximum(words.counts, 1)
            out[low:high, PATH + INNER : PATH + INNER + WORDS] = np.bincount(cell, minlength=words.n * WORDS).reshape(-1, WORDS) / np.sqrt(n)[:, None]
            counts[low:high] = words.counts
        size = np.array([len(b.text) for b in blocks])
        place = np.concatenate([np.arange(len(p)) for p in pages if p])
        left = np.concatenate([np.arange(len(p))[::-1] for p in pages if p])
        out[:, -NUMBERS:] = np.stack(
            [
                np.log1p(counts) / 4, np.minimum(np.array([b.link_chars for b in blocks]) / size, 1), [b.text[-1] in ".!?:…\"'»”" for b in blocks],
                [b.text[0].isupper() for b in blocks], np.log1p(place) / 3, np.log1p(left) / 3, [len(b.path) / 8 for b in blocks],
                ["©" in b.text for b in blocks], counts < 4, [any(names for _, names in b.path[-3:]) for b in blocks],
            ],
            axis=1,
        )
    bounds = np.cumsum([0, *map(len, pages)])
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def labelled(seed: int) -> tuple[list[TextBlock], np.ndarray]:
    """The blocks of one made-up page and which of them are main text."""
    blocks = split_blocks(marked_page(seed)[0])
    main = np.array([MARK in b.text for b in blocks], dtype=np.float32)
    return [TextBlock(b.text.replace(MARK, "").strip(), b.path, b.link_chars) for b in blocks], main


@lru_cache(maxsize=4)
def fitted(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = SEED) -> Labeller:
    """A labeller fitted on `pages` made-up pages in many layouts. It takes some seconds and always gives the same
    weights on the same machine."""
    samples = [labelled(seed * 1_000_003 + k) for k in range(pages)]
    inputs = features([b for b, _ in samples])
    model = Labeller(SIZE, hidden, seed)
    model.fit([(x, y) for x, (b, y) in zip(inputs, samples) if len(b)], epochs, batch=16, rate=0.01, seed=seed)
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """The main text of each page: the blocks labelled so, in page order, joined by one space."""
    blocks = [split_blocks(p) for p in pages]
    kept = model.label(features(blocks))
    return [" ".join(b.text for b, k in zip(page, keep) if k) for page, keep in zip(blocks, kept)]


def extract(pages: DataFrame, model: Labeller | None = None, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row. Null and empty pages, and pages without main text, have an empty text; null
    ids and urls stay null; repeated rows stay; other columns are not read. Pages of any length are labelled whole.
    No shuffle: the fitted weights, whose size is fixed, go to every task."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fitted())

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low in range(0, batch.num_rows, PAGES):
            part = batch.slice(low, PAGES)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(main_texts(part.column(2).to_pylist(), shared.value), pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(rows, work, "page_id long, url string, text string")


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
