"""Word counts over all texts, a frequency-bounded vocabulary of them, and packed integer arrays.

Words are 64-bit hashes. Every distinct word of the corpus is counted for itself in a Spark aggregation; the
vocabulary is the `size` most frequent ones (ties by hash), a sorted array that is bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Chunk, chunks
from .shared import texts, written

HELD = 1 << 20


def pack(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, compressed."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def lower_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words in order, and the documents' bounds in them."""
    low = chunk.lower
    return low.word_hashes, low.words[2]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def word_counts(docs: DataFrame, words: Callable[[Chunk], tuple[np.ndarray, np.ndarray]] = lower_words) -> DataFrame:
    """word (its hash) and n, its occurrences in all texts, one row for each distinct word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            k, c = summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["word", "n"])

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                k, c = np.unique(words(chunk)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > HELD:
                    k, c = summed(keys, counts)
                    keys, counts = [k], [c]
                    if len(k) > HELD // 2:
                        yield flush()
                        keys, counts = [], []
        if keys:
            yield flush()

    return texts(docs).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int, words: Callable[[Chunk], tuple[np.ndarray, np.ndarray]] = lower_words) -> tuple[np.ndarray, int]:
    """The `size` most frequent words in order of their hashes, and how many distinct words there are outside."""
    counted = written(word_counts(docs, words), "words")
    top = counted.orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()  # at most `size` rows
    found = np.sort(np.array(top.column(0).combine_chunks()).astype(np.int64).view(np.uint64))
    return found, counted.count() - len(found)


def places(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted vocabulary by binary search; its length for words outside."""
    if not len(known):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, len(known))
