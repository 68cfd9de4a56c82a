"""Vectorised text primitives on raw UTF-8 buffers: words, rolling hashes, shingles.

A chunk is a slice of an Arrow string column: one byte buffer and the documents' offsets in it.
Nothing here makes a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A random-looking odd 64-bit value for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base & _U64, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
                up[0] = down[0] = 1
                self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_POWERS = Powers(_BASE)
_VALUES = byte_values(17)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prefix_hash(data: np.ndarray, values: np.ndarray = _VALUES, powers: Powers = _POWERS) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any span."""
    up, _ = powers.upto(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = _POWERS) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, down = powers.upto(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


@dataclass
class Chunk:
    """Some rows of a batch: row numbers first..first+n, bytes, and offsets (n + 1) into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    @cached_property
    def lower(self) -> Chunk:
        return Chunk(self.first, _LOWER[self.data], self.offsets)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and offsets of the documents' words."""
        return self.runs(~_WHITE[self.data])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = len(inside)
        start, end = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        if size:
            start[0], end[size] = inside[0], inside[-1]
            start[1:size] = inside[1:] & ~inside[:-1]
            end[1:size] = inside[:-1] & ~inside[1:]
            cuts = self.offsets[(self.offsets > 0) & (self.offsets < size)]
            start[cuts] = inside[cuts]
            end[cuts] = inside[cuts - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end)
        return starts, ends, np.searchsorted(starts, self.offsets)

    @cached_property
    def prefix(self) -> np.ndarray:
        return prefix_hash(self.data)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words
        return mixed(span_hash(self.prefix, starts, ends) + (ends - starts).astype(np.uint64))

    def owners(self, bounds: np.ndarray) -> np.ndarray:
        """For items dealt to documents by bounds: each item's document."""
        return np.repeat(np.arange(self.n), np.diff(bounds))

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all word shingles in order, and the documents' bounds in them.

        A document with fewer words than width has its whole word sequence as its only shingle.
        """
        _, _, bounds = self.words
        hashes = self.word_hashes
        counts = np.diff(bounds)
        many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        out_bounds = np.concatenate([[0], np.cumsum(many)])
        owner = np.repeat(np.arange(self.n), many)
        at = np.arange(out_bounds[-1]) - out_bounds[owner] + bounds[owner]
        total = np.zeros(len(at), np.uint64)
        length = np.minimum(counts, width)[owner]
        for j in range(width):
            factor = np.uint64((_BASE * (2 * j + 3)) & _U64 | 1)
            if len(at) and length.min() > j:
                total = mixed(total + hashes[at + j] * factor)
            else:
                live = length > j
                total[live] = mixed(total[live] + hashes[at[live] + j] * factor)
        return total, out_bounds


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string or binary column into chunks of about `limit` bytes; one text is never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(raw_offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(len(column), max(first + 1, last))
        yield Chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def per_document_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, and their bounds."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
