"""Terms of texts as strings: maximal runs of a class of bytes, told apart exactly, counted without a row per occurrence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from .kernel import Chunk, byte_values, mixed, prefix_hash, span_hash

_OTHER = byte_values(91)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A flag for each byte: whether it is in one of the inclusive ranges; bytes of letters beyond ASCII always are."""
    inside = np.zeros(256, bool)
    for low, high in (*ranges, (0x80, 0xFF)):
        inside[low : high + 1] = True
    return inside


def slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes data[start : start + size] one after another, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def chunk_terms(chunk: Chunk, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunk's distinct terms, A-Z lower-cased; for each occurrence its place among them; the documents' bounds.

    Occurrences are grouped by a 64-bit hash and compared by a second one with their group's first; should
    two terms ever share the first, the keys are mixed with the second and grouped again.
    """
    low = chunk.lower
    starts, ends, bounds = low.runs(inside[low.data])
    sizes = ends - starts
    with np.errstate(over="ignore"):
        keys = mixed(span_hash(low.prefix, starts, ends) + sizes.astype(np.uint64))
        other = span_hash(prefix_hash(low.data, _OTHER), starts, ends)
        while True:
            _, first, place = np.unique(keys, return_index=True, return_inverse=True)
            if not len(keys) or ((other[first[place]] == other).all() and (sizes[first[place]] == sizes).all()):
                break
            keys = mixed(keys + mixed(other + sizes.astype(np.uint64)))
    return strings(*slices(low.data, starts[first], sizes[first])), place, bounds


def joined_terms(parts: Sequence[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """(distinct terms, places) of several chunks as one: the distinct strings of all and each occurrence's place."""
    coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    bases = np.cumsum([0, *(len(p[0]) for p in parts)])
    return coded.dictionary, np.concatenate([code[base + place] for base, (_, place) in zip(bases, parts)])
