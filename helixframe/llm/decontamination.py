"""Operator 6, benchmark decontamination by pigeonhole edit matching.

A text within k edits of an item of m code points holds at least one of k + 1 pieces of the item
unchanged. The pieces of all items form one automaton; a text is walked once, each piece hit gives a
diagonal, and the merged windows around an item's diagonals are verified with Myers' bit-parallel
edit distance (whole item against any substring of the window). Before comparing, the case of all
letters is folded on both sides and each ASCII blank becomes a space. Folding may lengthen a text (a
sharp s becomes ss); lengths and budgets are those of folded items, places those of the text as it is.

The items are read in blocks of at most BLOCK_CHARS characters, so what is broadcast is bounded;
each block is one more pass over the documents.

Items under SHORT code points have no budget: they are found where they stand whole, between characters
that aren't letters or digits, by the same automaton.

Defined results: null or empty text has no hits; a text of any length is searched whole; of an item's
equally near places the first counts; empty, blank or null items are not searched; repeated items are
hits of their own; item ids may have any type; repeated rows are judged alike; with an empty benchmark
nothing is hit; the documents' own columns pass through, whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import _LOWER, _WHITE, chunks
from .shared import free_name, table

ERROR_RATE = 0.05
SHORT = 16
BLOCK_CHARS = 4_000_000
_PLAIN = np.where(_WHITE, np.uint8(0x20), _LOWER)


def folded(text: str) -> str:
    """Case folded code point by code point; a dotless i, whose capital is I, becomes i."""
    return text.lower() if text.isascii() else text.casefold().replace("\u0131", "i")


def plain(text: str) -> str:
    return folded(_PLAIN[np.frombuffer(text.encode(), np.uint8)].tobytes().decode())


def unfolded(text: str, hits: list[dict]) -> list[dict]:
    """Hits whose places in the folded text become those of the text itself."""
    lengths = [len(c.casefold()) for c in text]
    at = np.repeat(np.arange(len(text)), lengths).tolist()
    place = lambda h: {"start": at[h["start"]], "end": at[h["end"] - 1] + 1} if h["start"] < h["end"] else {}
    return [h | place(h) for h in hits]


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def piece_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """`parts` pieces of about equal size that cover range(length)."""
    cuts = [length * i // parts for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def best_match(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Least edit distance of pattern to a substring of text, and that substring's first end; None beyond limit."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << m - 1
    up, down, score = every, 0, m
    best, end = limit + 1, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | down
        diagonal = ((eq & up) + up ^ up) | eq
        plus = down | ~(diagonal | up) & every
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & every, minus << 1 & every
        up = minus | ~(vertical | plus) & every
        down = plus & vertical
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= limit else None


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit goes on across either border of a span that has one inside it."""
    left = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    right = end < len(text) and text[end - 1].isalnum() and text[end].isalnum()
    return not left and not right


@dataclass
class Items:
    """Searchable items and the automaton of their pieces."""

    ids: list
    texts: list[str]
    rate: float

    def build(self) -> None:
        import ahocorasick

        self.limits = [budget(len(t), self.rate) for t in self.texts]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, text in enumerate(self.texts):
            for a, b in piece_bounds(len(text), self.limits[i] + 1):
                at.setdefault(text[a:b], []).append((i, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[dict]:
        """Each item's best match within its budget."""
        diagonals: dict[int, set[int]] = {}
        for end, places in self.automaton.iter(text):
            for i, b in places:
                diagonals.setdefault(i, set()).add(end + 1 - b)
        found = []
        for i, starts in sorted(diagonals.items()):
            pattern, limit = self.texts[i], self.limits[i]
            if not limit:  # the only piece is the item itself
                places = (a for a in sorted(starts) if len(pattern) >= SHORT or stands_alone(text, a, a + len(pattern)))
                if (at := next(places, None)) is not None:
                    found.append({"item_id": self.ids[i], "distance": 0, "start": at, "end": at + len(pattern)})
                continue
            best: tuple[int, int, int] | None = None
            for low, high in self._windows(starts, len(pattern) + limit, limit, len(text)):
                match = best_match(pattern, text[low:high], limit if best is None else best[0] - 1)
                if match:
                    end = low + match[1]
                    back = best_match(pattern[::-1], text[max(0, end - len(pattern) - limit) : end][::-1], match[0])
                    best = (match[0], end - (back[1] if back else len(pattern)), end)
                    if not match[0]:
                        break
            if best:
                found.append({"item_id": self.ids[i], "distance": best[0], "start": best[1], "end": best[2]})
        return found

    @staticmethod
    def _windows(starts: set[int], reach: int, limit: int, size: int) -> Iterator[tuple[int, int]]:
        low = high = None
        for s in sorted(starts):
            a, b = max(0, s - limit), min(size, s + reach)
            if high is not None and a <= high:
                high = max(high, b)
            else:
                if high is not None:
                    yield low, high
                low, high = a, b
        if high is not None:
            yield low, high


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", block_chars: int = BLOCK_CHARS, least: int = 1) -> Iterator[tuple[list, list[str]]]:
    """The benchmark's items of `least` code points or more, in blocks of about block_chars characters."""
    items = benchmark.filter((F.length("text") >= least) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).select(F.col(item_id).alias("id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // block_chars)
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).orderBy("id", "text").collect()
        if rows:
            yield [r.id for r in rows], [plain(r.text) for r in rows]


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text: str = "text", block_chars: int = BLOCK_CHARS, least: int = 1, item_id: str = "item_id"
) -> DataFrame:
    """docs with one more, last column: the items found in each text, with distance and place.

    It is named hits, or hits_1 and so on where docs has that name already. `least` is the caller's
    choice of the shortest item that counts.
    """
    spark = docs.sparkSession
    kind = benchmark.schema[item_id].dataType.simpleString()
    hit = f"array<struct<item_id: {kind}, distance: int, start: int, end: int>>"
    out = docs.withColumn(free_name(docs, "hits"), F.array().cast(hit))
    for ids, items in item_blocks(benchmark, item_id, block_chars, least):
        shared = spark.sparkContext.broadcast(Items(ids, items, rate))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tool = Items(**vars(shared.value)) if not hasattr(shared.value, "automaton") else shared.value
            tool.build()
            for batch in batches:
                where = batch.schema.get_field_index(text)
                found = batch.column(batch.num_columns - 1).to_pylist()
                column = batch.column(where)
                for chunk in chunks(column.fill_null("")):
                    data = _PLAIN[chunk.data].tobytes()
                    for i, (a, b) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())):
                        raw = data[a:b].decode()
                        searched = folded(raw)
                        if b > a and (hits := tool.hits(searched)):
                            if len(searched) != len(raw):
                                hits = unfolded(raw, hits)
                            found[chunk.first + i] = [*(found[chunk.first + i] or []), *hits]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

        out = out.mapInArrow(search, out.schema)
    return out


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.distance", "h.start", "h.end")
