"""Operator 8, quality rules: surface counts and an n-gram perplexity band per language.

The model is a modified Kneser-Ney ORDER-gram model over characters. Its alphabet is the ALPHABET most
frequent code points of the corpus (A-Z as a-z, digits as 0, ASCII blanks as a space, a run of one mark
or blank as one, so that a long rule of dashes dilutes nothing); all others are one symbol. Spark counts code
points and n-grams over all texts. Lower orders count the distinct n-grams that end alike, as Kneser-Ney
asks. Each order lies in a sorted array of 60-bit codes beside log probabilities, each context's code beside
the log of the mass it leaves to the order below, and both are found by binary search, once for each
distinct n-gram of a chunk.

The model is whole, whatever the corpus' size. Up to MOST_GRAMS distinct n-grams it is broadcast, about 40 MB.
Beyond that it stays in a table dealt by the two symbols before the last (`Dealt`): a context's n-grams and their
endings of three symbols or more lie in one bucket, so each bucket is a model of its own once it knows the discounts and the
two lowest orders, which the alphabet bounds. Texts then ask the buckets for their distinct n-grams, a unit of
texts at a time. Both ways take the same sums in the same order, so every loss is the same to the last bit.
`trained` cuts a larger model to its most frequent n-grams instead; the operator doesn't use it.

Characters, not words: documents hold many words that stand nowhere else. A word bigram model with 65,534
words was tried on sf0.1, at one band only, nine quartile distances: it rejected 1 of 291 labelled-bad
documents that pass the base rules. Narrower bands were not tried, but more than half of the bad ones in
English and French lay within the range of the good ones.

All languages share the model, so a passage in another language costs a clean document little; the
bands are the language's own. Junk that the model has learned is likely to it, so n-grams are
counted over a core alone: of the documents that pass the base rules, those with at most one symbol to
SYMBOL_RATIO words; and counted anew, REFITS times (once), over those of them that lie within a band of CORE
spreads under the model before.

A document's perplexity is judged against a band of its own language and length: the language's median
minus `below` or plus `above` times the wider of a floor and the spread of the language's deviations on
that side at that length, over all its documents that pass the base rules. The spread of a side is the
distance from the median to the quartile there. A mean over n characters strays as 1 / sqrt(n), so it is
taken of the deviations times sqrt(n). Quantiles are taken of values rounded to a fixed grid and
counted, so they depend neither on the order of rows nor on how many there are.

Defined results: null or empty text has no words, fails the base rules and has null perplexity and band;
a null language, or a table without lang, is a language of its own; repeated rows are judged alike and
all counted; texts of any length are judged whole; an empty table gives an empty result; extra columns
are ignored by the query and kept by the operator's filter form.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from .kernel import Chunk, mixed, span_hash
from .kernel import chunks as cut_in_chunks
from .shared import Scratch, dense_sum, discarded, local_rows, rewritten, table, texts, written
from .vocabulary import pack, pack_sorted, summed, unpack, unpack_sorted

ORDER = 5
BITS = 12
ALPHABET = (1 << BITS) - 2  # two more symbols: START, and the one for all other code points
MOST_GRAMS = 1 << 20
FLUSH = 1 << 19
BUCKET_CHARS = 1 << 24
UNIT_CHARS = 1 << 22
OPENED_CHARS = CHUNK_BYTES = 1 << 18  # a worker's arrays are some dozens of bytes for each of these
LOW = 2
START = 0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BELOW, ABOVE = 12.0, 12.0
BAND_FLOOR = 0.01
REFITS = 1
CORE = 2.0
SYMBOL_RATIO = 10
GRID = 1 << 12
RECENT = 20
_CODE_POINTS = 0x110000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "[#*$%&|<>]" if c not in "[]"]] = True
_FOLD = np.arange(128)
_FOLD[0x41:0x5B] += 32
_FOLD[0x30:0x3A] = 0x30
_FOLD[[0x09, 0x0B, 0x0C, 0x0D]] = 0x20
_RUN = np.zeros(129, bool)
_RUN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def chunks(column: pa.Array) -> Iterator[Chunk]:
    return cut_in_chunks(column, CHUNK_BYTES)


def code_points(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points in order, a run of one ASCII mark or blank as one, and the documents' bounds in them."""
    data = chunk.data
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    bounds = np.concatenate([[0], np.cumsum(lead)])[chunk.offsets]
    first = data[at].astype(np.int64)
    out = np.where(first < 128, _FOLD[first & 127], 0)
    wide = np.flatnonzero(first >= 128)
    if len(wide):
        rest = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
        a, f = at[wide], first[wide]
        two = (f & 0x1F) << 6 | rest[a + 1]
        three = (f & 0x0F) << 12 | rest[a + 1] << 6 | rest[a + 2]
        four = (f & 0x07) << 18 | rest[a + 1] << 12 | rest[a + 2] << 6 | rest[a + 3]
        out[wide] = np.where(f < 0xE0, two, np.where(f < 0xF0, three, np.minimum(four, _CODE_POINTS - 1)))
    again = np.zeros(len(out), bool)
    again[1:] = (out[1:] == out[:-1]) & _RUN[np.minimum(out[1:], 128)]
    again[bounds[:-1][np.diff(bounds) > 0]] = False
    return out[~again], bounds - np.concatenate([[0], np.cumsum(again)])[bounds]


def alphabet(docs: DataFrame, size: int = ALPHABET) -> np.ndarray:
    """The `size` most frequent folded code points of all texts, in order."""

    def update(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for chunk in chunks(batch.column(0)):
            found = np.bincount(code_points(chunk)[0])
            total[: len(found)] += found

    counts = dense_sum(texts(docs), _CODE_POINTS, update)
    seen = np.flatnonzero(counts)
    return np.sort(seen[np.argsort(-counts[seen], kind="stable")[:size]])


def symbols(chunk: Chunk, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (1 and up; len(letters) + 1 for a code point outside) in order, and the documents' bounds."""
    points, bounds = code_points(chunk)
    place = np.full(_CODE_POINTS, len(letters) + 1, np.uint16)
    place[letters] = np.arange(1, len(letters) + 1)
    return place[points], bounds


def codes(found: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each symbol; a document starts after STARTs."""
    code = found.astype(np.uint64)
    starts = bounds[:-1]
    for back in range(1, order):
        earlier = np.zeros(len(found), np.uint64)
        earlier[back:] = found[:-back]
        for step in range(back):
            at = starts + step
            earlier[at[at < bounds[1:]]] = START
        code |= earlier << np.uint64(BITS * back)
    return code


def factored(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code among the distinct ones, and those."""
    found = pa.array(code).dictionary_encode()  # pandas would cost each worker some 27 MB
    return found.indices.to_numpy(), found.dictionary.to_numpy()


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, and 3 or more."""
    return discounts_of(tuple(int((counts == k).sum()) for k in (1, 2, 3, 4)))


def discounts_of(few: tuple[int, ...]) -> np.ndarray:
    """The discounts from the numbers of n-grams counted 1, 2, 3 and 4 times."""
    ones, twos, threes, fours = few
    if not ones or not twos:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = ones / (ones + 2 * twos)
    d1, d2 = 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos
    d3 = 3 - 4 * y * fours / threes if threes else d2
    return np.array([0.0, min(max(d1, 0.1), 0.95), min(max(d2, 0.1), 1.9), min(max(d3, 0.1), 2.9)])


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys in sorted ones, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class KneserNey:
    """The alphabet; for each order sorted codes with log probabilities, and sorted contexts with the logs of what they leave."""

    letters: np.ndarray
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    left: list[np.ndarray]

    def losses(self, code: np.ndarray) -> np.ndarray:
        """Minus log probability of the last symbol of each n-gram after the others.

        A table of the n-grams met last, one to a slot, answers most; the others are searched.
        """
        if not hasattr(self, "recent"):
            self.recent, self.known = np.full(1 << RECENT, ~np.uint64(0)), np.zeros(1 << RECENT)
        slot = code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - RECENT)
        out = self.known[slot]
        new = np.flatnonzero(self.recent[slot] != code)
        out[new] = found = self.searched(code[new])
        self.known[slot[new]] = found
        self.recent[slot[new]] = code[new]
        return out

    def searched(self, code: np.ndarray) -> np.ndarray:
        at, distinct = factored(code)
        out = np.zeros(len(distinct))
        open_ = np.arange(len(distinct))
        for order in range(len(self.keys), 0, -1):
            mine = distinct[open_] & np.uint64((1 << BITS * order) - 1)
            place, there = looked_up(self.keys[order - 1], mine)
            out[open_[there]] -= self.logs[order - 1][place[there]]
            open_, mine = open_[~there], mine[~there]
            place, there = looked_up(self.contexts[order - 1], mine >> np.uint64(BITS))
            out[open_[there]] -= self.left[order - 1][place[there]]
        out[open_] += np.log(len(self.letters) + 1)
        return out[at]


def fit(letters: np.ndarray, keys: np.ndarray, counts: np.ndarray, order: int = ORDER) -> KneserNey:
    """Interpolated modified Kneser-Ney from sorted codes of the highest order and their counts."""
    tables = lower_orders(keys, counts, order, 1)
    return grown(KneserNey(letters, [], [], [], []), np.zeros(0), tables, [discounts(c) for _, c in tables])[0]


def lower_orders(keys: np.ndarray, counts: np.ndarray, order: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of the orders from `least` up to `order`."""
    tables = [(keys, counts)]
    for n in range(order - 1, least - 1, -1):
        tables.append(np.unique(tables[-1][0] & np.uint64((1 << BITS * n) - 1), return_counts=True))
    return tables[::-1]


def grown(low: KneserNey, below: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], taken: list[np.ndarray]) -> tuple[KneserNey, np.ndarray]:
    """The model `low`, whose highest order has the probabilities `below`, with further orders and their discounts; and the new highest ones."""
    model = KneserNey(low.letters, *map(list, (low.keys, low.logs, low.contexts, low.left)))
    for (k, c), discount in zip(tables, taken):
        n = len(model.keys) + 1
        cut = discount[np.minimum(c, 3)]
        contexts, first, of = np.unique(k >> np.uint64(BITS), return_index=True, return_inverse=True)
        total = np.bincount(of, c)
        spare = np.bincount(of, np.minimum(cut, c)) / np.maximum(total, 1)
        lower = below[looked_up(model.keys[-1], k & np.uint64((1 << BITS * (n - 1)) - 1))[0]] if n > 1 else 1 / (len(model.letters) + 1)
        below = np.maximum(c - cut, 0) / total[of] + spare[of] * lower if len(k) else np.zeros(0)
        model.keys.append(k)
        model.logs.append(np.log(below).astype(np.float32))
        model.contexts.append(contexts)
        model.left.append(np.log(np.maximum(spare, 1e-12)).astype(np.float32))
    return model, below


@dataclass
class Dealt:
    """A whole model too large to broadcast: a written table of n-grams and counts, the two lowest orders, all discounts."""

    letters: np.ndarray
    grams: DataFrame
    buckets: int
    low: KneserNey
    below: np.ndarray
    taken: list[np.ndarray]


_SURFACE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def coded(docs: DataFrame, letters: np.ndarray, *keys: str) -> DataFrame:
    """Key columns, lang, surface counts, the unit, n_chars and packed symbols of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(letters)
    source = texts(docs, *dict.fromkeys([*keys, "lang"]))
    schema = StructType([*source.schema.fields[:-1], *(StructField(n, LongType()) for n in (*_SURFACE, "_unit", "n_chars")), StructField("symbols", BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                counts = surface(chunk)
                found, bounds = symbols(chunk, shared.value)
                raw = [pack(found[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                kept = [batch.column(i).slice(chunk.first, chunk.n) for i in range(batch.num_columns - 1)]
                unit = first + (before + bounds[:-1]) // UNIT_CHARS
                before += int(bounds[-1])
                arrays = [*(pa.array(counts[n].astype(np.int64)) for n in _SURFACE), pa.array(unit), pa.array(np.diff(bounds)), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=schema.names)

    return source.mapInArrow(encode, schema)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, n-grams and bounds of a batch of coded texts, some texts at a time; symbols and n_chars come last."""
    ends = np.cumsum(np.array(batch.column(batch.num_columns - 2)))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + OPENED_CHARS)))
        found = [unpack(x.as_py(), np.uint16) for x in batch.column(batch.num_columns - 1)[first:last]]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        yield slice(first, last), codes(np.concatenate(found), bounds), bounds
        first = last


def mean_losses(losses: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log perplexity of each document from the loss of each symbol; not a number without any. Each is summed by itself."""
    sums, some = np.zeros(len(bounds) - 1), np.diff(bounds) > 0
    if some.any():
        sums[some] = np.add.reduceat(losses, bounds[:-1][some])
    with np.errstate(invalid="ignore", divide="ignore"):
        return sums / np.diff(bounds)


def by_bucket(k: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets of the two symbols before the last, so that a context's n-grams meet in one; and where each one's n-grams are."""
    bucket = (mixed(k >> np.uint64(BITS) & np.uint64((1 << BITS * LOW) - 1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return bucket[heads], np.split(order, heads[1:])


def _dealt(k: np.ndarray, c: np.ndarray, buckets: int) -> pa.RecordBatch:
    """n-grams and counts packed by bucket."""
    names, places = by_bucket(k, buckets)
    cut = [(pack_sorted(k[at]), pack(c[at])) for at in places]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*cut))], names=["bucket", "grams", "counts"])


def summed_grams(rows: DataFrame, found: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int) -> DataFrame:
    """grams, counts: the n-grams and counts that `found` takes from each batch, summed over all, a written row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for distinct, n in found(batch):
                keys.append(distinct)
                counts.append(n)
                held += len(distinct)
                if held > FLUSH:
                    k, c = summed(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held > FLUSH // 2:
                        yield _dealt(k, c, buckets)
                        keys, counts, held = [], [], 0
        if held:
            yield _dealt(*summed(keys, counts), buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(unpack_sorted(p.as_py()), unpack(c.as_py(), np.int64)) for batch in batches for p, c in zip(batch.column(1), batch.column(2))]
        if parts:
            k, c = summed(*map(list, zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array([pack_sorted(k)], pa.binary()), pa.array([pack(c)], pa.binary())], names=["grams", "counts"])

    return written(rows.mapInArrow(count, "bucket int, grams binary, counts binary").repartition(buckets, "bucket").mapInArrow(add, "grams binary, counts binary"), "grams")


def _counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, distinct = factored(code)
    return distinct, np.bincount(at, minlength=len(distinct))


def _of_texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, code, _ in _opened(batch):
        yield _counted(code)


def _of_near_texts(shared: Broadcast, limits: dict) -> Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """As _of_texts, of the texts within CORE spreads under a model that is broadcast; lang comes first."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, code, bounds in _opened(batch):
            size, languages = np.diff(bounds), batch.column(0)[part].to_pylist()
            spans = np.array([span_of(limits, k, n, CORE, CORE) for k, n in zip(languages, size.tolist())])
            means = mean_losses(shared.value.losses(code), bounds)
            near = (spans[:, 0] <= means) & (means <= spans[:, 1])
            yield _counted(code[np.repeat(near, size)])

    return found


def _levels(counts: np.ndarray) -> np.ndarray:
    """Eight levels for each power of two."""
    return (8 * np.log2(counts)).astype(np.int64)


def tally(grams: DataFrame) -> tuple[np.ndarray, tuple[int, ...]]:
    """How many n-grams are at or above each level, and how many are counted 1, 2, 3 and 4 times."""
    levels = 512

    def update(batch: pa.RecordBatch, cells: np.ndarray) -> None:
        for raw in batch.column(1):
            c = unpack(raw.as_py(), np.int64)
            cells[:levels] += np.bincount(_levels(c), minlength=levels)
            cells[levels:] += np.bincount(c[c < 5], minlength=5)[1:]

    cells = dense_sum(grams, levels + 4, update)
    return np.cumsum(cells[:levels][::-1])[::-1], tuple(int(x) for x in cells[levels:])


def gram_table(texts_: DataFrame, found: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]] = _of_texts) -> tuple[DataFrame, int]:
    """All n-grams of the highest order with their counts, and the number of buckets that they are dealt to."""
    texts_ = texts_.select(*(["lang"] if "lang" in texts_.columns else []), "n_chars", "symbols")
    total = texts_.agg(F.sum("n_chars")).first()[0] or 0
    buckets = max(int(texts_.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_CHARS))
    return summed_grams(texts_, found, buckets), buckets


def most_frequent(grams: DataFrame, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The MOST_GRAMS most frequent n-grams in order, with their counts."""
    least = int(np.flatnonzero(np.append(above, 0) <= MOST_GRAMS)[0])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, n in zip(batch.column(0), batch.column(1)):
                k, c = unpack_sorted(p.as_py()), unpack(n.as_py(), np.int64)
                often = _levels(c) >= least
                yield pa.RecordBatch.from_arrays([pa.array([pack_sorted(k[often])], pa.binary()), pa.array([pack(c[often])], pa.binary())], names=["grams", "counts"])

    rows = grams.mapInArrow(keep, "grams binary, counts binary").collect()  # MOST_GRAMS n-grams at most
    return summed([unpack_sorted(bytes(r.grams)) for r in rows], [unpack(bytes(r.counts), np.int64) for r in rows])


def count_grams(texts_: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The MOST_GRAMS most frequent n-grams of the coded texts in order, with their counts."""
    grams, _ = gram_table(texts_)
    return most_frequent(grams, tally(grams)[0])


def trained(letters: np.ndarray, texts_: DataFrame) -> KneserNey:
    """The model of the coded texts: whole if it has up to MOST_GRAMS n-grams, each order cut to that many otherwise."""
    grams, buckets = gram_table(texts_)
    above, few = tally(grams)
    if above[0] <= MOST_GRAMS:
        return fit(letters, *most_frequent(grams, above))
    orders = [cut_order(grams, above, few)]
    for n in range(ORDER - 1, 0, -1):
        mask = np.uint64((1 << BITS * n) - 1)

        def endings(batch: pa.RecordBatch, mask: np.uint64 = mask) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for raw in batch.column(0):
                yield np.unique(unpack_sorted(raw.as_py()) & mask, return_counts=True)

        grams = summed_grams(grams, endings, buckets)
        orders.append(cut_order(grams, *tally(grams)))
    return joined_orders(letters, orders[::-1])


def whole(letters: np.ndarray, grams: DataFrame, buckets: int) -> KneserNey | Dealt:
    """The model of all n-grams of the table: to broadcast if it has up to MOST_GRAMS, else dealt. Both give the same losses."""
    above, few = tally(grams)
    return fit(letters, *most_frequent(grams, above)) if above[0] <= MOST_GRAMS else dealt(letters, grams, buckets, few)


def dealt(letters: np.ndarray, grams: DataFrame, buckets: int, few: tuple[int, ...]) -> Dealt:
    """The model that lies in `grams`; few are its numbers of n-grams counted 1, 2, 3 and 4 times."""

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, n in zip(batch.column(0), batch.column(1)):
                tables = lower_orders(unpack_sorted(raw.as_py()), unpack(n.as_py(), np.int64), ORDER, LOW)
                for order, (k, c) in enumerate(tables[:-1], LOW):
                    if order > LOW:
                        k, c = np.arange(1, 5), np.bincount(c[c < 5], minlength=5)[1:]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), order, np.int32)), pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], names=["order", "key", "n"])

    # pairs of the alphabet, and four numbers for each order between
    found = grams.mapInArrow(low, "order int, key long, n long").groupBy("order", "key").agg(F.sum("n").alias("n")).orderBy("order", "key").toArrow()
    order, key, n = (np.array(found.column(c).combine_chunks()) for c in ("order", "key", "n"))
    pairs = lower_orders(key[order == LOW].astype(np.uint64), n[order == LOW].astype(np.int64), LOW, 1)
    model, below = grown(KneserNey(letters, [], [], [], []), np.zeros(0), pairs, [discounts(c) for _, c in pairs])
    taken = [discounts_of(tuple(int(x) for x in n[order == m])) for m in range(LOW + 1, ORDER)]
    return Dealt(letters, grams, buckets, model, below, [*taken, discounts_of(few)])


def scored_apart(rows: DataFrame, model: Dealt) -> DataFrame:
    """As `scored`, by a model that is dealt: units of texts ask for their distinct n-grams, buckets answer with losses."""
    buckets = model.buckets
    shared = rows.sparkSession.sparkContext.broadcast((model.low, model.below, model.taken))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = 0

        def asking() -> pa.RecordBatch:
            k = np.unique(np.concatenate(held))
            names, places = by_bucket(k, buckets)
            return pa.RecordBatch.from_arrays([pa.array([last] * len(names), pa.int64()), pa.array(names, pa.int32()), pa.array([pack_sorted(k[at]) for at in places], pa.binary())], names=["_unit", "bucket", "grams"])

        for batch in batches:
            units = np.array(batch.column(0))
            for part, code, bounds in _opened(batch):
                cuts = np.flatnonzero(np.diff(units[part])) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.stop - part.start]):
                    unit, found = int(units[part.start + a]), code[bounds[a] : bounds[b]]
                    if unit != last and held:
                        yield asking()
                        held.clear()
                    last = unit
                    if len(found):
                        held.append(factored(found)[1])
        if held:
            yield asking()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, n in zip(batch.column(0), batch.column(1)):
                yield _dealt(unpack_sorted(raw.as_py()), unpack(n.as_py(), np.int64), buckets)

    def answer(asking: pa.Table, known: pa.Table) -> pa.Table:
        low, below, taken = shared.value
        k, c = summed([unpack_sorted(x.as_py()) for x in known.column("grams")], [unpack(x.as_py(), np.int64) for x in known.column("counts")])
        mine, _ = grown(low, below, lower_orders(k, c, ORDER, LOW + 1), taken)
        told = [pack(mine.searched(unpack_sorted(x.as_py()))) for x in asking.column("grams")]
        return pa.table({"_unit": asking.column("_unit"), "grams": asking.column("grams"), "losses": pa.array(told, pa.binary())})

    names = [n for n in rows.columns if n not in ("log_ppl", "n_chars", "symbols")]
    rows = rows.select(*names, "n_chars", "symbols")
    schema = StructType([*rows.schema.fields[:-2], StructField("log_ppl", DoubleType()), *rows.schema.fields[-2:]])

    def score(texts_: pa.Table, told: pa.Table) -> pa.Table:
        k = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x.as_py()) for x in told.column("grams"))])
        losses = np.concatenate([np.zeros(0), *(unpack(x.as_py(), np.float64) for x in told.column("losses"))])
        order = np.argsort(k)
        k, losses = k[order], losses[order]
        means = [np.zeros(0)]
        for batch in texts_.select(["n_chars", "symbols"]).to_batches():
            means.extend(mean_losses(losses[np.searchsorted(k, code)], bounds) for _, code, bounds in _opened(batch))
        mean = np.concatenate(means)
        return pa.table([*texts_.columns[:-2], pa.array(mean, mask=np.isnan(mean)), *texts_.columns[-2:]], names=schema.names)

    asks = rows.select("_unit", "n_chars", "symbols").mapInArrow(ask, "_unit long, bucket int, grams binary")
    pieces = model.grams.mapInArrow(deal, "bucket int, grams binary, counts binary")
    answers = asks.groupBy("bucket").cogroup(pieces.groupBy("bucket")).applyInArrow(answer, "_unit long, grams binary, losses binary")
    return rows.groupBy("_unit").cogroup(answers.groupBy("_unit")).applyInArrow(score, schema)


def cut_order(grams: DataFrame, above: np.ndarray, few: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Of one order's MOST_GRAMS most frequent n-grams: codes, own shares, what their contexts spare; contexts, and what these leave.

    Shares and spares are those among all n-grams of the context; what it leaves is its spare and the shares of those cut.
    """
    least = int(np.flatnonzero(np.append(above, 0) <= MOST_GRAMS)[0])
    taken = discounts_of(few)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, n in zip(batch.column(0), batch.column(1)):
                k, c = unpack_sorted(raw.as_py()), unpack(n.as_py(), np.int64)
                cut = np.minimum(taken[np.minimum(c, 3)], c)
                contexts, heads, of = np.unique(k >> np.uint64(BITS), return_index=True, return_inverse=True)
                total = np.add.reduceat(c, heads)
                own, spare, often = (c - cut) / total[of], np.add.reduceat(cut, heads) / total, _levels(c) >= least
                left, some = spare + np.bincount(of, np.where(often, 0, own)), np.bincount(of, often) > 0
                values = [pack_sorted(k[often]), pack(own[often]), pack(spare[of[often]]), pack_sorted(contexts[some]), pack(left[some])]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["k", "own", "spare", "contexts", "left"])

    rows = grams.mapInArrow(keep, "k binary, own binary, spare binary, contexts binary, left binary").collect()  # MOST_GRAMS n-grams at most
    read = lambda name, opened: np.concatenate([opened(bytes(r[name])) for r in rows])
    number = lambda raw: unpack(raw, np.float64)
    k, contexts = read("k", unpack_sorted), read("contexts", unpack_sorted)
    by, at = np.argsort(k), np.argsort(contexts)
    return k[by], read("own", number)[by], read("spare", number)[by], contexts[at], read("left", number)[at]


def joined_orders(letters: np.ndarray, orders: list[tuple[np.ndarray, ...]]) -> KneserNey:
    """The model of the cut orders, lowest first: each n-gram's own share and its context's spare times the order below."""
    model = KneserNey(letters, [], [], [], [])
    for n, (k, own, spare, contexts, left) in enumerate(orders, 1):
        lower = np.exp(-model.searched(k & np.uint64((1 << BITS * (n - 1)) - 1))) if n > 1 else 1 / (len(letters) + 1)
        model.keys.append(k)
        model.logs.append(np.log(own + spare * lower))
        model.contexts.append(contexts)
        model.left.append(np.log(np.maximum(left, 1e-12)))
    model.logs, model.left = ([x.astype(np.float32) for x in part] for part in (model.logs, model.left))
    return model


def span_of(limits: dict, language: str | None, n_chars: int, below: float, above: float) -> tuple[float, float]:
    """The band of a language at a length; an empty one for a language without limits."""
    if language not in limits or not n_chars:
        return np.inf, -np.inf
    middle, under, over = limits[language]
    return middle - below * max(under / math.sqrt(n_chars), BAND_FLOOR), middle + above * max(over / math.sqrt(n_chars), BAND_FLOOR)


def with_band(rows: DataFrame, limits: dict, below: float, above: float) -> DataFrame:
    """rows with low and high, the band of their language and length, null where there is none."""
    kind = rows.schema["lang"].dataType.simpleString()
    known = local_rows(rows.sparkSession, [(k, *v) for k, v in limits.items()], f"_lang {kind}, _middle double, _under double, _over double")
    joined = rows.join(known.hint("broadcast"), F.col("lang").eqNullSafe(F.col("_lang")), "left")  # one row for each language
    reach = lambda side: F.when(F.col("n_chars") > 0, F.greatest(F.try_divide(side, F.sqrt("n_chars")), F.lit(BAND_FLOOR)))
    low, high = F.col("_middle") - below * reach("_under"), F.col("_middle") + above * reach("_over")
    return joined.withColumn("low", low).withColumn("high", high).drop("_lang", "_middle", "_under", "_over")


def surface(chunk: Chunk) -> dict[str, np.ndarray]:
    """Counts of one chunk's documents by the base rules."""
    starts, ends, bounds = chunk.words
    n_words = np.diff(bounds)
    head = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(head[ends] - head[starts])])
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[chunk.data])])
    return {
        "n_words": n_words,
        "word_chars": in_words[bounds[1:]] - in_words[bounds[:-1]],
        "n_symbols": marks[chunk.offsets[1:]] - marks[chunk.offsets[:-1]],
        "n_dup_lines": repeated_lines(chunk),
        "n_repeat_words": repeated_words(chunk),
    }


def _first_seen(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the items by (owner, hash), and which of them start a new value there."""
    key = mixed(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return order, new


def repeated_lines(chunk: Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    data, offsets = chunk.data, chunk.offsets
    feeds = np.append(np.flatnonzero(data == 0x0A), len(data))
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feeds[:-1] + 1]))
    starts = starts[starts < len(data)]
    owner = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(feeds[np.searchsorted(feeds, starts)], offsets[owner + 1])
    first_words = chunk.words[0]
    holds = np.searchsorted(first_words, ends) > np.searchsorted(first_words, starts)
    starts, ends, owner = starts[holds], ends[holds], owner[holds]
    order, new = _first_seen(owner, span_hash(chunk.prefix, starts, ends) + mixed((ends - starts).astype(np.uint64)))
    return np.bincount(owner[order[~new]], minlength=chunk.n)


def repeated_words(chunk: Chunk) -> np.ndarray:
    """Words that lie in a 3-word window found twice or more in their document."""
    _, _, bounds = chunk.words
    hashes = chunk.word_hashes
    counts = np.diff(bounds)
    windows = np.maximum(counts - 2, 0)
    ends = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(chunk.n), windows)
    at = np.arange(ends[-1]) - ends[owner] + bounds[owner]
    if not len(at):
        return np.zeros(chunk.n, np.int64)
    value = mixed(mixed(hashes[at] + np.uint64(1)) * np.uint64(3) + hashes[at + 1])
    value = mixed(value * np.uint64(5) + hashes[at + 2])
    order, new = _first_seen(owner, value)
    group = np.cumsum(new) - 1
    often = np.bincount(group) > 1
    hit = at[order[often[group]]]
    covered = np.zeros(len(hashes) + 3, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + 3, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[: len(hashes)] > 0)])
    return inside[bounds[1:]] - inside[bounds[:-1]]


def base_failed(min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def base_passed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] >= MIN_WORDS) & (100 * found["n_repeat_words"] <= MAX_REPEAT_PERCENT * found["n_words"])


def scored(rows: DataFrame, model: Broadcast | Dealt) -> DataFrame:
    """Coded rows with log_ppl (null without text) instead of what they had, before n_chars and symbols."""
    if isinstance(model, Dealt):
        return scored_apart(rows, model)
    shared = model
    names = [n for n in rows.columns if n not in ("log_ppl", "n_chars", "symbols")]
    rows = rows.select(*names, "n_chars", "symbols")
    schema = StructType([*rows.schema.fields[:-2], StructField("log_ppl", DoubleType()), *rows.schema.fields[-2:]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, code, bounds in _opened(batch):
                loss = mean_losses(shared.value.losses(code), bounds)
                cut = batch.slice(part.start, part.stop - part.start).columns
                yield pa.RecordBatch.from_arrays([*cut[:-2], pa.array(loss, mask=np.isnan(loss)), *cut[-2:]], names=schema.names)

    return rows.mapInArrow(score, schema)


def quantiles(rows: DataFrame, value: str, shares: list[float], *keys: str) -> DataFrame:
    """Key columns and q, the lower quantiles of the values rounded to the grid."""
    cells = rows.groupBy(*keys, F.round(F.col(value) * GRID).cast("long").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    ranked = cells.withColumn("_upto", F.sum("_n").over(whole.orderBy("_cell"))).withColumn("_all", F.sum("_n").over(whole))
    least = [F.min(F.when(F.col("_upto") >= F.lit(q) * F.col("_all"), F.col("_cell"))) / GRID for q in shares]
    return ranked.groupBy(*keys).agg(F.array(*least).alias("q"))


def language_limits(rows: DataFrame) -> dict:
    """Each language's median log perplexity, and its quartiles' distances below and above, of deviations times sqrt(n_chars)."""
    middles = {r["lang"]: r["q"][0] for r in quantiles(rows, "log_ppl", [0.5], "lang").collect()}  # one row for each language
    kind = rows.schema["lang"].dataType.simpleString()
    known = local_rows(rows.sparkSession, list(middles.items()), f"_lang {kind}, _middle double")
    far = (F.col("log_ppl") - F.col("_middle")) * F.sqrt("n_chars")
    strayed = rows.join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", far.alias("far"))
    spreads = quantiles(strayed, "far", [0.25, 0.75], "lang").collect()
    return {r["lang"]: (middles[r["lang"]], max(-r["q"][0], 0.0), max(r["q"][1], 0.0)) for r in spreads}


def with_lang(docs: DataFrame) -> DataFrame:
    return docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))


def judge(docs: DataFrame, *keys: str) -> tuple[KneserNey | Dealt, dict, DataFrame]:
    """The model of the core, each language's median and spreads under it, and the rows, scored, without their symbols.

    Symbols are written once: a model that is broadcast scores the core anew while its n-grams are counted. By one that is
    dealt, rows move to be scored, so they are written with their scores, and what they were before goes.
    """
    docs = with_lang(docs)
    letters = alphabet(docs)
    rows, path = rewritten(coded(docs, letters, *keys).transform(with_base), "coded")
    clear = ~F.col("base_failed") & (SYMBOL_RATIO * F.col("n_symbols") <= F.col("n_words"))
    judged = lambda scores: language_limits(scores.filter(~F.col("base_failed")))
    grams = gram_table(rows.filter(clear))
    for _ in range(REFITS):
        model = whole(letters, *grams)
        if isinstance(model, Dealt):
            rows, path = rewritten(scored(rows, model), "scored", path)
            near = with_band(rows.filter(clear), judged(rows), CORE, CORE).filter(F.col("log_ppl").between(F.col("low"), F.col("high")))
            grams = gram_table(near)
        else:
            shared = docs.sparkSession.sparkContext.broadcast(model)
            passed = rows.filter(~F.col("base_failed")).select("lang", "base_failed", "n_chars", "symbols")
            scores, at = rewritten(scored(passed, shared).drop("symbols"), "scores")
            limits = judged(scores)
            discarded(docs.sparkSession, at)
            grams = gram_table(rows.filter(clear), _of_near_texts(shared, limits))
            shared.unpersist()
    model = whole(letters, *grams)
    shared = model if isinstance(model, Dealt) else docs.sparkSession.sparkContext.broadcast(model)
    rows, _ = rewritten(scored(rows, shared).drop("symbols"), "scored", path)
    return model, judged(rows), rows


def quality_rules(docs: DataFrame, *keys: str, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """Key columns, lang, counts, base_failed, log_ppl, the band (low, high) and kept, one row per row of docs."""
    _, limits, rows = judge(docs, *keys)
    judged = with_band(rows, limits, below, above).drop("_unit", "n_chars")
    return judged.withColumn("kept", kept())


def with_base(rows: DataFrame) -> DataFrame:
    """Coded rows with base_failed before the unit, n_chars and symbols."""
    return rows.select(*rows.columns[:-3], base_failed().alias("base_failed"), *rows.columns[-3:])


def kept():
    inside = F.col("log_ppl").between(F.col("low"), F.col("high"))
    return ~F.col("base_failed") & F.coalesce(inside, F.lit(False))


def quality_filter(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their own columns.

    The counts, the perplexity and the verdict are computed where the rows are, in one pass after
    the bands are known, so no text is shuffled to meet its verdict; what was written to learn them is deleted.
    Where the model is dealt, rows are coded once more and go to the answers, a unit at a time.
    """
    with Scratch(docs.sparkSession) as own:
        learned = model, limits = judge(docs)[:2]
        if isinstance(model, Dealt):
            whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
            rows = coded(with_lang(docs).select(whole_row, "lang", "text"), model.letters, "_row").transform(with_base)
            judged = with_band(scored(written(rows, "coded"), model), limits, below, above)
            return own.hand_out(judged.filter(kept()).select("_row.*"), "kept")
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, limits = shared.value
        for batch in batches:
            languages = batch.column(names.index("lang")).to_pylist() if "lang" in names else [None] * batch.num_rows
            chosen: list[int] = []
            for chunk in chunks(batch.column(names.index("text")).fill_null("")):
                good = base_passed(surface(chunk))
                ids, bounds = symbols(chunk, known.letters)
                losses, length = mean_losses(known.losses(codes(ids, bounds)), bounds), np.diff(bounds)
                for i in np.flatnonzero(good).tolist():
                    low, high = span_of(limits, languages[chunk.first + i], int(length[i]), below, above)
                    if low <= losses[i] <= high:
                        chosen.append(chunk.first + i)
            yield batch.take(pa.array(chosen, pa.int64()))

    return docs.mapInArrow(keep, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_ppl", "low", "high"
    )
