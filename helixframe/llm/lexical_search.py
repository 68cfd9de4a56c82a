"""Operator 13, ranked lexical search: Block-Max WAND over compressed posting blocks.

The index is a written table. Documents are packed into shards of about SHARD_TOKENS terms, in order of
their key inside a shard; each shard has one row a term: its postings in blocks of BLOCK documents, gaps and
frequencies packed in as many bits as the block's largest needs, and for every block a head with its last
document, its greatest impact and where its bytes begin. One more row a shard, under the empty term, holds the documents'
keys and length norms.

A search ships the items' terms to the shards, where a term's row is read once for a batch of items. The
heads alone are walked first: the ends of all blocks of an item's terms cut the shard into intervals, in each
of which every term stands in one block, and the blocks' greatest impacts bound what a document there can
score (the shallow pointer moves, done for all pivots of a shard at once). Intervals are visited by
falling bound, and only blocks of intervals whose bound reaches the threshold, the score of the last of the
best so far, are decompressed. One shard in FIRST_WAVE is searched first; the scores that it
reaches are the threshold from which the others start, so that shards without a good document decompress
little. Local bests are merged by score. All scores are integers and bounds are exact, so nothing is lost.

Defined results: null or empty text has no terms and is never found, and counts for nothing; a text of any
length is one document; items that are null, empty or without a known term have no rows; equal scores are
ranked by ascending key, null keys last; rows of one key are documents of their own; items of one id and one text are
one item, unlike texts of one id are ranked each for itself; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import chunks
from .shared import table, texts, written
from .terms import byte_class, chunk_terms, joined_terms
from .vocabulary import pack, unpack

BLOCK = 128
SHARD_TOKENS = 1 << 21
BATCH_ITEMS = 64
FIRST_WAVE = 16
TOP = 50
ROWS = 4096
_TERM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_HEAD = np.dtype([("last", "<i4"), ("most", "<i4"), ("at", "<i4"), ("n", "u1"), ("gap_bits", "u1"), ("tf_bits", "u1"), ("_", "u1")])


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each document's m: half fixed, half its length over the mean."""
    return 50 + (50 * lengths * n_docs) // max(n_terms, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _bits(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of each block's largest value, one at least."""
    most = np.maximum.reduceat(values, starts)
    return np.maximum(1, np.ceil(np.log2(most + 1.0))).astype(np.int64)


def packed_blocks(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
    """Write each block's values into out from at on, width bits each, blocks filled up to eights."""
    eights = -(-sizes // 8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        cells = np.zeros(int(eights[own].sum()) * 8, np.int64)
        first = np.concatenate([[0], np.cumsum(eights[own] * 8)])[:-1]
        inside = np.arange(int(sizes[own].sum())) - np.repeat(np.concatenate([[0], np.cumsum(sizes[own])])[:-1], sizes[own])
        cells[np.repeat(first, sizes[own]) + inside] = values[np.repeat(starts[own], sizes[own]) + inside]
        stream = np.packbits(((cells[:, None] >> np.arange(w)) & 1).astype(np.uint8).ravel())
        length = eights[own] * w
        bounds = np.concatenate([[0], np.cumsum(length)])
        out[np.repeat(at[own] - bounds[:-1], length) + np.arange(bounds[-1])] = stream


def unpacked(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(raw[: -(-n // 8) * width]).reshape(-1, width)[:n]
    return bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def posting_rows(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Document frequency, heads and packed blocks of each of the terms 0 .. n_terms, from postings sorted by (term, doc)."""
    df = np.bincount(term, minlength=n_terms)
    first = np.concatenate([[0], np.cumsum(df)])[:-1]
    many = -(-df // BLOCK)
    of_term = np.concatenate([[0], np.cumsum(many)])
    inside = np.arange(of_term[-1]) - np.repeat(of_term[:-1], many)
    starts = np.repeat(first, many) + BLOCK * inside
    sizes = np.minimum(BLOCK, np.repeat(first + df, many) - starts)
    before = np.empty_like(doc)
    before[1:] = doc[:-1]
    before[first] = -1
    gap, more = doc - before - 1, tf - 1
    gap_bits, tf_bits = _bits(gap, starts), _bits(more, starts)
    eights = -(-sizes // 8)
    length = eights * (gap_bits + tf_bits)
    at = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(int(at[-1]), np.uint8)
    packed_blocks(gap, starts, sizes, gap_bits, out, at[:-1])
    packed_blocks(more, starts, sizes, tf_bits, out, at[:-1] + eights * gap_bits)
    head = np.zeros(len(starts), _HEAD)
    head["last"] = doc[starts + sizes - 1]
    head["most"] = np.maximum.reduceat(impacts(tf, m[doc]), starts)
    head["at"] = at[:-1] - np.repeat(at[of_term[:-1]], many)
    head["n"], head["gap_bits"], head["tf_bits"] = sizes, gap_bits, tf_bits
    return df, _binaries(head.view(np.uint8), of_term * _HEAD.itemsize), _binaries(out, at[of_term])


def _binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


@dataclass
class Index:
    """shard, term, df, head, payload, keys; the number of documents with terms, and of all terms."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.diff(c.runs(_TERM[c.data])[2]) for c in chunks(batch.column(0))]
            yield pa.RecordBatch.from_pydict({"docs": [sum(int((n > 0).sum()) for n in found)], "terms": [sum(int(n.sum()) for n in found)]})

    total = texts(docs).mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return total[0] or 0, total[1] or 0


def build_index(docs: DataFrame, key: str = "doc_id") -> Index:
    """The index of all rows of docs, written."""
    n_docs, n_terms = corpus_size(docs)
    source = texts(docs, key)
    kind = source.schema[0].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]] = []
        made = 0

        def shard() -> Iterator[pa.RecordBatch]:
            keys = pa.concat_arrays([h[0] for h in held])
            lengths = np.concatenate([h[1] for h in held])
            terms, place = joined_terms([h[2:] for h in held])
            order = np.asarray(pc.sort_indices(keys, null_placement="at_end")).astype(np.int64)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            doc = np.repeat(rank, lengths)
            pairs, tf = np.unique(place * len(order) + doc, return_counts=True)
            m = norms(lengths[order], n_docs, n_terms)
            df, heads, payloads = posting_rows(pairs // len(order), pairs % len(order), tf, m, len(terms))
            names = ["shard", "term", "df", "head", "payload", "keys"]
            taken = keys.take(pa.array(order))
            of_docs = pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken)
            number = first + made
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([""]), pa.array([0]), pa.array([b""]), pa.array([pack(m)], pa.binary()), of_docs], names=names)
            none = pa.nulls(len(terms), of_docs.type)
            whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), number)), terms, pa.array(df), heads, payloads, none], names=names)
            for a in range(0, len(terms), ROWS):
                yield whole.slice(a, ROWS)

        for batch in batches:
            for chunk in chunks(batch.column(1)):
                terms, place, bounds = chunk_terms(chunk, _TERM)
                lengths = np.diff(bounds)
                some = np.flatnonzero(lengths)
                if len(some):
                    held.append((batch.column(0).slice(chunk.first, chunk.n).take(pa.array(some)), lengths[some], terms, place))
                if sum(len(h[3]) for h in held) >= SHARD_TOKENS:
                    yield from shard()
                    held, made = [], made + 1
        if held:
            yield from shard()

    rows = source.mapInArrow(build, f"shard long, term string, df long, head binary, payload binary, keys array<{kind}>")
    return Index(written(rows, "index"), n_docs, n_terms)


class Postings:
    """One term's blocks in a shard; a block is decompressed when first asked for."""

    def __init__(self, head: bytes, payload: bytes, m: np.ndarray) -> None:
        self.head, self.raw, self.m = np.frombuffer(head, _HEAD), np.frombuffer(payload, np.uint8), m
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @cached_property
    def last(self) -> np.ndarray:
        return self.head["last"].astype(np.int64)

    @cached_property
    def most(self) -> np.ndarray:
        return self.head["most"].astype(np.int64)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if b not in self.read:
            _, _, at, n, gap_bits, tf_bits, _ = self.head[b].tolist()
            gaps = unpacked(self.raw[at:], n, gap_bits)
            tf = unpacked(self.raw[at + -(-n // 8) * gap_bits :], n, tf_bits) + 1
            doc = np.cumsum(gaps + 1) + (self.last[b - 1] if b else -1)
            self.read[b] = doc, impacts(tf, self.m[doc])
        return self.read[b]


def best(lists: list[tuple[Postings, int]], n_docs: int, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the `top` best with a score above 0 and of at least `floor`, best first."""
    ends = np.unique(np.concatenate([p.last for p, _ in lists]))
    bound = np.zeros(len(ends), np.int64)
    blocks = []
    for postings, weight in lists:
        at = np.searchsorted(postings.last, ends)
        live = at < len(postings.last)
        bound[live] += weight * postings.most[at[live]]
        blocks.append(np.where(live, at, -1))
    order = np.argsort(-bound, kind="stable")
    scores, threshold, done, step = np.zeros(n_docs, np.int64), max(floor, 1), 0, 16
    while done < len(order):
        chosen = order[done : done + step]
        chosen = chosen[bound[chosen] >= threshold]
        if not len(chosen):
            break
        open_ = np.zeros(len(ends) + 1, bool)
        open_[chosen] = True
        for (postings, weight), at in zip(lists, blocks):
            wanted = np.unique(at[chosen])
            found = [postings.block(b) for b in wanted[wanted >= 0].tolist()]
            if found:
                doc, impact = (np.concatenate(x) for x in zip(*found))
                inside = open_[np.searchsorted(ends, doc)]
                scores[doc[inside]] += weight * impact[inside]
        if (scores >= threshold).sum() >= top:
            threshold = max(threshold, int(np.partition(scores, n_docs - top)[n_docs - top]))
        done, step = done + step, step * 2
    found = np.flatnonzero(scores >= threshold)
    found = found[np.lexsort((found, -scores[found]))][:top]
    return found, scores[found]


def item_terms(items: DataFrame) -> DataFrame:
    """item and its distinct terms, from rows of item and text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                terms, place, bounds = chunk_terms(chunk, _TERM)
                pairs = np.unique(chunk.owners(bounds) * max(len(terms), 1) + place)
                owner, term = pairs // max(len(terms), 1), pairs % max(len(terms), 1)
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n).take(pa.array(owner)), terms.take(pa.array(term))], names=["item", "term"])
                for a in range(0, rows.num_rows, ROWS):
                    yield rows.slice(a, ROWS)

    return texts(items, "item").mapInArrow(find, "item long, term string")


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("long")


def search(index: Index, items: DataFrame, item_key: str, key: str = "doc_id", top: int = TOP) -> DataFrame:
    """item_key, rank, key and score of each item's best documents."""
    asked = items.select(item_key, F.coalesce("text", F.lit("")).alias("text")).distinct()
    asked = written(asked.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("_id"), "text"), "items")
    batches = max(1, -(-asked.count() // BATCH_ITEMS))
    batch = F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int")
    wanted = written(item_terms(asked), "terms")
    seen = index.rows.select("term", "df").join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    entry = F.struct("item", "value")
    weighed = wanted.join(seen.select("term", weight(F.col("df"), index.n_docs).alias("value")), "term").withColumn("batch", batch)
    by_term = written(weighed.groupBy("term", "batch").agg(F.collect_list(entry).alias("entries")), "weights")
    kind = [f.dataType.elementType.simpleString() for f in index.rows.schema if f.name == "keys"][0]

    def find(group: pa.Table) -> pa.Table:
        return _search_shard(group, top)

    def wave(rows: DataFrame, floors: DataFrame) -> DataFrame:
        """Each shard's best of every item; floors (item, value) stand under the empty term beside the documents."""
        of_docs = floors.withColumn("batch", batch).groupBy("batch").agg(F.collect_list(entry).alias("entries")).select(F.lit("").alias("term"), "batch", "entries")
        met = rows.join(by_term.unionByName(of_docs), "term")
        return met.groupBy("shard", "batch").applyInArrow(find, f"item long, key {kind}, score long")

    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))).cast("int")
    merged = lambda found: found.withColumn("rank", rank).filter(F.col("rank") <= top)
    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST_WAVE)) == 0
    one = written(merged(wave(index.rows.filter(first), asked.select("item", F.lit(0).cast("long").alias("value")))), "first")
    reached = one.filter(F.col("rank") == top).select("item", F.col("score").alias("value"))
    floors = asked.select("item").join(reached, "item", "left").select("item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    both = one.drop("rank").unionByName(wave(index.rows.filter(~first), floors))
    return merged(both).join(asked.select("item", "_id"), "item").select(F.col("_id").alias(item_key), "rank", F.col("key").alias(key), "score")


def _search_shard(group: pa.Table, top: int) -> pa.Table:
    """Every item's best of one shard, from the rows of one shard and one batch of items."""
    head, payload, terms = (group.column(c).to_pylist() for c in ("head", "payload", "term"))
    entries = group.column("entries").to_pylist()
    schema = pa.schema([("item", pa.int64()), ("key", group.schema.field("keys").type.value_type), ("score", pa.int64())])
    home = terms.index("")
    m = unpack(payload[home], np.int64)
    keys = group.column("keys").slice(home, 1).combine_chunks().flatten()
    floors = {e["item"]: e["value"] for e in entries[home]}
    lists: dict[int, list[tuple[Postings, int]]] = {item: [] for item in floors}
    for i, of_items in enumerate(entries):
        if i != home:
            postings = Postings(head[i], payload[i], m)
            for e in of_items:
                lists[e["item"]].append((postings, e["value"]))
    found = [(item, *best(own, len(m), min(top, len(m)), floors[item])) for item, own in lists.items() if own]
    parts = [pa.table([pa.array(np.full(len(docs), item)), keys.take(pa.array(docs)), pa.array(scores)], schema=schema) for item, docs, scores in found]
    return pa.concat_tables(parts) if parts else schema.empty_table()


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    return search(index, table(spark, sf_dir, "benchmark"), "item_id")
