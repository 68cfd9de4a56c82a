"""Operator 11, source divergence audit: which sources of a language speak unlike each other, and in which terms.

Every (language, source) group has a vector of counts over the terms that its language keeps. Groups are
compared all with all by systolic rotation. A language's terms are dealt to lanes of about LANE terms, its
groups to seats of about SEAT groups, so one lane of one seat is a block of bounded size whatever
the corpus or its largest source. Blocks are dealt to partitions once and stay there; in each round of a round-robin
tournament (the circle method) a compressed copy of every travelling block goes to the seat that it
meets, which evaluates all pairs of their groups, each for both directions, and passes nothing on. A seat needs
memory for itself and one guest. Sums over lanes are added up afterwards. ROUNDS of the schedule go into one
Spark job, one after another in each task.

The terms in which a group exceeds its language are ranked by a heap of TOP terms for each group and
lane, filled where the block is made; the heaps of all lanes meet in one last ranking.

All arithmetic is exact: shares are parts in SCALE, divided digit by digit so that counts may reach 9e15.
Where a group lacks a term, all such terms have one share, so the work for a pair follows the terms
that either holds.

Defined results: null text, language or source is ''; a text of any length counts whole; repeated rows count
each; equal values are ranked by the item's bytes; a group without terms is compared by its smoothed
shares; a language that keeps no term has value 0 for all pairs and no term rows; a language with one source has no
pairs; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import chunks
from .shared import table, written
from .terms import byte_class, chunk_terms
from .vocabulary import pack, unpack

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
LANE = 1 << 15
SEAT = 8
ROUNDS = 4
ROWS = 1 << 14
_TERM = byte_class((0x41, 0x5A), (0x61, 0x7A))
_GROUP = ["lang", "source"]
_BLOCK = "lang string, lane long, seat long, n_seats long, names array<string>, block binary, tops array<struct<source: string, item: string, value: long>>"
_PAIR = "lang string, source string, item string, value long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: occurrences of a term in a group, and how many of the group's documents hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = np.asarray(one.indices).astype(np.int64) * max(len(two.dictionary), 1) + np.asarray(two.indices)
            order = np.argsort(group, kind="stable")  # a chunk then has few groups, and a term few rows
            group = group[order]
            for chunk in chunks(batch.column(2).take(pa.array(order)), 2 << 20):
                terms, place, bounds = chunk_terms(chunk, _TERM)
                if not len(place):
                    continue
                size = len(terms)
                in_docs, n = np.unique(chunk.owners(bounds) * size + place, return_counts=True)
                cells, at, held = np.unique(group[chunk.first + in_docs // size] * size + in_docs % size, return_inverse=True, return_counts=True)
                owner = cells // size
                rows = pa.RecordBatch.from_arrays([
                    one.dictionary.take(pa.array(owner // len(two.dictionary))), two.dictionary.take(pa.array(owner % len(two.dictionary))),
                    terms.take(pa.array(cells % size)), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(held.astype(np.int64)),
                ], names=[*_GROUP, "term", "n", "docs"])
                for a in range(0, len(cells), ROWS):
                    yield rows.slice(a, ROWS)

    found = docs.select(*_GROUP, "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, whole: int, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + 2) / whole), the quotient taken three digits at a time."""
    left, out = counts.astype(np.int64) + 2, np.zeros(len(counts), np.int64)
    while scale > 1:
        left = left * 1000
        out, left, scale = out * 1000 + left // whole, left % whole, scale // 1000
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Block:
    """The groups of one seat in one lane: for each its places in the lane's terms and its shares there."""

    def __init__(self, size: int, wholes: np.ndarray, bounds: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        self.size, self.wholes, self.bounds, self.places, self.counts = size, wholes, bounds, places, counts

    @staticmethod
    def of(raw: bytes) -> Block:
        size, n, held = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24 + 8 * (2 * n + 1)
        numbers = np.frombuffer(raw, np.int64, 2 * n + 1, 24)
        return Block(size, numbers[:n], numbers[n:], unpack(raw[at : at + held], np.int32).astype(np.int64), unpack(raw[at + held :], np.int64))

    def packed(self) -> bytes:
        places = pack(self.places.astype(np.int32))
        return np.array([self.size, len(self.wholes), len(places)], np.int64).tobytes() + np.concatenate([self.wholes, self.bounds]).astype(np.int64).tobytes() + places + pack(self.counts)

    def group(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places, shares there, and the share everywhere else."""
        own = slice(*self.bounds[i : i + 2])
        whole = int(self.wholes[i])
        none = 1 + 2 * SCALE // whole if whole else 0
        return self.places[own], shares(self.counts[own], whole) if whole else self.counts[own], none


def meeting(host: Block, guest: Block | None = None) -> Iterator[tuple[int, int, int]]:
    """(group of the host, group of the guest, summed divergence) of all pairs; of the host's own pairs without a guest."""
    guests = [(guest or host).group(j) for j in range(len((guest or host).wholes))]
    for i in range(len(host.wholes)):
        at, p, none = host.group(i)
        everywhere, held = np.full(host.size, none), np.zeros(host.size, bool)
        everywhere[at], held[at] = p, True
        for j, (places, q, absent) in enumerate(guests):
            if guest is None and j <= i:
                continue
            if not none or not absent or not host.size:
                yield i, j, 0
                continue
            both = places[held[places]]
            neither = host.size - len(at) - len(places) + len(both)
            one = divergence(everywhere[places], q).sum() + divergence(p, absent).sum() - divergence(everywhere[both], absent).sum()
            yield i, j, int(one) + neither * ((none - absent) ** 2 // (none + absent))


def schedule(turn: Column, seat: Column, seats: Column) -> Column:
    """The seat that `seat` meets in round 0, 1, ... of the circle method; one beyond the last is a rest."""
    n = seats + F.pmod(seats, F.lit(2))
    other = F.pmod(turn - seat, n - 1)
    fixed = F.pmod(turn * F.floor(n / 2), n - 1)  # whom the seat that never turns meets: twice that place is the round
    return F.when(seat == n - 1, fixed).when(other == seat, n - 1).otherwise(other).cast("long")


def divergences(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, lane: int = LANE, seat: int = SEAT) -> DataFrame:
    """lang, source, part, item, value and rank, by the contract of the audit."""
    source = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*_GROUP, "text")))
    counted = written(term_counts(source), "counts")
    by_lang = Window.partitionBy("lang", "lane").orderBy("term")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = written(kept.select("lang", "term", "total"), "kept")
    groups = written(source.select(*_GROUP).distinct(), "groups")
    known = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("total").alias("n_lang"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / seat).cast("long").alias("n_seats")).join(known, "lang", "left").na.fill(0, ["n_kept", "n_lang"])
    langs = written(langs.withColumn("lanes", F.greatest(F.lit(1), F.ceil(F.col("n_kept") / lane)).cast("long")), "langs")
    laned = kept.join(langs, "lang").withColumn("lane", F.pmod(F.xxhash64("term"), "lanes")).withColumn("place", F.row_number().over(by_lang) - 1)
    laned = written(laned.select("lang", "term", "total", "n_kept", "n_lang", "n_seats", "lane", "place"), "lanes")
    seat_of = F.pmod(F.xxhash64("source", F.lit("seat")), F.col("n_seats"))
    entries = written(counted.select(*_GROUP, "term", "n").join(laned, ["lang", "term"]).withColumn("seat", seat_of), "entries")
    sums = entries.groupBy(*_GROUP).agg(F.sum("n").alias("n_group"))
    sizes = laned.groupBy("lang", "lane").agg(F.count(F.lit(1)).alias("size"))
    members = groups.join(langs, "lang").join(sums, _GROUP, "left").na.fill(0, ["n_group"]).withColumn("whole", F.col("n_group") + 2 * F.col("n_kept"))
    members = members.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1))).withColumn("seat", seat_of).join(sizes, ["lang", "lane"], "left").na.fill(0, ["size"])

    def make(key: tuple, rows: pa.Table, who: pa.Table) -> pa.Table:
        return _block(key, rows, who, top)

    block = ["lang", "lane", "seat"]
    cells = entries.select(*block, "source", "term", "n", "total", "n_lang", "n_kept", "place").groupBy(*block)
    blocks = cells.cogroup(members.select(*block, "source", "whole", "size", "n_seats").groupBy(*block)).applyInArrow(make, _BLOCK)
    blocks = written(blocks, "blocks")
    pairs = rotated(blocks).groupBy(*_GROUP, "item").agg(F.sum("value").alias("value")).select(*_GROUP, F.lit("pair").alias("part"), "item", "value")
    terms = blocks.select("lang", F.explode("tops").alias("t")).select("lang", "t.source", F.lit("term").alias("part"), "t.item", "t.value")
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))


def _block(key: tuple, rows: pa.Table, who: pa.Table, top: int) -> pa.Table:
    """One block from its groups' entries, with the heap of each group's terms above the language."""
    if not who.num_rows:
        raise ValueError("a block without groups")
    lang, lane, seat = (k.as_py() for k in key)
    who = who.sort_by("source")
    names = who.column("source").to_pylist()
    size, n_seats = who.column("size")[0].as_py(), who.column("n_seats")[0].as_py()
    wholes = who.column("whole").to_numpy()
    number = {name: i for i, name in enumerate(names)}
    group = np.array([number[s] for s in rows.column("source").to_pylist()], np.int64)
    place, n, total = (rows.column(c).to_numpy().astype(np.int64) for c in ("place", "n", "total"))
    order = np.lexsort((place, group))
    bounds = np.searchsorted(group[order], np.arange(len(names) + 1))
    block = Block(size, wholes, bounds, place[order], n[order])
    tops = []
    if len(order):
        whole = rows.column("n_lang")[0].as_py() + 2 * rows.column("n_kept")[0].as_py()
        q, term = shares(total[order], whole), rows.column("term").take(pa.array(order))
        for i, name in enumerate(names):
            own = slice(*bounds[i : i + 2])
            p = block.group(i)[1]
            value = np.where(p > q[own], divergence(p, q[own]), -1)
            heap = np.lexsort((block.places[own], -value))[:top]  # a lane's places are in order of the terms' bytes
            tops += [{"source": name, "item": term[int(bounds[i] + k)].as_py(), "value": int(value[k])} for k in heap.tolist() if value[k] >= 0]
    return pa.table({
        "lang": pa.array([lang], pa.string()), "lane": pa.array([lane], pa.int64()), "seat": pa.array([seat], pa.int64()), "n_seats": pa.array([n_seats], pa.int64()), "names": pa.array([names], pa.list_(pa.string())),
        "block": pa.array([block.packed()], pa.binary()), "tops": pa.array([tops], pa.list_(pa.struct([("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))),
    })


def rotated(blocks: DataFrame) -> DataFrame:
    """lang, source, item, value of every lane, pair and direction: the home pairs, then round after round of meetings."""
    spark = blocks.sparkSession
    home = blocks.select("lang", "lane", "seat", "n_seats", "names", "block")
    most = home.agg(F.max("n_seats")).first()[0] or 0
    rounds = most + most % 2 - 1
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    resident = home.repartition(width, "lang", "lane", "seat").persist(pyspark.StorageLevel.DISK_ONLY)
    out = [written(resident.groupBy("lang", "lane", "seat").applyInArrow(_at_home, _PAIR), "home")]
    for first in range(0, rounds if most > 1 else 0, ROUNDS):
        turn = F.explode(F.sequence(F.lit(first).cast("long"), F.least(F.lit(first + ROUNDS), F.col("n_seats") + F.pmod("n_seats", F.lit(2)) - 1).cast("long") - 1))
        due = home.filter(F.col("n_seats") + F.pmod("n_seats", F.lit(2)) - 1 > first).withColumn("round", turn)
        met = due.withColumn("host", schedule(F.col("round"), F.col("seat"), F.col("n_seats"))).filter(F.col("host") < F.col("n_seats"))
        # one of the two travels: the lower seat in even rounds, the higher in odd ones
        guests = met.filter((F.col("seat") < F.col("host")) == (F.pmod("round", F.lit(2)) == 0)).select("lang", "lane", F.col("host").alias("seat"), "round", F.col("names"), F.col("block"))
        out.append(written(resident.groupBy("lang", "lane", "seat").cogroup(guests.groupBy("lang", "lane", "seat")).applyInArrow(_with_guests, _PAIR), "round"))
    resident.unpersist()
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _rows(lang: str, found: Iterator[tuple[str, str, int]]) -> pa.Table:
    both = [(x, y, v) for a, b, v in found for x, y in ((a, b), (b, a))]
    columns = list(zip(*both)) if both else [(), (), ()]
    return pa.table({"lang": pa.array([lang] * len(both), pa.string()), "source": pa.array(columns[0], pa.string()), "item": pa.array(columns[1], pa.string()), "value": pa.array(columns[2], pa.int64())})


def _at_home(rows: pa.Table) -> pa.Table:
    row = rows.to_pylist()[0]
    return _rows(row["lang"], ((row["names"][i], row["names"][j], v) for i, j, v in meeting(Block.of(row["block"]))))


def _with_guests(mine: pa.Table, others: pa.Table) -> pa.Table:
    if not mine.num_rows or not others.num_rows:
        return _rows("", iter(()))
    row = mine.to_pylist()[0]
    host = Block.of(row["block"])
    found = ((row["names"][i], other["names"][j], v) for other in others.to_pylist() for i, j, v in meeting(host, Block.of(other["block"])))
    return _rows(row["lang"], found)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))
