"""Operator 7, exact substring removal by prefix-free parsing.

A rolling hash picks triggers: in each run of 100 - GRAM + 1 places, the place whose GRAM bytes have
the least hash. So every 100-byte string holds a trigger, the same in all its copies, and triggers
cut texts into phrases whatever stands around them. The strings that one trigger serves form its
context. Per trigger hash (`grouped`): a context seen before is a repeat as a whole; a hash with one
context needs nothing more; a hash with several has edges, where copies begin or end, and only the
first of each context is looked at byte by byte, and only where a hash of the bytes that all strings
of a range hold is met twice.

Those contexts are cut at their trigger into what precedes (the phrase suffix, the dictionary side)
and what follows (the parse side). Both sides are suffix-sorted with common-prefix lengths, and a
string's place in corpus order is its pair of ranks: neighbours with enough common bytes on both
sides are the same string (`corpus_order`). Classes are merged across tasks by 128-bit fingerprints.
The suffix arrays cover only what can't be settled by whole phrases, never the whole corpus.

Defined results: null text is empty; texts under 100 bytes lose nothing; documents are ordered by
doc_id, null first; rows that share a doc_id are judged against smaller ids and their own earlier
places, not against each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Chunk, Powers, byte_values, chunks, mixed, prefix_hash, span_hash
from .shared import table, texts, written

LENGTH = 100
GRAM = 40
REACH = LENGTH - GRAM
CHUNK = 1 << 20
FLUSH = 200_000
EDGE_FLUSH = 10_000
PARTITION_BYTES = 1 << 25
MOST_CONTEXTS = 8
NULL_ID = -(1 << 63)
_SECOND = byte_values(91)
_SECOND_POWERS = Powers(0xD1342543DE82EF95)
RANGES = ((0, 20), (20, 40), (40, REACH + 1))  # of the trigger's distance from a string's start
_RAW = {"h": 6, "f": 8, "g": 8, "c": 4, "k0": 2, "k1": 2, "k2": 2, "tag": 8}
_TRIGGER = np.dtype([("h", "<u8"), ("c", "<u4"), ("k0", "<u2"), ("k1", "<u2"), ("k2", "<u2"), ("doc", "<i8"), ("tag", "<i8"), ("t", "<i4"), ("before", "u1"), ("least", "u1"), ("many", "?")])
_EDGE = np.dtype([("t", "<i4"), ("before", "<i4"), ("least", "<i4")])
_WINDOW = np.dtype([("f", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("p", "<i4")])
MARKS, EDGES, PACKED = 0, 1, 2
_STEP = "kind int, part int, doc long, tag long, payload binary"


def row_tags(chunk: Chunk) -> np.ndarray:
    """A 64-bit hash of each text, to tell rows apart that share a doc_id, as all null ids do."""
    sizes = np.diff(chunk.offsets).astype(np.uint64)
    return mixed(span_hash(chunk.prefix, chunk.offsets[:-1], chunk.offsets[1:]) + sizes).view(np.int64)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def triggers(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigger places with the first and last start of the strings they serve, and all places' hashes."""
    size = len(chunk.data)
    none = np.zeros(0, np.int64)
    if size < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(size - GRAM + 1)
    h = mixed(span_hash(chunk.prefix, at, at + GRAM))
    least = sliding_least(h, REACH + 1)
    valid = np.zeros(size + 1, np.int64)
    for sign, edge in ((1, chunk.offsets[:-1]), (-1, np.maximum(chunk.offsets[1:] - LENGTH + 1, chunk.offsets[:-1]))):
        np.add.at(valid, edge, sign)
    starts = np.flatnonzero(np.cumsum(valid)[: len(least)] > 0)
    if not len(starts):
        return none, none, none, h
    owner = np.searchsorted(chunk.offsets, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = (least[starts[1:]] != least[starts[:-1]]) | (owner[1:] != owner[:-1])
    first = starts[new]
    last = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1])
    t = np.empty(len(first), np.int64)
    for a in range(0, len(first), 1 << 14):
        rows = first[a : a + (1 << 14), None] + np.arange(REACH + 1)
        t[a : a + (1 << 14)] = first[a : a + (1 << 14)] + np.argmin(h[rows], axis=1)
    tied = np.flatnonzero(last > t)
    if len(tied):
        more = []
        for i in tied:  # the same hash again before the first is passed: repetitive text
            a, b = int(first[i]), int(last[i])
            places = a + np.flatnonzero(h[a : b + REACH + 1] == h[t[i]])
            upto = np.minimum(places, b)
            since = np.concatenate([[a], upto[:-1] + 1])
            live = since <= upto
            more.append(np.stack([places[live], since[live], upto[live]]))
        whole = np.ones(len(t), bool)
        whole[tied] = False
        t, first, last = (np.concatenate([x[whole], *(m[k] for m in more)]) for k, x in enumerate((t, first, last)))
    return t, first, last, h


def merged(doc: np.ndarray, tag: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Per document, its intervals joined where they overlap or touch: pairs of 32-bit places."""
    if not len(doc):
        return
    order = np.lexsort((a, tag, doc))
    doc, tag, a, b = doc[order], tag[order], a[order].astype(np.int64), b[order].astype(np.int64)
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    group = np.cumsum(head) - 1
    span = int(b.max()) + 1
    reach = np.maximum.accumulate(b + group * span) - group * span
    start = head.copy()
    start[1:] |= a[1:] > reach[:-1]
    firsts = np.flatnonzero(start)
    pairs = np.stack([a[firsts], np.append(reach[firsts[1:] - 1], reach[-1])], 1).astype("<i4")
    cuts = np.flatnonzero(head[firsts])
    for i, j in zip(cuts, np.append(cuts[1:], len(firsts))):
        yield int(doc[firsts[i]]), int(tag[firsts[i]]), pairs[i:j]


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 20_000):
        kind, part, doc, tag, payload = zip(*rows[i : i + 20_000])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(payload, pa.binary())], names=["kind", "part", "doc", "tag", "payload"])


def _columns(rows: np.ndarray, names: tuple[str, ...]) -> bytes:
    """A structured array by columns: hashes as they are, the regular ones by differences and compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = []
    for n in names:
        values = np.ascontiguousarray(rows[n])
        if n in _RAW:
            parts.append(values.view(np.uint8).reshape(len(rows), -1)[:, : _RAW[n]].tobytes())
        else:
            parts.append(squeeze(_delta(values)))
    return np.array([len(rows), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _delta(values: np.ndarray) -> bytes:
    return np.diff(values.astype(np.int64), prepend=np.int64(0)).tobytes() if values.dtype.itemsize > 1 else values.tobytes()


def _rows(raw: bytes, kind: np.dtype, names: tuple[str, ...]) -> np.ndarray:
    head = np.frombuffer(raw, "<i8", 1 + len(names))
    n_rows = int(head[0])
    out = np.zeros(n_rows, kind)
    unpack = zstandard.ZstdDecompressor().decompress
    at = 8 * (1 + len(names))
    for n, size in zip(names, head[1:].tolist()):
        piece = raw[at : at + size]
        at += size
        if n in _RAW:
            wide = np.zeros((n_rows, kind[n].itemsize), np.uint8)
            wide[:, : _RAW[n]] = np.frombuffer(piece, np.uint8).reshape(n_rows, -1)
            out[n] = wide.view(kind[n]).ravel()
        elif kind[n].itemsize > 1:
            out[n] = np.cumsum(np.frombuffer(unpack(piece), np.int64))
        else:
            out[n] = np.frombuffer(unpack(piece), kind[n])
    return out


def _dealt(rows: np.ndarray, key: np.ndarray, buckets: int, names: tuple[str, ...], kind: int) -> list[tuple]:
    """Rows packed by bucket of their key, in document order within each."""
    bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((rows["t" if "t" in names else "p"], rows["doc"], bucket))
    rows, bucket = rows[order], bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else []
    return [(kind, int(bucket[a]), None, None, _columns(rows[a:b], names)) for a, b in zip(heads, np.append(heads[1:], len(rows)))]


def _repeats(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (h, context, doc, t), and which are the first of their context."""
    shape = rows["c"].astype(np.uint64) << np.uint64(16) | rows["before"].astype(np.uint64) << np.uint64(8) | rows["least"]
    for k in ("k0", "k1", "k2"):
        shape = mixed(shape + rows[k])
    order = np.lexsort((rows["t"], rows["tag"], rows["doc"], shape, rows["h"]))
    rows, shape = rows[order], shape[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["h"][1:] != rows["h"][:-1]) | (shape[1:] != shape[:-1])
    return rows, first


def _intervals(rows: np.ndarray) -> list[tuple]:
    t = rows["t"].astype(np.int64)
    found = merged(rows["doc"], rows["tag"], t - rows["before"], t - rows["least"] + LENGTH)
    return [(MARKS, doc % 9973, doc, tag, pairs.tobytes()) for doc, tag, pairs in found]


def _edges(rows: np.ndarray) -> list[tuple]:
    if not len(rows):
        return []
    rows = rows[np.lexsort((rows["t"], rows["tag"], rows["doc"]))]
    heads = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tag"][1:] != rows["tag"][:-1])]))
    cut = np.zeros(len(rows), _EDGE)
    for n in ("t", "before", "least"):
        cut[n] = rows[n]
    return [(EDGES, int(rows["doc"][a]) % 9973, int(rows["doc"][a]), int(rows["tag"][a]), cut[a:b].tobytes()) for a, b in zip(heads, np.append(heads[1:], len(rows)))]


def _shared_ranges(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows cut to the ranges in which another context of their group has the same bytes around the trigger.

    A group that some task has cut short (many) keeps whole rows: its other contexts aren't here.
    """
    many = np.bincount(group, rows["many"])[group] > 0
    out = [rows[many]]
    rest, of = rows[~many], group[~many]
    for i, (low, high) in enumerate(RANGES):
        meets = (rest["least"] < high) & (rest["before"] >= low)
        some, key = rest[meets], of[meets].astype(np.int64) << 16 | rest[f"k{i}"][meets]
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        some = some[counts[back] > 1]
        some["least"] = np.maximum(some["least"], low)
        some["before"] = np.minimum(some["before"], high - 1)
        out.append(some)
    return np.concatenate(out)


def _same_place(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows that stand at the very place (doc and offset) of their context's first: copies of one doc_id."""
    lead = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    return (rows["doc"] == rows["doc"][lead]) & (rows["t"] == rows["t"][lead])


def parsed(source: DataFrame, buckets: int) -> DataFrame:
    """Triggers of all texts packed by bucket of their hash, and repeats and edges already known."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, first = _repeats(np.concatenate(held))
        again = ~first & ~_same_place(rows, first)
        out = _intervals(rows[again])
        rows = rows[~again]
        new = np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])
        rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        rows["many"] = size > MOST_CONTEXTS
        out += _edges(rows[rank >= MOST_CONTEXTS])
        kept = rows[rank < MOST_CONTEXTS]
        out += _dealt(kept, kept["h"], buckets, _TRIGGER.names, PACKED)
        yield from _batch(out)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids = np.array(batch.column(0))
            for chunk in chunks(batch.column(1), CHUNK):
                t, lo, hi, h = triggers(chunk)
                if not len(t):
                    continue
                doc = np.searchsorted(chunk.offsets, t, "right") - 1
                tags = row_tags(chunk)
                rows = np.zeros(len(t), _TRIGGER)
                rows["h"] = h[t] & np.uint64((1 << 48) - 1)
                rows["c"] = mixed(span_hash(chunk.prefix, lo, hi + LENGTH) ^ np.uint64(0xA5A5)) >> np.uint64(32)
                for i, (low, high) in enumerate(RANGES):
                    meets = (t - hi < high) & (t - lo >= low)
                    at = t[meets]
                    rows[f"k{i}"][meets] = mixed(span_hash(chunk.prefix, at - low, at + LENGTH + 1 - high)) >> np.uint64(48)
                rows["doc"], rows["tag"] = ids[chunk.first + doc], tags[doc]
                rows["t"], rows["before"], rows["least"] = t - chunk.offsets[doc], t - lo, t - hi
                held.append(rows)
                count += len(rows)
                if count >= FLUSH:
                    yield from flush(held)
                    held, count = [], 0
        if count:
            yield from flush(held)

    return source.mapInArrow(parse, _STEP)


def grouped(steps: DataFrame, partitions: int) -> DataFrame:
    """Repeats and edges of every document: each trigger hash's contexts compared in one place."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            kinds = np.array(batch.column(0))
            other = batch.filter(pa.array(kinds != PACKED))
            if other.num_rows:
                yield other
            for i in np.flatnonzero(kinds == PACKED).tolist():
                held.append(_rows(batch.column(4)[i].as_py(), _TRIGGER, _TRIGGER.names))
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        rows, first = _repeats(rows)
        again = ~first & ~_same_place(rows, first)
        yield from _batch(_intervals(rows[again]))
        rows, first = rows[~again], first[~again]
        group_of = np.cumsum(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])) - 1
        wanted = (np.bincount(group_of, first)[group_of] > 1) | (np.bincount(group_of, rows["many"])[group_of] > 0)
        yield from _batch(_edges(_shared_ranges(rows[wanted], group_of[wanted])))

    return steps.repartition(partitions, "part").mapInArrow(group, _STEP)


def corpus_order(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-sort the sides of contexts: ranks and common lengths of neighbours, for each side.

    `before` has the bytes before the trigger, nearest first; `after` those from the trigger on.
    """
    out = []
    for side in (before, after):
        order = np.argsort(np.ascontiguousarray(side).view(f"S{side.shape[1]}").ravel(), kind="stable")
        ranked = side[order]
        unlike = ranked[1:] != ranked[:-1]
        common = np.where(unlike.any(1), unlike.argmax(1), side.shape[1])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out += [place, np.concatenate([[0], common])]
    return tuple(out)


def settled(edges: np.ndarray, bodies: list[bytes], doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of some edges in (doc, t) order: the first of each class as fingerprints, and the repeats as rows.

    And for each first a hash of the bytes that its range's strings share, so that an edge's strings go
    to few tasks, and equal ones to the same.
    """
    n = len(edges)
    before, after = np.zeros((n, REACH), np.uint8), np.zeros((n, LENGTH), np.uint8)
    for i, (t, back, least) in enumerate(edges.tolist()):
        left = bodies[i][max(0, t - back) : t][::-1]
        right = bodies[i][t : t + LENGTH - least]
        before[i, : len(left)] = np.frombuffer(left, np.uint8)
        after[i, : len(right)] = np.frombuffer(right, np.uint8)
    place_b, common_b, place_a, common_a = corpus_order(before, after)
    whole = np.concatenate([before[:, ::-1], after], axis=1).ravel()
    first_prefix = prefix_hash(whole)
    second_prefix = prefix_hash(whole, _SECOND, _SECOND_POWERS)
    firsts, cores, repeats = [], [], []
    for o in range(REACH + 1):
        live = np.flatnonzero((edges["least"] <= o) & (o <= edges["before"]))
        if not len(live):
            continue
        class_b = np.cumsum(common_b < o)[place_b[live]] if o else np.zeros(len(live), np.int64)
        class_a = np.cumsum(common_a < LENGTH - o)[place_a[live]]
        _, index, back = np.unique(class_b * (n + 1) + class_a, return_index=True, return_inverse=True)
        lead = index[back]
        rows = np.zeros(len(live), _WINDOW)
        rows["doc"], rows["tag"], rows["p"] = doc[live], tag[live], edges["t"][live] - o
        again = (rows["doc"] != rows["doc"][lead]) | (rows["p"] != rows["p"][lead])
        repeats.append(rows[again])
        start = live * (REACH + LENGTH) + REACH - o
        rows["f"] = mixed(span_hash(first_prefix, start, start + LENGTH))
        rows["g"] = mixed(span_hash(second_prefix, start, start + LENGTH, _SECOND_POWERS))
        firsts.append(rows[~again])
        low, high = next(r for r in RANGES if r[0] <= o < r[1])
        trigger = live[~again] * (REACH + LENGTH) + REACH
        cores.append(mixed(span_hash(first_prefix, trigger - low, trigger + LENGTH + 1 - high)))
    return np.concatenate(firsts), np.concatenate(cores), np.concatenate(repeats)


def _window_marks(rows: np.ndarray) -> list[tuple]:
    return [(doc, tag, pairs.tobytes()) for doc, tag, pairs in merged(rows["doc"], rows["tag"], rows["p"], rows["p"].astype(np.int64) + LENGTH)]


def _joined(parts: list[bytes]) -> np.ndarray:
    pairs = np.concatenate([np.frombuffer(p, "<i4").reshape(-1, 2) for p in parts]) if parts else np.zeros((0, 2), "<i4")
    zero = np.zeros(len(pairs), np.int64)
    return next((p for _, _, p in merged(zero, zero, pairs[:, 0], pairs[:, 1])), np.zeros((0, 2), "<i4"))


def _result(text: bytes, spans: np.ndarray) -> tuple[int, int, int, str]:
    digest, at = hashlib.sha256(), 0
    for a, b in spans.tolist():
        digest.update(text[at:a])
        at = b
    digest.update(text[at:])
    return len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()


DONE, PENDING, WINDOWS, LATE = 0, 1, 2, 3
_MADE = "kind int, part int, doc long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, marks binary, body binary"


def _made(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in _MADE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def resolved(rows: DataFrame, buckets: int) -> DataFrame:
    """Results of documents without edges; for the others their text, and fingerprints of their edges' strings."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[0])
            edges = np.concatenate([x[2] for x in held])
            sizes = [len(x[2]) for x in held]
            doc, tag = (np.repeat(np.array([x[k] for x in held], np.int64), sizes) for k in (0, 1))
            order = np.lexsort((edges["t"], doc))
            bodies = [x[3] for x, n in zip(held, sizes) for _ in range(n)]
            firsts, cores, repeats = settled(edges[order], [bodies[i] for i in order], doc[order], tag[order])
            out = [(LATE, None, d, t, None, None, None, None, m, None) for d, t, m in _window_marks(repeats)]
            out += [(WINDOWS, part, None, None, None, None, None, None, None, raw) for _, part, _, _, raw in _dealt(firsts, cores, buckets, _WINDOW.names, PACKED)]
            for i in range(0, len(out), 5_000):
                yield _made(out[i : i + 5_000])

        for batch in batches:
            doc, tag, body, marks, edges = (batch.column(batch.schema.get_field_index(n)) for n in ("doc", "tag", "packed", "marks", "edges"))
            out = []
            for d, t, raw, known, open_ in zip(doc.to_pylist(), tag.to_pylist(), body.to_pylist(), marks.to_pylist(), edges.to_pylist()):
                text = unpack(raw)
                spans = _joined(known or [])
                if open_:
                    cut = np.concatenate([np.frombuffer(x, _EDGE) for x in open_])
                    out.append((PENDING, None, d, t, None, None, None, None, spans.tobytes(), raw))
                    for i in range(0, len(cut), EDGE_FLUSH):
                        held.append((d, t, cut[i : i + EDGE_FLUSH], text))
                        count += len(held[-1][2])
                        if count >= EDGE_FLUSH:
                            yield from flush()
                            held.clear()
                            count = 0
                else:
                    out.append((DONE, None, d, t, *_result(text, spans), None, None))
            if out:
                yield _made(out)
        if held:
            yield from flush()

    return rows.mapInArrow(resolve, _MADE)


def late_marks(made: DataFrame, partitions: int) -> DataFrame:
    """doc, tag, marks: strings whose fingerprint has an earlier place, over all tasks."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_rows(x.as_py(), _WINDOW, _WINDOW.names) for batch in batches for x in batch.column(1)]
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        rows = rows[np.lexsort((rows["p"], rows["doc"], rows["g"], rows["f"]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows["f"][1:] != rows["f"][:-1]) | (rows["g"][1:] != rows["g"][:-1])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        again = (rows["doc"] != rows["doc"][lead]) | (rows["p"] != rows["p"][lead])
        out = _window_marks(rows[again])
        for i in range(0, len(out), 20_000):
            doc, tag, marks = zip(*out[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(marks, pa.binary())], names=["doc", "tag", "marks"])

    windows = made.filter(F.col("kind") == WINDOWS).select("part", "body")
    found = windows.repartition(partitions, "part").mapInArrow(settle, "doc long, tag long, marks binary")
    return found.unionByName(made.filter(F.col("kind") == LATE).select("doc", "tag", "marks"))


def finished(rows: DataFrame) -> DataFrame:
    """Results of the documents that waited for late marks."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            doc, body, known, late = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc", "body", "marks", "late"))
            out = [(d, *_result(unpack(raw), _joined([m, *(more or [])]))) for d, raw, m, more in zip(doc, body, known, late)]
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(finish, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def packed_texts(source: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for chunk in chunks(batch.column(1), CHUNK):
                tags = row_tags(chunk)
                raw = [squeeze(chunk.text(i)) for i in range(chunk.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(tags), pa.array(raw, pa.binary())], names=["doc", "tag", "packed"])

    return source.mapInArrow(pack, "doc long, tag long, packed binary")


def substring_removal(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256, one row per row of docs."""
    spark = docs.sparkSession
    source = texts(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), "text"), "doc")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    steps = written(grouped(parsed(source, 8 * width), width), "marks")
    of_kind = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("payload")))
    per_doc = steps.groupBy("doc", "tag").agg(of_kind(MARKS).alias("marks"), of_kind(EDGES).alias("edges"))
    rows = packed_texts(source).join(per_doc.hint("merge"), ["doc", "tag"], "left")
    made = written(resolved(rows, 8 * width), "resolved")
    late = late_marks(made, width).groupBy("doc", "tag").agg(F.collect_list("marks").alias("late"))
    waiting = made.filter(F.col("kind") == PENDING).select("doc", "tag", "body", "marks").join(late.hint("merge"), ["doc", "tag"], "left")
    columns = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    every = made.filter(F.col("kind") == DONE).select(columns).unionByName(finished(waiting))
    return every.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias(key), *columns[1:])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_removal(table(spark, sf_dir, "documents"))
