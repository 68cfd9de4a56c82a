"""Operator 4, token-ID output: documents as token ids in rANS-coded blocks, and back.

Documents are encoded by the tokenizers library, get an end id, are dealt into shards by ranges of
doc_id and written in ascending order. A shard is a sequence of blocks of about BLOCK_TOKENS ids
(a document never spans blocks). A block is coded by a static range asymmetric numeral system:
LANES interleaved 64-bit states share one word stream and one corpus-wide frequency table; every
CHECKPOINT_STEPS steps the decoder's states and its place in the stream are kept, so that parts of a
block decode independently; the ids and the payload each carry a CRC-32. The container is Parquet
(committed by Spark, so lost tasks leave no partial files), one row per block.

The ids come from the library alone. A text is a sequence of units: blanks and a word, the word cut
where marks follow a Latin letter (an apostrophe apart). The pre-tokenizer never joins characters
across units, so each distinct short unit is encoded once per worker and looked up by hash after
that. Texts with blanks outside ASCII are encoded whole.

Ids take 16 bits on the way where the vocabulary allows it, else 32; a vocabulary may hold at most
2**SCALE_BITS ids that occur. The number of shards follows from the counted ids.

Defined results: null text is empty and yields the end id alone; a text of any length is one document
of one block; repeated doc_ids are kept, ordered by their ids' bytes; doc_ids may have any type that can be
ordered; a null doc_id sorts first; an empty table writes an empty file; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Chunk, chunks, mixed, span_hash
from .shared import dense_sum, fresh_path, table, texts, written

END_ID = 0
SCALE_BITS = 18
LANES = 1024
CHECKPOINT_STEPS = 128
BLOCK_TOKENS = 1 << 18
SHARD_TOKENS = 1 << 26
CACHE_UNITS = 3_000_000
LONGEST_UNIT = 64
ENCODE_BYTES = 1 << 20
LOW = np.uint64(1 << 31)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)) if c != 0x27]] = True


def _odd_blanks(chunk: Chunk) -> np.ndarray:
    """Which texts hold a blank that isn't one of ASCII's six (or might)."""
    d = chunk.data
    a = np.concatenate([d, np.zeros(2, np.uint8)])
    one, two = a[1:-1], a[2:]
    odd = (d >= 0x1C) & (d <= 0x1F)
    odd |= (d == 0xC2) & ((one == 0x85) | (one == 0xA0))
    odd |= (d == 0xE1) & ((one == 0x9A) | (one == 0xA0))
    odd |= (d == 0xE2) & (one == 0x80) & ((two <= 0x8B) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
    odd |= (d == 0xE2) & (one == 0x81)
    odd |= (d == 0xE3) & (one == 0x80) | (d == 0xEF) & (one == 0xBB)
    hits = np.concatenate([[0], np.cumsum(odd)])
    return hits[chunk.offsets[1:]] > hits[chunk.offsets[:-1]]


def _mark_cuts(chunk: Chunk) -> np.ndarray:
    """Places where marks follow a Latin letter: a border of the pre-tokenizer whatever comes next."""
    d = chunk.data
    if len(d) < 2:
        return np.zeros(0, np.int64)
    letter = _LETTER[d]
    letter[1:] |= (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] != 0x97) & (d[1:] != 0xB7)
    border = letter[:-1] & _MARK[d[1:]]
    inner = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < len(d))]
    border[inner - 1] = False
    return np.flatnonzero(border) + 1


class Encoder:
    """The library's ids for many texts, each distinct short unit encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.lengths = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token)  # a byte-level token has one character for each byte
        self.clear()

    def clear(self) -> None:
        self.old = self.new = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0
        self.starts, self.counts, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0

    def find(self, values: np.ndarray) -> np.ndarray:
        """Slots of unit hashes, -1 where unknown, from two sorted arrays, a large and a recent one."""
        out = np.full(len(values), -1, np.int64)
        for keys, slots in (self.old, self.new):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                out = np.where(keys[at] == values, slots[at], out)
        return out

    def remember(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        def union(a: tuple, b: tuple) -> tuple:
            keys, values = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
            order = np.argsort(keys, kind="stable")
            return keys[order], values[order]

        self.new = union(self.new, (hashes, slots.astype(np.int32)))
        if len(self.new[0]) > 20_000 + len(self.old[0]) // 8:
            self.old, self.new = union(self.old, self.new), (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.kind)

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Encode units: those of blanks and a word in one go, as their joint text has just these units."""
        plain = [i for i, u in enumerate(units) if u[0] in b" \t\n\v\f\r" and u[-1] not in b" \t\n\v\f\r"]
        rest = sorted({*range(len(units))} - {*plain})
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        if plain:
            ids = self.whole(b"".join(units[i] for i in plain))
            ends = np.cumsum(self.lengths[ids])
            cuts = np.cumsum([len(units[i]) for i in plain])
            at = np.searchsorted(ends, cuts)
            if len(ends) and ends[-1] == cuts[-1] and (ends[at] == cuts).all():
                parts, sizes = [ids], [np.diff(at, prepend=-1)]
            else:
                plain, rest = [], list(range(len(units)))
        for i in rest:
            parts.append(self.whole(units[i]))
            sizes.append(np.array([len(parts[-1])]))
        counts = np.concatenate(sizes).astype(np.int64)
        hashes = hashes[[*plain, *rest]]
        need, more = int(counts.sum()), len(counts)
        while self.used + need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + more > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.pool[self.used : self.used + need] = np.concatenate(parts)
        self.starts[self.n : self.n + more] = self.used + np.cumsum(counts) - counts
        self.counts[self.n : self.n + more] = counts
        self.remember(hashes, np.arange(self.n, self.n + more))
        self.used, self.n = self.used + need, self.n + more

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the chunk, each followed by the end id, and the texts' bounds in them."""
        if self.n > CACHE_UNITS:
            self.clear()
        _, ends, bounds = chunk.words
        counts = np.diff(bounds)
        last = chunk.offsets[:-1].copy()
        last[counts > 0] = ends[bounds[1:][counts > 0] - 1]
        tails = np.flatnonzero(last < chunk.offsets[1:])
        stops = np.sort(np.concatenate([ends, chunk.offsets[1:][tails], _mark_cuts(chunk)]))
        owner = np.searchsorted(chunk.offsets[1:], stops)
        unit_bounds = np.searchsorted(owner, np.arange(chunk.n + 1))
        begins = np.empty_like(stops)
        begins[1:] = stops[:-1]
        begins[unit_bounds[:-1][np.diff(unit_bounds) > 0]] = chunk.offsets[:-1][np.diff(unit_bounds) > 0]
        sizes = stops - begins
        odd = _odd_blanks(chunk)
        long = np.zeros(chunk.n, bool)
        long[owner[sizes > LONGEST_UNIT]] = True
        direct = odd | long
        fast = ~direct[owner] if len(owner) else np.zeros(0, bool)
        keys = mixed(span_hash(chunk.prefix, begins[fast], stops[fast]) + sizes[fast].astype(np.uint64))
        values, firsts, back = np.unique(keys, return_index=True, return_inverse=True)
        index = self.find(values)
        new = np.flatnonzero(index < 0)
        if len(new):
            raw = chunk.data.tobytes()
            at = np.flatnonzero(fast)[firsts[new]]
            self._learn(values[new], [raw[a:b] for a, b in zip(begins[at].tolist(), stops[at].tolist())])
            index[new] = self.find(values[new])
        slot = index[back]
        lens = np.zeros(len(stops), np.int64)
        lens[fast] = self.counts[slot]
        per_doc = np.bincount(owner, lens, minlength=chunk.n).astype(np.int64)
        special = {int(i): self.whole(chunk.text(i)) for i in np.flatnonzero(direct)}
        for i, ids in special.items():
            per_doc[i] = len(ids)
        out_bounds = np.concatenate([[0], np.cumsum(per_doc + 1)])
        out = np.full(out_bounds[-1], END_ID, self.kind)
        n = self.counts[slot].astype(np.int64)
        skipped = np.cumsum(n) - n
        source = np.arange(n.sum()) - np.repeat(skipped - self.starts[slot], n)
        fast_bounds = np.concatenate([[0], np.cumsum(np.where(direct, 0, per_doc))])
        spread = np.repeat(np.where(direct, 0, out_bounds[:-1] - fast_bounds[:-1]), np.where(direct, 0, per_doc))
        out[np.arange(len(source)) + spread] = self.pool[source]
        for i, ids in special.items():
            out[out_bounds[i] : out_bounds[i] + len(ids)] = ids
        return out, out_bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """Key, n_tokens and ids (little-endian, 16 bits for vocabularies up to 2**16, else 32; end id included)."""
    source = texts(docs, key)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            for chunk in chunks(batch.column(1), ENCODE_BYTES):
                ids, bounds = tool.encode(chunk)
                raw = pa.Array.from_buffers(pa.binary(), chunk.n, [None, pa.py_buffer((tool.kind.itemsize * bounds).astype(np.int32)), pa.py_buffer(ids.astype(tool.kind.newbyteorder("<")))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(np.diff(bounds)), raw], names=[key, "n_tokens", "ids"])

    return source.mapInArrow(encode, f"`{key}` {source.schema[0].dataType.simpleString()}, n_tokens long, ids binary")


def id_kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    kind = id_kind(size)

    def update(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for chunk in chunks(batch.column(0)):
            total += np.bincount(chunk.data.view(kind), minlength=size)

    return dense_sum(ids.select("ids"), size, update)


@dataclass
class Frequencies:
    """Frequencies that sum to 2**SCALE_BITS, their running sums, and the id of each slot."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        self.freq = self.freq.astype(np.uint64)
        self.first = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(len(self.freq), dtype=id_kind(len(self.freq))), self.freq.astype(np.int64))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Whole frequencies for all ids that occur (and the end id), by largest need, summing to 2**SCALE_BITS."""
    counts = counts.astype(np.float64)
    counts[END_ID] = max(counts[END_ID], 1)
    seen = counts > 0
    room = (1 << SCALE_BITS) - int(seen.sum())
    freq = np.where(seen, 1 + np.floor(counts / counts.sum() * room), 0).astype(np.int64)
    freq[int(np.argmax(freq))] += (1 << SCALE_BITS) - int(freq.sum())
    return freq


def pack(ids: np.ndarray, table: Frequencies) -> dict:
    """One block: word stream, and the decoder's states and places at its start and at each checkpoint."""
    steps = max(1, -(-len(ids) // LANES))
    grid = np.full(steps * LANES, END_ID, ids.dtype)
    grid[: len(ids)] = ids
    grid = grid.reshape(steps, LANES)
    state = np.full(LANES, LOW, np.uint64)
    shift, limit_shift, half = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS), np.uint64(32)
    words: list[np.ndarray] = []
    states, places, total = [], [], 0
    for step in range(steps - 1, -1, -1):
        f, c = table.freq[grid[step]], table.first[grid[step]]
        full = state >= f << limit_shift
        if full.any():
            words.append(state[full].astype(np.uint32))
            state[full] >>= half
            total += len(words[-1])
        high = state // f
        state = (high << shift) + (state - high * f) + c
        if step % CHECKPOINT_STEPS == 0:
            states.append(state.copy())
            places.append(total)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    body = stream.astype("<u4").tobytes()
    return {
        "n_tokens": len(ids),
        "states": np.concatenate(states[::-1]).astype("<u8").tobytes(),
        "places": [total - p for p in places[::-1]],
        "stream": body,
        "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
        "payload_crc32": zlib.crc32(body),
    }


def unpack(n_tokens: int, states: bytes, places: list[int], stream: bytes, table: Frequencies, part: int | None = None) -> np.ndarray:
    """Ids of a block, or of the part that starts at one checkpoint."""
    words = np.frombuffer(stream, "<u4").astype(np.uint64)
    heads = np.frombuffer(states, "<u8").reshape(-1, LANES)
    steps = max(1, -(-n_tokens // LANES))
    mask, shift, half = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    out = []
    for k in range(len(heads)) if part is None else [part]:
        state, place = heads[k].copy(), places[k]
        for _ in range(k * CHECKPOINT_STEPS, min(steps, (k + 1) * CHECKPOINT_STEPS)):
            slot = state & mask
            ids = table.slots[slot]
            state = table.freq[ids] * (state >> shift) + slot - table.first[ids]
            low = state < LOW
            n = int(low.sum())
            if n:
                state[low] = (state[low] << half) | words[place : place + n]
                place += n
            out.append(ids)
    ids = np.concatenate(out)
    first = 0 if part is None else part * CHECKPOINT_STEPS * LANES
    return ids[: max(0, min(n_tokens - first, len(ids)))]


_FILE = "shard int, block int, start long, n_tokens long, doc_ids array<{}>, lengths array<long>, states binary, places array<long>, stream binary, ids_crc32 long, payload_crc32 long"


def write_token_file(ids: DataFrame, frequencies: Frequencies, path: str, key: str = "doc_id") -> None:
    """Write the ids' blocks in ascending order of key, one shard for each range of keys."""
    shared = ids.sparkSession.sparkContext.broadcast(frequencies)
    wide = id_kind(len(frequencies.freq))
    file = _FILE.format(ids.schema[key].dataType.simpleString())

    def row(shard: int, block: int, start: int, keys: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        made = pack(np.concatenate(parts), shared.value)
        fields = {"shard": shard, "block": block, "start": start, "n_tokens": made["n_tokens"], "doc_ids": keys, "lengths": [len(p) for p in parts]} | {k: made[k] for k in ("states", "places", "stream", "ids_crc32", "payload_crc32")}
        kinds = {"shard": pa.int32(), "block": pa.int32(), "lengths": pa.list_(pa.int64()), "states": pa.binary(), "places": pa.list_(pa.int64()), "stream": pa.binary()}
        fields["doc_ids"] = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.concat_arrays(keys))
        return pa.RecordBatch.from_arrays([v if k == "doc_ids" else pa.array([v], kinds.get(k, pa.int64())) for k, v in fields.items()], names=list(fields))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, start, keys, parts, held = TaskContext.get().partitionId(), 0, 0, [], [], 0
        for batch in batches:
            for at, raw in enumerate(batch.column(1)):
                piece = np.frombuffer(raw.as_buffer(), wide)
                keys.append(batch.column(0).slice(at, 1))
                parts.append(piece.copy())
                held += len(piece)
                if held >= BLOCK_TOKENS:
                    yield row(shard, block, start, keys, parts)
                    block, start, keys, parts, held = block + 1, start + held, [], [], 0
        if parts:
            yield row(shard, block, start, keys, parts)

    total = ids.agg(F.sum("n_tokens")).first()[0] or 0
    width = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_TOKENS))
    ordered = ids.repartitionByRange(width, key, "n_tokens").sortWithinPartitions(key, "ids").select(key, "ids")
    ordered.mapInArrow(encode, file).write.parquet(f"{path}/blocks")
    ids.sparkSession.createDataFrame([(i, int(f)) for i, f in enumerate(frequencies.freq) if f], "id int, freq long").coalesce(1).write.parquet(f"{path}/frequencies")


def read_token_file(spark: SparkSession, path: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """Key, start, n_tokens and ids (32-bit little-endian) of each document, decoded from the file.

    With digest, ids_crc32 (of those bytes) instead of the ids.
    """
    rows = spark.read.parquet(f"{path}/frequencies").collect()  # at most one row for each id of the vocabulary
    freq = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    freq[[r.id for r in rows]] = [r.freq for r in rows]
    shared = spark.sparkContext.broadcast(Frequencies(freq))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # one row for each shard
    ends = np.cumsum([r.n for r in sizes])
    before = {r.shard: int(end - r.n) for r, end in zip(sizes, ends)}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_ids"))
            for at, r in enumerate(batch.drop_columns(["doc_ids"]).to_pylist()):
                if zlib.crc32(r["stream"]) != r["payload_crc32"]:
                    raise ValueError(f"shard {r['shard']}, block {r['block']}: the stream's checksum differs")
                ids = unpack(r["n_tokens"], r["states"], r["places"], r["stream"], shared.value)
                if zlib.crc32(ids.astype("<u4").tobytes()) != r["ids_crc32"]:
                    raise ValueError(f"shard {r['shard']}, block {r['block']}: the ids' checksum differs")
                bounds = np.concatenate([[0], np.cumsum(r["lengths"])])
                wide = ids.astype("<u4")
                if digest:
                    last = pa.array([zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())
                else:
                    last = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(wide)])
                yield pa.RecordBatch.from_arrays(
                    [names.slice(at, 1).flatten(), pa.array(before[r["shard"]] + r["start"] + bounds[:-1]), pa.array(np.diff(bounds)), last],
                    names=[key, "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return blocks.mapInArrow(decode, f"`{key}` {kind}, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def token_round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", path: str | None = None, digest: bool = False) -> DataFrame:
    """Encode docs, write the token file, and return what is read back from it."""
    spark = docs.sparkSession
    ids = written(tokenized(docs, tokenizer, key), "ids")
    path = path or fresh_path(spark, "tokens")
    write_token_file(ids, Frequencies(scaled(id_counts(ids, encoder(tokenizer).size))), path, key)
    return read_token_file(spark, path, key, digest)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)
