"""Operator 9, quality classifier: random-indexing word vectors and a two-layer numpy network.

Tokens are runs of letters, digits and non-ASCII characters, or runs of other marks. Spark counts them
over all texts; each of the WORDS most frequent has a vector of its own, and the others, which are too
rare for one, share TAIL vectors by their hashes. Every vector has a fixed ternary index vector. Random
indexing adds to a word's context vector the index vectors of its neighbours up to WINDOW places away,
over all texts (dense_sum, integers, so the sums don't depend on task order). A document is the mean of
its tokens' scaled context vectors. A hidden layer of tanh units and a sigmoid are fitted on the driver
by full batch Adam on a bounded sample of labelled rows (MAX_FIT_ROWS, those with the smallest hash, then
the smallest key), and a temperature is fitted on a part of that sample that the network hasn't seen.

Defined results: null or empty text is the zero vector and still gets a score; a text of any length is
pooled whole; a label whose document is missing is ignored, of several labels of one document the
greatest counts; without any usable label, or with one class only, the score is that class' share (0.5
without labels); repeated rows score alike; a score of exactly 0.5 predicts 1; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Chunk, chunks, mixed, span_hash
from .shared import dense_sum, table, texts, written
from .vocabulary import places, vocabulary

WORDS = 1 << 14
TAIL = 1 << 11
WINDOW = 2
DIMS = 32
NONZERO = 4
MAX_FIT_ROWS = 20_000
HIDDEN = 24
STEPS = 400

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _KIND[_low:_high] = 1


def index_vectors(size: int, dims: int = DIMS) -> np.ndarray:
    """A sparse ternary vector for each place, from hashes alone."""
    out = np.zeros((size, dims), np.int8)
    rows = np.arange(size, dtype=np.uint64)
    for k in range(NONZERO):
        draw = mixed(rows * np.uint64(8) + np.uint64(k + 1))
        out[np.arange(size), (draw % np.uint64(dims)).astype(int)] = np.where(draw >> np.uint64(63), 1, -1)
    return out


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens in order, and the documents' bounds in them."""
    low = chunk.lower
    kind = _KIND[low.data]
    size = len(kind)
    edge = np.ones(size + 1, bool)
    edge[1:size] = kind[1:] != kind[:-1]
    edge[chunk.offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = kind[starts] > 0 if size else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    return mixed(span_hash(low.prefix, starts, ends) + (ends - starts).astype(np.uint64)), np.searchsorted(starts, chunk.offsets)


def placed(chunk: Chunk, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens' vectors: the vocabulary's in its order, then the tail's."""
    hashes, bounds = tokens(chunk)
    at = places(known, hashes)
    return np.where(at < len(known), at, len(known) + (hashes % np.uint64(TAIL)).astype(np.int64)), bounds


def context_sums(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """For each vector the sum of its neighbours' index vectors."""
    size = len(known) + TAIL
    index = index_vectors(size)
    shared = docs.sparkSession.sparkContext.broadcast((known, index))

    def update(batch: pa.RecordBatch, total: np.ndarray) -> None:
        words, fixed = shared.value
        grid = total.reshape(size, DIMS)
        for chunk in chunks(batch.column(0), 1 << 20):
            place, bounds = placed(chunk, words)
            n = len(place)
            if not n:
                continue
            doc = np.repeat(np.arange(chunk.n), np.diff(bounds))
            own = fixed[place]
            around = np.zeros((n, DIMS), np.int8)
            for far in range(1, WINDOW + 1):
                same = (doc[far:] == doc[:-far])[:, None]
                around[far:] += own[:-far] * same
                around[:-far] += own[far:] * same
            order = np.argsort(place, kind="stable")
            ranked = place[order]
            heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            grid[ranked[heads]] += np.add.reduceat(around[order], heads, axis=0, dtype=np.int64)

    return dense_sum(texts(docs), size * DIMS, update).reshape(size, DIMS)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors of unit length; one without neighbours is zero."""
    vectors = sums.astype(np.float64)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, known: np.ndarray, vectors: np.ndarray, *keys: str) -> DataFrame:
    """The key columns and the mean word vector of each document."""
    shared = docs.sparkSession.sparkContext.broadcast((known, vectors))  # WORDS + TAIL vectors at most
    source = texts(docs, *keys)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "vector array<float>"])

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = shared.value
        for batch in batches:
            out = [np.zeros((0, DIMS), np.float32)]
            for chunk in chunks(batch.column(batch.num_columns - 1), 1 << 20):
                place, bounds = placed(chunk, words)
                counts = np.diff(bounds)
                mean = np.zeros((chunk.n, DIMS), np.float32)
                live = counts > 0
                if live.any():
                    sums = np.add.reduceat(vectors[place], bounds[:-1][live], axis=0, dtype=np.float64)
                    mean[live] = sums / counts[live, None]
                out.append(mean)
            grid = np.concatenate(out)
            flat = pa.array(grid.ravel())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, grid.size + 1, DIMS, dtype=np.int32)), flat)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, rows], names=[*batch.schema.names[:-1], "vector"])

    return source.mapInArrow(pool, schema)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, decay: float = 1e-3) -> Network:
    """Full-batch Adam on cross entropy with class weights removed; deterministic."""
    dims = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    if len(y) < 2 or y.min() == y.max():
        return Network(np.zeros(dims), np.ones(dims), np.zeros((dims, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    draw = np.random.default_rng(7)
    net = Network(x.mean(0), x.std(0) + 1e-6, draw.normal(0, dims**-0.5, (dims, hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), float(np.log(share / (1 - share))))
    fit_rows = np.arange(len(y)) % 5 != 0 if len(y) >= 50 else np.ones(len(y), bool)
    z, t = ((x - net.mean) / net.scale)[fit_rows], y[fit_rows].astype(float)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        h = np.tanh(z @ params[0] + params[1])
        g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -40, 40))) - t) / len(t)
        back = np.outer(g, params[2]) * (1 - h * h)
        grads = [z.T @ back + decay * params[0] / len(t) ** 0.5, back.sum(0), h.T @ g + decay * params[2] / len(t) ** 0.5, np.array([g.sum()])]
        for p, grad, m, v in zip(params, grads, first, second):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if not fit_rows.all():
        held, target = net.logits(x[~fit_rows]), y[~fit_rows]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(target == 1, -1, 1) * held / g).mean() for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_sample(vectors: DataFrame, labels: DataFrame, key: str, label: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `limit` labelled vectors that aren't held out: those with the smallest hash of their key."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max(label).alias("_label"))
    rows = vectors.join(usable, key).orderBy(F.xxhash64(key), key).limit(limit).select("vector", "_label").toArrow()
    if not rows.num_rows:
        return np.zeros((0, DIMS)), np.zeros(0)
    x = np.array(rows.column(0).combine_chunks().flatten()).reshape(rows.num_rows, -1).astype(np.float64)
    return x, np.array(rows.column(1)).astype(int)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", limit: int = MAX_FIT_ROWS) -> DataFrame:
    """Key, held_out, score and predicted, one row per row of docs."""
    known, _ = vocabulary(docs, WORDS, tokens)
    vectors = written(pooled(docs, known, word_vectors(context_sums(docs, known)), key), "vectors")
    net = train(*fit_sample(vectors, labels, key, label, limit))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = vectors.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1).astype(np.float64)
            score = shared.value.scores(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=[key, "score"])

    scored = vectors.select(key, "vector").mapInArrow(apply, f"`{key}` {kind}, score double")
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
