"""Operator 10, LM scoring: cross-entropy difference between a target and a background model.

Both models are bigram models smoothed by a Dirichlet prior of the unigrams, over the vocabulary of the
corpus: every distinct word and every distinct pair of words is counted for itself, under a 64-bit hash.
The background counts every word of every text, the target those of the documents that the labels call
good. Per token, loss = -ln p; a document's score is its mean target loss minus its mean background
loss, so a lower score means more like the target.

No document is scored by counts of its own: they are taken out of both models first, so a labelled
document scores like an unlabelled one of its kind. Its copies are other documents and stay in.

The models are matched in size: the background's log probabilities are expected values over all ways to
thin the corpus' tokens to the target's number, each token kept with the same probability (`expected_log`).
All documents are counted and none is drawn; a background as large as the corpus would know more words
and pairs than the target for its size alone, and every document would score above 0.

Nothing that grows with the corpus is broadcast or collected. Documents are packed into units of about
UNIT_TOKENS words. A unit asks for its distinct words and pairs, once each and dealt by ranges of their
hashes; whoever holds a range adds up what all units say and answers each unit in the order of its
keys; the answers meet the unit again, which scores its documents. A frequent word or pair costs one
row's share for each unit, however often it occurs.

Defined results: null or empty text has n_tokens 0 and null losses and score; without any target
document both models are uniform and every score is 0; repeated rows score alike, each counted; labels without a
document are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import chunks, mixed
from .shared import table, texts, written
from .vocabulary import pack, pack_sorted, unpack, unpack_sorted

UNIT_TOKENS = 3 << 19
RANGE_TOKENS = 1 << 20
WORDS_SHARE = 8
PRIOR = 100.0
DIRECT = 64.0
START = np.uint64(0)
_ASKED = "unit long, range int, payload binary, counts binary"
_ANSWER = "unit long, range int, counts binary, n_words long"


class Unit:
    """Some documents' words as places in their sorted vocabulary (place 0 is START), and their distinct pairs."""

    def __init__(self, vocabulary: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> None:
        self.vocabulary, self.word = vocabulary, word.astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.before = np.zeros_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[self.bounds[:-1][lengths > 0]] = 0
        size = len(vocabulary)
        pairs, self.pair = np.unique(self.before * size + self.word, return_inverse=True)
        self.pair_before, self.pair_word = pairs // size, pairs % size
        names = mixed(mixed(vocabulary[self.pair_before] + np.uint64(1)) * np.uint64(3) + vocabulary[self.pair_word])
        self.order = np.argsort(names)
        self.pair_keys = names[self.order]

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its occurrences and those as a context, of each pair key its own; target's first, then all."""
        mine = np.repeat(target, np.diff(self.bounds))
        size = len(self.vocabulary)
        words = [np.bincount(x, minlength=size) for x in (self.word[mine], self.word, self.before[mine], self.before)]
        pairs = [np.bincount(x, minlength=len(self.order))[self.order] for x in (self.pair[mine], self.pair)]
        return np.stack(words), np.stack(pairs)

    def losses(self, words: np.ndarray, pairs: np.ndarray, totals: tuple[int, int], n_words: int, target: np.ndarray) -> np.ndarray:
        """Summed loss of each document by both models, from the counts of the whole corpus without the document's own."""
        n_docs, size = len(self.bounds) - 1, len(self.vocabulary)
        lengths = np.diff(self.bounds)
        owner = np.repeat(np.arange(n_docs), lengths)
        entries, mine = np.unique(owner * len(self.order) + self.pair, return_counts=True)
        doc, pair = entries // len(self.order), entries % len(self.order)
        word, before = self.pair_word[pair], self.pair_before[pair]
        own = [(mine, lengths[doc], *(_sums_by(doc * size + x, mine) for x in (word, before)))]
        own.insert(0, tuple(x * target[doc] for x in own[0]))  # a document outside the target has nothing there
        out = np.zeros((2, n_docs))
        for model, (of_pair, of_all, of_word, of_context) in enumerate(own):
            rate = 1.0 if not model else totals[0] / max(totals[1], 1)
            count = np.empty(len(self.order), np.int64)
            count[self.order] = pairs[model]
            single = (rate * (words[model][word] - of_word) + 1.0) / (rate * (totals[model] - of_all) + n_words)
            joint = expected_log(count[pair] - of_pair, rate, PRIOR * single)
            context = expected_log(words[2 + model][before] - of_context, rate, np.full(len(doc), PRIOR))
            out[model] = np.bincount(doc, mine * (context - joint), minlength=n_docs)
        return out


def _sums_by(key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row the sum of the counts of all rows with its key."""
    _, at = np.unique(key, return_inverse=True)
    return np.bincount(at, counts)[at].astype(np.int64)


def expected_log(count: np.ndarray, rate: float, extra: np.ndarray) -> np.ndarray:
    """Mean of ln(X + extra), X binomial: `count` tokens each kept with probability `rate`.

    Summed term by term where the mean of X + extra is under DIRECT; beyond that by moments up to the
    fourth, which leaves an error under 1e-5.
    """
    if rate >= 1.0:
        return np.log(count + extra)
    mean = rate * count
    middle = mean + extra
    spread = mean * (1 - rate)
    third, fourth = spread * (1 - 2 * rate), spread * (1 + 3 * (count - 2) * rate * (1 - rate))
    out = np.log(middle) - spread / (2 * middle**2) + third / (3 * middle**3) - fourth / (4 * middle**4)
    live = np.flatnonzero((middle < DIRECT) & (count > 0) & (rate > 0))
    if not len(live):
        return out
    n, a = count[live].astype(np.float64), extra[live]
    log_p, odds = n * np.log1p(-rate), np.log(rate) - np.log1p(-rate)
    total, k = np.exp(log_p) * np.log(a), 0
    left = np.arange(len(live))
    while True:
        left = left[(n[left] > k) & (k < rate * n[left] + 10 * np.sqrt(rate * n[left]) + 20)]
        if not len(left):
            break
        log_p[left] += np.log((n[left] - k) / (k + 1)) + odds
        k += 1
        total[left] += np.exp(log_p[left]) * np.log(k + a[left])
    out[live] = total
    return out


def units(docs: DataFrame, key: str) -> DataFrame:
    """The units of (key, is_target, text) rows; a text is never cut."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        made = 0

        def unit() -> pa.RecordBatch:
            names = pa.concat_arrays([h[0] for h in held])
            target, lengths, hashes = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            vocabulary, word = np.unique(np.append(hashes, START), return_inverse=True)
            arrays = [
                pa.array([first + made]), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([len(hashes)]), pa.array([int(lengths[target].sum())]),
                *(pa.array([x], pa.binary()) for x in (pack(target), pack(lengths), pack_sorted(vocabulary), pack(word[:-1].astype(np.uint32)))),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["unit", "names", "n_tokens", "n_target", "target", "lengths", "vocabulary", "words"])

        for batch in batches:
            wanted = np.array(batch.column(1)).astype(bool)
            for chunk in chunks(batch.column(2)):
                low = chunk.lower
                rows = slice(chunk.first, chunk.first + chunk.n)
                held.append((batch.column(0)[rows], wanted[rows], np.diff(low.words[2]).astype(np.int64), low.word_hashes))
                if sum(len(h[3]) for h in held) >= UNIT_TOKENS:
                    yield unit()
                    held, made = [], made + 1
        if held:
            yield unit()

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(build, f"unit long, names array<{kind}>, n_tokens long, n_target long, target binary, lengths binary, vocabulary binary, words binary")


def opened(row: dict) -> Unit:
    return Unit(unpack_sorted(row["vocabulary"]), unpack(row["words"], np.uint32), unpack(row["lengths"], np.int64))


def asked(found: DataFrame, ranges: int) -> DataFrame:
    """Keys and counts of every unit, dealt by ranges of the keys: pairs from 0 up, words from -1 down."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                unit = opened(row)
                words, pairs = unit.counts(unpack(row["target"], bool))
                out: list[tuple[int, bytes, bytes]] = []
                for keys, counts, parts, sign in ((unit.pair_keys, pairs, ranges, 1), (unit.vocabulary, words, -(-ranges // WORDS_SHARE), -1)):
                    cuts = np.searchsorted(keys, np.array([(i << 64) // parts for i in range(parts)], np.uint64)).tolist() + [len(keys)]
                    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        if a < b:
                            out.append((i if sign > 0 else -1 - i, pack_sorted(keys[a:b]), pack(counts[:, a:b].ravel())))
                place, payload, counts = zip(*out)
                arrays = [pa.array([row["unit"]] * len(out)), pa.array(place, pa.int32()), pa.array(payload, pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["unit", "range", "payload", "counts"])

    return found.select("unit", "target", "lengths", "vocabulary", "words").mapInArrow(ask, _ASKED)


def answer(asking: pa.Table) -> pa.Table:
    """The sums over all units of one range's counts, for each unit in the order of its keys; n_words stands once."""
    place = asking.column("range")[0].as_py()
    keys = [unpack_sorted(x.as_py()) for x in asking.column("payload")]
    sizes = [len(k) for k in keys]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unpack(x.as_py(), np.int64).reshape(-1, n) for x, n in zip(asking.column("counts"), sizes)], axis=1)
    sums = [np.bincount(at, row, minlength=len(distinct)).astype(np.int64) for row in counts]
    whole = np.stack([s[at] for s in sums])
    parts = np.split(whole, np.cumsum(sizes)[:-1], axis=1)
    n_words = int((sums[1] > 0).sum()) if place < 0 else 0
    return pa.table({
        "unit": asking.column("unit"), "range": asking.column("range"), "counts": pa.array([pack(p.ravel()) for p in parts], pa.binary()),
        "n_words": pa.array([n_words, *[0] * (len(sizes) - 1)], pa.int64()),
    })


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Key, n_tokens, target_loss, background_loss and score, one row per row of docs."""
    spark = docs.sparkSession
    good = labels.filter(F.col(label) == 1).select(F.col(key).alias("_good")).distinct()
    source = texts(docs, key)
    # the labels grow with the documents, so the join is never a broadcast
    marked = source.join(good.hint("merge"), F.col(key) == F.col("_good"), "left").select(key, F.col("_good").isNotNull().alias("is_target"), "text")
    found = written(units(marked, key), "units")
    total, target_total = (x or 0 for x in found.agg(F.sum("n_tokens"), F.sum("n_target")).first())
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_TOKENS))
    answers = written(asked(found, ranges).groupBy("range").applyInArrow(answer, _ANSWER), "answers")
    n_words = answers.agg(F.sum("n_words")).first()[0] or 0
    kind = source.schema[0].dataType.simpleString()

    def score(asking: pa.Table, told: pa.Table) -> pa.Table:
        outs = []
        by_place = dict(zip(told.column("range").to_pylist(), told.column("counts").to_pylist()))
        for at in range(asking.num_rows):
            row = asking.slice(at, 1)
            raw = row.drop_columns(["names"]).to_pylist()[0]
            unit, unit_target = opened(raw), unpack(raw["target"], bool)
            words, pairs = (
                np.concatenate([np.zeros((width, 0), np.int64), *(unpack(by_place[i], np.int64).reshape(width, -1) for i in places)], axis=1)
                for width, places in ((4, sorted((i for i in by_place if i < 0), reverse=True)), (2, sorted(i for i in by_place if i >= 0)))
            )
            n = np.diff(unit.bounds)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = unit.losses(words, pairs, (target_total, total), n_words, unit_target) / n
            names = row.column("names").combine_chunks().flatten()
            outs.append(pa.table([names, pa.array(n), *(pa.array(m, mask=n == 0) for m in mean)], names=[key, "n_tokens", "target_loss", "background_loss"]))
        return pa.concat_tables(outs)

    schema = f"`{key}` {kind}, n_tokens long, target_loss double, background_loss double"
    scored = found.select("unit", "names", "target", "lengths", "vocabulary", "words").groupBy("unit").cogroup(answers.select("unit", "range", "counts").groupBy("unit")).applyInArrow(score, schema)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
