"""Operator 1, best-fit packing into bins of several permitted sequence lengths.

Best-fit decreasing needs only how many pieces there are of each length, and a length is at most the
largest permitted one. So Spark counts lengths, the driver packs the histogram (bins in the same
state form one group, whatever their number) and gets runs: pieces of length L with ranks
[first, end) go to consecutive bins, k to each. Spark then ranks the pieces of each length in two
levels, (length, salt) groups and a running sum over salts, so a hot length is never one task's
work, and looks each rank up in the runs. The result equals best-fit decreasing over all pieces.

When no open bin holds a piece, the least-cost permitted length that a policy allows is opened; each
policy (smallest length to open, room left for others) is tried on the histogram and the cheapest
total after downsizing wins. Last, each bin is downsized to the least permitted length that holds
its contents. The cost of a bin of c tokens is c + c * c / `attention`.

The number of salts follows the number of pieces. Which length function counts the tokens is the
caller's; the query counts words.

Defined results: null or empty text is one piece with the end token alone; a text beyond the largest
permitted length is cut into pieces, all but the last of that length; repeated rows are pieces of
their own; pieces of equal length are ranked by salt, key and piece, so ties fall alike in every run;
a null doc_id is packed like any other; an empty table gives an empty result; columns that aren't keys
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free_name, local_rows, table, written

LENGTHS = (512, 1024, 2048, 4096)
ATTENTION = 16_384.0
SALTS = 256
SALT_ROWS = 1_000_000
BROADCAST_RUNS = 500_000


def word_tokens(text: str = "text") -> Column:
    """Tokens of a text where a word is a token: its words, and an end token."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


@dataclass
class Group:
    """`count` bins, numbered from `first`, opened at `size`, each holding `used` tokens."""

    first: int
    count: int
    size: int
    used: int


@dataclass
class Run:
    """Pieces of `length` ranked start..end - 1: `per_bin` to each of the bins from `bin` on, at `offset`."""

    length: int
    start: int
    end: int
    bin: int
    per_bin: int
    offset: int


def bin_cost(size: int, attention: float = ATTENTION) -> float:
    return size + size * size / attention


def best_fit(histogram: dict[int, int], lengths: Sequence[int], smallest: int, room: int, attention: float = ATTENTION) -> tuple[list[Run], list[Group]]:
    """Best-fit decreasing over a histogram; new bins by one policy."""
    open_by_rest: dict[int, list[Group]] = {}
    rests: list[int] = []
    closed: list[Group] = []
    runs: list[Run] = []
    bins = 0

    def put(group: Group) -> None:
        rest = group.size - group.used
        if group.count and rest:
            if rest not in open_by_rest:
                open_by_rest[rest] = []
                insort(rests, rest)
            open_by_rest[rest].append(group)
        elif group.count:
            closed.append(group)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rests, length)
            if at < len(rests):
                rest = rests[at]
                group = open_by_rest[rest].pop()
                if not open_by_rest[rest]:
                    del open_by_rest[rest], rests[at]
            else:
                allowed = [s for s in lengths if s >= max(length, min(smallest, lengths[-1]), min(room * length, lengths[-1]))]
                size = min(allowed, key=lambda s: (bin_cost(s, attention), s))
                per_bin = size // length
                group = Group(bins, -(-left // per_bin), size, 0)
                bins += group.count
            per_bin = (group.size - group.used) // length
            full = min(group.count, left // per_bin)
            if full:
                runs.append(Run(length, rank, rank + full * per_bin, group.first, per_bin, group.used))
                put(Group(group.first, full, group.size, group.used + per_bin * length))
                rank, left = rank + full * per_bin, left - full * per_bin
            some = int(full < group.count and left > 0)
            if some:
                runs.append(Run(length, rank, rank + left, group.first + full, per_bin, group.used))
                put(Group(group.first + full, 1, group.size, group.used + left * length))
                rank, left = rank + left, 0
            put(Group(group.first + full + some, group.count - full - some, group.size, group.used))
    return runs, sorted([*closed, *(g for gs in open_by_rest.values() for g in gs)], key=lambda g: g.first)


def downsized(group: Group, lengths: Sequence[int]) -> int:
    return next(s for s in lengths if s >= group.used)


def plan(histogram: dict[int, int], lengths: Sequence[int] = LENGTHS, attention: float = ATTENTION) -> tuple[list[tuple[Run, int, int, int]], list[Group]]:
    """The cheapest policy's runs, cut where the final length of the bins changes: (run, from rank, to rank, bin length)."""
    lengths = sorted(lengths)
    found = (best_fit(histogram, lengths, smallest, room, attention) for smallest in lengths for room in (1, 2, 4))
    runs, groups = min(found, key=lambda x: sum(g.count * bin_cost(downsized(g, lengths), attention) for g in x[1]))
    firsts = [g.first for g in groups]
    out = []
    for run in runs:
        last_bin = run.bin + (run.end - 1 - run.start) // run.per_bin
        k = bisect_left(firsts, run.bin + 1) - 1
        while k < len(groups) and groups[k].first <= last_bin:
            low = max(run.bin, groups[k].first)
            high = min(last_bin + 1, groups[k].first + groups[k].count)
            start = run.start + (low - run.bin) * run.per_bin
            end = min(run.end, run.start + (high - run.bin) * run.per_bin)
            out.append((run, start, end, downsized(groups[k], lengths)))
            k += 1
    return out, groups


def pieces(docs: DataFrame, length: Column, largest: int, *keys: str) -> DataFrame:
    """Key columns (as _k0, _k1, ...), piece, first_token and n_tokens: texts cut at the largest permitted length."""
    own = [f"_k{i}" for i in range(len(keys))]
    n = docs.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), length.cast("long").alias("_n"))
    cut = n.select(*own, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / largest), F.lit(1)).cast("long") - 1)).alias("piece"))
    start = F.col("piece") * largest
    return cut.select(*own, "piece", start.alias("first_token"), F.least(F.col("_n") - start, F.lit(largest).cast("long")).alias("n_tokens"))


def packed(docs: DataFrame, length: Column, *keys: str, lengths: Sequence[int] = LENGTHS, attention: float = ATTENTION) -> DataFrame:
    """Key columns, piece, first_token, n_tokens, bin_id, bin_offset and bin_length of every piece.

    Where a key has the name of one of these, that one gets the next free name: piece_1 and so on.
    """
    spark = docs.sparkSession
    items = written(pieces(docs, length, max(lengths), *keys), "pieces")
    own = items.columns[: len(keys)]
    salts = max(SALTS, -(-items.count() // SALT_ROWS))
    items = items.withColumn("_salt", F.pmod(F.xxhash64(*own, "piece"), F.lit(salts)).cast("int"))
    counts = items.groupBy("n_tokens", "_salt").agg(F.count(F.lit(1)).alias("_count"))
    histogram = {r.n_tokens: r.n for r in counts.groupBy("n_tokens").agg(F.sum("_count").alias("n")).collect()}  # at most max(lengths) rows
    runs, _ = plan(histogram, lengths, attention)
    rows = [(r.length, a, b, r.start, r.bin, r.per_bin, r.offset, size) for r, a, b, size in runs]
    lookup = local_rows(spark, rows, "_length long, _from long, _to long, _start long, _bin long, _per long, _offset long, bin_length int")
    if len(rows) <= BROADCAST_RUNS:
        lookup = F.broadcast(lookup)
    running = Window.partitionBy("n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("n_tokens", "_salt", F.coalesce(F.sum("_count").over(running), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("n_tokens", "_salt").orderBy(*own, "piece")
    ranked = items.withColumn("_rank", F.row_number().over(inner) - 1).join(base, ["n_tokens", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    place = ranked.join(lookup, (F.col("n_tokens") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    step = F.col("_rank") - F.col("_start")
    made = {
        "piece": F.col("piece"), "first_token": F.col("first_token"), "n_tokens": F.col("n_tokens"),
        "bin_id": F.col("_bin") + F.floor(step / F.col("_per")),
        "bin_offset": F.col("_offset") + step % F.col("_per") * F.col("n_tokens"),
        "bin_length": F.col("bin_length"),
    }
    named = docs.select(*keys)
    return place.select(*(F.col(o).alias(k) for o, k in zip(own, keys)), *(c.alias(free_name(named, n)) for n, c in made.items()))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), word_tokens(), "doc_id")
