"""Assembly metrics from alignment tables (asm, ref, qry, 1-based inclusive ranges)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import binned_overlaps, center, union


def _ref(coords: DataFrame, keys: list[str]) -> DataFrame:
    """Reference ranges as half-open intervals in the aligner's own coordinates."""
    return coords.select(*keys, F.least("ref_start", "ref_end").alias("lo"), (F.greatest("ref_start", "ref_end") + 1).alias("hi"))


def _qry(coords: DataFrame, keys: list[str]) -> DataFrame:
    return coords.select(*keys, F.least("qry_start", "qry_end").alias("lo"), (F.greatest("qry_start", "qry_end") + 1).alias("hi"))


def _bases(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return union(df, keys).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias(name))


def chromosome_coverage(coords: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """asm, ref, coverage: percent of each chromosome under the assembly's alignments."""
    grid = coords.select("asm").distinct().crossJoin(F.broadcast(chromosomes.select("ref", "len")))
    covered = _bases(_ref(coords, ["asm", "ref"]), ["asm", "ref"], "bases")
    return grid.join(covered, ["asm", "ref"], "left").select("asm", "ref", (F.lit(100).cast("double") * F.coalesce("bases", F.lit(0)) / F.col("len")).alias("coverage"))


def chromosomes_present(coverage: DataFrame, default: float = 80, thresholds: DataFrame | None = None) -> DataFrame:
    """asm, n_present: chromosomes at or above the default threshold, or their own (ref, threshold)."""
    limit = F.lit(default)
    if thresholds is not None:
        coverage = coverage.join(F.broadcast(thresholds), "ref", "left")
        limit = F.coalesce("threshold", F.lit(default))
    return coverage.groupBy("asm").agg(F.count_if(F.col("coverage") >= limit).alias("n_present"))


def contigs_to_coverage(coords: DataFrame, contigs: DataFrame, chromosomes: DataFrame, percent: float) -> DataFrame:
    """asm, n: contigs, by own coverage, that together cover enough of the genome; null if never.

    Every elementary reference segment is first covered by the contig of least rank, so the
    cumulative union is a running sum of first-covered bases.
    """
    own = _bases(_ref(coords, ["asm", "qry", "ref"]), ["asm", "qry", "ref"], "b").groupBy("asm", "qry").agg(F.sum("b").alias("own"))
    order = Window.partitionBy("asm").orderBy(F.col("own").desc(), F.col("ord").desc())
    ranked = contigs.select("asm", "qry", "ord").join(own, ["asm", "qry"], "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("rank", F.row_number().over(order))
    parts = union(_ref(coords, ["asm", "ref", "qry"]), ["asm", "ref", "qry"], width=None).join(ranked.select("asm", "qry", "rank"), ["asm", "qry"])
    cuts = parts.select("asm", "ref", F.explode(F.array("lo", "hi")).alias("x")).distinct()
    segments = cuts.withColumn("y", F.lead("x").over(Window.partitionBy("asm", "ref").orderBy("x"))).filter("y is not null")
    pairs = binned_overlaps(segments.select("asm", "ref", F.col("x").alias("lo"), F.col("y").alias("hi")), parts.select("asm", "ref", "lo", "hi", "rank"), ["asm", "ref"], 2_000)
    first = pairs.groupBy("asm", "ref", F.col("lo").alias("x"), F.col("hi").alias("y")).agg(F.min("b_rank").alias("rank"))
    genome = chromosomes.agg(F.sum("len").alias("genome"))
    gained = first.groupBy("asm", "rank").agg(F.sum(F.col("y") - F.col("x")).alias("gain"))
    running = Window.partitionBy("asm").orderBy("rank")
    reached = gained.withColumn("total", F.sum("gain").over(running)).crossJoin(F.broadcast(genome)).filter(100 * F.col("total") >= percent * F.col("genome"))
    return coords.select("asm").distinct().join(reached.groupBy("asm").agg(F.min("rank").cast("long").alias("n")), "asm", "left")


def double_centromeres(contigs: DataFrame, hits: DataFrame) -> DataFrame:
    """asm, n: contigs with more than one hit."""
    counts = contigs.select("asm", "qry").join(hits.select("asm", "qry", F.lit(1).alias("h")), ["asm", "qry"], "left").groupBy("asm", "qry").agg(F.count("h").alias("k"))
    return counts.groupBy("asm").agg(F.count_if(F.col("k") > 1).alias("n"))


def merged_chromosomes(coords: DataFrame, chromosomes: DataFrame, percent: float, inclusive_end: bool = True) -> DataFrame:
    """asm, n: contigs that cover at least `percent` of more than one chromosome."""
    rows = _ref(coords, ["asm", "qry", "ref"])
    rows = rows if inclusive_end else rows.withColumn("hi", F.col("hi") - 1)
    share = _bases(rows, ["asm", "qry", "ref"], "b").join(F.broadcast(chromosomes.select("ref", "len")), "ref")
    per_contig = share.groupBy("asm", "qry").agg(F.count_if(100 * F.col("b") >= percent * F.col("len")).alias("k"))
    return per_contig.groupBy("asm").agg(F.count_if(F.col("k") > 1).alias("n"))


def nuclear_split(contigs: DataFrame, coords: DataFrame, min_len: int, min_aligned: int) -> DataFrame:
    """contigs with nuclear: long enough, and a single alignment long enough."""
    best = coords.groupBy("asm", "qry").agg(F.max(F.abs(F.col("qry_end") - F.col("qry_start")) + 1).alias("best"))
    nuclear = (F.col("len") >= min_len) & (F.coalesce("best", F.lit(0)) >= min_aligned)
    return contigs.join(best, ["asm", "qry"], "left").withColumn("nuclear", nuclear).drop("best")


def remove_redundant(hits: DataFrame, contigs: DataFrame, percent: float = 95) -> DataFrame:
    """asm, qry, kept: drop the contig most covered by the others while that is at least `percent`.

    Hits are (asm, qry, other, lo, hi) on qry. Greedy and order dependent, so one assembly is one task. A
    contig is cut where a hit begins or ends, and each piece counts the hits of living contigs on it; a
    contig that goes takes its hits from its neighbours' pieces, and shares are recomputed for these alone: a
    share that has fallen is noticed when the queue brings it up. Hits of one contig on another come and go
    together, so they are first united, by all tasks: an assembly's task holds the contigs and what is left of
    each pair of them, however many rows lie there.
    """

    def peel(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("ord")
        names, sizes = left["qry"].tolist(), left["len"].tolist()
        place = {q: i for i, q in enumerate(names)}
        right = right[right["other"].isin(place) & right["qry"].isin(place)]
        on: list[list[tuple[int, int, int]]] = [[] for _ in names]  # of a contig: whom its hits cover, and which pieces
        counts, lengths = [np.zeros(0, int)] * len(names), [np.zeros(0, int)] * len(names)
        covered = [0] * len(names)
        for q, part in right.groupby("qry", sort=False):
            i = place[q]
            cuts = np.unique(np.concatenate([part["lo"], part["hi"]]))
            first, last = np.searchsorted(cuts, part["lo"]), np.searchsorted(cuts, part["hi"])
            steps = np.bincount(first, minlength=len(cuts)) - np.bincount(last, minlength=len(cuts))
            counts[i], lengths[i] = np.cumsum(steps)[:-1], np.diff(cuts)
            covered[i] = int(lengths[i][counts[i] > 0].sum())
            for other, a, b in zip(part["other"], first.tolist(), last.tolist()):
                on[place[other]].append((i, a, b))
        alive = [True] * len(names)
        share = lambda i: 100.0 * covered[i] / sizes[i]
        queue = [(-share(i), i) for i in range(len(names))]
        heapq.heapify(queue)
        while queue:
            noted, worst = heapq.heappop(queue)
            if -noted != share(worst):
                heapq.heappush(queue, (-share(worst), worst))
                continue
            if -noted < percent:
                break
            alive[worst] = False
            for i, a, b in on[worst]:
                counts[i][a:b] -= 1
                covered[i] -= int(lengths[i][a:b][counts[i][a:b] == 0].sum())
        return pd.DataFrame({"asm": key[0], "qry": names, "kept": alive})

    real = hits.filter((F.col("other") != F.col("qry")) & (F.col("lo") < F.col("hi")))
    keys = [F.col(c).alias(c) for c in ("asm", "qry", "other")]  # columns of their own, where contigs come from the same table
    united = union(real.select(*keys, "lo", "hi"), ["asm", "qry", "other"])
    left = contigs.select("asm", "qry", "ord", "len").groupBy("asm")
    return left.cogroup(united.groupBy("asm")).applyInPandas(peel, "asm string, qry string, kept boolean")


def rename_contigs(coords: DataFrame, contigs: DataFrame, chromosomes: DataFrame, min_bases: int = 100_000, percent_ref: float = 20, percent_contig: float = 50, prefix: str = "") -> DataFrame:
    """asm, qry, name: the chromosomes of a contig in order along it, numbered where split; else Unplaced.n."""
    keys = ["asm", "qry", "ref"]
    on_ref = _bases(_ref(coords, keys), keys, "b").join(F.broadcast(chromosomes.select("ref", "len", F.col("ord").alias("ref_ord"))), "ref")
    matched = on_ref.join(contigs.select("asm", "qry", F.col("len").alias("qlen")), ["asm", "qry"]).filter(F.col("b") >= F.least(F.lit(min_bases).cast("double"), percent_ref * F.col("len") / 100.0, percent_contig * F.col("qlen") / 100.0))
    placed = matched.select(*keys, "ref_ord").join(center(_ref(coords, keys), keys).withColumnRenamed("center", "at_ref"), keys).join(center(_qry(coords, keys), keys).withColumnRenamed("center", "at_qry"), keys)
    split = Window.partitionBy("asm", "ref")
    numbered = placed.withColumn("k", F.count(F.lit(1)).over(split)).withColumn("r", F.rank().over(split.orderBy("at_ref")))
    part = F.when(F.col("k") > 1, F.concat("ref", F.lit("."), "r")).otherwise(F.col("ref"))
    names = numbered.groupBy("asm", "qry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at_qry", "ref_ord", part.alias("part")))), lambda x: x["part"]), "_").alias("name"))
    every = contigs.select("asm", "qry", "ord").join(names, ["asm", "qry"], "left")
    unplaced = F.row_number().over(Window.partitionBy("asm", F.col("name").isNull()).orderBy("ord"))
    return every.withColumn("u", unplaced).select("asm", "qry", F.concat(F.lit(prefix), F.coalesce("name", F.concat(F.lit("Unplaced."), "u"))).alias("name"))


def reorder_contigs(coords: DataFrame, contigs: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """asm, qry, ref, place, strand, rank: best chromosome, middle of the longest alignment, orientation, order."""
    size = F.abs(F.col("qry_end") - F.col("qry_start")) + 1
    sized = coords.withColumn("n", size).withColumn("forward", F.col("qry_start") <= F.col("qry_end"))
    totals = sized.groupBy("asm", "qry", "ref").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("forward"), F.col("n")).otherwise(0)).alias("plus"), F.max(F.struct("n", (-F.col("ref_start")).alias("s"), (-F.col("ref_end")).alias("e"))).alias("long"))
    refs = F.broadcast(chromosomes.select("ref", F.col("ord").alias("ref_ord")))
    best = totals.join(refs, "ref").groupBy("asm", "qry").agg(F.max(F.struct("total", (-F.col("ref_ord")).alias("o"), "ref", "plus", "long")).alias("b"))
    first = chromosomes.agg(F.min_by("ref", "ord").alias("first_ref"))
    joined = contigs.select("asm", "qry", "ord").join(best, ["asm", "qry"], "left").crossJoin(F.broadcast(first))
    place = F.coalesce(F.floor((-F.col("b.long.s") - F.col("b.long.e")) / 2), F.lit(0)).cast("long")
    strand = F.when(F.col("b.plus") > F.col("b.total") - F.col("b.plus"), "F").otherwise("R")
    rows = joined.select("asm", "qry", "ord", F.coalesce("b.ref", "first_ref").alias("ref"), place.alias("place"), strand.alias("strand")).join(refs, "ref")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("asm").orderBy("ref_ord", "place", "ord")).cast("long")).drop("ref_ord", "ord")


def last_rows(lines: DataFrame, key: str = "file", order: str = "line") -> DataFrame:
    """The last line of each file."""
    return lines.groupBy(key).agg(F.max_by("value", order).alias("value"))


def pick_draft(strains: DataFrame) -> DataFrame:
    return strains.withColumn("draft", F.when(F.col("n_merged") == 0, F.col("scaffolded")).otherwise(F.col("polished")))


def name_equivalence(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """column replaced through a table (old, new), kept where it has no entry."""
    return df.join(names.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def quality_filter(strains: DataFrame, first: DataFrame, second: DataFrame, least: float = 40, truncate: bool = False) -> DataFrame:
    """Strains whose QV, from the first table or else the second, is at least `least`."""
    joined = strains.join(first.select("strain", F.col("qv").alias("q1")), "strain", "left").join(second.select("strain", F.col("qv").alias("q2")), "strain", "left")
    value = F.coalesce("q1", "q2")
    return joined.withColumn("qv", value).filter((F.floor(value) if truncate else value) >= least).drop("q1", "q2")


def busco_score(text: DataFrame, column: str = "value") -> DataFrame:
    part = lambda letter: F.regexp_extract(column, rf"{letter}:\s*([0-9.]+)%", 1).cast("double")
    return text.withColumn("score", part("S") + part("D"))


def qv_collect(rows: DataFrame, phased: bool) -> DataFrame:
    """Collapsed: assembly and its QV; phased: those of the row Both."""
    return (rows.filter("name = 'Both'") if phased else rows).select("asm", "qv")
