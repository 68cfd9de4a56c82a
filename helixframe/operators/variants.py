"""Structural-variant operators: packed ids, breakpoints, windows, diversity, merging, gene impact."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .graph import components_with_nodes, cut_lineage
from .intervals import binned_overlaps, overlap_length, running, union

COVER_BLOCK = 1 << 12
SPAN_TYPES = ("DEL", "DUP", "CONTR", "INV")


def unpack_id(df: DataFrame, column: str = "id") -> DataFrame:
    """n, type, chrom, pos, len from ids n_TYPE_chrom_pos_len_L."""
    parts = F.from_csv(F.col(column), "n long, type string, chrom string, pos long, len long, tail string", {"sep": "_"})
    return df.withColumn("_p", parts).select(*df.columns, "_p.n", "_p.type", "_p.chrom", "_p.pos", "_p.len")


def compose_id(n: Column, kind: Column, chrom: Column, pos: Column, size: Column) -> Column:
    return F.concat_ws("_", n.cast("string"), kind, chrom, pos.cast("string"), size.cast("string"), F.lit("L"))


def info_map(column: str = "info") -> Column:
    return F.str_to_map(F.col(column), F.lit(";"), F.lit("="))


def second_breakpoint(df: DataFrame) -> DataFrame:
    """chrom2, pos2: the same place for INS, pos + len for spans, BREAKPOINT2 of INFO for TRA."""
    mate = info_map()["BREAKPOINT2"]
    chrom2 = F.when(F.col("type") == "TRA", F.split_part(mate, F.lit(":"), F.lit(1))).otherwise(F.col("chrom"))
    pos2 = F.when(F.col("type") == "TRA", F.split_part(mate, F.lit(":"), F.lit(2)).cast("long")).when(F.col("type").isin(*SPAN_TYPES), F.col("pos") + F.col("len")).otherwise(F.col("pos"))
    return df.withColumns({"chrom2": chrom2, "pos2": pos2})


def split_haplotypes(df: DataFrame, column: str = "gt") -> DataFrame:
    """hap (1, 2) and allele of phased calls a|b."""
    return df.select("*", F.posexplode(F.split(F.col(column), r"\|")).alias("hap", "allele")).withColumn("hap", F.col("hap") + 1).drop(column)


def window_grid(chromosomes: DataFrame, window: int, step: int) -> DataFrame:
    """chrom, start, end: starts 0, step, ... under size + step - window (one window at least); ends clipped."""
    top = F.greatest(F.col("size") + step - window, F.lit(1))
    return chromosomes.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), (top - 1).cast("long"), F.lit(step).cast("long"))).alias("start"), "size").select("chrom", "start", F.least(F.col("start") + window, "size").alias("end"))


def window_assign(svs: DataFrame, grid: DataFrame, window: int, step: int) -> DataFrame:
    """(variant, chrom, start, end) of the windows that hold a breakpoint or lie inside a non-TRA variant.

    Candidate starts are computed from the places, so the join is by (chrom, start), not by range.
    """

    def starts(lo: Column, hi: Column) -> Column:
        first = F.greatest(F.ceil((lo - window) / step), F.lit(0)).cast("long")
        last = F.floor(hi / step).cast("long")
        return F.when(first <= last, F.sequence(first, last))

    spans = F.array_compact(F.array(
        F.struct(F.col("chrom").alias("c"), starts(F.col("pos"), F.col("pos")).alias("s")),
        F.struct(F.col("chrom2").alias("c"), starts(F.col("pos2"), F.col("pos2")).alias("s")),
        F.when((F.col("type") != "TRA") & (F.col("chrom") == F.col("chrom2")), F.struct(F.col("chrom").alias("c"), starts(F.col("pos"), F.col("pos2")).alias("s"))),
    ))
    candidates = svs.select("variant", F.col("chrom").alias("c1"), "pos", F.col("chrom2").alias("c2"), "pos2", "type", F.explode(spans).alias("x")).filter("x.s is not null")
    keyed = candidates.select("variant", "c1", "pos", "c2", "pos2", "type", F.col("x.c").alias("chrom"), F.explode("x.s").alias("k")).withColumn("start", F.col("k") * step).drop("k").distinct()
    joined = keyed.join(grid, ["chrom", "start"])
    inside1 = (F.col("c1") == F.col("chrom")) & F.col("pos").between(F.col("start"), F.col("end"))
    inside2 = (F.col("c2") == F.col("chrom")) & F.col("pos2").between(F.col("start"), F.col("end"))
    around = (F.col("type") != "TRA") & (F.col("c1") == F.col("chrom")) & (F.col("c1") == F.col("c2")) & (F.col("pos") <= F.col("start")) & (F.col("pos2") >= F.col("end"))
    return joined.filter(inside1 | inside2 | around).select("variant", "chrom", "start", "end")


def window_ranges(svs: DataFrame, chromosomes: DataFrame, window: int, step: int) -> DataFrame:
    """variant, chrom and the runs lo .. hi (half-open) of numbers of the windows that `window_assign` gives a variant.

    One row or two a variant, however many windows they stand for: all windows that meet a variant within one
    chromosome, those that hold a breakpoint of any other.
    """
    part = lambda c, lo, hi: F.struct(F.col(c).alias("chrom"), F.col(lo).alias("a"), F.col(hi).alias("b"))
    within = (F.col("type") != "TRA") & (F.col("chrom") == F.col("chrom2"))
    parts = F.when(within, F.array(part("chrom", "pos", "pos2"))).otherwise(F.array(part("chrom", "pos", "pos"), part("chrom2", "pos2", "pos2")))
    placed = svs.select("variant", F.explode(parts).alias("p")).select("variant", "p.*").join(chromosomes.select("chrom", "size"), "chrom").filter("a <= size")
    most = F.floor((F.greatest(F.col("size") + step - window, F.lit(1)) - 1) / step)
    first, last = F.greatest(F.ceil((F.col("a") - window) / step), F.lit(0)), F.least(F.floor(F.col("b") / step), most)
    runs = placed.select("variant", "chrom", first.cast("long").alias("lo"), (last + 1).cast("long").alias("hi")).filter("lo < hi")
    return union(runs, ("variant", "chrom"), width=None)


def _steps(ranges: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """What each range adds where it begins and takes away where it ends."""
    ends = F.array(F.struct(F.col("lo").alias("k"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("k"), F.lit(-1).alias("sign")))
    return ranges.withColumn("_e", F.explode(ends)).select(*keys, "_e.k", *((value * F.col("_e.sign")).alias(name) for name, value in sums.items()))


def _of_windows(runs: DataFrame, chromosomes: DataFrame, window: int, step: int) -> DataFrame:
    """chrom, start, end, value of every window of the runs k .. next."""
    each = runs.select("chrom", F.explode(F.sequence("k", F.col("next") - 1)).alias("k"), "value").join(chromosomes.select("chrom", "size"), "chrom")
    start = F.col("k") * step
    return each.select("chrom", start.alias("start"), F.least(start + window, "size").alias("end"), "value")


def _site_values(genotypes: DataFrame) -> DataFrame:
    """variant, site: (1 - sum of squared allele frequencies) * n / (n - 1), null if a single allele is called."""
    counts = genotypes.groupBy("variant", "allele").agg(F.count(F.lit(1)).alias("k"))
    sites = counts.groupBy("variant").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q"))
    one = F.lit(1).cast("double")
    return sites.select("variant", F.try_divide((one - one * F.col("q") / (F.col("n") * F.col("n"))) * F.col("n"), F.col("n") - 1).alias("site"))


def sliding_theta_pi(svs: DataFrame, genotypes: DataFrame, chromosomes: DataFrame, window: int, step: int) -> DataFrame:
    """theta_pi of every window with a variant: sites are added where their windows begin and taken away after them.

    Sums are decimals, so what is taken away leaves nothing behind. No row is made for a variant's every window.
    """
    values = window_ranges(svs, chromosomes, window, step).join(_site_values(genotypes), "variant")
    site = F.coalesce("site", F.lit(0.0)).cast("decimal(28,18)")
    swept = running(_steps(values, ["chrom"], {"v": site, "n": F.lit(1)}), ("chrom",), "k", ["v", "n"])
    return _of_windows(swept.filter("n > 0").withColumn("value", F.col("v").cast("double") / window), chromosomes, window, step)


def sliding_theta_s(svs: DataFrame, n: int, chromosomes: DataFrame, window: int, step: int) -> DataFrame:
    """theta_s of every window with a variant, by the same sums."""
    harmonic = sum(1.0 / i for i in range(1, n))
    swept = running(_steps(window_ranges(svs, chromosomes, window, step), ["chrom"], {"n": F.lit(1)}), ("chrom",), "k", ["n"])
    value = F.try_divide(F.col("n"), F.lit(float(harmonic))) / F.lit(window)
    return _of_windows(swept.filter("n > 0").withColumn("value", value), chromosomes, window, step)


def sliding_gene_diversity(svs: DataFrame, genotypes: DataFrame, chromosomes: DataFrame, window: int, step: int) -> DataFrame:
    """gene_diversity of every window of the grid, a haplotype being the set of its (variant, allele).

    A haplotype's window is the difference of two prefix sums of hashes (96 bits, summed as integers that
    can't overflow) along its chromosome. It only changes where a variant's windows begin or end, so
    haplotypes are compared once for all windows between two such places: rows follow variants times
    haplotypes, whatever the step. Every haplotype has a row, if of zeros, at each such place.
    """
    hashes = F.xxhash64("variant", "allele")
    terms = {"a": F.shiftright(hashes, 32), "b": hashes.bitwiseAND(F.lit(0xFFFFFFFF)), "c": F.hash("variant", "allele").cast("long"), "n": F.lit(1).cast("long")}
    held = window_ranges(svs, chromosomes, window, step).join(genotypes.select("variant", "sample", "hap", "allele"), "variant")
    own = ["chrom", "sample", "hap"]
    steps = cut_lineage(_steps(held, own, terms).groupBy(*own, "k").agg(*(F.sum(c).alias(c) for c in terms)), "steps")
    zeros = steps.select("chrom", "k").distinct().join(steps.select(*own).distinct(), "chrom").select(*own, "k", *(F.lit(0).cast("long").alias(c) for c in terms))
    states = running(steps.unionByName(zeros), own, "k", list(terms)).filter("n > 0")
    kinds = states.groupBy("chrom", "k", "next", "a", "b", "c").agg(F.count(F.lit(1)).alias("m"))
    sums = kinds.groupBy("chrom", "k", "next").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("q"))
    one = F.lit(1).cast("double")
    value = F.try_divide((one - one * F.col("q") / (F.col("n") * F.col("n"))) * F.col("n"), F.col("n") - 1)
    found = _of_windows(sums.withColumn("value", value), chromosomes, window, step)
    grid = window_grid(chromosomes, window, step)
    return grid.join(found, ["chrom", "start", "end"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def theta_pi(assigned: DataFrame, genotypes: DataFrame, window: int) -> DataFrame:
    """Sum over a window's sites of 1 - sum of squared allele frequencies, times n / (n - 1) / window.

    A site with a single allele called adds nothing. For windows of any kind; a regular grid is swept by
    `sliding_theta_pi`, which makes no row for each window of a variant.
    """
    site = F.col("site") / window
    return assigned.join(_site_values(genotypes), "variant").groupBy("chrom", "start", "end").agg(F.sum(F.coalesce(site, F.lit(0.0))).alias("value"))


def theta_s(assigned: DataFrame, n: int, window: int) -> DataFrame:
    """Segregating sites over the harmonic number of n - 1, per base of the window; null below two sequences."""
    harmonic = sum(1.0 / i for i in range(1, n))
    return assigned.groupBy("chrom", "start", "end").agg((F.try_divide(F.count(F.lit(1)), F.lit(float(harmonic))) / F.lit(window)).alias("value"))


def haplotype_counts(assigned: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Distinct haplotypes (alleles in order of variants) of each window, and how many samples have them."""
    strings = assigned.join(genotypes.select("variant", "sample", "hap", "allele"), "variant").groupBy("chrom", "start", "end", "sample", "hap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", "allele"))), lambda x: x["allele"]), "").alias("haplotype"))
    return strings.groupBy("chrom", "start", "end", "haplotype").agg(F.count(F.lit(1)).alias("k"))


def gene_diversity(assigned: DataFrame, genotypes: DataFrame, grid: DataFrame) -> DataFrame:
    """n / (n - 1) * (1 - sum of squared haplotype frequencies); windows without variants, or with one haplotype, 0."""
    sums = haplotype_counts(assigned, genotypes).groupBy("chrom", "start", "end").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q"))
    one = F.lit(1).cast("double")
    value = F.try_divide((one - one * F.col("q") / (F.col("n") * F.col("n"))) * F.col("n"), F.col("n") - 1)
    return grid.join(sums, ["chrom", "start", "end"], "left").select("chrom", "start", "end", F.coalesce(value, F.lit(0.0)).alias("value"))


def in_region(svs: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Variants of a region: either chromosome matches and a breakpoint is inside, or the variant encloses it."""
    one = (F.col("chrom") == chrom) | (F.col("chrom2") == chrom)
    inside = F.col("pos").between(start, end) | F.col("pos2").between(start, end)
    around = (F.col("chrom") == F.col("chrom2")) & (F.col("pos") <= start) & (F.col("pos2") >= end)
    return svs.filter(one & (inside | around))


def of_types(svs: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return svs.filter(F.col("type").isin(*kinds))


def support_vector(df: DataFrame, strains: DataFrame, column: str = "supp_vec") -> DataFrame:
    """One row per variant and strain with 0/1, from a string of flags in strain order (ord from 0)."""
    flags = df.select("id", F.posexplode(F.split(F.col(column), "")).alias("ord", "present")).filter("present <> ''")
    return flags.join(strains, "ord").select("id", "strain", F.col("present").cast("int").alias("present"))


def confirm_singletons(support: DataFrame, best: DataFrame, second_suffix: str = "_2") -> DataFrame:
    """Ids present in a best assembly, but not in one alone that its second-best assembly lacks."""
    present = support.filter("present = 1")
    held = present.join(best, "strain", "left_semi")
    counts = held.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("strain").alias("only"))
    second = present.select(F.col("id").alias("i2"), F.col("strain").alias("s2"))
    checked = counts.join(second, (F.col("id") == F.col("i2")) & (F.concat("only", F.lit(second_suffix)) == F.col("s2")), "left")
    return checked.filter((F.col("k") > 1) | F.col("s2").isNotNull()).select("id")


def phase_genotypes(support: DataFrame) -> DataFrame:
    """id, sample, gt: x|x for unphased samples, HP1|HP2 for phased ones (strain.HP1, strain.HP2)."""
    sample = F.regexp_replace("strain", r"\.HP[12]$", "")
    pick = lambda suffix: F.max(F.when(F.col("strain").endswith(suffix), F.col("present")))
    plain = F.max(F.when(~F.col("strain").rlike(r"\.HP[12]$"), F.col("present")))
    grouped = support.withColumn("sample", sample).groupBy("id", "sample").agg(plain.alias("x"), pick(".HP1").alias("a"), pick(".HP2").alias("b"))
    left, right = F.coalesce("x", "a", F.lit(0)), F.coalesce("x", "b", F.lit(0))
    return grouped.select("id", "sample", F.concat_ws("|", left.cast("string"), right.cast("string")).alias("gt"))


def order_breakpoints(tra: DataFrame) -> DataFrame:
    """Smaller chromosome number first, then smaller position."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("int")
    one = F.struct(number("chrom").alias("n"), F.col("pos").alias("p"), F.col("chrom").alias("c"))
    two = F.struct(number("chrom2").alias("n"), F.col("pos2").alias("p"), F.col("chrom2").alias("c"))
    ordered = tra.withColumn("_o", F.array_sort(F.array(one, two)))
    low, high = F.col("_o")[0], F.col("_o")[1]
    return ordered.withColumns({"chrom": low["c"], "pos": low["p"], "chrom2": high["c"], "pos2": high["p"]}).drop("_o")


def translocation_length(tra: DataFrame, sizes: DataFrame) -> DataFrame:
    """Greater of both breakpoints' distance to the nearer chromosome end."""
    a = sizes.select(F.col("chrom").alias("chrom"), F.col("size").alias("s1"))
    b = sizes.select(F.col("chrom").alias("chrom2"), F.col("size").alias("s2"))
    end = lambda p, s: F.least(F.col(p), F.col(s) - F.col(p))
    return tra.join(F.broadcast(a), "chrom").join(F.broadcast(b), "chrom2").withColumn("length", F.greatest(end("pos", "s1"), end("pos2", "s2"))).drop("s1", "s2")


def link_translocations(tra: DataFrame, distance: int) -> DataFrame:
    """Pairs (src < dst) of one chromosome pair with both breakpoints nearer than distance: a band join binned on both."""
    return _near(tra, distance).filter("src < dst").select("src", "dst")


def _near(tra: DataFrame, distance: int) -> DataFrame:
    """Ordered pairs (src, dst) with both breakpoints nearer than distance."""
    binned = tra.select("chrom", "chrom2", "id", "pos", "pos2", F.floor(F.col("pos") / distance).alias("bin"), F.floor(F.col("pos2") / distance).alias("bin2"))
    right = binned.select("chrom", "chrom2", "bin", "bin2", F.col("id").alias("dst"), F.col("pos").alias("q1"), F.col("pos2").alias("q2"))
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    left = binned.drop("bin", "bin2").withColumnRenamed("id", "src").withColumn("bin", F.floor(F.col("pos") / distance)).withColumn("bin2", F.floor(F.col("pos2") / distance))
    left = left.withColumn("bin", around("bin")).withColumn("bin2", around("bin2"))
    near = (F.abs(F.col("pos") - F.col("q1")) < distance) & (F.abs(F.col("pos2") - F.col("q2")) < distance)
    return left.join(right, ["chrom", "chrom2", "bin", "bin2"]).filter(near).select("src", "dst")


def spanning_links(tra: DataFrame, distance: int) -> DataFrame:
    """Links (src, dst) with the components of `link_translocations`, a few for each row at most.

    Cells of a grid as wide as the distance: whatever shares a cell is linked to its least id. Two cells side
    by side are linked if the last of one and the first of the other are near, which one row a cell
    tells. Of two cells at a corner, the rows are swept by their first place with the farthest second place
    so far; of each place in a cell only its least and greatest second place take part, so a sweep has
    at most 2 * distance rows however many translocations share a cell.
    """
    cell = ["chrom", "chrom2", "x", "y"]
    rows = tra.select("chrom", "chrom2", "id", "pos", "pos2", F.expr(f"pos div {distance}").alias("x"), F.expr(f"pos2 div {distance}").alias("y"))
    stars = rows.join(rows.groupBy(*cell).agg(F.min("id").alias("dst")), cell).filter("id <> dst").select(F.col("id").alias("src"), "dst")
    low, high = F.min(F.struct("pos2", "id")), F.max(F.struct("pos2", "id"))
    places = cut_lineage(rows.groupBy(*cell, "pos").agg(low.alias("low"), high.alias("high")), "places")
    ends = places.groupBy(*cell).agg(
        F.min(F.struct("pos", F.col("low.id").alias("id"))).alias("left"), F.max(F.struct("pos", F.col("low.id").alias("id"))).alias("right"),
        F.min("low").alias("bottom"), F.max("high").alias("top"),
    )

    def beside(dx: int, dy: int, mine: str, place: str, other: str) -> DataFrame:
        far = ends.select("chrom", "chrom2", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col(other).alias("_far"))
        met = ends.join(far, cell).filter(F.col("_far")[place] - F.col(mine)[place] < distance)
        return met.select(F.col(f"{mine}.id").alias("src"), F.col("_far.id").alias("dst"))

    def corner(dy: int) -> DataFrame:
        """Links to the cell one to the right and one above (dy 1) or below (dy -1)."""
        mine, theirs = ("high", "low") if dy > 0 else ("low", "high")
        # heights are mirrored for the cell below, so that nearer is always higher
        height = lambda c: F.col(c)["pos2"] * dy
        left = places.select("chrom", "chrom2", "x", "y", F.col("pos").alias("at"), F.lit(1).alias("side"), height(mine).alias("h"), F.col(mine)["id"].alias("id"))
        right = places.select("chrom", "chrom2", (F.col("x") - 1).alias("x"), (F.col("y") - dy).alias("y"), (F.col("pos") - distance).alias("at"), F.lit(0).alias("side"), height(theirs).alias("h"), F.col(theirs)["id"].alias("id"))
        # a place of the left cell counts for a place of the right one that is less than the distance away
        order = Window.partitionBy(*cell).orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
        strictly = F.max(F.when(F.col("side") == 1, F.struct("h", "id", "at"))).over(order)
        swept = left.unionByName(right.withColumn("at", F.col("at") + 1)).withColumn("best", strictly)
        near = swept.filter((F.col("side") == 0) & (F.col("h") - F.col("best.h") < distance))
        return near.groupBy(*cell).agg(F.min(F.struct("id", "best")).alias("l")).select(F.col("l.best.id").alias("src"), F.col("l.id").alias("dst"))

    across = beside(1, 0, "right", "pos", "left").unionByName(beside(0, 1, "top", "pos2", "bottom"))
    return stars.unionByName(across).unionByName(corner(1)).unionByName(corner(-1))


def merge_translocations(tra: DataFrame, distance: int, strains: DataFrame | None = None) -> DataFrame:
    """One row per component: rounded means (half even), sample deviations, members and their number.

    With strains (strain, ord from 0) and a strain of each translocation, also supp_vec: a 0 or 1 for
    every strain, in their order.
    """
    comp = components_with_nodes(tra.select("id"), cut_lineage(spanning_links(tra, distance), "tra"))
    members = tra.join(comp, "id")
    rows = members.groupBy("component")
    mean = lambda c: F.rint(F.avg(c)).cast("long").alias(c)
    merged = rows.agg(F.min("chrom").alias("chrom"), mean("pos"), F.min("chrom2").alias("chrom2"), mean("pos2"), mean("length"), F.stddev_samp("pos").alias("std1"), F.stddev_samp("pos2").alias("std2"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.count(F.lit(1)).alias("n"))
    if strains is None:
        return merged
    held = members.join(strains, "strain").groupBy("component").agg(F.collect_set("ord").alias("_held"))
    size = strains.agg(F.max("ord").alias("_last"))
    flags = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long")), lambda i: F.when(F.array_contains("_held", i), "1").otherwise("0"))
    return merged.join(held, "component", "left").crossJoin(F.broadcast(size)).withColumn("_held", F.coalesce("_held", F.array().cast("array<bigint>"))).withColumn("supp_vec", F.array_join(flags, "")).drop("_held", "_last")


def genomic_number(df: DataFrame, tie: str) -> DataFrame:
    """Running number in order of chromosome number and position."""
    number = F.regexp_extract("chrom", r"(\d+)$", 1).cast("int")
    return numbered(df, [number, "pos", tie])


def impact_regions(svs: DataFrame, margin: int) -> DataFrame:
    """Regions around variants: all of DEL, DUP, CONTR with margins; breakpoint windows of the others; from 0."""
    around = lambda c, p: F.struct(F.col(c).alias("id"), F.greatest(F.col(p) - margin, F.lit(0)).alias("lo"), (F.col(p) + margin).alias("hi"))
    whole = F.struct(F.col("chrom").alias("id"), F.greatest(F.col("pos") - margin, F.lit(0)).alias("lo"), (F.col("pos2") + margin).alias("hi"))
    parts = F.when(F.col("type").isin("DEL", "DUP", "CONTR"), F.array(whole)).when(F.col("type") == "INS", F.array(around("chrom", "pos"))).otherwise(F.array(around("chrom", "pos"), around("chrom2", "pos2")))
    return svs.select("variant", F.explode(parts).alias("r")).select("variant", "r.id", "r.lo", "r.hi")


def gene_pairs(svs: DataFrame, genes: DataFrame, margin: int) -> DataFrame:
    """variant, gene, overlap: share of a gene's bases in a variant's impact region, where there is any."""
    regions = union(impact_regions(svs, margin), ["variant", "id"], width=None)
    pairs = binned_overlaps(regions, genes.select("id", "gene", "lo", "hi"), ["id"], 20_000)
    bases = F.sum(overlap_length(F.col("lo"), F.col("hi"), F.col("b_lo"), F.col("b_hi")))
    return pairs.groupBy("variant", F.col("b_gene").alias("gene"), (F.col("b_hi") - F.col("b_lo")).alias("size")).agg(bases.alias("b")).select("variant", "gene", (F.lit(1).cast("double") * F.col("b") / F.col("size")).alias("overlap"))


def rename_ids(df: DataFrame, names: DataFrame, column: str = "id") -> DataFrame:
    joined = df.join(names.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_n")), F.col(column) == F.col("_o"), "left")
    return joined.withColumn(column, F.coalesce("_n", column)).drop("_o", "_n")


def variant_type(ref: Column, alt: Column) -> Column:
    a, b = F.length(ref), F.length(alt)
    return F.when(a == b, "SNP").when((a < 50) & (b < 50), "INDEL").otherwise("SV")


def greedy_cover(presence: DataFrame, high_quality: DataFrame, most: int = 500, at_once: int = 32) -> DataFrame:
    """step, haplotype, gained: haplotypes by most uncovered variants, high quality first while they gain.

    presence (haplotype, ord, variant). Variants are numbered and held as bitmaps of COVER_BLOCK bits, a row for each
    haplotype and block, written once. What a haplotype would gain can only fall, so old gains are bounds: a
    step counts anew for the `at_once` haplotypes of the greatest bounds until one beats all bounds that are
    left. A step writes the bitmaps of what is covered and nothing else; the driver holds a number a haplotype.
    """
    spark = presence.sparkSession
    places = numbered(presence.select("variant").distinct(), ["variant"], "place").withColumn("place", F.col("place") - 1)
    held = presence.select("haplotype", "ord", "variant").distinct().join(places, "variant")
    bits = held.groupBy("haplotype", F.floor(F.col("place") / COVER_BLOCK).alias("block")).agg(F.collect_list((F.col("place") % COVER_BLOCK).cast("int")).alias("at"))
    kind = presence.schema["haplotype"].dataType.simpleString()

    def packed(batches):
        for batch in batches:
            rows = []
            for at in batch.column(2):
                flags = np.zeros(COVER_BLOCK, bool)
                flags[at.values.to_numpy()] = True
                rows.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.binary())], names=["haplotype", "block", "bits"])

    table = cut_lineage(bits.select("haplotype", "block", "at").mapInArrow(packed, f"haplotype {kind}, block long, bits binary"), "bitmaps")

    def fresh(batches):
        for batch in batches:
            n = [int(np.bitwise_count(np.frombuffer(b, np.uint8) & ~np.frombuffer(c or bytes(COVER_BLOCK // 8), np.uint8)).sum()) for b, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["haplotype", "n"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        union = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in group.column("bits")])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([union.tobytes()], pa.binary())})

    good = high_quality.select("haplotype").distinct().withColumn("hq", F.lit(True))
    sizes = held.groupBy("haplotype", "ord").agg(F.count(F.lit(1)).alias("n")).join(good, "haplotype", "left").collect()  # a row a haplotype
    rank = {r.haplotype: (0 if r.hq else 1, r.ord) for r in sizes}
    entry = lambda name, n, step: (rank[name][0], -n, rank[name][1], name, step)
    queue = [entry(r.haplotype, r.n, 0) for r in sizes]
    heapify(queue)
    covered: DataFrame | None = None
    steps: list[tuple[int, str, int]] = []
    while queue and len(steps) < most:
        if queue[0][4] == len(steps):
            _, loss, _, chosen, _ = heappop(queue)
            steps.append((len(steps) + 1, chosen, -loss))
            own = table.filter(F.col("haplotype") == chosen).select("block", "bits")
            covered = cut_lineage(own if covered is None else covered.unionByName(own).groupBy("block").applyInArrow(merge, "block long, bits binary"), "covered")
            continue
        stale = []
        while queue and len(stale) < at_once and queue[0][4] != len(steps):
            stale.append(heappop(queue)[3])
        asked = table.filter(F.col("haplotype").isin(stale)).join(covered.withColumnRenamed("bits", "old"), "block", "left").select("haplotype", "bits", "old")
        for r in asked.mapInArrow(fresh, f"haplotype {kind}, n long").groupBy("haplotype").agg(F.sum("n").alias("n")).collect():
            if r.n:
                heappush(queue, entry(r.haplotype, r.n, len(steps)))
    return spark.createDataFrame(steps, f"step long, haplotype {kind}, gained long")


def te_tag(df: DataFrame, related: DataFrame, column: str = "id") -> DataFrame:
    marked = df.join(related.select(F.col(related.columns[0]).alias("_t")).distinct(), F.col(column) == F.col("_t"), "left")
    return marked.withColumn(column, F.when(F.col("_t").isNotNull(), F.concat(column, F.lit("_TyRelated"))).otherwise(F.col(column))).drop("_t")


def concat_sources(merged: DataFrame, translocations: DataFrame) -> DataFrame:
    """Merged variants without translocations, then the merged translocations."""
    return merged.filter("type <> 'TRA'").unionByName(translocations.select(merged.columns))


def loh_windows(snps: DataFrame, chromosomes: DataFrame, bin_size: int = 1000, bins: int = 50, most: int = 10) -> DataFrame:
    """chrom, start, end of sliding windows of `bins` bins with fewer than `most` heterozygous sites; ends clipped.

    Bins are summed in blocks of `block` bins, each with the first bins of the next, so a chromosome is
    dealt over its blocks.
    """
    block = max(4096, 4 * bins)
    grid = chromosomes.select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / bin_size).cast("long"))).alias("bin"))
    counts = snps.groupBy("chrom", F.floor(F.col("pos") / bin_size).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    home = F.floor(F.col("bin") / block)
    shared = F.when((F.col("bin") % block < bins - 1) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    frame = Window.partitionBy("chrom", "block").orderBy("bin").rowsBetween(0, bins - 1)
    dense = grid.join(counts, ["chrom", "bin"], "left").withColumn("block", F.explode(shared)).withColumn("s", F.sum(F.coalesce("k", F.lit(0))).over(frame))
    start = F.col("bin") * bin_size
    whole = (F.col("bin") + bins <= F.ceil(F.col("size") / bin_size)) | (F.col("bin") == 0)
    return dense.filter((F.col("block") == home) & (F.col("s") < most) & whole).select("chrom", start.alias("start"), F.least(start + bins * bin_size, "size").alias("end"))


def allele_balance(counts: Column) -> Column:
    """First count over the sum of a comma list."""
    values = F.transform(F.split(counts, ","), lambda x: x.cast("double"))
    return values[0] / F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
