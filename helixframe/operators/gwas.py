"""Genotype encoding and association post-processing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.stats import average_rank, chi2_inv_1, norm_inv
from ..functions.numbering import numbered
from ..storage import written
from .graph import connected_components
from .samples import dissimilarity, dose_planes, mean_products, principal_components, reml, sample_order  # noqa: F401
from .trees import neighbour_joining  # noqa: F401

BLOCK = 256
REACHES = 16
# The feature types that have a location.
LOCATED = ("gene", "pseudogene", "transposable_element_gene", "blocked_reading_frame")


def cnv_bins(copies: DataFrame) -> DataFrame:
    """threshold, genotype (1 at or above, else 2) for thresholds y / 2 + 0.25, y = 0 .. 2 ceil(norm)."""
    thresholds = F.transform(F.sequence(F.lit(0), (2 * F.ceil("norm")).cast("int")), lambda y: y / F.lit(2).cast("double") + 0.25)
    rows = copies.withColumn("threshold", F.explode(thresholds))
    return rows.withColumn("genotype", F.when(F.col("norm") >= F.col("threshold"), 1).otherwise(2))


def cnv_locations(gff: DataFrame, extra: DataFrame, kinds: Sequence[str] = LOCATED, mitochondrion: str = "chrmt") -> DataFrame:
    rows = gff.filter(F.col("type").isin(*kinds) & (F.col("chrom") != mitochondrion)).select("gene", "chrom", "start")
    return rows.unionByName(extra.select("gene", "chrom", "start"))


def dictionary_encode(df: DataFrame, column: str) -> DataFrame:
    """code: 1 .. n in order of the distinct values, which are ranked apart from the rows."""
    return df.join(numbered(df.select(column).distinct(), [column], "code"), column)


def ped_rows(genotypes: DataFrame, variants: DataFrame) -> DataFrame:
    """strain, line: family, sample, four zeros, then two equal alleles per variant in order (missing 2)."""
    grid = genotypes.select("strain").distinct().crossJoin(variants.select("variant", "ord"))
    full = grid.join(genotypes.select("strain", "variant", "genotype"), ["strain", "variant"], "left").withColumn("g", F.coalesce("genotype", F.lit(2)).cast("string"))
    alleles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "g"))), lambda x: F.concat_ws("\t", x["g"], x["g"])), "\t")
    lead = F.concat_ws("\t", F.split_part("strain", F.lit("_"), F.lit(1)), F.split_part("strain", F.lit("_"), F.lit(-1)), *[F.lit("0")] * 4)
    return full.groupBy("strain").agg(alleles.alias("a")).select("strain", F.concat_ws("\t", lead, "a").alias("line"))


def map_rows(variants: DataFrame) -> DataFrame:
    return variants.select("chrom", F.concat("gene", F.lit("_Cov"), F.col("threshold").cast("string")).alias("id"), F.lit(0).alias("distance"), "start").orderBy("chrom", "start", "id")


def rank_inverse_normal(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """int: normal quantile of (rank - 3/8) / (n + 1/4); nulls stay null and aren't counted."""
    n = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    ranked = average_rank(df, value, keys, "_r").join(n, keys)
    return ranked.withColumn("int", norm_inv((F.col("_r") - 0.375) / (F.col("_n") + 0.25))).drop("_r", "_n")


def genomic_inflation(assoc: DataFrame, p: str = "p") -> DataFrame:
    """lambda: median chi-square of the p values over its expectation."""
    expected = F.lit(0.454936423119572)  # chi-square quantile of one half with one degree of freedom
    return assoc.filter(F.col(p).isNotNull()).agg((F.median(chi2_inv_1(F.col(p))) / expected).alias("lambda"))


def permute(pheno: DataFrame, permutations: int, seed: int, key: str = "strain", value: str = "value") -> DataFrame:
    """key, perm, value: values shuffled over keys in each permutation, from hashes alone."""
    every = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")
    places = numbered(pheno.select(key), [key], "r").select(key, "r", every)
    drawn = pheno.select(key, value, every).withColumn("h", F.xxhash64(key, "perm", F.lit(seed)))
    binned = drawn.withColumn("b", F.shiftright("h", 64 - 8))  # ranges of the hash, so that no task sorts a whole permutation
    counts = binned.groupBy("perm", "b").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("perm").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("perm", "b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("perm", "b").orderBy("h", key))
    ranked = binned.withColumn("own", own).join(starts, ["perm", "b"]).select("perm", value, (F.col("own") + F.col("start")).alias("r"))
    return places.join(ranked, ["perm", "r"]).select(key, "perm", value)


def batch_of(perm: Column, size: int = 101) -> Column:
    return F.floor(perm / size)


def best_p(assoc: DataFrame) -> DataFrame:
    return assoc.groupBy("perm").agg(F.min("p").alias("p"))


def threshold(best: DataFrame, share: float = 0.05) -> DataFrame:
    return best.agg(F.percentile("p", F.lit(share)).alias("threshold"))


def significant(assoc: DataFrame, limit: DataFrame) -> DataFrame:
    return assoc.crossJoin(F.broadcast(limit)).filter("p < threshold").drop("threshold")


def ld_pairs(dosage: DataFrame, window: int, least: float, ploidy: int = 2) -> DataFrame:
    """(a, b, r2) of variants of one chromosome within window whose squared correlation reaches `least`.

    dosage (variant, chrom, pos, sample, dose), doses 0 .. ploidy, null where missing; correlations are over
    the samples in which neither dose is missing. A variant's doses are packed into bit planes once and go
    to its own cell of REACHES windows and, if it lies within a window of the cell's beginning, as a guest
    to the one before, where every pair within the window meets; sums of products are counts of shared bits.
    """
    bad = F.raise_error(F.concat(F.lit("a dose beyond the ploidy: "), F.col("dose").cast("string"))).cast("long")
    called = dosage.filter(F.col("dose").isNotNull()).withColumn("dose", F.when(F.col("dose").between(0, ploidy), F.col("dose").cast("long")).otherwise(bad))
    order = sample_order(dosage, "sample")
    many = order.count()
    cells = F.collect_list(F.struct(F.col("place").alias("at"), "dose"))
    doses = called.join(order, "sample").groupBy("variant", "chrom", "pos").agg(cells.alias("cells"))
    kind = dosage.schema["variant"].dataType.simpleString()

    def planes(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                column = part.column(3)
                cells, owner = column.flatten(), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
                dense = np.full((len(column), many), np.nan)
                dense[owner, np.array(cells.field("at"))] = np.array(cells.field("dose"))
                packed = np.moveaxis(dose_planes(dense, ploidy), 0, 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in packed], pa.binary())], names=["variant", "chrom", "pos", "planes"])

    chrom, pos = (dosage.schema[c].dataType.simpleString() for c in ("chrom", "pos"))
    packed = doses.mapInArrow(planes, f"variant {kind}, chrom {chrom}, pos {pos}, planes binary")
    width = max(1, REACHES * window)
    home, within = F.expr(f"pos div {width}"), F.expr(f"pos % {width}") <= window
    cells_of = F.when(within, F.array("home", F.col("home") - 1)).otherwise(F.array("home"))
    dealt = packed.withColumn("home", home).withColumn("cell", F.explode(cells_of))

    def scan(group: pa.Table) -> pa.Table:
        return _linked(group.sort_by([("pos", "ascending"), ("variant", "ascending")]), window, least, ploidy)

    return dealt.groupBy("chrom", "cell").applyInArrow(scan, f"a {kind}, b {kind}, r2 double")


def _linked(group: pa.Table, window: int, least: float, ploidy: int) -> pa.Table:
    """Pairs of a cell: each of its own variants with those after it, guests of the next cell among them."""
    pos = group.column("pos").to_numpy()
    own = (group.column("home").to_numpy() == group.column("cell").to_numpy()).nonzero()[0]
    raw = b"".join(x.as_py() for x in group.column("planes"))
    bits = np.frombuffer(raw, np.uint64).reshape(len(pos), ploidy + 1, -1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in own.tolist():
        end = int(np.searchsorted(pos, pos[i] + window, "right"))
        if end > i + 1:
            x, y = bits[i], bits[i + 1 : end]
            both = x[0] & y[:, 0]
            count = lambda b: np.bitwise_count(b).sum(-1).astype(np.float64)
            n, levels = count(both), range(1, ploidy + 1)
            sx, sy = (sum(count(p(k) & both) for k in levels) for p in (lambda k: x[k], lambda k: y[:, k]))
            sxx, syy = (sum((2 * k - 1) * count(p(k) & both) for k in levels) for p in (lambda k: x[k], lambda k: y[:, k]))
            sxy = sum(count(x[k] & y[:, m]) for k in levels for m in levels)
            cov, var = n * sxy - sx * sy, (n * sxx - sx * sx) * (n * syy - sy * sy)
            r2 = np.divide(cov * cov, var, out=np.full(len(n), -1.0), where=var > 0)
            hit = np.flatnonzero((r2 >= least) & (var > 0))
            found.append((np.full(len(hit), i), i + 1 + hit, r2[hit]))
    a, b, r2 = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    names = group.column("variant")
    return pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "r2": pa.array(r2)})


def ld_groups(assoc: DataFrame, pairs: DataFrame, order: str = "ord") -> DataFrame:
    """snp, label: LD_i by first appearance of a component of linked variants (unlinked ones are their own)."""
    ids = assoc.select("snp", F.col(order).alias("id"))
    edges = pairs.join(ids.select(F.col("snp").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("snp").alias("b"), F.col("id").alias("dst")), "b")
    comp = ids.join(connected_components(edges), "id", "left").withColumn("component", F.coalesce("component", "id"))
    roots = numbered(comp.select("component").distinct(), ["component"])
    return comp.join(roots, "component").select("snp", F.concat(F.lit("LD_"), "number").alias("label"))


def mask_genotypes(calls: DataFrame, depth: int = 10, quality: int = 20) -> DataFrame:
    return calls.withColumn("gt", F.when((F.col("dp") < depth) | (F.col("gq") < quality), F.lit(None)).otherwise(F.col("gt")))


def site_tags(calls: DataFrame) -> DataFrame:
    """site, ac, an, af, f_missing, het from diploid calls a|b (null missing)."""
    alleles = F.split("gt", r"[|/]")
    alt = F.aggregate(alleles, F.lit(0), lambda s, a: s + F.when(a != "0", 1).otherwise(0))
    one = F.lit(1).cast("double")
    tagged = calls.withColumn("alt", alt).withColumn("h", F.when(alleles[0] != alleles[1], 1).otherwise(0))
    sums = tagged.groupBy("site").agg(F.coalesce(F.sum("alt"), F.lit(0)).alias("ac"), (2 * F.count("gt")).alias("an"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("gt").isNotNull(), F.col("h"))), F.lit(0)).alias("het"))
    return sums.select("site", "ac", "an", F.when(F.col("an") > 0, one * F.col("ac") / F.col("an")).alias("af"), (one - one * F.col("an") / (2 * F.col("n"))).alias("f_missing"), "het")


@F.pandas_udf(DoubleType())
def excess_het(ac: pd.Series, an: pd.Series, het: pd.Series) -> pd.Series:
    """Exact one-sided test: probability of at least `het` heterozygotes given the allele counts."""

    def one(minor: int, total: int, seen: int) -> float:
        minor = min(minor, total - minor)
        h = np.arange(minor % 2, minor + 1, 2)
        rare = (minor - h[:-1]) / 2
        common = total // 2 - h[:-1] - rare
        steps = np.log(4 * rare * common) - np.log((h[:-1] + 2.0) * (h[:-1] + 1.0))
        logs = np.concatenate([[0.0], np.cumsum(steps)])  # of weights that many samples take beyond any float
        weights = np.exp(logs - logs.max())
        return float(weights[h >= seen].sum() / weights.sum())

    return pd.Series([one(int(a), int(b), int(c)) for a, b, c in zip(ac, an, het)], dtype="float64")


def site_filters(tags: DataFrame, missing: float = 0.01) -> DataFrame:
    return tags.filter((F.col("f_missing") < missing) & (F.col("ac") >= 1))


def common(tags: DataFrame, least: float = 0.05) -> DataFrame:
    return tags.withColumn("maf", F.least("af", 1 - F.col("af"))).filter(F.col("maf") >= least)


def ld_prune(pairs: DataFrame, sites: DataFrame, size: int = 1 << 16) -> DataFrame:
    """variant, kept: in order of place, a variant goes if linked to a kept earlier one.

    Places are dealt to ranges of `size`. In a round every range goes through its open variants from left to right: one
    with a kept earlier neighbour goes, one whose earlier neighbours all went stays, and one that hangs on
    an open variant of another range waits. What was settled is written and told to the next round, so a
    range hands its state over its border; the first open range always settles, and links rarely reach so far
    that more than a few rounds are needed.
    """
    order = numbered(sites.select("variant", "pos"), ["pos", "variant"], "place")
    ends = pairs.select("a", "b").join(order.select(F.col("variant").alias("a"), F.col("place").alias("x")), "a").join(order.select(F.col("variant").alias("b"), F.col("place").alias("y")), "b")
    links = ends.filter("x <> y").select(F.greatest("x", "y").alias("later"), F.least("x", "y").alias("earlier")).distinct()
    links = written(links.withColumn("part", F.expr(f"later div {size}")), "links")
    free = written(links.select(F.col("earlier").alias("place")).distinct().join(links.select(F.col("later").alias("place")), "place", "left_anti").withColumn("kept", F.lit(True)), "settled")

    def told(rows: DataFrame, news: DataFrame) -> DataFrame:
        return rows.join(news.select(F.col("place").alias("earlier"), F.col("kept").alias("_news")), "earlier", "left").withColumn("kept", F.coalesce("kept", "_news")).drop("_news")

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        state: dict[int, bool | None] = {}
        near: dict[int, list[tuple[int, bool | None]]] = {}
        for later, earlier, kept in zip(part["later"].tolist(), part["earlier"].tolist(), part["kept"].tolist()):
            near.setdefault(later, []).append((earlier, kept))
        for place in sorted(near):
            seen = [state.get(e) if k is None else k for e, k in near[place]]
            state[place] = False if True in seen else None if None in seen else True
        return pd.DataFrame({"place": list(state), "kept": pd.array(list(state.values()), dtype="boolean")})

    open_ = told(links.withColumn("kept", F.lit(None).cast("boolean")), free)
    settled = free
    while True:
        out = written(open_.select("part", "later", "earlier", "kept").groupBy("part").applyInPandas(settle, "place long, kept boolean"), "round")
        news = out.filter("kept is not null")
        settled = settled.unionByName(news)
        if out.filter("kept is null").isEmpty():
            break
        left = open_.join(news.select(F.col("place").alias("later")), "later", "left_anti")
        open_ = written(told(left, news), "open")
    return order.join(settled, "place", "left").select("variant", F.coalesce("kept", F.lit(True)).alias("kept"))


def merge_types(**matrices: DataFrame) -> DataFrame:
    """Matrices united, ids prefixed by their type."""
    parts = [m.withColumn("variant", F.concat(F.lit(f"{name}_"), F.col("variant").cast("string"))) for name, m in matrices.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rename_chromosomes(df: DataFrame, prefix: str = "chromosome") -> DataFrame:
    return df.withColumn("chrom", F.regexp_replace("chrom", f"^{prefix}", "").cast("int"))


def sample_subset(df: DataFrame, keep: DataFrame, exclude_prefix: str, old: str, new: str) -> DataFrame:
    kept = df.join(keep.select("sample").distinct(), "sample", "left_semi").filter(~F.col("sample").startswith(exclude_prefix))
    return kept.withColumn("sample", F.when(F.col("sample") == old, new).otherwise(F.col("sample")))


def split_multiallelic(sites: DataFrame) -> DataFrame:
    return sites.select("site", "ref", F.posexplode(F.split("alts", ",")).alias("k", "alt")).withColumn("k", F.col("k") + 1)


def join_multiallelic(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site", "ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "alt"))), lambda x: x["alt"]), ",").alias("alts"))


def atomize(rows: DataFrame) -> DataFrame:
    """Single-base differences of equally long alleles."""
    at = rows.filter(F.length("ref") == F.length("alt")).select("site", "ref", "alt", F.explode(F.sequence(F.lit(1), F.length("ref"))).alias("i"))
    one = at.select("site", "i", F.expr("substring(ref, i, 1)").alias("r"), F.expr("substring(alt, i, 1)").alias("a"))
    return one.filter("r <> a")


def qq_data(assoc: DataFrame) -> DataFrame:
    """Observed and expected -log10 p by rank of p, and the position along all chromosomes."""
    n = assoc.agg(F.count("p").alias("n"))
    ranked = average_free_rank(assoc)
    lengths = assoc.groupBy("chrom").agg(F.max("bp").alias("size"))
    offset = F.coalesce(F.sum("size").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = lengths.withColumn("shift", offset).select("chrom", "shift")
    return ranked.crossJoin(F.broadcast(n)).join(F.broadcast(shifts), "chrom").select("snp", (-F.log10("p")).alias("observed"), (-F.log10((F.col("r") - 0.5) / F.col("n"))).alias("expected"), (F.col("bp") + F.col("shift")).alias("place"))


def average_free_rank(assoc: DataFrame) -> DataFrame:
    """r: rank of p over all rows in two levels, p ranges first, so that no task sorts everything."""
    parts = 256
    binned = assoc.withColumn("_b", F.floor(F.col("p") * parts))
    counts = binned.groupBy("_b").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.withColumn("_o", before).select("_b", "_o")
    return binned.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("p", "snp"))).join(F.broadcast(base), "_b").withColumn("r", F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count().filter("count > 1").select(column)


def covariates(components: DataFrame, ploidy: DataFrame) -> DataFrame:
    return components.join(ploidy, "sample")


def without_strong(pheno: DataFrame, assoc: DataFrame, limit: float = 1e-20) -> DataFrame:
    return pheno.join(assoc.filter(F.col("p") <= limit).select("pheno").distinct(), "pheno", "left_anti")


def heritability_pivot(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """pheno, kinships and one column per Her_ name from `Her_X value` lines."""
    rows = lines.select("pheno", "kinships", F.regexp_extract("value", r"^(Her_\w+)\s+(\S+)", 1).alias("k"), F.regexp_extract("value", r"^(Her_\w+)\s+(\S+)", 2).cast("double").alias("v"))
    return rows.filter("k <> ''").groupBy("pheno", "kinships").pivot("k", list(names)).agg(F.first("v"))


def model_grid(phenotypes: DataFrame, kinships: DataFrame) -> DataFrame:
    return phenotypes.crossJoin(kinships)


def kinship(dosage: DataFrame, power: float = -0.25, kept: DataFrame | None = None) -> DataFrame:
    """(a, b, k): mean over variants of products of centred doses, each scaled by (2f(1-f)) ** (power / 2).

    A product then carries (2f(1-f)) ** power; power -1 gives standardised doses. kept (variant) is the
    thinned set, if any. Missing (null) doses are left out: a pair's mean is over the variants that both have.
    Doses meet in blocks of BLOCK samples (`samples.mean_products`).
    """
    dosage = dosage.filter(F.col("dose").isNotNull())
    if kept is not None:
        dosage = dosage.join(kept.select("variant").distinct(), "variant", "left_semi")
    freq = dosage.groupBy("variant").agg((F.avg("dose") / 2).alias("f")).filter("f > 0 and f < 1")
    z = (F.col("dose") - 2 * F.col("f")) * F.pow(2 * F.col("f") * (1 - F.col("f")), F.lit(power / 2))
    return mean_products(dosage.join(freq, "variant").select("variant", "sample", z.alias("value")), BLOCK)
