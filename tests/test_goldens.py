"""Small goldens of the operators, derived by hand."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import graph, gwas, hits, intervals, pangenome, sequences, variants


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def ivl(spark, *items):
    return spark.createDataFrame(list(items), "id string, lo long, hi long")


def test_union_and_touching(spark):
    assert rows(intervals.union(ivl(spark, ("b", 2, 400), ("b", 300, 600)))) == [("b", 2, 600)]
    assert rows(intervals.union(ivl(spark, ("a", 1, 5), ("a", 5, 9)))) == [("a", 1, 9)]
    assert rows(intervals.insert(ivl(spark, ("a", 1, 5)), ivl(spark, ("a", 5, 9)))) == [("a", 1, 5), ("a", 5, 9)]
    assert rows(intervals.union(ivl(spark, ("a", 3, 3)))) == []


def test_inverted_interval_is_an_error(spark):
    with pytest.raises(Exception, match="inverted"):
        intervals.union(ivl(spark, ("a", 5, 1))).collect()


def test_subtract_center_coverage(spark):
    left = intervals.subtract(ivl(spark, ("a", 2, 100)), ivl(spark, ("a", 20, 41)))
    assert rows(left) == [("a", 2, 20), ("a", 41, 100)]
    assert rows(intervals.length(left)) == [("a", 77)]
    assert rows(intervals.center(left))[0][1] == pytest.approx((10.5 * 18 + 70 * 59) / 77)
    whole = intervals.coverage_percent(ivl(spark, ("a", 0, 100)), ivl(spark, ("a", 10, 30), ("a", 20, 50)))
    assert rows(whole, "coverage") == [(40.0,)]


def test_non_n(spark):
    seqs = spark.createDataFrame([("x", "ACNNGT"), ("y", "N"), ("z", "NAN")], "id string, seq string")
    assert rows(intervals.non_n(seqs)) == [("x", 1, 3), ("x", 5, 7), ("z", 2, 3)]


def test_sequences(spark):
    seqs = spark.createDataFrame([("s", "s d", "ACGTACGT", 1)], "id string, description string, seq string, ord long")
    assert rows(sequences.extract(seqs, start=3, end=20), "id", "seq") == [("s_3..8", "GTACGT")]
    assert seqs.select(sequences.reverse_complement(F.lit("ACGTN"))).first()[0] == "NACGT"
    with pytest.raises(Exception, match="unknown sequence"):
        sequences.extract(seqs, ids=spark.createDataFrame([("t",)], "id string")).collect()
    assert rows(sequences.mask_ends(seqs, 3), "seq") == [("NNNTANNN",)]
    assert rows(sequences.wrapped(seqs, 4), "fasta") == [(">s d\nACGT\nACGT",)]


def test_window_grid(spark):
    grid = variants.window_grid(spark.createDataFrame([("c", 12_000)], "chrom string, size long"), 10_000, 1_000)
    assert rows(grid) == [("c", 0, 10_000), ("c", 1_000, 11_000), ("c", 2_000, 12_000)]


def diversity(spark):
    alleles = ["00", "01", "01", "11"]
    gt = spark.createDataFrame([(v, s, 1, h[v]) for s, h in enumerate(alleles) for v in range(2)], "variant long, sample long, hap int, allele string")
    where = spark.createDataFrame([(0, "c", 0, 1000), (1, "c", 0, 1000)], "variant long, chrom string, start long, end long")
    return gt, where


def test_diversity(spark):
    gt, where = diversity(spark)
    assert variants.theta_pi(where, gt, 1000).first().value == pytest.approx(0.001)
    assert variants.theta_s(where, 4, 1000).first().value == pytest.approx(0.00109090909)
    grid = where.select("chrom", "start", "end").distinct()
    assert variants.gene_diversity(where, gt, grid).first().value == pytest.approx(0.8333333333)


def test_translocation(spark):
    tra = spark.createDataFrame([(1, "chromosome1", 1000, "chromosome2", 50_000)], "id long, chrom string, pos long, chrom2 string, pos2 long")
    sizes = spark.createDataFrame([("chromosome1", 230_218), ("chromosome2", 813_184)], "chrom string, size long")
    measured = variants.translocation_length(tra, sizes)
    assert measured.first().length == 50_000
    merged = variants.merge_translocations(measured, 10_000).first()
    assert merged.std1 is None and merged.n == 1


def test_copy_number(spark):
    norm = spark.createDataFrame([("a", 1.25, 2), ("b", 0.28, 2), ("c", 0.31, 1)], "gene string, norm double, ploidy int")
    assert rows(pangenome.call_copies(norm, F.col("ploidy")), "gene", "cn") == [("a", 1.0), ("b", 0.5), ("c", 1.0)]
    counts = spark.createDataFrame([("s", "x", 10, 100), ("s", "y", 20, 100), ("s", "*", 5, 0)], "strain string, gene string, reads long, length long")
    assert [round(t, 2) for (t,) in rows(pangenome.tpm(counts), "tpm")] == [333333.33, 666666.67]


def test_association(spark):
    bins = gwas.cnv_bins(spark.createDataFrame([(0.42,)], "norm double"))
    assert rows(bins, "threshold", "genotype") == [(0.25, 1), (0.75, 2), (1.25, 2)]
    values = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 2.0), ("k", 3, 2.0), ("k", 4, 5.0), ("k", 5, None)], "k string, i int, value double")
    got = dict(rows(gwas.rank_inverse_normal(values, ["k"]), "i", "int"))
    assert got[1] == pytest.approx(-1.04913, abs=1e-5) and got[2] == got[3] == 0 and got[4] == pytest.approx(1.04913, abs=1e-5) and got[5] is None
    p = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "p double")
    assert gwas.threshold(p).first()[0] == pytest.approx(1.15)
    even = spark.createDataFrame([(i / 1000,) for i in range(1, 1000)], "p double")
    assert gwas.genomic_inflation(even).first()[0] == pytest.approx(1, abs=1e-6)


def test_norm_inv(spark):
    got = spark.createDataFrame([(0.975,), (0.0,), (None,)], "p double").select(stats.norm_inv("p").alias("z")).collect()
    assert got[0].z == pytest.approx(1.959963985) and got[1].z is None and got[2].z is None


def test_norm_inv_over_the_whole_range(spark):
    from statistics import NormalDist

    places = [10.0**-k for k in range(1, 300, 7)] + [i / 997 for i in range(1, 997)] + [1 - 10.0**-k for k in range(1, 16)]
    got = spark.createDataFrame([(p,) for p in places], "p double").select("p", stats.norm_inv("p").alias("z")).collect()
    assert all(r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-13, abs=1e-15) for r in got) and len(got) == len(places)



def test_density(spark):
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    comp = graph.components_with_nodes(nodes, path)
    assert rows(comp) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]
    assert {r.component: r.density for r in graph.density(comp, path).collect()} == {1: 0.5, 5: None}


def test_classify(spark):
    seen = [(1, 85.0, 10.0, False, False), (2, 55.0, 0.0, False, False), (3, 0.0, 92.0, False, False), (4, 40.0, 0.0, True, True)]
    got = hits.classify(spark.createDataFrame(seen, "i int, scov double, qcov double, at_start boolean, at_end boolean"))
    assert [c for _, c in rows(got, "i", "class")] == ["complete", "truncated", "truncated", "complete"]


def test_origin(spark):
    flags = spark.createDataFrame([(1, 95.0, ["genus", "sister species"]), (2, 90.0, ["genus", "sister species"]), (3, 99.0, [])], "id int, pident double, clades array<string>")
    assert [o for _, o in rows(pangenome.origin_call(flags), "id", "origin")] == ["sister species", "genus", "Error"]


def test_multiallelic_round_trip(spark):
    sites = spark.createDataFrame([(1, "A", "C,G,T")], "site int, ref string, alts string")
    assert rows(gwas.join_multiallelic(gwas.split_multiallelic(sites))) == rows(sites)


def test_excess_heterozygosity(spark):
    got = spark.createDataFrame([(10, 20, 10)], "ac int, an int, het int").select(gwas.excess_het("ac", "an", "het").alias("p")).first().p
    assert got == pytest.approx(2**10 / math.comb(20, 10))


@pytest.mark.parametrize("ac, an, het", [(0, 0, 0), (0, 20, 0), (20, 20, 0), (7, 20, 3), (13, 20, 3), (1, 2, 1), (4000, 8000, 2060), (3001, 8000, 1901), (90, 8000, 90)])
def test_excess_heterozygosity_against_whole_numbers(spark, ac, an, het):
    def ways(h):
        return 2**h * math.factorial(n) // (math.factorial((minor - h) // 2) * math.factorial(h) * math.factorial(n - (minor + h) // 2))

    n, minor = an // 2, min(ac, an - ac)
    all_ = {h: ways(h) for h in range(minor % 2, minor + 1, 2)}
    want = Fraction(sum(w for h, w in all_.items() if h >= het), sum(all_.values()))
    got = spark.createDataFrame([(ac, an, het)], "ac int, an int, het int").select(gwas.excess_het("ac", "an", "het").alias("p")).first().p
    assert got == pytest.approx(float(want), rel=1e-9)
