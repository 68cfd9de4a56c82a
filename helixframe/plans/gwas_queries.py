"""Queries of the genotype and association operators."""

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import gwas as gw
from .registry import query


@query("cnv_bins", "SELECT p_partkey, y / CAST(2 AS DOUBLE) + 0.25 AS threshold, CASE WHEN p_size / CAST(20 AS DOUBLE) >= y / CAST(2 AS DOUBLE) + 0.25 THEN 1 ELSE 2 END AS genotype FROM {part}, unnest(range(0, 50)) t(y) WHERE y <= 2 * ceil(p_size / CAST(20 AS DOUBLE))")
def _(v):
    return gw.cnv_bins(v.part.selectExpr("p_partkey", "p_size / CAST(20 AS DOUBLE) AS norm")).select("p_partkey", "threshold", "genotype")


@query("cnv_locations", "SELECT ord AS gene, seqid AS chrom, start FROM {gff} WHERE type IN ('ECONOMY', 'PROMO') AND seqid <> 'chr3' UNION ALL SELECT n_nationkey, n_name, 1 FROM {nation}")
def _(v):
    rows = v.gff.selectExpr("ord AS gene", "type", "seqid AS chrom", "start")
    return gw.cnv_locations(rows, v.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS gene", "n_name AS chrom", "CAST(1 AS BIGINT) AS start"), ["ECONOMY", "PROMO"], "chr3")


@query("dictionary_encode", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS code FROM {part}")
def _(v):
    return gw.dictionary_encode(v.part.select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "code")


@query("ped_matrix", "WITH g AS (SELECT c.c_custkey AS strain, n.n_nationkey AS o, CASE WHEN (c.c_custkey * 7 + n.n_nationkey) % 3 = 0 THEN 2 ELSE (c.c_custkey + n.n_nationkey) % 2 + 1 END AS g FROM {customer} c CROSS JOIN {nation} n) SELECT concat('f_', strain) AS strain, concat('f', chr(9), strain, chr(9), '0', chr(9), '0', chr(9), '0', chr(9), '0', chr(9), string_agg(concat(g, chr(9), g), chr(9) ORDER BY o)) AS line FROM g GROUP BY strain")
def _(v):
    rows = v.customer.crossJoin(v.nation).filter("(c_custkey * 7 + n_nationkey) % 3 <> 0").selectExpr("concat('f_', c_custkey) AS strain", "n_nationkey AS variant", "(c_custkey + n_nationkey) % 2 + 1 AS genotype")
    return gw.ped_rows(rows, v.nation.selectExpr("n_nationkey AS variant", "n_nationkey AS ord"))


@query("map_file", "SELECT p_partkey % 16 + 1 AS chrom, concat(p_partkey, '_Cov', CAST(p_size * CAST(0.5 AS DOUBLE) AS STRING)) AS id, 0 AS distance, p_partkey * 100 AS start FROM {part}")
def _(v):
    return gw.map_rows(v.part.selectExpr("p_partkey % 16 + 1 AS chrom", "CAST(p_partkey AS STRING) AS gene", "p_size * CAST(0.5 AS DOUBLE) AS threshold", "p_partkey * 100 AS start"))


AVG_RANK = "WITH a AS (SELECT strain, cond, value, rank() OVER (PARTITION BY cond ORDER BY value) + (count(*) OVER (PARTITION BY cond, value) - 1) / CAST(2 AS DOUBLE) AS r FROM {pheno} WHERE value IS NOT NULL)"


@query("average_rank", AVG_RANK + " SELECT strain, cond, r FROM a")
def _(v):
    return stats.average_rank(v.pheno.filter("value is not null"), "value", ["cond"], "r").select("strain", "cond", "r")


def quantile_sql(p: str) -> str:
    """SQL of the normal quantile by the same public algorithm; tests/test_goldens.py holds its values against the standard library's."""
    number = lambda c: f"{c!r}" + ("" if "e" in repr(c) else "e0")

    def ratio(parts, x):
        texts = []
        for first, *rest in parts:
            text = number(first)
            for c in rest:
                text = f"({text} * {x} + {number(c)})"
            texts.append(text)
        return f"({texts[0]} / {texts[1]})"

    q, tail = f"({p} - 5e-1)", f"sqrt(-ln(least({p}, 1e0 - {p})))"
    outer = f"CASE WHEN {tail} <= 5 THEN {ratio(stats._NEAR, f'({tail} - 1.6e0)')} ELSE {ratio(stats._FAR, f'({tail} - 5e0)')} END"
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({q}) <= 4.25e-1 THEN {q} * {ratio(stats._CENTRAL, f'(1.80625e-1 - {q} * {q})')} WHEN {q} < 0 THEN -({outer}) ELSE {outer} END END"


@query("rank_int", AVG_RANK + ", n AS (SELECT cond, count(*) AS n FROM a GROUP BY cond), u AS (SELECT p.strain, p.cond, (r - 3.75e-1) / (n + 2.5e-1) AS u FROM {pheno} p LEFT JOIN a ON a.strain = p.strain AND a.cond = p.cond LEFT JOIN n ON n.cond = p.cond) SELECT strain, cond, round(" + quantile_sql("u") + ", 9) AS int FROM u")
def _(v):
    return gw.rank_inverse_normal(v.pheno, ["cond"]).select("strain", "cond", F.round("int", 9).alias("int"))


@query("genomic_inflation", "WITH u AS (SELECT p / 2 AS u FROM {assoc} WHERE p IS NOT NULL), z AS (SELECT " + quantile_sql("u") + " AS z FROM u) SELECT median(z * z) / 4.54936423119572e-1 AS lambda FROM z")
def _(v):
    return gw.genomic_inflation(v.assoc)


@query("permute_phenotypes", "SELECT CAST(perm AS INTEGER) AS perm, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS total FROM {customer}, unnest(range(1, 6)) t(perm) GROUP BY perm")
def _(v):
    rows = gw.permute(v.customer.selectExpr("c_custkey AS strain", "c_acctbal AS value"), 5, 11)
    return rows.groupBy("perm").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))


@query("batch_columns", "SELECT c_custkey, c_custkey // 101 AS batch FROM {customer}")
def _(v):
    return v.customer.select("c_custkey", gw.batch_of(F.col("c_custkey")).alias("batch"))


@query("best_p_per_permutation", "SELECT perm, min(p) AS p FROM {assoc} GROUP BY perm")
def _(v):
    return gw.best_p(v.assoc)


@query("significance_threshold", "SELECT quantile_cont(p, 0.05) AS threshold FROM (SELECT min(p) AS p FROM {assoc} GROUP BY perm)")
def _(v):
    return gw.threshold(gw.best_p(v.assoc))


@query("significant_variants", "SELECT snp, p FROM {assoc} WHERE p < (SELECT quantile_cont(p, 0.05) FROM {assoc})")
def _(v):
    return gw.significant(v.assoc, gw.threshold(v.assoc)).select("snp", "p")


DOSE = "WITH ds AS (SELECT p_partkey AS variant, p_partkey % 16 + 1 AS chrom, p_partkey * 100 AS pos, s.n_nationkey AS sample, (p_partkey * s.n_nationkey + p_size % 2 * s.n_nationkey) % 3 AS dose FROM {part} CROSS JOIN {nation} s)"
PAIRS = DOSE + ", st AS (SELECT DISTINCT variant, chrom, pos FROM ds), nr AS (SELECT a.variant AS a, b.variant AS b FROM st a JOIN st b ON a.chrom = b.chrom AND b.pos - a.pos BETWEEN 0 AND 5000 AND (a.pos < b.pos OR a.variant < b.variant)), ld AS (SELECT a, b, corr(x.dose, y.dose) AS r FROM nr JOIN ds x ON x.variant = a JOIN ds y ON y.variant = b AND y.sample = x.sample GROUP BY a, b), lp AS (SELECT a, b, r * r AS r2 FROM ld WHERE r * r >= 0.199999999 AND NOT isnan(r))"


def dosage(v):
    return v.part.crossJoin(v.nation).selectExpr("p_partkey AS variant", "p_partkey % 16 + 1 AS chrom", "p_partkey * 100 AS pos", "n_nationkey AS sample", "(p_partkey * n_nationkey + p_size % 2 * n_nationkey) % 3 AS dose")


def pairs(v):
    return gw.ld_pairs(dosage(v), 5_000, 0.199999999)


@query("ld_pairs", PAIRS + " SELECT a, b, round(r2, 9) AS r2 FROM lp")
def _(v):
    return pairs(v).withColumn("r2", F.round("r2", 9))


@query("ld_groups", PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + ", e AS (SELECT a, b FROM lp UNION SELECT b, a FROM lp), w AS (SELECT p_partkey AS id, p_partkey AS r FROM {part} UNION SELECT w.id, e.b FROM w JOIN e ON w.r = e.a), c AS (SELECT id, min(r) AS component FROM w GROUP BY id) SELECT id AS snp, concat('LD_', dense_rank() OVER (ORDER BY component)) AS label FROM c")
def _(v):
    return gw.ld_groups(v.part.selectExpr("p_partkey AS snp", "p_partkey AS ord"), pairs(v))


CALLS = "WITH ca AS (SELECT event_id % 400 AS site, event_id AS sample, CASE WHEN user_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '0|1' WHEN event_id % 5 = 0 THEN '1|1' ELSE '0|0' END AS gt FROM {events}), tg AS (SELECT site, coalesce(sum(CASE gt WHEN '0|1' THEN 1 WHEN '1|1' THEN 2 ELSE 0 END), 0) AS ac, 2 * count(gt) AS an, count(*) AS n, count(*) FILTER (WHERE gt = '0|1') AS het FROM ca GROUP BY site), tags AS (SELECT site, ac, an, CASE WHEN an > 0 THEN CAST(ac AS DOUBLE) / an END AS af, 1 - CAST(an AS DOUBLE) / (2 * n) AS f_missing, het FROM tg)"


def calls(v):
    return v.events.selectExpr("event_id % 400 AS site", "event_id AS sample", "CASE WHEN user_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '0|1' WHEN event_id % 5 = 0 THEN '1|1' ELSE '0|0' END AS gt")


@query("geno_depth_quality", "SELECT event_id, CASE WHEN user_id % 40 < 10 OR event_id % 50 < 20 THEN NULL ELSE '0|1' END AS gt FROM {events}")
def _(v):
    return gw.mask_genotypes(v.events.selectExpr("event_id", "user_id % 40 AS dp", "event_id % 50 AS gq", "'0|1' AS gt")).select("event_id", "gt")


@query("geno_fill_tags", CALLS + " SELECT site, CAST(ac AS BIGINT) AS ac, an, af, f_missing, het FROM tags")
def _(v):
    return gw.site_tags(calls(v))


@query("geno_site_filters", CALLS + " SELECT site FROM tags WHERE f_missing < 0.05 AND ac >= 1")
def _(v):
    return gw.site_filters(gw.site_tags(calls(v)), 0.05).select("site")


EXCESS = CALLS + """, m AS (SELECT site, het, least(ac, an - ac) AS minor, an // 2 AS n FROM tags),
k AS (SELECT site, het, minor, n, unnest(range(CAST(minor % 2 AS BIGINT), CAST(minor + 1 AS BIGINT), 2)) AS h FROM m),
w AS (SELECT site, het, h, h * ln(2) - lgamma((minor - h) / 2 + 1) - lgamma(h + 1) - lgamma(n - (minor + h) / 2 + 1) AS lw FROM k),
x AS (SELECT site, het, h, exp(lw - max(lw) OVER (PARTITION BY site)) AS e FROM w)
SELECT site, round(coalesce(sum(e) FILTER (WHERE h >= het), 0) / sum(e), 9) AS p FROM x GROUP BY site"""


@query("geno_excess_het", EXCESS)
def _(v):
    tags = gw.site_tags(calls(v))
    return tags.select("site", F.round(gw.excess_het("ac", "an", "het"), 9).alias("p"))


@query("geno_maf", CALLS + " SELECT site, least(af, 1 - af) AS maf FROM tags WHERE least(af, 1 - af) >= 0.2")
def _(v):
    return gw.common(gw.site_tags(calls(v)), 0.2).select("site", "maf")


PRUNE = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, si AS (SELECT p_partkey AS variant, p_partkey % 16 + 1 AS chrom, row_number() OVER (PARTITION BY p_partkey % 16 ORDER BY p_partkey) AS r FROM {part}),
nbr AS (SELECT x AS variant, list(y) AS near FROM (SELECT a AS x, b AS y FROM lp UNION SELECT b, a FROM lp) GROUP BY x),
o AS (SELECT si.*, coalesce(near, []) AS near FROM si LEFT JOIN nbr USING (variant)),
k AS (SELECT chrom, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept FROM o GROUP BY chrom
UNION ALL SELECT k.chrom, o.r, CASE WHEN list_has_any(k.kept, o.near) THEN k.kept ELSE list_append(k.kept, o.variant) END FROM k JOIN o ON o.chrom = k.chrom AND o.r = k.r + 1),
e AS (SELECT chrom, unnest(arg_max(kept, r)) AS variant FROM k GROUP BY chrom)
SELECT variant, variant IN (SELECT variant FROM e) AS kept FROM o"""


def sites(v):
    return v.part.selectExpr("p_partkey AS variant", "p_partkey % 16 + 1 AS chrom", "p_partkey * 100 AS pos")


@query("ld_prune", PRUNE)
def _(v):
    return gw.ld_prune(pairs(v), sites(v))


@query("geno_merge_types", "SELECT concat('SNP_', p_partkey) AS variant, p_size FROM {part} UNION ALL SELECT concat('SV_', p_partkey), p_size FROM {part} WHERE p_size > 10")
def _(v):
    one = v.part.selectExpr("p_partkey AS variant", "p_size")
    return gw.merge_types(SNP=one, SV=one.filter("p_size > 10"))


@query("chrom_rename", "SELECT event_id, CAST(substring(chrom, 11) AS INT) AS chrom FROM {sv}")
def _(v):
    return gw.rename_chromosomes(v.sv.select("event_id", "chrom"))


@query("sample_subset", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSE' ELSE c_mktsegment END AS sample FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND c_mktsegment NOT LIKE 'M%'")
def _(v):
    keep = v.customer.filter("c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE')").selectExpr("c_mktsegment AS sample")
    return gw.sample_subset(v.customer.selectExpr("c_custkey", "c_mktsegment AS sample"), keep, "M", "BUILDING", "HOUSE").select("c_custkey", "sample")


@query("multiallelic_split", "SELECT p_partkey AS site, unnest([1, 2, 3]) AS k, unnest(['A', p_brand, 'C']) AS alt FROM {part}")
def _(v):
    return gw.split_multiallelic(v.part.selectExpr("p_partkey AS site", "'G' AS ref", "concat('A,', p_brand, ',C') AS alts")).select("site", "k", "alt")


@query("multiallelic_merge", "SELECT p_partkey AS site, concat('A,', p_brand, ',C') AS alts FROM {part}")
def _(v):
    return gw.join_multiallelic(gw.split_multiallelic(v.part.selectExpr("p_partkey AS site", "'G' AS ref", "concat('A,', p_brand, ',C') AS alts"))).select("site", "alts")


@query("multiallelic_atomize", "SELECT site, CAST(i AS INTEGER) AS i, r, a FROM (SELECT p_partkey AS site, unnest(range(1, 5)) AS i, unnest(['A', 'C', 'G', 'T']) AS r, unnest(['A', CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'T' END, 'C', 'T']) AS a FROM {part}) WHERE r <> a")
def _(v):
    return gw.atomize(v.part.selectExpr("p_partkey AS site", "'ACGT' AS ref", "concat('A', CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'T' END, 'CT') AS alt"))


@query("qq_manhattan_data", "WITH r AS (SELECT *, row_number() OVER (ORDER BY p, snp) AS r, count(*) OVER () AS n FROM {assoc}), l AS (SELECT chrom, max(bp) AS size FROM {assoc} GROUP BY chrom), s AS (SELECT chrom, coalesce(sum(size) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM l) SELECT snp, round(-log10(p), 9) AS observed, round(-log10((r - 0.5) / n), 9) AS expected, CAST(bp + shift AS BIGINT) AS place FROM r JOIN s USING (chrom)")
def _(v):
    return gw.qq_data(v.assoc).select("snp", F.round("observed", 9).alias("observed"), F.round("expected", 9).alias("expected"), "place")


@query("duplicate_ids", "SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING count(*) > 1")
def _(v):
    return gw.duplicate_ids(v.lineitem, "l_orderkey")


@query("covariate_join", "SELECT c_custkey AS sample, c_acctbal AS pc1, s_acctbal AS ploidy FROM {customer} JOIN {supplier} ON c_custkey = s_suppkey")
def _(v):
    return gw.covariates(v.customer.selectExpr("c_custkey AS sample", "c_acctbal AS pc1"), v.supplier.selectExpr("s_suppkey AS sample", "s_acctbal AS ploidy"))


@query("complex_trait_filter", "SELECT c_custkey, c_mktsegment AS pheno FROM {customer} WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM {customer} WHERE c_acctbal / 1e7 <= 1e-6 AND c_nationkey = 3)")
def _(v):
    pheno = v.customer.selectExpr("c_custkey", "c_mktsegment AS pheno")
    return gw.without_strong(pheno, v.customer.filter("c_nationkey = 3").selectExpr("c_mktsegment AS pheno", "c_acctbal / 1e7 AS p"), 1e-6)


@query("heritability_pivot", "SELECT c_custkey AS pheno, 'k1' AS kinships, c_acctbal AS Her_All, c_acctbal + 1 AS Her_SNPs FROM {customer}")
def _(v):
    lines = v.customer.selectExpr("c_custkey AS pheno", "'k1' AS kinships", "explode(array(concat('Her_All ', c_acctbal), concat('Her_SNPs ', c_acctbal + 1), 'Other 3')) AS value")
    return gw.heritability_pivot(lines, ["Her_All", "Her_SNPs"])


@query("model_grid", "SELECT DISTINCT c_mktsegment AS pheno, r_name AS kinship FROM {customer} CROSS JOIN {region}")
def _(v):
    return gw.model_grid(v.customer.selectExpr("c_mktsegment AS pheno").distinct(), v.region.selectExpr("r_name AS kinship"))


@query("kinship", DOSE + ", f AS (SELECT variant, avg(dose) / 2 AS f FROM ds GROUP BY variant HAVING avg(dose) / 2 > 0 AND avg(dose) / 2 < 1), z AS (SELECT variant, sample, (dose - 2 * f) * pow(2 * f * (1 - f), -0.125) AS z FROM ds JOIN f USING (variant)) SELECT a.sample AS a, b.sample AS b, round(avg(a.z * b.z), 9) AS k FROM z a JOIN z b ON a.variant = b.variant AND a.sample <= b.sample GROUP BY ALL")
def _(v):
    return gw.kinship(dosage(v)).withColumn("k", F.round("k", 9))


DISS = DOSE + ", dd AS (SELECT a.sample AS a, b.sample AS b, avg(abs(a.dose - b.dose)) / 2 AS d FROM ds a JOIN ds b ON a.variant = b.variant AND a.sample < b.sample GROUP BY ALL)"


@query("dissimilarity", DISS + " SELECT a, b, round(d, 9) AS d FROM dd")
def _(v):
    return gw.dissimilarity(dosage(v)).withColumn("d", F.round("d", 9))


def tree(v):
    d = gw.dissimilarity(dosage(v))
    return d.sparkSession, gw.neighbour_joining(d)


@query("nj_tree")
def _(v):
    spark, joins = tree(v)
    return spark.createDataFrame([(a, b, round(x, 9), round(y, 9)) for a, b, x, y in joins], "a long, b long, da double, db double")


@query("tree_newick")
def _(v):
    """The tree written as a Newick text and read again, a row for each node."""
    from ..storage import fresh_path
    from ..operators.trees import newick, read_newick, write_newick

    spark, joins = tree(v)
    path = fresh_path(spark, "newick")
    write_newick(spark, [newick(joins, {r.n_nationkey: r.n_name for r in v.nation.collect()})], path)
    return read_newick(spark, path).select("node", "parent", "name", F.round("length", 9).alias("length"))


@query("pca")
def _(v):
    parts = gw.principal_components(gw.kinship(dosage(v)), 4)
    return parts.select("sample", *(F.round(f"pc{i}", 6).alias(f"pc{i}") for i in range(1, 5)))


@query("reml")
def _(v):
    """Variance of the nations' mean balances by the kinships of two classes of variants."""
    doses = dosage(v)
    kinships = {name: gw.kinship(doses.filter(f"variant % 3 {test} 0"), -1.0) for name, test in (("Her_SNPs", "="), ("Her_SVs", "<>"))}
    phenotypes = v.customer.groupBy(F.col("c_nationkey").cast("long").alias("sample")).agg(F.avg("c_acctbal").alias("value"))
    return gw.reml(kinships, phenotypes).select("name", F.round("share", 6).alias("share"))


@query("kinship_pruned", PRUNE[: PRUNE.rindex("\nSELECT")] + ", kp AS (SELECT * FROM ds WHERE variant IN (SELECT variant FROM e)), f AS (SELECT variant, avg(dose) / 2 AS f FROM kp GROUP BY variant HAVING avg(dose) / 2 > 0 AND avg(dose) / 2 < 1), z AS (SELECT variant, sample, (dose - 2 * f) * pow(2 * f * (1 - f), -0.125) AS z FROM kp JOIN f USING (variant)) SELECT a.sample AS a, b.sample AS b, round(avg(a.z * b.z), 9) AS k FROM z a JOIN z b ON a.variant = b.variant AND a.sample <= b.sample GROUP BY ALL")
def _(v):
    """Kinship of the variants that pruning by linkage leaves."""
    kept = gw.ld_prune(pairs(v), sites(v)).filter("kept")
    return gw.kinship(dosage(v), kept=kept).withColumn("k", F.round("k", 9))
