"""Queries of the similarity-hit and assembly operators."""

from pyspark.sql import functions as F

from ..operators import assembly as asm
from ..operators import hits as h
from .interval_queries import united
from .registry import query


def covered(name: str, src: str, keys: str, start: str, end: str, less: int = 1, more: int = 0) -> str:
    """Relation `name` with the union bases of inclusive ranges."""
    ranges = f"{name}rng AS (SELECT {keys}, least({start}, {end}) - {less} AS lo, greatest({start}, {end}) + {more} AS hi FROM {src})"
    return f"{ranges}, {united(name + 'u', name + "rng", keys)}, {name} AS (SELECT {keys}, sum(hi - lo) AS b FROM {name}u GROUP BY {keys})"


PAIRS = "WITH " + covered("q", "{SRC}", "qseqid, sseqid", "qstart", "qend") + ", " + covered("s", "{SRC}", "qseqid, sseqid", "sstart", "send") + """,
z AS (SELECT qseqid, sseqid, arg_min(qlen, ord) AS qlen, arg_min(slen, ord) AS slen FROM {SRC} GROUP BY qseqid, sseqid),
pc AS (SELECT z.qseqid, z.sseqid, CAST(100 AS DOUBLE) * q.b / qlen AS qcov, CAST(100 AS DOUBLE) * s.b / slen AS scov FROM z JOIN q USING (qseqid, sseqid) JOIN s USING (qseqid, sseqid))"""
ALL_PAIRS = PAIRS.replace("{SRC}", "{hit}")
EVIDENCE = ALL_PAIRS + """, ev AS (SELECT pc.*, e.evalue, e.at_start, e.at_end FROM pc JOIN (SELECT qseqid, sseqid, min(evalue) AS evalue, bool_or(least(sstart, send) <= 10) AS at_start, bool_or(greatest(sstart, send) > slen - 10) AS at_end FROM {hit} GROUP BY qseqid, sseqid) e USING (qseqid, sseqid)),
cl AS (SELECT *, CASE WHEN scov >= 80 THEN 'complete' WHEN qcov >= 80 AND at_start AND at_end THEN 'complete' WHEN scov >= 30 AND at_start AND at_end THEN 'complete' WHEN qcov >= 90 THEN 'truncated' WHEN scov >= 50 THEN 'truncated' ELSE 'none' END AS class FROM ev)"""


@query("hits_pair_coverage", ALL_PAIRS + " SELECT qseqid, sseqid, qcov, scov FROM pc")
def _(v):
    return h.pair_coverage(v.hit)


@query("hits_orthologs", PAIRS.replace("{SRC}", "ns").replace("WITH ", "WITH ns AS (SELECT * FROM {hit} WHERE qseqid <> sseqid), ", 1) + " SELECT qseqid, sseqid, qcov, scov FROM pc WHERE (qcov >= 50 AND scov >= 50) OR scov >= 90 OR qcov >= 90")
def _(v):
    return h.orthologs(v.hit)


@query("hits_subject_cov_join", ALL_PAIRS + " SELECT ord, qseqid, sseqid, scov AS scovq FROM {hit} LEFT JOIN pc USING (qseqid, sseqid)")
def _(v):
    return h.with_subject_coverage(v.hit).select("ord", "qseqid", "sseqid", "scovq")


@query("hits_min_identity_cov", "SELECT ord, qseqid, sseqid FROM {hit} WHERE pident >= 30 AND qcovs >= 50")
def _(v):
    return h.min_identity_coverage(v.hit).select("ord", "qseqid", "sseqid")


@query("hits_best_first", "SELECT qseqid, arg_min(sseqid, ord) AS sseqid, arg_min(nullif(qcovs, 20), ord) FILTER (WHERE nullif(qcovs, 20) IS NOT NULL) AS qcovs FROM {hit} GROUP BY qseqid")
def _(v):
    return h.best_first(v.hit.withColumn("qcovs", F.expr("nullif(qcovs, 20)")), ["sseqid", "qcovs"])


@query("hits_annotation_transfer", EVIDENCE + " SELECT qseqid, sseqid, evalue, at_start, at_end, qcov, scov FROM ev")
def _(v):
    return h.annotation_evidence(v.hit)


@query("hits_classify", EVIDENCE + " SELECT qseqid, sseqid, class FROM cl")
def _(v):
    return h.classify(h.annotation_evidence(v.hit)).select("qseqid", "sseqid", "class")


@query("hits_pick_reference", EVIDENCE + """, l AS (SELECT *, CASE class WHEN 'complete' THEN 0 ELSE 1 END AS lv FROM cl WHERE class <> 'none'), r AS (SELECT *, rank() OVER (PARTITION BY qseqid ORDER BY lv, evalue, qcov DESC) AS k FROM l),
n AS (SELECT qseqid, string_agg(sseqid, '/' ORDER BY sseqid) || CASE WHEN min(lv) = 1 THEN '_truncated' ELSE '' END AS name FROM r WHERE k = 1 GROUP BY qseqid) SELECT q.qseqid, coalesce(n.name, q.qseqid) AS name FROM (SELECT DISTINCT qseqid FROM {hit}) q LEFT JOIN n USING (qseqid)""")
def _(v):
    return h.pick_reference(h.classify(h.annotation_evidence(v.hit)), v.hit)


@query("hits_te_related", "WITH g AS (SELECT * FROM {hit} WHERE pident >= 95), " + covered("q", "g", "qseqid", "qstart", "qend") + " SELECT q.qseqid FROM q JOIN (SELECT qseqid, arg_min(qlen, ord) AS qlen FROM g GROUP BY qseqid) z USING (qseqid) WHERE 100 * b >= 50 * qlen")
def _(v):
    return h.te_related(v.hit)


@query("hits_identical_regions", "SELECT qseqid AS gene1, qstart - 1 AS start1, qend AS end1, sseqid AS gene2, sstart - 1 AS start2, send AS end2 FROM {hit} WHERE qseqid <> sseqid")
def _(v):
    return h.identical_regions(v.hit)


@query("hits_self_dedupe_edges", "SELECT DISTINCT qseqid, sseqid FROM {hit} WHERE qseqid <> sseqid AND qcovs >= 50")
def _(v):
    return h.self_edges(v.hit)


@query("hits_threshold_ids", "SELECT DISTINCT qseqid FROM {hit} WHERE qcovs > 98")
def _(v):
    return h.ids_above(v.hit, "qcovs", 98)


@query("hits_non_reference_only", "SELECT ord, sseqid FROM {hit} WHERE sseqid LIKE 'q%'")
def _(v):
    return h.subjects_with_prefix(v.hit, "q").select("ord", "sseqid")


CHR = "WITH " + covered("c", "{coords}", "asm, ref", "ref_start", "ref_end", 0, 1) + ", cov AS (SELECT a.asm, k.ref, CAST(100 AS DOUBLE) * coalesce(c.b, 0) / k.len AS coverage FROM (SELECT DISTINCT asm FROM {coords}) a CROSS JOIN {chromosome} k LEFT JOIN c ON c.asm = a.asm AND c.ref = k.ref)"


@query("asm_ref_coverage", CHR + " SELECT asm, ref, coverage FROM cov")
def _(v):
    return asm.chromosome_coverage(v.coords, v.chromosome)


@query("asm_nb_chr_present", CHR + " SELECT asm, count(*) FILTER (WHERE coverage >= CASE ref WHEN 'ref3' THEN 5 ELSE 1 END) AS n_present FROM cov GROUP BY asm")
def _(v):
    own = v.chromosome.filter("ref = 'ref3'").select("ref", F.lit(5.0).alias("threshold"))
    return asm.chromosomes_present(asm.chromosome_coverage(v.coords, v.chromosome), 1, own)


@query("asm_contigs_to_x", "WITH " + covered("o", "{coords}", "asm, qry, ref", "ref_start", "ref_end", 0, 1) + """, own AS (SELECT asm, qry, sum(b) AS own FROM o GROUP BY asm, qry),
rk AS (SELECT k.asm, k.qry, row_number() OVER (PARTITION BY k.asm ORDER BY coalesce(own, 0) DESC, ord DESC) AS r FROM {contig} k LEFT JOIN own USING (asm, qry)),
p AS (SELECT u.asm, u.ref, u.lo, u.hi, rk.r FROM ou u JOIN rk USING (asm, qry)), x AS (SELECT asm, ref, lo AS x FROM p UNION SELECT asm, ref, hi FROM p),
sg AS (SELECT asm, ref, x, lead(x) OVER (PARTITION BY asm, ref ORDER BY x) AS y FROM x), f AS (SELECT sg.asm, sg.ref, sg.x, sg.y, min(r) AS r FROM sg JOIN p ON p.asm = sg.asm AND p.ref = sg.ref AND lo <= x AND y <= hi GROUP BY ALL),
t AS (SELECT asm, r, sum(sum(y - x)) OVER (PARTITION BY asm ORDER BY r) AS total FROM f GROUP BY asm, r)
SELECT a.asm, (SELECT min(r) FROM t WHERE t.asm = a.asm AND 100 * total >= 2 * (SELECT sum(len) FROM {chromosome})) AS n FROM (SELECT DISTINCT asm FROM {coords}) a""")
def _(v):
    return asm.contigs_to_coverage(v.coords, v.contig, v.chromosome, 2)


@query("asm_double_centromere", "SELECT k.asm, count(*) FILTER (WHERE n > 1) AS n FROM {contig} k LEFT JOIN (SELECT asm, qry, count(*) AS n FROM {coords} WHERE ref = 'ref5' GROUP BY asm, qry) USING (asm, qry) GROUP BY k.asm")
def _(v):
    return asm.double_centromeres(v.contig, v.coords.filter("ref = 'ref5'"))


@query("asm_merged_chr", "WITH " + covered("o", "{coords}", "asm, qry, ref", "ref_start", "ref_end", 0, 1) + ", k AS (SELECT asm, qry, count(*) FILTER (WHERE 100 * b >= 0.2 * len) AS k FROM o JOIN {chromosome} USING (ref) GROUP BY asm, qry) SELECT asm, count(*) FILTER (WHERE k > 1) AS n FROM k GROUP BY asm")
def _(v):
    return asm.merged_chromosomes(v.coords, v.chromosome, 0.2)


@query("asm_nuclear_split", "SELECT k.asm, k.qry, len >= 53000 AND coalesce(best, 0) >= 98 AS nuclear FROM {contig} k LEFT JOIN (SELECT asm, qry, max(abs(qry_end - qry_start) + 1) AS best FROM {coords} GROUP BY asm, qry) USING (asm, qry)")
def _(v):
    return asm.nuclear_split(v.contig, v.coords, 53_000, 98).select("asm", "qry", "nuclear")


@query("asm_remove_redundant")
def _(v):
    hits = v.coords.selectExpr("asm", "qry", "concat('ctg', substring(ref, 4)) AS other", "least(qry_start, qry_end) AS lo", "least(qry_start, qry_end) + 3000 AS hi")
    return asm.remove_redundant(hits, v.contig, 60)


NAMES = "WITH " + covered("o", "{coords}", "asm, qry, ref", "ref_start", "ref_end", 0, 1) + ", " + covered("w", "{coords}", "asm, qry, ref", "qry_start", "qry_end", 0, 1) + """,
m AS (SELECT o.*, k.ord AS ro FROM o JOIN {chromosome} k USING (ref) JOIN {contig} c ON c.asm = o.asm AND c.qry = o.qry WHERE b >= least(CAST(300 AS DOUBLE), 20 * k.len / CAST(100 AS DOUBLE), 50 * c.len / CAST(100 AS DOUBLE))),
cr AS (SELECT asm, qry, ref, sum((lo + hi - 1) * CAST(0.5 AS DOUBLE) * (hi - lo)) / sum(hi - lo) AS ar FROM ou GROUP BY asm, qry, ref), cq AS (SELECT asm, qry, ref, sum((lo + hi - 1) * CAST(0.5 AS DOUBLE) * (hi - lo)) / sum(hi - lo) AS aq FROM wu GROUP BY asm, qry, ref),
nn AS (SELECT asm, qry, ref, ro, aq, count(*) OVER (PARTITION BY asm, ref) AS k, rank() OVER (PARTITION BY asm, ref ORDER BY ar) AS r FROM m JOIN cr USING (asm, qry, ref) JOIN cq USING (asm, qry, ref)),
nm AS (SELECT asm, qry, string_agg(CASE WHEN k > 1 THEN concat(ref, '.', r) ELSE ref END, '_' ORDER BY aq, ro) AS name FROM nn GROUP BY asm, qry)
SELECT asm, qry, concat('YS_', coalesce(name, concat('Unplaced.', row_number() OVER (PARTITION BY asm, name IS NULL ORDER BY ord)))) AS name FROM {contig} LEFT JOIN nm USING (asm, qry)"""


@query("asm_rename", NAMES)
def _(v):
    return asm.rename_contigs(v.coords, v.contig, v.chromosome, 300, 20, 50, "YS_")


@query("asm_reorder", """WITH t AS (SELECT asm, qry, ref, sum(abs(qry_end - qry_start) + 1) AS total, sum(CASE WHEN qry_start <= qry_end THEN abs(qry_end - qry_start) + 1 ELSE 0 END) AS plus, max((abs(qry_end - qry_start) + 1, -ref_start, -ref_end)) AS lg FROM {coords} GROUP BY asm, qry, ref),
b AS (SELECT t.*, row_number() OVER (PARTITION BY asm, qry ORDER BY total DESC, k.ord) AS r FROM t JOIN {chromosome} k USING (ref)),
j AS (SELECT c.asm, c.qry, c.ord, coalesce(ref, (SELECT arg_min(ref, ord) FROM {chromosome})) AS ref, CAST(coalesce(floor((-lg[2] - lg[3]) / 2), 0) AS BIGINT) AS place, CASE WHEN plus > total - plus THEN 'F' ELSE 'R' END AS strand FROM {contig} c LEFT JOIN b ON b.asm = c.asm AND b.qry = c.qry AND r = 1)
SELECT j.asm, j.qry, j.ref, place, strand, row_number() OVER (PARTITION BY j.asm ORDER BY k.ord, place, j.ord) AS rank FROM j JOIN {chromosome} k USING (ref)""")
def _(v):
    return asm.reorder_contigs(v.coords, v.contig, v.chromosome)


@query("asm_collect_last_rows", "SELECT l_suppkey AS file, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS value FROM {lineitem} GROUP BY l_suppkey")
def _(v):
    return asm.last_rows(v.lineitem.select(F.col("l_suppkey").alias("file"), F.col("l_extendedprice").alias("value"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("line")))


@query("asm_pick_draft", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END AS draft FROM {part}")
def _(v):
    return asm.pick_draft(v.part.selectExpr("p_partkey", "p_size % 3 AS n_merged", "p_name AS scaffolded", "p_brand AS polished")).select("p_partkey", "draft")


@query("asm_name_equivalence", "SELECT c_custkey, coalesce(n_name, c_mktsegment) AS name FROM {customer} LEFT JOIN {nation} ON c_custkey = n_nationkey")
def _(v):
    keyed = v.customer.selectExpr("c_custkey", "c_mktsegment", "CAST(c_custkey AS STRING) AS name")
    out = asm.name_equivalence(keyed, v.nation.selectExpr("CAST(n_nationkey AS STRING) AS old", "n_name AS new"), "name")
    return out.selectExpr("c_custkey", "CASE WHEN name = CAST(c_custkey AS STRING) THEN c_mktsegment ELSE name END AS name")


@query("asm_quality_filter", "SELECT c.c_custkey AS strain, coalesce(a.qv, b.qv) AS qv FROM {customer} c LEFT JOIN (SELECT s_suppkey AS strain, s_acctbal / 100 AS qv FROM {supplier}) a ON a.strain = c.c_custkey LEFT JOIN (SELECT c_custkey AS strain, c_acctbal / 100 AS qv FROM {customer}) b ON b.strain = c.c_custkey WHERE coalesce(a.qv, b.qv) >= 40")
def _(v):
    first = v.supplier.selectExpr("s_suppkey AS strain", "s_acctbal / 100 AS qv")
    second = v.customer.selectExpr("c_custkey AS strain", "c_acctbal / 100 AS qv")
    return asm.quality_filter(v.customer.selectExpr("c_custkey AS strain"), first, second)


@query("asm_busco_score", "SELECT p_partkey, CAST(p_size AS DOUBLE) + p_size / CAST(2 AS DOUBLE) AS score FROM {part}")
def _(v):
    return asm.busco_score(v.part.selectExpr("p_partkey", "concat('C:99%[S:', CAST(p_size AS DOUBLE), '%,D:', p_size / CAST(2 AS DOUBLE), '%]') AS value")).select("p_partkey", "score")


@query("asm_qv_collect", "SELECT s_suppkey AS asm, s_acctbal AS qv FROM {supplier} WHERE s_nationkey % 3 = 0")
def _(v):
    return asm.qv_collect(v.supplier.selectExpr("s_suppkey AS asm", "s_acctbal AS qv", "CASE WHEN s_nationkey % 3 = 0 THEN 'Both' ELSE 'HP1' END AS name"), True)
