"""Queries of the graph and structural-variant operators."""

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import variants as vr
from .interval_queries import united
from .registry import query

CC = """WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {edge} UNION SELECT dst, src FROM {edge}), w AS (SELECT id, id AS r FROM {node} UNION SELECT w.id, e.b FROM w JOIN e ON w.r = e.a), cc AS (SELECT id, min(r) AS component FROM w GROUP BY id),
se AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM {edge})"""


def cc(v):
    return g.components_with_nodes(v.node, v.edge)


@query("graph_components", CC + " SELECT id, component FROM cc")
def _(v):
    return cc(v)


@query("graph_density", CC + ", n AS (SELECT component, count(*) AS n FROM cc GROUP BY component), m AS (SELECT component, count(*) AS m FROM se JOIN cc ON src = id GROUP BY component) SELECT component, n, coalesce(m, 0) AS m, CASE WHEN n > 1 THEN CAST(2 AS DOUBLE) * coalesce(m, 0) / (n * (n - 1)) END AS density FROM n LEFT JOIN m USING (component)")
def _(v):
    return g.density(cc(v), v.edge)


@query("graph_split_sparse")
def _(v):
    return g.communities(v.node, v.edge)


@query("graph_degree", CC + " SELECT id, count(src) AS degree FROM {node} LEFT JOIN se ON id = src OR id = dst GROUP BY id")
def _(v):
    return g.degree(v.node, v.edge)


@query("graph_representative", CC + ", d AS (SELECT n.id, n.len, n.is_ref, cc.component AS grp, (SELECT count(*) FROM se WHERE src = n.id OR dst = n.id) AS degree FROM {node} n JOIN cc USING (id)) SELECT grp, id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY is_ref DESC, degree DESC, len DESC, id) AS r FROM d) WHERE r = 1")
def _(v):
    return g.representative(v.node.join(cc(v).withColumnRenamed("component", "grp"), "id").join(g.degree(v.node, v.edge), "id"))


@query("graph_component_label", CC + " SELECT id, concat('LD_', dense_rank() OVER (ORDER BY component)) AS label FROM cc")
def _(v):
    return g.label_components(cc(v))


@query("graph_redundancy_peel")
def _(v):
    genes = v.part.selectExpr("p_partkey AS id", "CAST(p_size AS BIGINT) + 80 AS len")
    regions = v.part.selectExpr("p_partkey AS id", "p_partkey + 1 AS other", "0 AS lo", "CAST(p_size AS BIGINT) AS hi").filter("id % 4 <> 3")
    both = regions.unionByName(regions.selectExpr("other AS id", "id AS other", "lo", "hi"))
    return g.redundancy_peel(genes, both).select("id")


@query("graph_longest_per_component", CC + ", j AS (SELECT cc.component, n.* FROM cc JOIN {node} n USING (id)) SELECT component, arg_max(id, (len, -id)) AS id, CASE WHEN bool_or(is_ref) THEN '_InRef' ELSE '_OutRef' END AS tag FROM j GROUP BY component")
def _(v):
    return g.longest_per_component(cc(v), v.node)


_SEG = "WITH RECURSIVE l AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 3 AS b FROM {part} WHERE p_partkey + 1 + p_size % 3 IN (SELECT p_partkey FROM {part})), d AS (SELECT p_partkey AS id FROM {part} WHERE p_size < 5), w AS (SELECT a, b FROM l WHERE a NOT IN (SELECT id FROM d) UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a WHERE w.b IN (SELECT id FROM d)) SELECT a AS id1, b AS id2 FROM w WHERE b NOT IN (SELECT id FROM d)"


def _graph(v):
    ids = v.part.select(F.col("p_partkey").alias("id2"))
    links = v.part.selectExpr("p_partkey AS id1", "'+' AS dir1", "p_partkey + 1 + p_size % 3 AS id2", "'+' AS dir2").join(ids, "id2", "left_semi")
    return v.part.selectExpr("p_partkey AS id", "p_size AS size"), links


@query("graph_trim_short_segments", _SEG)
def _(v):
    segments, links = _graph(v)
    return g.trim_segments(segments, links, segments.filter("size < 5"))[1].select("id1", "id2").distinct()


@query("graph_filter_segments", _SEG.replace("p_size < 5", "p_partkey % 4 = 1"))
def _(v):
    segments, links = _graph(v)
    return g.trim_segments(segments, links, segments.filter("id % 4 = 1"))[1].select("id1", "id2").distinct()


def _walks(v):
    return v.part.selectExpr("p_partkey", "concat('>', p_partkey, CASE WHEN p_size % 2 = 0 THEN '>' ELSE '<' END, p_partkey * 3, '>', p_size, ',<', p_size, '>7') AS walk")


@query("graph_links_from_paths", """SELECT DISTINCT id1, dir1, id2, dir2 FROM (SELECT CAST(p_partkey AS STRING) AS id1, '+' AS dir1, CAST(p_partkey * 3 AS STRING) AS id2, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS dir2 FROM {part}
UNION ALL SELECT CAST(p_partkey * 3 AS STRING), CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END, CAST(p_size AS STRING), '+' FROM {part} UNION ALL SELECT CAST(p_size AS STRING), '-', '7', '+' FROM {part})""")
def _(v):
    return g.links_from_walks(_walks(v))


@query("graph_segments_from_paths", "SELECT CAST(l_partkey AS STRING) AS id FROM {lineitem} WHERE l_partkey = 7 OR l_partkey IN (SELECT p_partkey FROM {part} UNION SELECT p_partkey * 3 FROM {part} UNION SELECT p_size FROM {part})")
def _(v):
    return g.segments_from_walks(_walks(v), v.lineitem.selectExpr("CAST(l_partkey AS STRING) AS id"))


@query("graph_edge_persist", "SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM {edge} GROUP BY ALL")
def _(v):
    return g.cut_lineage(g.simple_edges(v.edge), "edges")


BP = "WITH bp AS (SELECT event_id AS variant, type, chrom, pos, len, CASE WHEN type = 'TRA' THEN mate_chrom ELSE chrom END AS chrom2, CASE WHEN type = 'TRA' THEN mate_pos WHEN type IN ('DEL', 'DUP', 'CONTR', 'INV') THEN pos + len ELSE pos END AS pos2 FROM {sv})"
GRID = ", ch AS (SELECT DISTINCT chrom, 101000 AS size FROM {sv}), grid AS (SELECT chrom, k * 5000 AS start, least(k * 5000 + 10000, size) AS stop FROM ch, unnest(range(0, 1000)) AS t(k) WHERE k * 5000 < greatest(size + 5000 - 10000, 1))"
ASSIGN = GRID + ", asg AS (SELECT variant, g.chrom, g.start, g.stop FROM bp JOIN grid g ON (bp.chrom = g.chrom AND pos BETWEEN start AND stop) OR (chrom2 = g.chrom AND pos2 BETWEEN start AND stop) OR (type <> 'TRA' AND bp.chrom = chrom2 AND bp.chrom = g.chrom AND pos <= start AND pos2 >= stop))"


def svs(v):
    unpacked = vr.unpack_id(v.packed_sv)
    return vr.second_breakpoint(unpacked).withColumnRenamed("event_id", "variant").drop("id", "n", "info")


def sizes(v):
    return v.sv.select("chrom").distinct().withColumn("size", F.lit(101_000))


def grid(v):
    return vr.window_grid(sizes(v), 10_000, 5_000)


def assigned(v):
    return vr.window_assign(svs(v), grid(v), 10_000, 5_000)


@query("vcf_second_breakpoint", BP + " SELECT variant, type, chrom, pos, chrom2, pos2 FROM bp")
def _(v):
    return svs(v).select("variant", "type", "chrom", "pos", "chrom2", "pos2")


@query("vcf_split_haplotypes", "SELECT p_partkey, 1 AS hap, CAST(p_size % 2 AS STRING) AS allele FROM {part} UNION ALL SELECT p_partkey, 2, CAST(p_size % 3 AS STRING) FROM {part}")
def _(v):
    return vr.split_haplotypes(v.part.selectExpr("p_partkey", "concat(p_size % 2, '|', p_size % 3) AS gt"))


@query("window_grid", BP + GRID + " SELECT chrom, start, stop FROM grid")
def _(v):
    return grid(v).withColumnRenamed("end", "stop")


@query("window_assign", BP + ASSIGN + " SELECT DISTINCT variant, chrom, start, stop FROM asg")
def _(v):
    return assigned(v).withColumnRenamed("end", "stop")


@query("theta_pi", BP + ASSIGN + ", c AS (SELECT variant, allele, count(*) AS k FROM {gt} GROUP BY ALL), s AS (SELECT variant, sum(k) AS n, sum(k * k) AS q FROM c GROUP BY variant) SELECT chrom, start, stop, round(sum((1 - q / CAST(n * n AS DOUBLE)) * n / (n - 1) / 10000), 12) AS value FROM asg JOIN s USING (variant) GROUP BY chrom, start, stop")
def _(v):
    return vr.sliding_theta_pi(svs(v), v.gt, sizes(v), 10_000, 5_000).select("chrom", "start", F.col("end").alias("stop"), F.round("value", 12).alias("value"))


@query("theta_s", BP + ASSIGN + " SELECT chrom, start, stop, round(count(*) / (SELECT sum(1 / CAST(i AS DOUBLE)) FROM range(1, 10) t(i)) / 10000, 12) AS value FROM asg GROUP BY chrom, start, stop")
def _(v):
    return vr.sliding_theta_s(svs(v), 10, sizes(v), 10_000, 5_000).select("chrom", "start", F.col("end").alias("stop"), F.round("value", 12).alias("value"))


HAPS = ", hs AS (SELECT chrom, start, stop, sample, hap, string_agg(allele, '' ORDER BY variant) AS h FROM (SELECT DISTINCT * FROM asg) a JOIN (SELECT variant, sample, hap, allele FROM {gt}) USING (variant) GROUP BY ALL), hc AS (SELECT chrom, start, stop, h, count(*) AS k FROM hs GROUP BY ALL)"


@query("gene_diversity", BP + ASSIGN + HAPS + ", q AS (SELECT chrom, start, stop, sum(k) AS n, sum(k * k) AS q FROM hc GROUP BY ALL) SELECT chrom, start, stop, round(coalesce((1 - q / CAST(n * n AS DOUBLE)) * n / (n - 1), 0), 12) AS value FROM grid LEFT JOIN q USING (chrom, start, stop)")
def _(v):
    return vr.sliding_gene_diversity(svs(v), v.gt, sizes(v), 10_000, 5_000).select("chrom", "start", F.col("end").alias("stop"), F.round("value", 12).alias("value"))


@query("region_haplotypes", BP + """, r AS (SELECT variant FROM bp WHERE (chrom = 'chromosome3' OR chrom2 = 'chromosome3') AND (pos BETWEEN 20000 AND 60000 OR pos2 BETWEEN 20000 AND 60000 OR (chrom = chrom2 AND pos <= 20000 AND pos2 >= 60000))),
s AS (SELECT sample, hap, string_agg(allele, '' ORDER BY variant) AS haplotype FROM r JOIN {gt} USING (variant) GROUP BY ALL) SELECT md5(haplotype) AS haplotype, count(*) AS k FROM s GROUP BY haplotype""")
def _(v):
    region = vr.in_region(svs(v), "chromosome3", 20_000, 60_000).selectExpr("variant", "'chromosome3' AS chrom", "20000 AS start", "60000 AS end")
    return vr.haplotype_counts(region, v.gt).select(F.md5("haplotype").alias("haplotype"), "k")


@query("sv_type_filter", "SELECT event_id, type FROM {sv} WHERE type IN ('INS', 'DEL')")
def _(v):
    return vr.of_types(v.sv, ["INS", "DEL"]).select("event_id", "type")


def support(v):
    packed = v.events.selectExpr("event_id AS id", "concat_ws('', transform(sequence(0, 24), i -> CAST(CASE WHEN (event_id * 7 + i * 13) % 11 < 2 THEN 1 ELSE 0 END AS STRING))) AS supp_vec")
    return vr.support_vector(packed, v.nation.selectExpr("n_nationkey AS ord", "concat('s', CAST(floor(n_nationkey / 2) AS BIGINT), CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '_2' END) AS strain"))


SUPPORT = "WITH su AS (SELECT event_id AS id, concat('s', n_nationkey // 2, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '_2' END) AS strain, CASE WHEN (event_id * 7 + n_nationkey * 13) % 11 < 2 THEN 1 ELSE 0 END AS present FROM {events} CROSS JOIN {nation})"


@query("sv_support_vector", SUPPORT + " SELECT id, strain, present FROM su")
def _(v):
    return support(v)


@query("sv_confirm_singletons", SUPPORT + ", b AS (SELECT id, count(*) AS k, min(strain) AS only FROM su WHERE present = 1 AND strain NOT LIKE '%\\_2' ESCAPE '\\' GROUP BY id) SELECT b.id FROM b LEFT JOIN su ON su.id = b.id AND su.strain = concat(b.only, '_2') AND su.present = 1 WHERE k > 1 OR su.id IS NOT NULL")
def _(v):
    s = support(v)
    return vr.confirm_singletons(s, s.filter("not endswith(strain, '_2')").select("strain").distinct())


@query("sv_phase_genotypes", "SELECT event_id AS id, concat('t', r) AS sample, CASE WHEN r = 0 THEN concat(event_id % 2, '|', event_id % 2) ELSE concat(event_id % 3 % 2, '|', event_id % 5 % 2) END AS gt FROM {events}, (VALUES (0), (1)) t(r)")
def _(v):
    e = v.events
    rows = e.selectExpr("event_id AS id", "'t0' AS strain", "event_id % 2 AS present").unionByName(e.selectExpr("event_id AS id", "'t1.HP1' AS strain", "event_id % 3 % 2 AS present")).unionByName(e.selectExpr("event_id AS id", "'t1.HP2' AS strain", "event_id % 5 % 2 AS present"))
    return vr.phase_genotypes(rows)


TRA = BP + """, tr AS (SELECT variant AS id, CASE WHEN (CAST(substring(chrom, 11) AS INT), pos) <= (CAST(substring(chrom2, 11) AS INT), pos2) THEN (chrom, pos, chrom2, pos2) ELSE (chrom2, pos2, chrom, pos) END AS t FROM bp WHERE type = 'TRA'),
o AS (SELECT id, t[1] AS chrom, t[2] AS pos, t[3] AS chrom2, t[4] AS pos2, greatest(least(t[2], 110000 - t[2]), least(t[4], 110000 - t[4])) AS length FROM tr)"""


def tra(v):
    rows = vr.order_breakpoints(svs(v).filter("type = 'TRA'").withColumnRenamed("variant", "id"))
    names = v.sv.select("chrom").union(v.sv.select("mate_chrom")).distinct()
    return vr.translocation_length(rows, names.withColumn("size", F.lit(110_000))).select("id", "chrom", "pos", "chrom2", "pos2", "length")


@query("tra_order_breakpoints", TRA + " SELECT id, chrom, pos, chrom2, pos2 FROM o")
def _(v):
    return tra(v).drop("length")


@query("tra_length", TRA + " SELECT id, length FROM o")
def _(v):
    return tra(v).select("id", "length")


LINKS = TRA + ", lk AS (SELECT a.id AS src, b.id AS dst FROM o a JOIN o b ON a.chrom = b.chrom AND a.chrom2 = b.chrom2 AND a.id < b.id AND abs(a.pos - b.pos) < 6000 AND abs(a.pos2 - b.pos2) < 6000)"


@query("tra_link", LINKS + " SELECT src, dst FROM lk")
def _(v):
    return vr.link_translocations(tra(v), 6_000)


@query("tra_merge", LINKS.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT src AS a, dst AS b FROM lk UNION SELECT dst, src FROM lk), w AS (SELECT id, id AS r FROM o UNION SELECT w.id, e.b FROM w JOIN e ON w.r = e.a), c AS (SELECT id, min(r) AS component FROM w GROUP BY id)
SELECT component, min(chrom) AS chrom, CAST(round_even(avg(pos), 0) AS BIGINT) AS pos, CAST(round_even(avg(pos2), 0) AS BIGINT) AS pos2, CAST(round_even(avg(length), 0) AS BIGINT) AS length, round(stddev_samp(pos), 6) AS std1, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS ids, count(*) AS n,
concat_ws('', """ + ", ".join(f"CASE WHEN bool_or(id % 8 = {i}) THEN '1' ELSE '0' END" for i in range(8)) + """) AS supp_vec FROM o JOIN c USING (id) GROUP BY component""")
def _(v):
    strains = v.region.sparkSession.range(8).select(F.concat(F.lit("st"), "id").alias("strain"), F.col("id").alias("ord"))
    found = tra(v).withColumn("strain", F.concat(F.lit("st"), F.col("id") % 8))
    merged = vr.merge_translocations(found, 6_000, strains)
    return merged.select("component", "chrom", "pos", "pos2", "length", F.round("std1", 6).alias("std1"), "ids", "n", "supp_vec")


@query("sv_genomic_sort_number", "SELECT event_id, row_number() OVER (ORDER BY CAST(substring(chrom, 11) AS INT), pos, event_id) AS number FROM {sv}")
def _(v):
    return vr.genomic_number(v.sv, "event_id").select("event_id", "number")


IMPACT = BP + """, im AS (SELECT variant, chrom AS id, greatest(pos - 2000, 0) AS lo, pos2 + 2000 AS hi FROM bp WHERE type IN ('DEL', 'DUP', 'CONTR') UNION ALL SELECT variant, chrom, greatest(pos - 2000, 0), pos + 2000 FROM bp WHERE type NOT IN ('DEL', 'DUP', 'CONTR')
UNION ALL SELECT variant, chrom2, greatest(pos2 - 2000, 0), pos2 + 2000 FROM bp WHERE type IN ('INV', 'TRA'))"""


@query("sv_impact_region", IMPACT + " SELECT variant, id, lo, hi FROM im")
def _(v):
    return vr.impact_regions(svs(v), 2_000)


@query("sv_gene_pairs", IMPACT + ", " + united("u", "im", "variant, id") + ", gn AS (SELECT concat('chromosome', p_partkey % 16 + 1) AS id, p_partkey AS gene, p_partkey * 50 AS lo, p_partkey * 50 + 20 + p_size AS hi FROM {part}) SELECT variant, gene, sum(least(u.hi, gn.hi) - greatest(u.lo, gn.lo)) * CAST(1 AS DOUBLE) / any_value(gn.hi - gn.lo) AS overlap FROM u JOIN gn ON u.id = gn.id AND u.lo < gn.hi AND gn.lo < u.hi GROUP BY variant, gene")
def _(v):
    genes = v.part.selectExpr("concat('chromosome', p_partkey % 16 + 1) AS id", "p_partkey AS gene", "p_partkey * 50 AS lo", "p_partkey * 50 + 20 + p_size AS hi")
    return vr.gene_pairs(svs(v), genes, 2_000)


@query("vcf_rename_ids", "SELECT event_id, coalesce(n_name, CAST(event_id AS STRING)) AS id FROM {events} LEFT JOIN {nation} ON event_id = n_nationkey")
def _(v):
    names = v.nation.selectExpr("CAST(n_nationkey AS STRING) AS old_id", "n_name AS new_id")
    return vr.rename_ids(v.events.selectExpr("event_id", "CAST(event_id AS STRING) AS id"), names)


@query("variant_type", "SELECT p_partkey, CASE WHEN p_size % 7 = length(p_brand) THEN 'SNP' WHEN p_size % 7 < 50 AND length(p_brand) < 50 AND p_size < 49 THEN 'INDEL' WHEN p_size % 7 = length(p_brand) THEN 'SNP' ELSE CASE WHEN p_size * 2 < 50 THEN 'INDEL' ELSE 'SV' END END AS kind FROM {part} WHERE p_size >= 49 OR p_size % 7 >= 0")
def _(v):
    ref = F.expr("repeat('A', CASE WHEN p_size >= 49 AND p_size % 7 <> length(p_brand) THEN p_size * 2 ELSE p_size % 7 END)")
    return v.part.select("p_partkey", vr.variant_type(ref, F.col("p_brand")).alias("kind"))


COVER = """WITH RECURSIVE pr AS (SELECT DISTINCT CAST(substring(chrom, 11) AS INT) AS ord, chrom AS haplotype, event_id % 997 AS variant FROM {sv}),
h AS (SELECT haplotype, ord, list(variant) AS vs FROM pr GROUP BY ALL),
s AS (SELECT CAST(0 AS BIGINT) AS step, CAST('' AS VARCHAR) AS haplotype, CAST(0 AS BIGINT) AS gained, CAST([] AS BIGINT[]) AS done
UNION ALL SELECT step + 1, x.haplotype, x.g, list_distinct(list_concat(done, x.vs)) FROM (SELECT s.step, s.done, h.haplotype, h.vs, CAST(len(list_filter(h.vs, lambda v: NOT list_contains(s.done, v))) AS BIGINT) AS g,
row_number() OVER (ORDER BY CASE WHEN h.ord <= 4 AND len(list_filter(h.vs, lambda v: NOT list_contains(s.done, v))) > 0 THEN 1 ELSE 0 END DESC, len(list_filter(h.vs, lambda v: NOT list_contains(s.done, v))) DESC, h.ord) AS rn FROM s CROSS JOIN h) x WHERE x.rn = 1 AND x.g > 0 AND x.step < 500)
SELECT step, haplotype, gained FROM s WHERE step > 0"""


@query("haplotype_greedy_cover", COVER)
def _(v):
    presence = v.sv.selectExpr("chrom AS haplotype", "CAST(substring(chrom, 11) AS INT) AS ord", "event_id % 997 AS variant").distinct()
    return vr.greedy_cover(presence, presence.filter("ord <= 4").select("haplotype"))


@query("sv_te_tag", "SELECT event_id, CASE WHEN event_id IN (SELECT p_partkey FROM {part} WHERE p_size > 25) THEN concat(event_id, '_TyRelated') ELSE CAST(event_id AS STRING) END AS id FROM {events}")
def _(v):
    related = v.part.filter("p_size > 25").selectExpr("CAST(p_partkey AS STRING) AS id")
    return vr.te_tag(v.events.selectExpr("event_id", "CAST(event_id AS STRING) AS id"), related)


@query("sv_concat_sources", "SELECT event_id, type FROM {sv} WHERE type <> 'TRA' UNION ALL SELECT event_id + 1000000, 'TRA' FROM {sv} WHERE type = 'TRA'")
def _(v):
    return vr.concat_sources(v.sv.select("event_id", "type"), v.sv.filter("type = 'TRA'").selectExpr("event_id + 1000000 AS event_id", "type"))


@query("sv_id_compose", "SELECT event_id, concat(event_id, '_', type, '_', chrom, '_', pos, '_', len, '_L') AS id FROM {sv}")
def _(v):
    return v.sv.select("event_id", vr.compose_id(F.col("event_id"), F.col("type"), F.col("chrom"), F.col("pos"), F.col("len")).alias("id"))


@query("loh_windows", """WITH ch AS (SELECT DISTINCT chrom, 101000 AS size FROM {sv}), g AS (SELECT chrom, size, bin FROM ch, unnest(range(0, 101)) t(bin)), c AS (SELECT chrom, pos // 1000 AS bin, count(*) AS k FROM {sv} GROUP BY ALL),
d AS (SELECT chrom, size, bin, sum(coalesce(k, 0)) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS s FROM g LEFT JOIN c USING (chrom, bin)) SELECT chrom, bin * 1000 AS start, least(bin * 1000 + 50000, size) AS stop FROM d WHERE s < 320 AND (bin + 50 <= 101 OR bin = 0)""")
def _(v):
    return vr.loh_windows(v.sv.select("chrom", "pos"), v.sv.select("chrom").distinct().withColumn("size", F.lit(101_000)), most=320).withColumnRenamed("end", "stop")


@query("allele_balance", "SELECT p_partkey, CAST(p_size AS DOUBLE) / (p_size + p_partkey) AS balance FROM {part} WHERE p_size + p_partkey > 0")
def _(v):
    return v.part.select("p_partkey", vr.allele_balance(F.concat_ws(",", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))).alias("balance"))
