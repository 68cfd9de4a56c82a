"""Queries of the interval and sequence operators."""

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import sequences as sq
from .registry import query

UNION = """{name}0 AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT {keys}, lo, hi FROM {src}) WHERE lo < hi),
{name}1 AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM {name}0),
{name} AS (SELECT {keys}, min(lo) AS lo, max(hi) AS hi FROM {name}1 GROUP BY {keys}, g)"""


def united(name: str, src: str, keys: str = "id") -> str:
    """SQL of the union of a relation's intervals as the relation `name`."""
    return UNION.replace("{name}", name).replace("{keys}", keys).replace("{src}", src)


@query("ivl_overlaps", "SELECT a.id, a.gene, b.gene AS other, a.lo < b.hi AND b.lo < a.hi AS overlaps FROM {gene} a JOIN {gene} b ON a.id = b.id AND b.gene = a.gene + 16")
def _(v):
    b = v.gene.select("id", F.col("gene").alias("other"), F.col("lo").alias("l"), F.col("hi").alias("h"))
    pairs = v.gene.join(b.withColumn("gene", F.col("other") - 16), ["id", "gene"])
    return pairs.select("id", "gene", "other", iv.overlaps(F.col("lo"), F.col("hi"), F.col("l"), F.col("h")).alias("overlaps"))


@query("ivl_union", "WITH " + united("u", "{ivl}") + " SELECT id, lo, hi FROM u")
def _(v):
    return iv.union(v.ivl)


@query("ivl_order", "SELECT id, lo, hi, row_number() OVER (ORDER BY id, lo, hi) AS place FROM (SELECT DISTINCT id, lo, hi FROM {ivl})")
def _(v):
    return v.ivl.distinct().orderBy("id", "lo", "hi").selectExpr("id", "lo", "hi", "CAST(row_number() OVER (ORDER BY id, lo, hi) AS BIGINT) AS place")


@query("ivl_length", "WITH " + united("u", "{ivl}") + " SELECT id, CAST(sum(hi - lo) AS BIGINT) AS length FROM u GROUP BY id")
def _(v):
    return iv.length(v.ivl)


@query("ivl_overlap_len", "SELECT a.id, a.gene, CAST(sum(greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo))) AS BIGINT) AS overlap FROM {gene} a JOIN {ivl} b ON a.id = b.id AND b.lo < a.hi AND a.lo < b.hi GROUP BY a.id, a.gene")
def _(v):
    pairs = iv.binned_overlaps(v.gene, v.ivl)
    return pairs.groupBy("id", "gene").agg(F.sum(iv.overlap_length(F.col("lo"), F.col("hi"), F.col("b_lo"), F.col("b_hi"))).alias("overlap"))


_SHARED = "WITH " + united("a", "{gene}") + ", " + united("b", "{ivl}") + ", w AS (SELECT id, CAST(sum(hi - lo) AS BIGINT) AS length FROM a GROUP BY id), s AS (SELECT a.id, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS overlap FROM a JOIN b ON a.id = b.id AND a.lo < b.hi AND b.lo < a.hi GROUP BY a.id)"


@query("ivl_set_overlap_len", _SHARED + " SELECT w.id, coalesce(overlap, 0) AS overlap FROM w LEFT JOIN s ON w.id = s.id")
def _(v):
    return iv.set_overlap_length(v.gene, v.ivl)


@query("ivl_binned_overlap_len", _SHARED + " SELECT w.id, coalesce(overlap, 0) AS overlap FROM w LEFT JOIN s ON w.id = s.id")
def _(v):
    return iv.set_overlap_length(v.gene, v.ivl)


@query("ivl_coverage_pct", _SHARED + " SELECT w.id, coalesce(overlap, 0) AS overlap, length, coalesce(overlap, 0) * CAST(100 AS DOUBLE) / length AS coverage FROM w LEFT JOIN s ON w.id = s.id")
def _(v):
    return iv.coverage_percent(v.gene, v.ivl)


@query("asm_chr_coverage", _SHARED + " SELECT w.id, coalesce(overlap, 0) * CAST(100 AS DOUBLE) / length AS coverage FROM w LEFT JOIN s ON w.id = s.id")
def _(v):
    return iv.coverage_percent(v.gene, v.ivl).select("id", "coverage")


_STRICT = united("u", "{ivl}").replace("lo > max(hi)", "lo >= max(hi)")


@query("ivl_add", "WITH two AS (SELECT gene, lo, hi FROM {gene} UNION ALL SELECT gene, lo + 20, hi + 30 FROM {gene}), " + united("u", "two", "gene").replace("lo > max(hi)", "lo >= max(hi)") + " SELECT gene, lo, hi FROM u")
def _(v):
    one = v.gene.select("gene", "lo", "hi")
    return iv.insert(one, one.selectExpr("gene", "lo + 20 AS lo", "hi + 30 AS hi"), ("gene",))


@query("ivl_add_into_set", "WITH two AS (SELECT id, lo, hi FROM {ivl} UNION ALL SELECT id, lo, hi FROM {gene}), " + _STRICT.replace("{ivl}", "two") + " SELECT id, lo, hi FROM u")
def _(v):
    return iv.insert(v.ivl, v.gene)


@query("ivl_subtract", "SELECT gene, lo, hi FROM (SELECT gene, lo, least(hi, lo + 10) AS hi FROM {gene} UNION ALL SELECT gene, greatest(lo, lo + 15) AS lo, hi FROM {gene}) x WHERE lo < hi")
def _(v):
    whole = v.gene.select("gene", "lo", "hi")
    return iv.subtract(whole, whole.selectExpr("gene", "lo + 10 AS lo", "lo + 15 AS hi"), ("gene",))


_MINUS = """WITH ev AS (SELECT id, lo AS x, 1 AS da, 0 AS db FROM {A} UNION ALL SELECT id, hi, -1, 0 FROM {A} UNION ALL SELECT id, lo, 0, 1 FROM {B} UNION ALL SELECT id, hi, 0, -1 FROM {B}),
net AS (SELECT id, x, sum(da) AS da, sum(db) AS db FROM ev GROUP BY id, x),
sw AS (SELECT id, x AS lo, lead(x) OVER (PARTITION BY id ORDER BY x) AS hi, sum(da) OVER (PARTITION BY id ORDER BY x) AS ca, sum(db) OVER (PARTITION BY id ORDER BY x) AS cb FROM net),
seg AS (SELECT id, lo, hi FROM sw WHERE ca > 0 AND cb = 0 AND hi IS NOT NULL), """ + united("u", "seg") + " SELECT id, lo, hi FROM u"


@query("ivl_set_subtract", _MINUS.replace("{A}", "{gene}").replace("{B}", "{ivl}"))
def _(v):
    return iv.subtract(v.gene, v.ivl)


@query("ivl_complement", _MINUS.replace("{A}", "{chrom}").replace("{B}", "{ivl}"))
def _(v):
    return iv.complement(v.chrom, v.ivl)


@query("ivl_set_add", "WITH two AS (SELECT id, lo, hi FROM {ivl} UNION ALL SELECT id, lo, hi FROM {gene}), " + united("u", "two") + " SELECT id, lo, hi FROM u")
def _(v):
    return iv.add_sets(v.ivl, v.gene)


@query("ivl_check_overlap", "SELECT id, bool_or(coalesce(lo < r, false)) AS overlaps FROM (SELECT id, lo, max(hi) OVER (PARTITION BY id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {ivl}) GROUP BY id")
def _(v):
    return iv.any_overlap(v.ivl)


@query("ivl_get_id", "WITH " + united("u", "{ivl}") + " SELECT id, lo, hi FROM u WHERE id = 'chr3'")
def _(v):
    return iv.union(v.ivl.filter("id = 'chr3'"))


@query("ivl_center", "WITH " + united("u", "{ivl}") + " SELECT id, sum((lo + hi - 1) * CAST(0.5 AS DOUBLE) * (hi - lo)) / sum(hi - lo) AS center FROM u GROUP BY id")
def _(v):
    return iv.center(v.ivl)


@query("ivl_merge_adjacent_windows", "WITH w AS (SELECT id, lo + 1 AS lo, hi FROM {ivl}), " + united("u", "w") + " SELECT id, lo - 1 AS lo, hi FROM u")
def _(v):
    return iv.merge_adjacent_windows(v.ivl.selectExpr("id", "lo + 1 AS lo", "hi"))


@query("ivl_non_n", """WITH c AS (SELECT id, unnest(string_split(seq, '')) AS ch, unnest(range(1, length(seq) + 1)) AS p FROM {dna} WHERE length(seq) > 0),
k AS (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM c WHERE ch <> 'n') SELECT id, CAST(min(p) AS BIGINT) AS lo, CAST(max(p) + 1 AS BIGINT) AS hi FROM k GROUP BY id, g""")
def _(v):
    return iv.non_n(v.dna)


@query("ivl_rank", "SELECT id, gene, hi - lo AS size, row_number() OVER (PARTITION BY id ORDER BY hi - lo, gene) AS up, row_number() OVER (PARTITION BY id ORDER BY hi - lo DESC, gene DESC) AS down FROM {gene}")
def _(v):
    sized = v.gene.selectExpr("id", "gene", "hi - lo AS size")
    up = iv.rank(sized, "size", "gene").withColumnRenamed("rank", "up")
    return iv.rank(up, "size", "gene", descending=True).withColumnRenamed("rank", "down")


@query("seq_length", "SELECT id, CAST(length(seq) AS BIGINT) AS length FROM {dna}")
def _(v):
    return sq.lengths(v.dna)


@query("seq_filter_min_len", "SELECT id, CAST(length(seq) AS BIGINT) AS length FROM {dna} WHERE length(seq) >= 1000")
def _(v):
    return sq.lengths(sq.at_least(v.dna, 1))


@query("seq_extract", "SELECT concat(id, '_11..', least(200, length(seq))) AS id, substring(seq, 11, 190) AS seq FROM {named_dna} WHERE starts_with(id, 'scf') AND length(seq) >= 11")
def _(v):
    return sq.extract(v.named_dna, prefixes=["scf"], start=11, end=200).select("id", "seq")


@query("seq_extract_ids", "SELECT id, seq FROM {named_dna} WHERE id IN (SELECT concat('ctg', n_nationkey * 2) FROM {nation})")
def _(v):
    return sq.extract(v.named_dna, ids=v.nation.selectExpr("concat('ctg', n_nationkey * 2) AS id")).select("id", "seq")


@query("seq_extract_invert", """SELECT id, seq FROM {named_dna} WHERE NOT starts_with(id, 'scf') UNION ALL SELECT concat(id, '_1..10'), substring(seq, 1, 10) FROM {named_dna} WHERE starts_with(id, 'scf')
UNION ALL SELECT concat(id, '_201..', length(seq)), substring(seq, 201) FROM {named_dna} WHERE starts_with(id, 'scf') AND length(seq) > 200""")
def _(v):
    return sq.extract_invert(v.named_dna, ["scf"], 11, 200).select("id", "seq")


@query("seq_mask_ends", "SELECT id, CASE WHEN length(seq) < 40 THEN repeat('N', length(seq)) ELSE concat(repeat('N', 20), substring(seq, 21, length(seq) - 40), repeat('N', 20)) END AS seq FROM {dna}")
def _(v):
    return sq.mask_ends(v.dna, 20).select("id", "seq")


@query("seq_revcomp", "SELECT id, reverse(translate(seq, 'acgtn', 'tgcan')) AS seq FROM {dna}")
def _(v):
    return v.dna.select("id", sq.reverse_complement(F.col("seq")).alias("seq"))


@query("seq_concat", "SELECT id, CAST(length(seq) AS BIGINT) AS length, 1 AS part FROM {named_dna} UNION ALL SELECT concat('x', id), CAST(length(seq) AS BIGINT), 2 FROM {named_dna}")
def _(v):
    one = v.named_dna.selectExpr("id", "CAST(length(seq) AS BIGINT) AS length", "1 AS part")
    return sq.concatenate(one, one.selectExpr("concat('x', id) AS id", "length", "2 AS part"))


@query("seq_rename_sequential", "SELECT concat('YS_', row_number() OVER (ORDER BY ord)) AS id, CAST(id AS STRING) AS description FROM {dna}")
def _(v):
    return sq.rename_sequential(v.dna.selectExpr("CAST(id AS STRING) AS id", "ord"), "YS").select("id", "description")


@query("seq_rename_map", "SELECT coalesce(n_name, id) AS id, CASE WHEN n_name IS NULL THEN concat('>', id, ' x') ELSE concat('>', n_name, ' x') END AS description FROM {named_dna} LEFT JOIN {nation} ON id = concat('ctg', n_nationkey)")
def _(v):
    names = v.nation.selectExpr("concat('ctg', n_nationkey) AS old_id", "n_name AS new_id")
    return sq.rename_map(v.named_dna.selectExpr("id", "concat('>', id, ' x') AS description"), names).select("id", "description")


@query("seq_prefix_token", "SELECT l_orderkey, l_linenumber, l_partkey, split_part(concat('ref|', l_partkey, '|', l_suppkey), '|', 2) AS tok, concat('ref|', l_partkey, '|', l_returnflag) AS swapped FROM {lineitem}")
def _(v):
    packed = F.concat(F.lit("ref|"), "l_partkey", F.lit("|"), "l_suppkey")
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.split_part(packed, F.lit("|"), F.lit(2)).alias("tok"), sq.replace_token(packed, 3, F.col("l_returnflag")).alias("swapped"))


@query("seq_total_bp", "SELECT CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum(length(seq)) // 12000000 AS BIGINT) AS depth FROM {dna}")
def _(v):
    return sq.total_bases(v.dna)


@query("seq_route_by_coverage", "SELECT p_partkey, '40X' AS branch FROM {part} WHERE p_size >= 40 UNION ALL SELECT p_partkey, '30X' FROM {part} UNION ALL SELECT p_partkey, 'all' FROM {part}")
def _(v):
    return sq.route_by_depth(v.part.select("p_partkey", F.col("p_size").alias("depth"))).select("p_partkey", "branch")


@query("seq_strip_stop", "SELECT id, replace(concat('*', seq, '*'), '*', '') AS seq FROM {dna}")
def _(v):
    return sq.strip_stop(v.dna.selectExpr("id", "concat('*', seq, '*') AS seq"))


@query("fasta_sink", "SELECT id, rtrim(concat('>', description, chr(10), regexp_replace(seq, '(.......... .......... )'.replace(' ', ''), '\\1' || chr(10), 'g')), chr(10)) AS fasta FROM {dna} WHERE length(seq) > 0")
def _(v):
    return sq.wrapped(v.dna.filter("length(seq) > 0"), 20).select("id", "fasta")
