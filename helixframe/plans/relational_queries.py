"""Relational idioms of the genomic scripts on the plain tables, and round trips through the file formats."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..operators.graph import cut_lineage
from ..sources import readers
from ..storage import fresh_path
from .registry import query


def fresh(df: DataFrame, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return fresh_path(df.sparkSession, name)


@query("rel_join_inner", "SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey")
def _(v):
    return v.lineitem.join(v.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_quantity", "o_orderstatus")


@query("rel_join_left_multi_key", "SELECT c_custkey, s_suppkey FROM {customer} LEFT JOIN {supplier} ON c_nationkey = s_nationkey AND c_custkey % 7 = s_suppkey % 7")
def _(v):
    left = v.customer.selectExpr("c_custkey", "c_nationkey AS n", "c_custkey % 7 AS k")
    return left.join(v.supplier.selectExpr("s_suppkey", "s_nationkey AS n", "s_suppkey % 7 AS k"), ["n", "k"], "left").select("c_custkey", "s_suppkey")


@query("rel_join_full", "SELECT coalesce(a.k, b.k) AS k, a.x, b.y FROM (SELECT p_partkey AS k, p_size AS x FROM {part} WHERE p_size > 20) a FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS y FROM {supplier}) b ON a.k = b.k")
def _(v):
    return v.part.filter("p_size > 20").selectExpr("p_partkey AS k", "p_size AS x").join(v.supplier.selectExpr("s_suppkey AS k", "s_nationkey AS y"), "k", "full")


@query("rel_join_positional", "SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS r FROM {customer}) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM {supplier}) b USING (r)")
def _(v):
    customers = numbered(v.customer.select("c_custkey"), [-F.col("c_custkey")], "r")
    return customers.join(numbered(v.supplier.select("s_suppkey"), ["s_suppkey"], "r"), "r").drop("r")


@query("rel_semi_join", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F')")
def _(v):
    return v.customer.join(v.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("rel_anti_join", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F')")
def _(v):
    return v.customer.join(v.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("rel_self_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(v):
    a, b = v.nation.selectExpr("n_nationkey AS a", "n_regionkey"), v.nation.selectExpr("n_nationkey AS b", "n_regionkey")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b")


@query("rel_aggregates", "SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, median(l_quantity) AS middle, round(stddev_samp(l_quantity), 9) AS deviation, bool_or(l_discount > 0.09) AS cheap FROM {lineitem} GROUP BY l_suppkey")
def _(v):
    return v.lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("total"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"),
        F.median("l_quantity").alias("middle"), F.round(F.stddev_samp("l_quantity"), 9).alias("deviation"), F.bool_or(F.col("l_discount") > 0.09).alias("cheap"),
    )


@query("rel_value_counts", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type")
def _(v):
    return v.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("rel_distinct", "SELECT DISTINCT p_brand, p_type FROM {part}")
def _(v):
    return v.part.select("p_brand", "p_type").distinct()


@query("rel_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) WHERE r = 1")
def _(v):
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return v.orders.withColumn("r", F.row_number().over(order)).filter("r = 1").select("o_custkey", "o_orderkey")


@query("rel_set_operations", "SELECT k, 'except' AS op FROM (SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}) UNION ALL SELECT k, 'intersect' FROM (SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) UNION ALL SELECT k, 'union' FROM (SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier})")
def _(v):
    a, b = v.customer.selectExpr("c_nationkey AS k"), v.supplier.selectExpr("s_nationkey AS k")
    tagged = lambda df, op: df.withColumn("op", F.lit(op))
    return tagged(a.subtract(b), "except").unionByName(tagged(a.intersect(b), "intersect")).unionByName(tagged(a.union(b).distinct(), "union"))


@query("rel_pivot", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS \"A\", count(*) FILTER (WHERE l_returnflag = 'R') AS \"R\" FROM {lineitem} GROUP BY l_suppkey")
def _(v):
    wide = v.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "R"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@query("rel_unpivot", "SELECT p_partkey, 'p_name' AS field, p_name AS value FROM {part} UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM {part}")
def _(v):
    return v.part.select("p_partkey", "p_name", "p_brand").unpivot("p_partkey", ["p_name", "p_brand"], "field", "value")


@query("rel_sliding_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}")
def _(v):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return v.events.select("event_id", F.count(F.lit(1)).over(order.rowsBetween(0, 49)).alias("n"), F.lag("event_id").over(order).alias("before"))


@query("fn_strings", "SELECT p_partkey, split_part(p_name, ' ', 2) AS part2, replace(p_brand, '#', '') AS tidy, upper(substring(p_type, 1, 3)) AS head, reverse(p_name) AS back, printf('%05d', p_partkey) AS padded, starts_with(p_name, 'red') AS red, regexp_replace(p_name, '[aeiou]', '', 'g') AS bare FROM {part}")
def _(v):
    return v.part.select(
        "p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("part2"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("tidy"), F.upper(F.substring("p_type", 1, 3)).alias("head"),
        F.reverse("p_name").alias("back"), F.format_string("%05d", "p_partkey").alias("padded"), F.col("p_name").startswith("red").alias("red"), F.regexp_replace("p_name", "[aeiou]", "").alias("bare"),
    )


@query("fn_math", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS half_even, ceil(l_discount * 10) AS up, greatest(l_partkey, l_suppkey) AS most, abs(l_partkey - l_suppkey) AS apart, round(log10(l_extendedprice + 1), 9) AS lg FROM {lineitem}")
def _(v):
    return v.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.rint(F.col("l_quantity") / 2).alias("half_even"), F.ceil(F.col("l_discount") * 10).cast("double").alias("up"), F.greatest("l_partkey", "l_suppkey").alias("most"),
        F.abs(F.col("l_partkey") - F.col("l_suppkey")).alias("apart"), F.round(F.log10(F.col("l_extendedprice") + 1), 9).alias("lg"),
    )


@query("fn_maps_arrays", "SELECT ord, regexp_extract(attributes, 'Name=([^;]*)', 1) AS name, regexp_extract(attributes, 'gene=([^;]*)', 1) AS gene, len(string_split(attributes, ';')) AS n FROM {gff}")
def _(v):
    attr = F.str_to_map("attributes", F.lit(";"), F.lit("="))
    return v.gff.select("ord", attr["Name"].alias("name"), attr["gene"].alias("gene"), F.size(F.split("attributes", ";")).cast("long").alias("n"))


@query("fasta_scan", "SELECT id, concat(id, ' of ', description) AS description, seq FROM {named_dna} WHERE length(seq) > 0")
def _(v):
    seqs = v.named_dna.filter("length(seq) > 0").selectExpr("id", "ord", "concat(id, ' of ', description) AS description", "seq")
    readers.write_fasta(seqs, path := fresh(seqs, "fasta"), 60)
    return readers.read_fasta(seqs.sparkSession, path).select("id", "description", "seq")


def _population(v):
    return v.part.join(v.region).selectExpr("concat('v', p_partkey) AS variant_id", "concat('chromosome', p_partkey % 16 + 1) AS chrom", "p_partkey * 10 AS pos", "'A' AS ref", "'T' AS alt", "concat('SVLEN=', p_size) AS info", "r_name AS sample", "concat(p_size % 2, '|', (p_size + r_regionkey) % 2) AS gt")


_VCF = "SELECT concat('v', p_partkey) AS variant_id, concat('chromosome', p_partkey % 16 + 1) AS chrom, p_partkey * 10 AS pos, concat('SVLEN=', p_size) AS info, r_name AS sample, concat(p_size % 2, '|', (p_size + r_regionkey) % 2) AS gt FROM {part} CROSS JOIN {region}"


@query("vcf_scan", _VCF)
def _(v):
    calls = _population(v)
    readers.write_vcf(calls, ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], path := fresh(calls, "vcf"))
    return readers.read_vcf(calls.sparkSession, path).select("variant_id", "chrom", "pos", "info", "sample", "gt")


@query("gfa_scan", "SELECT CAST(p_partkey AS STRING) AS id1, '+' AS dir1, CAST(p_partkey + 1 AS STRING) AS id2, '-' AS dir2, p_brand AS seq FROM {part}")
def _(v):
    links = v.part.selectExpr("CAST(p_partkey AS STRING) AS id1", "'+' AS dir1", "CAST(p_partkey + 1 AS STRING) AS id2", "'-' AS dir2")
    segments = v.part.selectExpr("CAST(p_partkey AS STRING) AS id", "p_brand AS seq")
    readers.write_gfa(segments, links, path := fresh(links, "gfa"))
    s, l = readers.read_gfa(links.sparkSession, path)
    return l.join(s.withColumnRenamed("id", "id1"), "id1").select("id1", "dir1", "id2", "dir2", "seq")


@query("skip_if_present", "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT s_suppkey FROM {supplier})")
def _(v):
    """Only what an earlier run hasn't written yet."""
    done = cut_lineage(v.supplier.select(F.col("s_suppkey").alias("p_partkey")), "done")
    return v.part.select("p_partkey").join(done, "p_partkey", "left_anti")
