"""Queries and operators on tables larger than the smallest, where a number or a group outgrows what it fits in."""

import duckdb
from pyspark.sql import functions as F

from helixframe import plans
from helixframe.operators import assembly, pangenome


def same_as_sql(spark, name, folder, tables):
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
    duck = duckdb.connect()
    for table in tables:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = plans.QUERIES[name](spark, str(folder))
    found = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(found.fetchall())


def test_hits_of_one_contig_on_another_reach_the_peel_united(spark, monkeypatch):
    import pyspark.sql.pandas.group_ops as group_ops

    seen = []
    plain = group_ops.PandasCogroupedOps.applyInPandas

    def noted(self, *args, **kwargs):
        seen.append(self._gd2._df.count())
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(group_ops.PandasCogroupedOps, "applyInPandas", noted)
    contigs = spark.createDataFrame([("a", q, i, 1000) for i, q in enumerate("xyz")], "asm string, qry string, ord long, len long")
    steps = spark.range(20_000).selectExpr("'a' AS asm", "'x' AS qry", "CASE WHEN id % 2 = 0 THEN 'y' ELSE 'z' END AS other", "id % 900 AS lo", "id % 900 + 100 AS hi")
    odd = spark.createDataFrame([("a", "x", "x", 0, 1000), ("a", "y", "z", 9, 3), ("a", "y", "x", None, 5), ("a", "y", "no", 0, 1000)], "asm string, qry string, other string, lo long, hi long")
    got = assembly.remove_redundant(steps.unionByName(odd), contigs, 95).collect()
    assert {r.qry: r.kept for r in got} == {"x": False, "y": True, "z": True}
    assert seen[0] <= 4


def test_gene_ids_equal_their_sql_beyond_five_digits(spark, tmp_path):
    part = spark.range(1, 100_021).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"))
    same_as_sql(spark, "assign_gene_ids", tmp_path, {"part": part})


def test_gene_ids_of_the_operator_stay_whole(spark):
    genes = spark.range(100_003).selectExpr("id AS gene", "0 AS number", "id AS start")
    ids = pangenome.assign_gene_ids(genes).filter("gene in (0, 99998, 100002)").orderBy("gene").collect()
    assert [r.gene_id for r in ids] == ["YX00001", "YX99999", "YX100003"]


def test_genes_without_hits_are_no_parts_of_a_large_table(spark, tmp_path):
    keys = spark.range(20).unionByName(spark.range(1_000_000, 1_000_020))
    part = keys.select(F.col("id").alias("p_partkey"), (F.col("id") % 10 + 36).cast("int").alias("p_size"))
    region = spark.createDataFrame(enumerate("AFRICA AMERICA ASIA EUROPE OTHER".split()), "r_regionkey long, r_name string")
    nation = spark.range(25).selectExpr("id AS n_nationkey", "id % 5 AS n_regionkey")
    same_as_sql(spark, "no_hit_fill", tmp_path, {"part": part, "region": region, "nation": nation})
