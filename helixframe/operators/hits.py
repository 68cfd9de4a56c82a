"""Similarity-hit operators on rows with qseqid, sseqid, pident, ranges, lengths and a file order `ord`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import union

PAIR = ["qseqid", "sseqid"]


def _covered(hits: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Bases of the union of 1-based inclusive ranges, whichever way they run."""
    rows = hits.select(*keys, (F.least(start, end) - 1).alias("lo"), F.greatest(start, end).alias("hi"))
    return union(rows, keys, width=None).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("bases"))


def _first(column: str) -> Column:
    return F.min_by(column, "ord").alias(column)


def pair_coverage(hits: DataFrame) -> DataFrame:
    """qseqid, sseqid, qcov, scov: percent of each sequence under the union of the pair's hits."""
    hundred = F.lit(100).cast("double")
    sizes = hits.groupBy(PAIR).agg(_first("qlen"), _first("slen"))
    q = _covered(hits, "qstart", "qend", PAIR).withColumnRenamed("bases", "qb")
    s = _covered(hits, "sstart", "send", PAIR).withColumnRenamed("bases", "sb")
    return sizes.join(q, PAIR).join(s, PAIR).select(*PAIR, (hundred * F.col("qb") / F.col("qlen")).alias("qcov"), (hundred * F.col("sb") / F.col("slen")).alias("scov"))


def orthologs(hits: DataFrame) -> DataFrame:
    """Pairs of different sequences with both coverages >= 50 or one >= 90."""
    keep = ((F.col("qcov") >= 50) & (F.col("scov") >= 50)) | (F.col("scov") >= 90) | (F.col("qcov") >= 90)
    return pair_coverage(hits.filter("qseqid <> sseqid")).filter(keep)


def with_subject_coverage(hits: DataFrame) -> DataFrame:
    return hits.join(pair_coverage(hits).select(*PAIR, F.col("scov").alias("scovq")), PAIR, "left")


def min_identity_coverage(hits: DataFrame, identity: float = 30, coverage: float = 50) -> DataFrame:
    return hits.filter((F.col("pident") >= identity) & (F.col("qcovs") >= coverage))


def best_first(hits: DataFrame, columns: list[str], key: str = "qseqid") -> DataFrame:
    """Per key, each column's first non-null value in file order."""
    return hits.groupBy(key).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in columns))


def annotation_evidence(hits: DataFrame, slack: int = 10) -> DataFrame:
    """Per pair: least e-value, coverages, and whether a hit starts and one ends within slack of the subject's ends."""
    low, high = F.least("sstart", "send"), F.greatest("sstart", "send")
    ends = hits.groupBy(PAIR).agg(F.min("evalue").alias("evalue"), F.bool_or(low <= slack).alias("at_start"), F.bool_or(high > F.col("slen") - slack).alias("at_end"))
    return ends.join(pair_coverage(hits), PAIR)


def classify(evidence: DataFrame) -> DataFrame:
    """class: complete before truncated before none, the reverse of the order of overwrites."""
    ends = F.col("at_start") & F.col("at_end")
    complete = (F.col("scov") >= 80) | ((F.col("qcov") >= 80) & ends) | ((F.col("scov") >= 30) & ends)
    truncated = (F.col("qcov") >= 90) | (F.col("scov") >= 50)
    return evidence.withColumn("class", F.when(complete, "complete").when(truncated, "truncated").otherwise("none"))


def pick_reference(classified: DataFrame, queries: DataFrame) -> DataFrame:
    """qseqid, name: of the best class the least e-value, then the most qcov, ids joined; else the own id."""
    level = F.when(F.col("class") == "complete", 0).when(F.col("class") == "truncated", 1)
    ranked = classified.withColumn("level", level).filter("level is not null")
    order = Window.partitionBy("qseqid").orderBy("level", "evalue", F.col("qcov").desc())
    best = ranked.withColumn("r", F.rank().over(order)).filter("r = 1")
    named = best.groupBy("qseqid", "level").agg(F.array_join(F.array_sort(F.collect_list("sseqid")), "/").alias("ids"))
    tagged = named.select("qseqid", F.when(F.col("level") == 1, F.concat("ids", F.lit("_truncated"))).otherwise(F.col("ids")).alias("picked"))
    return queries.select("qseqid").distinct().join(tagged, "qseqid", "left").select("qseqid", F.coalesce("picked", "qseqid").alias("name"))


def te_related(hits: DataFrame, identity: float = 95, coverage: float = 50) -> DataFrame:
    """Queries whose hits of enough identity cover enough of them."""
    good = hits.filter(F.col("pident") >= identity)
    sizes = good.groupBy("qseqid").agg(_first("qlen"))
    return _covered(good, "qstart", "qend", ["qseqid"]).join(sizes, "qseqid").filter(100 * F.col("bases") >= coverage * F.col("qlen")).select("qseqid")


def identical_regions(hits: DataFrame) -> DataFrame:
    one = hits.filter("qseqid <> sseqid")
    return one.select(F.col("qseqid").alias("gene1"), (F.col("qstart") - 1).alias("start1"), F.col("qend").alias("end1"), F.col("sseqid").alias("gene2"), (F.col("sstart") - 1).alias("start2"), F.col("send").alias("end2"))


def self_edges(hits: DataFrame, coverage: float = 50) -> DataFrame:
    return hits.filter((F.col("qseqid") != F.col("sseqid")) & (F.col("qcovs") >= coverage)).select(PAIR).distinct()


def ids_above(hits: DataFrame, column: str, threshold: float) -> DataFrame:
    return hits.filter(F.col(column) > threshold).select("qseqid").distinct()


def subjects_with_prefix(hits: DataFrame, prefix: str) -> DataFrame:
    return hits.filter(F.col("sseqid").startswith(prefix))
