"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Quality rules reject documents; of each group of near duplicates one row of the least doc_id stays;
documents that hold a benchmark item go; secrets in texts are replaced by a mark; what is left is
packed. A benchmark item counts from LEAST_LEAK characters on. A null doc_id comes after all others: a null-id document stays if its group has no other id.
Unlike texts that share a doc_id, null or not, are groups of their own. Empty tables give empty results;
further columns of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.decontamination import benchmark_hits
from helixframe.llm.jaccard_join import one_of_each
from helixframe.llm.packing import packed, word_tokens
from helixframe.llm.quality_rules import quality_filter
from helixframe.llm.secret_scan import redacted
from helixframe.llm.shared import free_name, table, written
from helixframe.storage import Scratch


LEAST_LEAK = 16  # an item of fewer characters, such as a lone word, is no sign of a leak
BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> None:
    """Batches that go to Python and come back hold up to 2 MB, not Spark's 64, from here on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bounded(spark)
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the 4/5 Jaccard graph, of its least doc_id, and each text without shingles."""
    bounded(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    bounded(spark)
    found = benchmark_hits(docs, table(spark, sf_dir, "benchmark"), least=LEAST_LEAK)
    return found.filter(F.size(found.columns[-1]) == 0).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced and n_chars set anew where the text changed."""
    if "n_chars" not in docs.columns:
        return redacted(docs)
    old = free_name(docs, "_text")
    clean = redacted(docs.withColumn(old, F.col("text")))
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col(old)), F.col("n_chars")).otherwise(size)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin_id, bin_offset and bin_length of every piece."""
    return packed(docs, word_tokens(), "doc_id")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents, every stage written and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with Scratch(spark) as stages:  # the table of the stage before is read no more once this one's is written
            if before is not None:
                stages.paths.append(before)
            with Scratch(spark) as own:
                docs = own.hand_out(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            before = stages.paths.pop()
    return docs


ORACLE_SQL = None
