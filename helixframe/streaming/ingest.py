"""Streaming ingestion of hit and depth files as they arrive. An extension: no operator depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import schemas


def stream_depth(spark: SparkSession, path: str, strain_pattern: str = r"^(.*?)\.") -> DataFrame:
    """Depth rows of files that arrive in a folder."""
    rows = spark.readStream.schema(schemas.DEPTH).option("sep", "\t").csv(path)
    return rows.withColumn("strain", F.regexp_extract(F.col("_metadata.file_name"), strain_pattern, 1))


def running_totals(depth: DataFrame) -> DataFrame:
    """Bases and positions of each strain and gene so far; state is one row for each."""
    return depth.groupBy("strain", "gene").agg(F.sum("depth").alias("bases"), F.count(F.lit(1)).alias("positions"))
