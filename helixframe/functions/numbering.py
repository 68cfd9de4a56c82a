"""Running numbers over all rows in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """df with `name`: 1 .. n in the given total order.

    Rows are dealt to ranges of the order and written; each range numbers its own rows and starts after
    the rows of the ranges before it. Only one row for each range is summed in one place.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.select("*", *(c.alias(f"_o{i}") for i, c in enumerate(columns)))
    keys = [f"_o{i}" for i in range(len(columns))]
    ranges = written(keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_k"))
    starts = counts.select("_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return ranges.withColumn("_own", own).join(starts, "_range").select(*df.columns, (F.col("_own") + F.col("_start")).cast("long").alias(name))
