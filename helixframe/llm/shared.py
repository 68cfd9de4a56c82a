"""Spark plumbing of the training-data operators: tables, free column names, dense sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..storage import Scratch, discarded, fresh_path, note_table, rewritten, written  # noqa: F401

BLOCK_CELLS = 1 << 16
_BLOCK_SCHEMA = "block int, salt int, payload binary"


def _emit(cells: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for block in range(0, len(cells), BLOCK_CELLS):
        part = cells[block : block + BLOCK_CELLS]
        if part.any():
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block // BLOCK_CELLS], pa.int32()),
                    "salt": pa.array([salt], pa.int32()),
                    "payload": pa.array([pack(part.tobytes())], pa.binary()),
                }
            )


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            part = np.frombuffer(unpack(payload), np.int64)
            if block in sums:
                sums[block] += part
            else:
                sums[block] = part.copy()
    pack = zstandard.ZstdCompressor(level=1).compress
    for block, part in sums.items():
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block], pa.int32()),
                "salt": pa.array([0], pa.int32()),
                "payload": pa.array([pack(part.tobytes())], pa.binary()),
            }
        )


def dense_sum(
    df: DataFrame, cells: int, update: Callable[[pa.RecordBatch, np.ndarray], None]
) -> np.ndarray:
    """Sum integer arrays of a fixed number of cells over all rows of df.

    Each task adds its batches into one array (update(batch, cells)), which is cut into blocks,
    summed by (block, salt) and then by block. Integer sums don't depend on the order of tasks.
    The result, `cells` 64-bit integers whatever the input's size, is returned to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(cells, np.int64)
        for batch in batches:
            if batch.num_rows:
                update(batch, total)
        yield from _emit(total, (TaskContext.get().partitionId() if TaskContext.get() else 0) % 16)

    blocks = -(-cells // BLOCK_CELLS)
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        df.mapInArrow(count, _BLOCK_SCHEMA)
        .repartition(max(1, min(width, blocks * 16)), "block", "salt")
        .mapInArrow(_sum_blocks, _BLOCK_SCHEMA)
        .repartition(max(1, min(width, blocks)), "block")
        .mapInArrow(_sum_blocks, _BLOCK_SCHEMA)
        .select("block", "payload")
        .collect()
    )
    out = np.zeros(blocks * BLOCK_CELLS, np.int64)
    unpack = zstandard.ZstdDecompressor().decompress
    for row in rows:
        part = np.frombuffer(unpack(bytes(row.payload)), np.int64)
        out[row.block * BLOCK_CELLS : row.block * BLOCK_CELLS + len(part)] += part
    return out[:cells]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's. They go as Arrow: a list of tuples would start Python workers on every executor."""
    kinds = StructType.fromDDL(schema)
    columns = [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
    return spark.createDataFrame(pa.table(columns, names=kinds.names), kinds)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the first of name_1, name_2, ... that no column of df has."""
    taken = {c.lower() for c in df.columns}
    names = (name if not i else f"{name}_{i}" for i in range(len(taken) + 1))
    return next(n for n in names if n.lower() not in taken)


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, text last; null texts become empty."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))
