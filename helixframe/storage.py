"""Tables written to the folder that driver and executors share, and their removal.

Every lineage is cut by writing a table there: it survives the loss of any executor. A `Scratch` removes
what was written inside it, whoever wrote it, once its result is safe.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own for a local session, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN.get() is None:
        _OWN.set("file://" + tempfile.mkdtemp(prefix="helixframe-"))
    return str(_OWN.get())


_OWN: ContextVar[str | None] = ContextVar("own", default=None)
_SCRATCH: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


class Scratch:
    """While it is entered, written tables are noted; at its end they are deleted, failed or not."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.tables = spark, [], []
        self.outer: Scratch | None = None
        self._token: Token | None = None

    def __enter__(self) -> Scratch:
        self.outer, self._token = _SCRATCH.get(), _SCRATCH.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        if self._token is not None:
            _SCRATCH.reset(self._token)
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            remove(self.spark, path)

    def hand_out(self, df: DataFrame, name: str) -> DataFrame:
        """df written so that it outlives this scratch; it belongs to the one around it."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        if self.outer is not None:
            self.outer.paths.append(path)
        return _put(df, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scratch = _SCRATCH.get()
    if scratch is not None:
        scratch.paths.append(path)
    return path


def note_table(name: str) -> None:
    """Have the scratch around drop a table of the warehouse at its end."""
    scratch = _SCRATCH.get()
    if scratch is not None:
        scratch.tables.append(name)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    return _put(df, fresh_path(df.sparkSession, name))


def rewritten(df: DataFrame, name: str, before: str | None = None) -> tuple[DataFrame, str]:
    """df written and read back, with its path; then the table at `before`, which it was made from, is deleted."""
    path = fresh_path(df.sparkSession, name)
    after = _put(df, path)
    if before is not None:
        discarded(df.sparkSession, before)
    return after, path


def discarded(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    scratch = _SCRATCH.get()
    if scratch is not None and path in scratch.paths:
        scratch.paths.remove(path)
    remove(spark, path)


def _put(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system holds it."""
    system, target = _located(spark, path)
    system.delete(target, True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    system, target = _located(spark, f"{path}/_SUCCESS")
    return system.exists(target)


def _located(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
