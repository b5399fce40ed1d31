"""Intermediate tables in the shared folder of the cluster.

Multi-step operators cut their lineage by writing a Parquet table below ``spark.checkpoint.dir``
and reading it back: the files outlive any executor, and Parquet is smaller than a row
checkpoint. The folder is read from the session, or from the context's own checkpoint folder; where neither is
set, a local session (tests) uses a folder of this process, and on a cluster it is an error.
Tables that nobody drops are deleted at the end of the ``scratch_scope`` that they were made in, or else when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCOPES: list[list[Scratch | _Folder]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Within it operators may be called and their results written; at its end the tables they made are deleted."""
    made: list[Scratch | _Folder] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()
        for t in made:
            t.drop()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="quire-scratch-")
    return _LOCAL["dir"]


class Scratch:
    """A written table: ``df`` reads it, ``drop()`` deletes its files once nothing reads it any more."""

    def __init__(self, df: DataFrame, partitions: int | None = None):
        spark = df.sparkSession
        self.path = f"{scratch_root(spark)}/quire-{uuid.uuid4().hex}"
        (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(self.path)
        self._spark = spark
        self.df = spark.read.schema(df.schema).parquet(self.path)
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._at)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def drop(self) -> None:
        self._fs.delete(self._at, True)
        self._fs.cancelDeleteOnExit(self._at)


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self._at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at)
        self._fs.deleteOnExit(self._at)

    def drop(self) -> None:
        self._fs.delete(self._at, True)
        self._fs.cancelDeleteOnExit(self._at)


def scratch_folder(spark: SparkSession) -> str:
    """A new empty folder for files and checkpoints, deleted like scratch tables."""
    path = f"{scratch_root(spark)}/quire-{uuid.uuid4().hex}"
    folder = _Folder(spark, path)
    if _SCOPES:
        _SCOPES[-1].append(folder)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back; for tables that the result still reads."""
    return Scratch(df).df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now, not at some later collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
