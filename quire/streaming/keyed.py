"""Keyed tables that are merged when read: a batch of upserts writes itself, not the table.

Below the table's path lie ``delta-<id>`` folders, one a batch with the last row of each key, and ``base-<id>`` folders with the
merged rows of all batches up to that one. Both are dealt into buckets by key, a folder each, so that a lookup opens one bucket. A folder
counts when its write is complete (Spark's ``_SUCCESS`` file). Readers take the greatest base and the deltas behind it. So a batch writes
as many bytes as it has rows, and the table is rewritten once every ``compact_after`` batches. A batch id that comes again
(after a restart) overwrites its own delta, or is left out if a base has it already.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.operators.state import latest


class KeyedTable:
    """Last write wins by ``order``, later batches among equals. Rows for which ``gone`` holds delete their key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: str, gone: str | None = None, buckets: int = 16, compact_after: int = 8):
        self.spark, self.path, self.schema, self.keys, self.order = spark, path.rstrip("/"), schema, list(keys), order
        self.gone, self.buckets, self.compact_after = gone, buckets, compact_after
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _complete(self, kind: str) -> list[int]:
        """Ids of complete folders, in order; one small listing, as compaction keeps the folders few."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        found = sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}-(\d+)", n)))
        return [i for i in found if self._fs.exists(self._at(f"{kind}-{i}/_SUCCESS"))]

    def _at(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _view(self) -> tuple[int | None, list[int]]:
        bases = self._complete("base")
        base = bases[-1] if bases else None
        return base, [d for d in self._complete("delta") if base is None or d > base]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket").write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy("_bucket").parquet(f"{self.path}/{name}")

    def _raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{self.path}/{name}")

    def _merged(self, bucket: Column | None = None) -> DataFrame:
        """One row a key, deletions among them, with ``_batch`` (the base counts as the batch it ends with)."""
        base, deltas = self._view()
        parts = [(f"delta-{d}", d) for d in deltas] + ([] if base is None else [(f"base-{base}", base)])
        rows = self.spark.createDataFrame([], self.schema).withColumn("_batch", F.lit(0).cast("long"))
        for name, batch in parts:
            raw = self._raw(name)
            raw = raw if bucket is None else raw.where(F.col("_bucket") == bucket)
            rows = rows.unionByName(raw.drop("_bucket").withColumn("_batch", F.lit(batch).cast("long")))
        return latest(rows, self.keys, [self.order, "_batch"])

    def read(self) -> DataFrame:
        """The table as of now."""
        rows = self._merged().drop("_batch")
        return rows.where(~F.coalesce(F.col(self.gone), F.lit(False))) if self.gone else rows

    def lookup(self, **key: object) -> DataFrame:
        """The row of one key; reads one bucket."""
        names = [F.lit(key[k]).cast(self.schema[k].dataType) for k in self.keys]
        rows = self._merged(F.pmod(F.xxhash64(*names), F.lit(self.buckets)).cast("int")).drop("_batch")
        for k, v in zip(self.keys, names, strict=True):
            rows = rows.where(F.col(k) == v)
        return rows.where(~F.coalesce(F.col(self.gone), F.lit(False))) if self.gone else rows

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Write one batch; a repeated id does nothing new."""
        base, deltas = self._view()
        if base is not None and batch_id <= base:
            return
        self._write(latest(batch.select(self.schema.names), self.keys, [self.order]), f"delta-{batch_id}")
        if len({*deltas, batch_id}) >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Merge all complete deltas into a new base. What it replaces goes one compaction later, for readers that hold the old view."""
        base, deltas = self._view()
        if not deltas:
            return
        rows = self._merged().drop("_batch")
        self._write(rows, f"base-{deltas[-1]}")
        if base is not None:
            for kind in ("base", "delta"):
                for i in self._complete(kind):
                    if i < base or (kind == "delta" and i <= base):
                        self._fs.delete(self._at(f"{kind}-{i}"), True)
