"""Places in an order, for tables and groups of any size: no window without a partition, and no group in one task.

Rows are dealt to ranges of the order in one shuffle and sorted there, so that a row's number within its range is known
without a window; the sizes of the ranges (one small row each) say what comes before. The table with these
numbers is written, as both steps read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.scratch import materialise

_ROW_BITS = 33


def _ranged(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``df`` with the range of each row (``_part``) and its number there (``_row``, from 0)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    written = materialise(dealt)  # the id holds the number of the partition above ROW_BITS bits
    return written.withColumns({"_part": F.shiftright("_at", _ROW_BITS), "_row": F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}).drop("_at")


def global_places(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row in the whole order, from 1; the order is to be total."""
    rows = _ranged(df, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def group_places(df: DataFrame, group: str, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row in its group, from 1; a large group lies in several ranges, each counted by its own task."""
    rows = _ranged(df, [F.col(group), *order])
    counts = rows.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    onward = counts.withColumn("_before", earlier).where("_before IS NOT NULL").select("_part", F.col(group).alias("_group"), "_before")  # one group a range at most
    own = F.row_number().over(Window.partitionBy("_part", group).orderBy("_row"))
    numbered = rows.withColumn("_own", own).join(F.broadcast(onward.withColumnRenamed("_part", "_p")), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return numbered.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_part", "_row", "_own", "_p", "_group", "_before")
