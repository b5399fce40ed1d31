"""Publishing and exporting books: a write that is staged, gated by the quality report, and committed by one rename and a marker.

Chapters of books that pass the gate are written as text below a staging folder, a folder a book. What was staged is read back
and counted against what was to be written; only then the folder is renamed to its version and marked. Readers see marked versions
only, so a job that dies leaves nothing that counts, and a book that fails the gate leaves no file at all.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKER = "_PUBLISHED"
#: Ids that may name a folder, as for the parts of a package.
SAFE = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def chapter_lines(chapters: DataFrame) -> DataFrame:
    """``book_id, ord, value`` from chapters (book_id, ord, chapter_id, text): a heading, an empty line and the text, as in an exported workspace."""
    return chapters.select("book_id", "ord", F.concat(F.lit("# "), "chapter_id", F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("value"))


def publish(chapters: DataFrame, passed: DataFrame, root: str, version: str) -> DataFrame:
    """Write ``root/version`` and give back ``book_id, n_chapters`` of the books in it.

    ``chapters`` has book_id, ord, chapter_id, text; ``passed`` the book_id of books that may be published. Ids that can't name a folder are refused
    as a whole. A version is written once. A large book is several files, in order of their names.
    """
    spark = chapters.sparkSession
    if not re.fullmatch(SAFE, version):
        raise ValueError(f"no version name: {version}")
    at, fs = _fs(spark, root)
    final, staging = at(f"{root}/{version}"), f"{root}/.staging-{version}"
    if fs.exists(final):
        raise FileExistsError(f"{root}/{version} is published")
    allowed = passed.select(F.col("book_id").cast("string").alias("book_id")).where(F.col("book_id").rlike(SAFE)).distinct()
    named = chapters.withColumn("book_id", F.col("book_id").cast("string"))
    rows = chapter_lines(named.join(allowed, "book_id", "left_semi"))
    # Ranges of (book, place) keep a book in order over its files, however large it is.
    rows.repartitionByRange("book_id", "ord").sortWithinPartitions("book_id", "ord").select("value", "book_id").write.mode("overwrite").partitionBy("book_id").option("lineSep", "\n").text(staging)
    size = F.size(F.split("value", "\n", -1))
    expected = rows.groupBy("book_id").agg(F.sum(size).alias("n"), F.count("*").alias("n_chapters"))
    if not expected.isEmpty():
        staged = _lines(spark, staging).groupBy(F.col("book_id").alias("b")).agg(F.count("*").alias("m"))
        if not expected.join(staged, F.col("book_id") == F.col("b"), "full_outer").where(~F.col("n").eqNullSafe(F.col("m"))).isEmpty():
            fs.delete(at(staging), True)
            raise OSError("what was staged isn't what was to be written")
    if not fs.rename(at(staging), final):
        raise OSError(f"can't rename to {root}/{version}")
    fs.create(at(f"{root}/{version}/{MARKER}"), True).close()
    return expected.select("book_id", "n_chapters")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    at, fs = _fs(spark, path)
    if not any(s.getPath().getName().startswith("book_id=") for s in fs.listStatus(at(path))):
        return spark.createDataFrame([], "value string, book_id string")  # a version without books has no folder to take book_id from
    return spark.read.schema("value string, book_id string").option("lineSep", "\n").text(path)


def versions(spark: SparkSession, root: str) -> list[str]:
    """The marked versions, by name."""
    at, fs = _fs(spark, root)
    if not fs.exists(at(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(root)) if s.isDirectory()]
    return sorted(n for n in names if not n.startswith(".") and fs.exists(at(f"{root}/{n}/{MARKER}")))


def published(spark: SparkSession, root: str, version: str) -> DataFrame:
    """``book_id, n, line``: the lines of each book of a marked version, numbered in order."""
    if version not in versions(spark, root):
        raise ValueError(f"no version {version}")
    rows = _lines(spark, f"{root}/{version}").withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("_file", "_at"))
    return rows.select("book_id", place.alias("n"), F.col("value").alias("line"))
