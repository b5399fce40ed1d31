"""Listings of directories, JSON documents and event logs. Every reader goes through Spark, so any store that it opens will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Limits of a source directory and of one file.
MOST_FILES, MOST_BYTES, MOST_FILE = 20_000, 2 << 30, 64 << 20


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``path, size, modified`` of the files below ``root`` that no dot hides; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.where(~F.col("path").rlike(r"/\.[^/]+(/|$)"))
    if suffixes:
        rows = rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    return rows


def over_limits(files: DataFrame) -> DataFrame:
    """One row: how many files and bytes, and the first limit that is passed (or null)."""
    sums = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))
    return sums.withColumn(
        "error",
        F.when(F.col("n_files") > MOST_FILES, "files").when(F.col("largest") > MOST_FILE, "file-size").when(F.col("n_bytes") > MOST_BYTES, "total-size"),
    )


def strict_json(column: Column, schema: StructType) -> Column:
    """A JSON object of exactly the known keys; null if it doesn't parse or has others."""
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    keys = F.json_object_keys(column)
    return F.when(keys.isNotNull() & (F.size(F.array_except(keys, known)) == 0), F.from_json(column, schema))


def task_events(spark: SparkSession, schema: StructType, lines: str, legacy: str | None = None) -> DataFrame:
    """An event log: an older JSON array first, then JSON lines; events without a sequence are numbered on."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(lines).withColumn("_part", F.lit(1))
    if legacy:
        rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(legacy).withColumn("_part", F.lit(0)).unionByName(rows)
    return number_events(rows.withColumn("_at", F.monotonically_increasing_id()), "_part", "_at").drop("_part", "_at")


#: Between the arrays of a file that holds several: an empty line, which no array has inside.
APART = "\n\n"


def event_logs(spark: SparkSession, schema: StructType, lines: str, legacy: str | None = None, apart: str | None = None) -> DataFrame:
    """The logs of many tasks below ``lines`` (JSON lines) and ``legacy`` (older JSON arrays): arrays first, numbered on by task.

    ``schema`` is that of an event, with ``seq``. The task is named by a folder ``task=<id>`` of its own or, where files are shared, by each event (``task``).
    A legacy file is one array, or several with ``apart`` between them. Rows count in order of their file's name and their place in it.
    """
    whole = StructType([*schema.fields, StructField("task", StringType())])

    def read(part: int, path: str, **options: str) -> DataFrame:
        rows = spark.read.schema(whole).options(mode="FAILFAST", **options).json(path)
        return rows.withColumn("_part", F.lit(part)).withColumn("_where", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")))

    rows = read(1, lines)
    if legacy:
        rows = read(0, legacy, **({"lineSep": apart} if apart else {"multiLine": "true"})).unionByName(rows)
    return number_events(rows, "_part", "_where", task="task").drop("_part", "_where")


def number_events(rows: DataFrame, part: str, at: str, seq: str = "seq", task: str | None = None) -> DataFrame:
    """Sequence 0 becomes the last known sequence plus the events since."""
    order = Window.partitionBy(task or F.lit(0)).orderBy(part, at)
    known = F.when(F.nullif(F.col(seq), F.lit(0)).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col("_n").alias("n")))
    last = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_n", F.row_number().over(order)).withColumn("_last", last)  # one sort serves both
    return marked.withColumn(seq, F.coalesce(F.col("_last.seq") - F.col("_last.n"), F.lit(0)).cast("long") + F.col("_n")).drop("_n", "_last")


def image_pages(lines: DataFrame, line: str = "line") -> DataFrame:
    """Pages that hold an image of at least 120 by 80, from a listing whose rows start with page, number, type, width, height."""
    cols = F.split(F.trim(F.col(line)), r"\s+")
    at = lambda k: F.get(cols, F.lit(k)).try_cast("int")
    return lines.where((at(3) >= 120) & (at(4) >= 80) & at(0).isNotNull()).select(at(0).alias("page")).distinct()
