"""Versioned snapshots of state tables: write, list, restore, retain. Names sort by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 3
NAME = r"^(auto|manual|pre-restore)-[0-9]{8}-[0-9]{6}$"


def write_snapshot(tables: dict[str, DataFrame], root: str, name: str) -> str:
    """Each table below ``root/name``; the commit of the last one, ``meta_version``, makes the snapshot valid."""
    spark = next(iter(tables.values())).sparkSession
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{table}")
    spark.createDataFrame([(SCHEMA_VERSION, sorted(tables))], "version int, tables array<string>").coalesce(1).write.mode("errorifexists").json(f"{root}/{name}/meta_version")
    return name


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """``name, version, tables`` of complete snapshots, newest first."""
    found = spark.read.schema("version int, tables array<string>").json(f"{root}/*/meta_version")
    rows = found.withColumn("name", F.regexp_extract(F.input_file_name(), r"/([^/]+)/meta_version/", 1)).where(F.col("name").rlike(NAME))
    return rows.select("name", "version", "tables").orderBy(F.regexp_extract("name", r"([0-9]{8}-[0-9]{6})$", 1).desc(), F.desc("name"))


def restore(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """The tables of a snapshot; one that a newer version wrote is refused."""
    rows = snapshots(spark, root).where(F.col("name") == name).collect()  # one row
    if not rows:
        raise ValueError(f"no snapshot {name}")
    if rows[0]["version"] > SCHEMA_VERSION:
        raise ValueError(f"snapshot {name} was written by a newer version")
    return {t: spark.read.parquet(f"{root}/{name}/{t}") for t in rows[0]["tables"]}


def retained(found: DataFrame, keep: int = 7) -> DataFrame:
    """The newest ``keep`` snapshots of any kind."""
    return found.orderBy(F.regexp_extract("name", r"([0-9]{8}-[0-9]{6})$", 1).desc(), F.desc("name")).limit(keep)
