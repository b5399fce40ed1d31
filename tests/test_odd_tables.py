"""Queries against their SQL twins on tables that the test data doesn't hold."""

from __future__ import annotations

import time

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_queries import rows

from quire.catalog import ORACLES, QUERIES
from quire.sources import files


def same(spark, folder, name, table, df):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


def test_events_of_two_logs_share_ids(spark, tmp_path):
    events = spark.createDataFrame([(i, f"k{i % 7}") for i in (0, 1, 99, 100, 300, 1_000_000, 1_000_001, 1_000_100, 1_000_300, 2_000_000)], "event_id long, event_type string")
    assert len(same(spark, tmp_path, "event_merge", "events", events)) == 17


def test_conflicts_without_urls(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x"), (2, "http://a/x"), (3, "http://a/"), (4, "http://b/"), (5, None), (6, None), (7, "x"), (8, "")], "page_id long, url string")
    assert len(same(spark, tmp_path, "conflict_catalog", "pages", pages)) == 3


def test_conflicts_of_one_large_book(spark, tmp_path):
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.format_string("http://one.example/en/%s/%09d", F.lit("x" * 100), "id").alias("url"))
    began = time.time()
    assert same(spark, tmp_path, "conflict_catalog", "pages", pages).n.tolist() == [60_000] and time.time() - began < 60


def test_logs_of_many_tasks_share_files(spark, tmp_path):
    events = spark.range(3000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 401 != 0, F.col("id") * 7 % 400).alias("user_id"), F.concat(F.lit('k"\n\n['), F.col("id") % 3).alias("event_type"))
    assert len(same(spark, tmp_path, "event_log_files", "events", events)) == 3000
    assert len(QUERIES["event_log_files"](spark, str(tmp_path)).inputFiles()) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_logs_in_folders_and_in_shared_files(spark, tmp_path):
    schema = T.StructType.fromDDL("event_id long, seq long")
    array, lines = '[{%s"event_id":1,"seq":0},\n{%s"event_id":2,"seq":5}]', '{%s"event_id":3,"seq":0}\n{%s"event_id":4,"seq":9}\n{%s"event_id":5,"seq":0}\n'
    for part, text in (("arrays", array), ("lines", lines)):
        shared = []
        for task in "ab":
            (tmp_path / "apart" / part / f"task={task}").mkdir(parents=True)
            (tmp_path / "apart" / part / f"task={task}" / "x.json").write_text(text.replace("%s", ""))
            shared.append(text.replace("%s", f'"task":"{task}",'))
        (tmp_path / "shared" / part).mkdir(parents=True)
        (tmp_path / "shared" / part / "x.json").write_text((files.APART if part == "arrays" else "").join(shared))
    want = [(t, e, n) for t in "ab" for e, n in ((1, 1), (2, 5), (3, 6), (4, 9), (5, 10))]
    for layout, apart in (("apart", None), ("shared", files.APART)):
        got = files.event_logs(spark, schema, f"{tmp_path}/{layout}/lines", f"{tmp_path}/{layout}/arrays", apart)
        assert sorted((r.task, r.event_id, r.seq) for r in got.collect()) == want


def test_headings_of_every_form(spark, tmp_path):
    part = spark.range(12_000).select(
        F.col("id").alias("p_partkey"), F.when(F.col("id") % 997 != 0, F.concat(F.lit("ring"), F.element_at(F.array(*map(F.lit, ("", " (a)", "（"))), (F.col("id") % 3 + 1).cast("int")))).alias("p_name"),
        F.concat(F.lit("Brand#"), F.col("id") * 5 % 23).alias("p_brand"), F.when(F.col("id") % 991 != 0, F.pmod(F.xxhash64("id"), F.lit(50)) + 1).cast("int").alias("p_size"),
    )
    got = same(spark, tmp_path, "heading_numbers", "part", part)
    assert got.number.dropna().nunique() > 990 and got.number.isna().sum() > 3000 and (got.complete == False).sum() > 1000  # noqa: E712
