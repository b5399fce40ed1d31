from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quire.llm import bloom
from quire.llm.url_filter import filter_urls

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("org", "/", "block"), (None, "/", "block")]


def judge(spark, urls, rules=RULES):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def test_rules(spark):
    got = judge(spark, [
        "http://A.Example.COM/en/72?x", "https://example.com/en/8#f", "http://notexample.com/en/7", "http://com/en/", "http://x.org",
        "http://x.org/?q=/", None, "no scheme/en/", "http://example.com?/en/7", "ftp://a://b/en/",
    ])
    assert got[0] == ("a.example.com", "/en/72", "example.com/en/7", "allow")
    assert got[1] == ("example.com", "/en/8", "com/en/", "block")
    assert got[2] == ("notexample.com", "/en/7", "com/en/", "block")
    assert got[3] == ("com", "/en/", "com/en/", "block")
    assert got[4] == ("x.org", "", None, "allow") and got[5] == ("x.org", "/", "org/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("example.com", "", None, "allow") and got[9] == ("a:", "//b/en/", None, "allow")


def test_repeated_rows_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")] * 3 + [(None, None)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert filter_urls(pages, rules).count() == 4
    assert {r.verdict for r in filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), rules).count() == 0


def test_shuffled_rules_and_long_urls(spark, monkeypatch):
    from quire.llm import url_filter

    urls = [f"http://h{i}.{'example.com' if i % 3 else 'org'}/en/{i}" for i in range(300)] + ["http://a.com/" + "x" * 200_000, "http://" + "a." * 300 + "com/en/", None]
    want = judge(spark, urls)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert judge(spark, urls) == want and want[301][3] == "block" and want[300][3] == "allow"


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    words = bloom.build(keys, 20_000)
    passes = lambda df: bloom.passes(words, df.toPandas()["h"].to_numpy())
    assert passes(keys).all()
    assert np.mean(passes(spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h")))) < 0.05
