"""Queries on texts whose end decides the result."""

from __future__ import annotations

import hashlib

import duckdb
from test_queries import rows

from quire.catalog import ORACLES, QUERIES


def both(spark, tmp_path, name, docs):
    """The query's rows by its columns, after comparison with its twin."""
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(found) == rows(con.execute(ORACLES[name]).fetch_df())
    return found.to_dict("records")


def test_failure_classes(spark, tmp_path):
    late = ["rate limit", "not logged in", "network timeout", "login first", "usage limit"]
    docs = [(8 * i + 3, "x" * 5000 + f" {t} " + "y" * 99) for i, t in enumerate(late)] + [(83, "x" * 5000), (91, ""), (99, "x" * 5000 + "译文")]
    found = both(spark, tmp_path, "failure_classes", docs)
    got = {r["doc_id"]: (r["failure"], r["provider"]) for r in found if r["of"] == "text"}
    assert len(found) == 2 * len(docs) and got[83] == got[91] == ("unknown", "provider")
    assert got[19] != got[83] and got[27][1] == "authentication" and got[35] != got[83]
    assert [r["doc_id"] for r in found if r["of"] == "text" and r["split"]] == [99]
    assert {r["failure"] for r in found if r["of"] == "text"} >= {"transient", "unknown", "permanent"}


def test_split_pages(spark, tmp_path):
    texts = {1: "a\nb\nc\nd\ne\n\nlast", 2: "one", 3: "", 4: "a\n", 5: None, 6: "p\fq\nr\ns"}
    found = both(spark, tmp_path, "split_pages_exactly", list(texts.items()))
    for extra in (-1, 0, 1):
        for i, t in texts.items():
            pages = [] if t is None else (t.replace("\f", "\n").split("\n") + [""])[: len(t.replace("\f", "\n").split("\n")) + extra]
            got = sorted((r["page"], r["n_chars"]) for r in found if (r["doc_id"], r["extra"]) == (i, extra))
            assert got == [(k + 1, len(p)) for k, p in enumerate(pages)]


def test_escaped_texts(spark, tmp_path):
    tail = "& < > \" ' &amp; é"
    found = both(spark, tmp_path, "text_measures", [(1, "x" * 5000 + tail), (2, ""), (3, None), (4, tail)])
    want = "&amp; &lt; &gt; &quot; &#039; &amp;amp; é"
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert {r["doc_id"]: r["escaped"] for r in found} == {1: digest("x" * 5000 + want), 2: digest(""), 3: None, 4: digest(want)}
