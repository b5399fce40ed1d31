from __future__ import annotations

import duckdb
from test_line_dedup import run as plain

from quire.llm.line_dedup import dedup_lines
from quire.llm.registry import ORACLES, QUERIES


def test_short_texts_and_long_lines(spark):
    long, other = "word " * 51, "word " * 50
    docs = [(1, f"a\n{long}\nb\nc"), (2, f"d\n{long}\n\ne"), (3, f"{long}"), (4, "x\n\ny"), (5, "x\ny"), (6, "y\nx"), (7, "z"), (8, " \nz"), (9, f"{long}\n{long}\nq"),
            (10, f"f\n{other}\ng"), (11, f"h\n{other}\ni"), (12, None), (13, "")]
    assert all(r[2] == 0 for r in plain(spark, docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in dedup_lines(df, long_words=50).collect()}
    assert got == {k: (0, docs[k - 1][1]) for k in (1, 4, 6, 7, 10, 11, 12, 13)} | {2: (1, "d\n\ne"), 3: (1, ""), 5: (2, ""), 8: (1, " "), 9: (2, "q")}


def test_twin(spark, data):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.execute(ORACLES["op10_line_dedup"]).fetchall()
    assert sorted(map(tuple, QUERIES["op10_line_dedup"](spark, data).collect())) == sorted(want)
