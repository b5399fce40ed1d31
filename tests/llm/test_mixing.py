from __future__ import annotations

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing
from quire.llm.mixing import mix_sources

SCHEMA = "doc_id long, source string, text string, size int, v int"


def targets(sizes, weights=(5, 2, 1), most=3):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), total
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return out | share
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full


def mixed(spark, rows, **k):
    return [r.asDict() for r in mix_sources(spark.createDataFrame([(*r, 9, 9) for r in rows], SCHEMA), **k).collect()]


@pytest.mark.parametrize("buckets", [4096, 3])
def test_targets_and_takes(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rows = [(i, f"s{(i * i) % 7}" if i % 11 else None, " ".join(["word"] * (i % 23))) for i in range(900)] + [(5, "tiny", "a b c"), (5, "tiny", "a b c"), (None, "z", None), (6, "z", "")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    sizes, taken, want, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        want[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
    expected = targets(dict(sizes))
    for s, t in want.items():
        assert math.isclose(t, expected[s], rel_tol=1e-9, abs_tol=1e-9), s
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    assert all(r["source_size"] == sizes[r["source"]] for r in got)
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixed(spark, rows[::-1])))


def test_heavier_documents_come_first(spark):
    rows = [(i, s, "word " * 10) for i in range(2000) for s in ("a", "b")]
    got = mixed(spark, rows, weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1))
    part = [r for r in got if r["source"] == "b"]
    even = sum(r["taken"] for r in part if r["doc_id"] % 2 == 0)
    assert even > 1.5 * sum(r["taken"] for r in part if r["doc_id"] % 2)


def test_measured_weights(spark):
    """Cells weigh the share of good documents among their labelled ones; documents of good cells come first."""
    good, bad = "This is prose of some length. " * 4, "x9 #1 %% $$ 7 " * 9
    rows = [(i, s, good if i % 2 else bad) for i in range(1200) for s in ("a", "b")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400)] + [(None, 1), (99999, 0), (7, None)], "doc_id long, quality int")
    cells = spark.createDataFrame(rows, "doc_id long, source string, text string").select("doc_id", mixing.quality_cell(F.col("text"), F.size(F.split("text", " ")).cast("long")).alias("cell"))
    w = sorted(r.w for r in mixing.measured_weights(cells, labels).collect())
    assert w == [0.05, 401 / 402]
    part = [r for r in mixed(spark, rows, labels=labels) if r["source"] == "b"]
    taken = [sum(r["taken"] for r in part if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert taken[1] == 600 * 24 and taken[0] < 0.5 * 600 * 45  # all good ones, then some of the others
    assert mixed(spark, rows, labels=labels.limit(0))


def test_shuffled_sources_and_long_texts(spark, monkeypatch):
    rows = [(i, f"s{i % 5}", "word " * (i % 7)) for i in range(200)] + [(900, "s1", "long " * 200_000)]
    want = sorted(map(str, mixed(spark, rows)))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixed(spark, rows))) == want
    extra = spark.createDataFrame([(*r, 1, 2.0, 3, 4) for r in rows], "doc_id long, source string, text string, bucket int, v double, cell int, label_id int")
    assert mix_sources(extra).count() == len(rows)


def test_weights_of_nothing_and_more(spark):
    got = mixed(spark, [(i, "a", "one two") for i in range(50)] + [(i, "b", "x") for i in range(50, 60)], weight=F.lit(0.0))
    assert len(got) == 60 and len(mixed(spark, [(1, "a", "b")], weight=F.lit(7.0))) == 1


def test_empty(spark):
    assert mixed(spark, []) == []
    assert [r["taken"] for r in mixed(spark, [(1, "a", None)])] == [0]
