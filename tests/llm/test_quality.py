from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quire.llm import quality
from quire.llm.quality import FEATURES, Forest, classify_quality, fit, statistics


def walk(forest: Forest, row: np.ndarray) -> float:
    total = forest.base
    for t in range(len(forest.feature)):
        at = 0
        for _ in range(forest.depth):
            at = 2 * at + 1 + int(row[forest.feature[t, at]] > forest.threshold[t, at])
        total += forest.value[t, at]
    return total


def test_traversal_and_learning():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = fit(x[:600], y[:600])
    assert np.allclose(forest.margin(x[:50]), [walk(forest, r) for r in x[:50]])
    assert np.mean((forest.score(x[600:]) > 0.5) == y[600:]) > 0.93


def test_few_or_no_labels():
    x = np.zeros((3, 2))
    assert np.allclose(fit(x[:0], np.zeros(0)).score(x), 0.5)
    assert (fit(x, np.ones(3)).score(x) > 0.5).all()


def test_statistics(monkeypatch):
    texts = [None, b"", b" \n", "Ünï çode".encode(), b"\x00\xff" * 10, b"A! " * 100]
    s = statistics(texts)
    assert s.shape == (6, FEATURES) and np.isfinite(s).all() and not s[0].any() and not s[1].any()
    long = [b"Some words here.\n" * 400, b"a b c d e f " * 900 + b"\n\nx\n" + bytes(range(65, 91)) * 200]
    whole = statistics(long)
    monkeypatch.setattr(quality, "PIECE", 1700)
    assert np.array_equal(whole, statistics(long))


def test_statistics_by_hand():
    text = b"One two, two three.\n\nOne two, two three.\nX1"
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    want = [np.log1p(9), sum(map(len, words)) / 9, len(set(words)) / 9, len(set(zip(words, words[1:]))) / 9, 3 / 29, 3 / 9, 2 / 3, 19 / len(text), 4 / 9, 0, 0, 1 / 9]  # noqa: B905
    assert np.allclose(statistics([text])[0, 12:], want)


def test_first_tree_is_the_best_one_by_brute_force():
    """Every cut of every column is tried; the histogram fit must reach the same gains and leaf values."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, size=(120, 3)).astype(float), rng.integers(0, 2, 120).astype(float)
    forest = fit(x, y, trees=1, depth=2, rate=1.0, bins=64, l2=1.0, least=2.0)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(rows, left):
        a, b = rows & left, rows & ~left
        if h[a].sum() < 2 or h[b].sum() < 2:
            return 0
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (a, b)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)

    def check(rows, node, level):
        if level == 2:
            assert np.isclose(forest.value[0, node], -g[rows].sum() / (h[rows].sum() + 1))
            return
        best = max(gain(rows, x[:, j] <= c) for j in range(3) for c in range(9))
        left = x[:, forest.feature[0, node]] <= forest.threshold[0, node]
        assert np.isclose(gain(rows, left), best) or best <= 1e-6
        check(rows & left, 2 * node + 1, level + 1)
        check(rows & ~left, 2 * node + 2, level + 1)

    check(np.ones(120, dtype=bool), 0, 0)


def test_held_out_accuracy_and_cases(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(10**9, None, 1.0), (10**9, "", 1.0), (None, "x", 1.0)], "doc_id long, text string, score double")
    got = classify_quality(docs.select("doc_id", "text", F.lit(9.0).alias("score")).unionByName(extra), labels)
    rows = got.collect()
    assert len(rows) == docs.count() + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean(held) > 0.93
    assert {r.score for r in classify_quality(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert classify_quality(docs.limit(0), labels).count() == 0
