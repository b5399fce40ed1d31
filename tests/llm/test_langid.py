from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import langid
from quire.llm.langid import fit_langid, identify, ngrams, predict_language


def test_ngrams_count_everything():
    text = "Abcab cÉ🙂 abC" * 3
    low = text.lower()
    at, n = ngrams(text)
    assert n.sum() == len(low) + len(low) - 1 + len(low) - 2
    one = ngrams("a")
    assert one[1].sum() == 1 and n[list(at).index(one[0][0])] >= Counter(low)["a"]
    assert ngrams("")[1].sum() == 0


def test_pieces(monkeypatch):
    text = "Some words, été " * 40
    whole = ngrams(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert all(np.array_equal(a, b) for a, b in zip(whole, ngrams(text), strict=True))


def test_accuracy_and_cases(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("lang_pred"))
    extra = spark.createDataFrame([(-1, None, "en", ""), (-2, "", "en", ""), (-3, "12 !?", "de", ""), (None, "Le chat est là", None, "")], docs.schema)
    rows = predict_language(docs.unionByName(extra)).collect()
    assert len(rows) == docs.count() + 4
    by = {r.doc_id: r for r in rows}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (-1, -2, -3))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = fit_langid(docs, F.lit(True))
    assert [(r.lang_pred, r.score) for r in identify(docs, model).collect()] == [("und", 0.0)]
    assert predict_language(docs.limit(0)).count() == 0


def test_temperature_and_sparsity(spark):
    docs = spark.createDataFrame([(i, ("ab cd " if i % 2 else "xy zw ") * 5, "p" if i % 2 else "q") for i in range(60)], "doc_id long, text string, lang string")
    model = fit_langid(docs, F.lit(True))
    assert 0.05 <= model.temperature <= 5 and np.mean(model.weights == 0) > 0.9
    assert model.predict("ab ab")[0] == "p" and model.predict("zw xy")[0] == "q"


def test_ftrl_against_plain_loops():
    """The same updates coordinate by coordinate."""
    from math import exp, log, sqrt

    rows = [(np.array([1, 5]), np.array([1, 2]), 0), (np.array([2, 5]), np.array([3, 1]), 1), (np.array([1]), np.array([1]), 0)] * 3
    model = langid.Model(["a", "b"], np.ones(langid.SIZE), np.zeros((2, langid.SIZE + 1)))
    langid.train(model, rows[:9], epochs=2, alpha=0.5, beta=1.0, l1=0.02, l2=0.02)
    z, n = {}, {}

    def weight(k, i):
        zi, ni = z.get((k, i), 0.0), n.get((k, i), 0.0)
        return 0.0 if abs(zi) <= 0.02 else -(zi - (0.02 if zi > 0 else -0.02)) / ((1 + sqrt(ni)) / 0.5 + 0.02)

    for _ in range(2):
        for at, count, y in rows[:9]:
            x = {int(i): 1 + log(c) for i, c in zip(at, count, strict=True)}
            norm = sqrt(sum(v * v for v in x.values()))
            x = {i: v / norm for i, v in x.items()} | {langid.SIZE: 1.0}
            w = {(k, i): weight(k, i) for k in (0, 1) for i in x}
            e = [exp(sum(w[k, i] * v for i, v in x.items())) for k in (0, 1)]
            for k in (0, 1):
                for i, v in x.items():
                    g = (e[k] / sum(e) - (k == y)) * v
                    old = n.get((k, i), 0.0)
                    z[k, i] = z.get((k, i), 0.0) + g - (sqrt(old + g * g) - sqrt(old)) / 0.5 * w[k, i]
                    n[k, i] = old + g * g
    for k in (0, 1):
        for i in (1, 2, 5, langid.SIZE):
            assert np.isclose(model.weights[k, i], weight(k, i))
