from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from quire.llm.ann import in_range, nearest, search

SCHEMA = "vec_id long, embedding array<float>, cid int"


def brute(rows, asked, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            ok[i] = np.array(v, dtype=np.float32).astype(np.float64)
    out = {}
    for q in asked:
        if q in ok:
            s = [(-round(float(v @ ok[q] / np.sqrt(v @ v) / np.sqrt(ok[q] @ ok[q])), 9), i) for i, v in ok.items() if i != q]
            out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def run(spark, rows, step=5):
    out = nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.col("vec_id") % step == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    return got


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(size=24)).astype(np.float32).tolist()) for i in range(1500)]
    want, got = brute(rows, range(0, 1500, 5)), run(spark, rows)
    assert got.keys() == want.keys()
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]
    assert np.mean(hits) / 5 >= 0.9
    assert all([s for _, s in x] == sorted((s for _, s in x), reverse=True) for x in got.values())


def test_odd_rows_and_ties(spark):
    one = [1.0, 0.0]
    rows = [(i, one) for i in range(40)] + [(100, [0.0, 1.0]), (101, [0.0, 0.0]), (102, None), (105, [float("nan"), 1.0]), (110, []), (115, [None, 1.0]), (None, one), (120, [1e30, 1e30]), (125, [1.0, 2.0, 3.0]), (0, one)]
    got = run(spark, rows)
    want = brute([r for r in rows if r[0] != 125], range(0, 130, 5))
    assert got == want and got[0][0] == (1, 1.0) and [v for v, _ in got[5]] == [0, 1, 2, 3, 4]


def test_any_finite_magnitude(spark):
    """Each vector at its own scale, from the least number above zero to nearly the greatest; exact cosines from fractions."""
    rng = np.random.default_rng(3)
    scales = [1e-322, 1e-300, 1e-200, 1e-160, 1.0, 1e160, 1e200, 1e300]
    rows = [(i, [float(x) for x in rng.integers(-9, 10, size=4) * scales[i % 8]]) for i in range(48)]
    rows += [(100, [1e-200, 1e200, 0.0, 0.0]), (105, [5e-324, 0.0, 0.0, 0.0]), (110, [1.7e308, -1.7e308, 1e-308, 0.0])]
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(nearest(df, F.col("vec_id") % 5 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact = {i: [Fraction(x) for x in v] for i, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))

    def cosine(a, b):
        square = dot(a, b) ** 2 / (dot(a, a) * dot(b, b))
        return float(square) ** 0.5 * (1 if dot(a, b) >= 0 else -1)

    for q in (i for i in exact if i % 5 == 0):
        want = sorted((-round(cosine(exact[q], v), 9), i) for i, v in exact.items() if i != q)[:5]
        assert [(-round(s, 9), i) for i, s in sorted(got[q], key=lambda x: (-round(x[1], 9), x[0]))] == want


def test_scaling_leaves_ordinary_vectors_as_they_are(spark):
    v = [0.1, -3.7e80, 2.5e-90]
    (got,) = spark.range(1).select(in_range(F.array(*map(F.lit, v)))).first()
    assert got == v


def test_few_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0])]) == {}
    assert run(spark, [(0, [1.0]), (3, [-2.0])]) == {0: [(3, -1.0)]}


def test_search_expands_the_whole_beam(spark):
    # A chain: every round of the search gets one node further.
    angles = [(i, [float(np.cos(i / 20)), float(np.sin(i / 20))]) for i in range(12)]
    halves = spark.createDataFrame(angles, "cid long, h array<float>")
    chain = [(i, j, float(np.cos(1 / 20))) for i in range(12) for j in (i - 1, i + 1) if 0 <= j < 12]
    graph = spark.createDataFrame(chain, "cid long, nbr long, sim float")
    found = search(graph, halves, spark.createDataFrame([(0,)], "q long")).collect()
    assert sorted(r.cid for r in found) == list(range(12))


def test_outlier_and_far_clusters(spark):
    # One vector against all others, and two tight clusters that point apart: every query gets all its neighbours.
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    rows = [(0, (-base).tolist())] + [(i, (base + 0.01 * rng.normal(size=16)).tolist()) for i in range(1, 400)]
    got = run(spark, rows, 50)
    want = brute(rows, range(0, 400, 50))
    assert {q: len(x) for q, x in got.items()} == dict.fromkeys(range(0, 400, 50), 5)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]) / 5 >= 0.9
