"""Centroid clustering against plain loops over all centroids."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm.centroids import Centroids, cluster

MOST = (1 << 63) - 1


def plain(rows, k, dim, rounds):
    rows = [(i, [math.floor(1024 * x) if abs(x) < 1e200 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(q) for _, q in seeds]
    dist = lambda q, m: sum((a - b) ** 2 for a, b in zip(q, m, strict=True))
    near = lambda q: min((dist(q, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in rows]
        n = Counter(own)
        for j in n:
            c[j] = [sum(q[p] for (_, q), o in zip(rows, own, strict=True) if o == j) // n[j] for p in range(dim)]
    last = [(i, *near(q)) for i, q in rows]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    cut = lambda x: min(x, MOST)
    return sorted(((i, j, cut(d), cut(inertia[j]), cut(sum(inertia.values())), digest[j]) for i, d, j in last), key=str)


def clustered(spark, rows, kind="float", **k):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, own int, members string")
    return sorted((tuple(r) for r in cluster(df, **k).collect()), key=str)


def test_clusters(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 6))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 12] + rng.normal(size=6) * 0.3]) for i in range(600)]
    rows += [(5, rows[5][1]), (700, None), (701, [1.0]), (702, [float("nan")] * 6), (703, [None] * 6), (704, [float("inf")] * 6), (None, rows[9][1])]
    assert clustered(spark, rows, k=8, dim=6, rounds=10) == plain(rows, 8, 6, 10)


def test_ties(spark):
    """Points of a small grid: many are as near to one centroid as to another."""
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-2, 3) / 1024 for _ in range(3)]) for i in range(300)]
    assert clustered(spark, rows, k=6, dim=3, rounds=4) == plain(rows, 6, 3, 4)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e150, 1e306])
def test_large_components(spark, size):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-size, size), rng.uniform(-1, 1), -0.0, 5e-324]) for i in range(40)]
    assert clustered(spark, rows, "double", k=4, dim=4, rounds=3) == plain(rows, 4, 4, 3)


def test_few_and_none(spark):
    rows = [(3, [0.5, -0.5]), (4, [0.25, 0.25])]
    assert clustered(spark, rows, k=8, dim=2, rounds=2) == plain(rows, 8, 2, 2)
    assert clustered(spark, [], k=8, dim=2) == [] == clustered(spark, [(1, None)], k=8, dim=2)


def test_bounds_leave_out_and_never_change_results():
    rng = np.random.default_rng(6)
    q = (np.repeat(rng.integers(-4000, 4000, size=(8, 16)), 50, axis=0) + rng.integers(-90, 90, size=(400, 16))).astype(np.int64)
    now, before = q[rng.choice(400, 8, replace=False)].copy(), None
    own, upper, lower = np.zeros(400, dtype=np.int32), np.full(400, np.inf), np.zeros((400, 8))
    counts = []
    for _ in range(8):
        own, upper, lower, n = Centroids(now, before).assign(q, own, upper, lower)
        counts.append(n)
        d = ((q[:, None] - now[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d[np.arange(400), own])).all() and (lower <= np.sqrt(d)).all()
        before, now = now, np.array([q[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else now[j] for j in range(8)])
    assert counts[-1] < 0.2 * counts[0]
