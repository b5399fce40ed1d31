"""Operators over one large group, and against plain Python."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import desk as K
from quire.operators import documents as D
from quire.operators import ledger as L
from quire.operators import mapper as M
from quire.operators import shelf as H
from quire.operators import state as S
from quire.plans import scratch
from quire.plans.ordering import global_places, group_places


def greedy(sizes, most, most_chars):
    out, batch, n, chars = [], 0, 0, 0
    for c in sizes:
        if batch == 0 or n >= most or chars + c > most_chars:
            batch, n, chars = batch + 1, 0, 0
        n, chars = n + 1, chars + c
        out.append(batch)
    return out


@pytest.mark.parametrize("segment", [5, 64, 4096])
def test_batches_are_greedy(spark, monkeypatch, segment):
    monkeypatch.setattr(L, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = [(book, f"{i:06d}", rng.choice([0, 1, 3, 9, 40])) for book in ("a", "b", None) for i in range(rng.randrange(1, 400))]
    got = {(r.book, r.id): (r.chars, r.batch) for r in L.batches(spark.createDataFrame(rows, "book string, id string, n int"), "book", "id", F.col("n"), 5, 20).collect()}
    for book in ("a", "b", None):
        own = sorted(r for r in rows if r[0] == book)
        assert [got[book, i] for _, i, _ in own] == list(zip([n for *_, n in own], greedy([n for *_, n in own], 5, 20), strict=True))
    assert L.batches(spark.createDataFrame([], "book string, id string, n int"), "book", "id", F.col("n")).collect() == []


def test_batches_of_one_large_book(spark):
    df = spark.range(300_000).select(F.lit("b").alias("book"), F.format_string("%09d", "id").alias("id"), (F.col("id") * 7919 % 700).alias("n"))
    began = time.time()
    got = [r.batch for r in L.batches(df, "book", "id", F.col("n")).orderBy("id").select("batch").collect()]
    assert got == greedy([i * 7919 % 700 for i in range(300_000)], 80, 12_000) and time.time() - began < 600


def test_places(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 1, 2, 3])) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, g string, x int")
    key = lambda r: (r[2] is not None, -(r[2] or 0), r[0])
    got = {r.id: r.place for r in global_places(df, [F.col("x").isNotNull(), F.col("x").desc(), F.col("id")]).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    got = {r.id: r.place for r in group_places(df, "g", [F.col("x").isNotNull(), F.col("x").desc(), F.col("id")]).collect()}
    assert got == {r[0]: n for g in ("hot", "a", None) for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=key), 1)}
    shelf = H.shelf_places(df.withColumn("t", F.lit("t")), "x", "t", "id")
    assert [r.place for r in shelf.orderBy("place").collect()] == list(range(1, 801))
    exchanges = shelf._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in exchanges.split("BroadcastExchange")[0]


def test_chains(spark):
    rng = random.Random(2)
    rows = [(b, i, rng.randrange(6)) for b in (1, 2) for i in range(60)] + [(3, 1, 5), (3, 2, 5), (3, 3, None), (None, 1, 1), (None, 2, 2)]
    df = spark.createDataFrame(rows, "book long, at long, o long")
    want = {}
    for book in (1, 2, 3, None):
        own = sorted((a, o) for b, a, o in rows if b == book and o is not None)
        best = {}
        for a, o in reversed(own):
            best[a, o] = 1 + max((n for (x, p), n in best.items() if x > a and p == o + 1), default=0)
        length, at = max((n, a) for (a, _), n in best.items())
        want[book] = (length, at)
    assert {r.book: (r.length, r.start) for r in D.longest_chain(df, "book", "at", "o").collect()} == want
    chains = {}
    for r in sorted(D.longest_chain_rows(df, "book", "at", "o").collect(), key=lambda r: r.at):
        chains.setdefault(r.book, []).append((r.at, r.ordinal))
    for book, chain in chains.items():
        assert len(chain) == want[book][0] and chain[0][0] == want[book][1]
        assert all(b[1] == a[1] + 1 and b[0] > a[0] for a, b in zip(chain, chain[1:], strict=False))
    assert chains.keys() == want.keys()


def test_one_long_chain(spark):
    df = spark.range(50_000).select(F.lit(1).alias("book"), F.col("id").alias("at"), F.col("id").alias("o"))
    assert D.longest_chain(df, "book", "at", "o").first()[1:] == (50_000, 0)


def test_admission(spark):
    rng = random.Random(3)
    rows = [(i, b, s, s + rng.randrange(0, 9)) for b in ("x", "y", None) for i in range(300) for s in [rng.randrange(200)]]
    rows = [(n, b, s, e) for n, (_, b, s, e) in enumerate(rows)]
    want = []
    for i, b, s, e in rows:
        if not any(b == x[1] and x[2] < e and s < x[3] for x in want):
            want.append((i, b, s, e))
    got = S.admit(spark.createDataFrame([*rows, (9999, "z", 5, 1)], "id long, blk string, s int, e int"), ["blk"], "id", "s", "e").collect()
    assert sorted((r.id, r.blk, r.s, r.e) for r in got) == want


def test_admission_in_one_block_is_near_linear(spark):
    rng = random.Random(4)
    rows = [(i, 1, s, s + 3) for i in range(60_000) for s in [rng.randrange(400_000)]]
    began = time.time()
    n = S.admit(spark.createDataFrame(rows, "id long, blk int, s int, e int"), ["blk"], "id", "s", "e").count()
    assert 40_000 < n < 60_000 and time.time() - began < 400


def test_nearest(spark):
    rng = random.Random(5)
    targets = [(i, g, None if i % 50 == 0 else rng.randrange(0, 60) / 2) for i in range(300) for g in [rng.choice(["a", "b", "none", None])]]
    blocks = [(g, rng.choice([None, *range(0, 30)]), f"k{i}") for i, g in enumerate(["a", "b", "other"] * 12)]
    got = K.nearest(spark.createDataFrame(targets, "id long, g string, at double"), spark.createDataFrame(blocks, "g string, p int, block string"), "g", "at", "p", "block").collect()
    want = {}
    for i, g, at in targets:
        near = [(abs(at - p), p, b) for h, p, b in blocks if h == g and p is not None] if at is not None else []
        if near:
            want[i] = min(near)[2]
    assert {r.id: r.block for r in got} == want


def test_mapper(spark):
    def worker(batch):
        if any("raise" in t for _, t in batch):
            raise ValueError("no")
        return [(i, t.upper()) for i, t in batch if t != "omit"] + [(i, t) for i, t in batch if t == "twice"] + [("stranger", "x") for i, t in batch if t == "invent"]

    texts = ["fine {{GR1}}".replace("GR1", "GR12"), "omit", "twice", "raise it", "invent", "plain words", "", None] + ["ok"] * 40
    rows = [(b, f"{i:03d}", t) for b in ("a", "b") for i, t in enumerate(texts)]
    got = {(r.book, r.block_id): r for r in M.map_in_batches(spark.createDataFrame(rows, "book string, block_id string, text string"), worker, most=16).collect()}
    assert len(got) == len(rows)
    kinds = {"omit": "missing", "twice": "duplicate", "raise it": "error", "invent": "unknown", "": "invalid", None: "invalid"}
    for b, i, t in rows:
        r = got[b, i]
        assert r.problem == kinds.get(t), (t, r)
        assert r.text == (t if t in kinds else t.upper())
        assert (r.turn == 1) == (i >= "016") and len(r.grp) == 5 + r.turn
    once = M.map_in_batches(spark.createDataFrame(rows, "book string, block_id string, text string"), worker, most=16, turns=1)
    assert once.where("problem IS NOT NULL").count() == 32 and once.count() == len(rows)
    assert M.map_in_batches(spark.createDataFrame([], "book string, block_id string, text string"), worker).collect() == []


def test_scope_drops_tables(spark):
    root = scratch.scratch_root(spark).removeprefix("file://")
    from pathlib import Path

    before = set(Path(root).iterdir())
    with scratch.scratch_scope():
        assert global_places(spark.range(5), [F.col("id")]).count() == 5
        assert set(Path(root).iterdir()) > before
    assert set(Path(root).iterdir()) == before
