from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import jaccard
from quire.llm.components import connected
from quire.llm.jaccard import indexed, jaccard_components, needed
from quire.llm.shingles import Shingler


def sets(text, k):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, percent):
    found = [(i, sets(t, k)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(found):
        for j, b in found[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return sorted((i, len(s), top(i)) for i, s in found)


def run(spark, docs, k=4, percent=85):
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, id int")
    return sorted(map(tuple, jaccard_components(df, k=k, percent=percent).collect()))


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice(["", "É", "x"])
    bases = [[word() for _ in range(rng.choice([2, 5, 9, 14, 40, 90, 200]))] for _ in range(14)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
        docs.append((i * 3 % 1000, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return list({i: (i, t) for i, t in docs}.values())


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 85)])
def test_brute_force(spark, k, percent):
    docs = corpus(k) + [(2001, None), (2002, ""), (2003, " \n "), (2004, "a b"), (2005, "A\tB"), (2006, "w " * 9000)]
    assert run(spark, docs, k, percent) == brute(docs, k, percent)


def test_small_chunks_and_chains(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 2)
    base = [f"w{i}" for i in range(100)]
    chain = [(i, " ".join([f"n{j}" for j in range(i)] + base[i:])) for i in range(0, 60, 3)]
    docs = [(i + 100, t) for i, t in chain] + [(i, t) for i, t in corpus(9, 60)]
    docs = list({i: (i, t) for i, t in docs}.values())
    for k, percent in ((1, 85), (2, 80)):
        assert run(spark, docs, k, percent) == brute(docs, k, percent)


def test_ids(spark):
    got = run(spark, [(5, "a b c d"), (5, "q r s t"), (3, "q r s t"), (9, "a b c d")])
    assert got == [(3, 1, 3), (5, 1, 3), (5, 1, 3), (9, 1, 3)]
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard_components(df).collect()), key=repr) == [(1, 1), (None, None)]
    assert run(spark, []) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 2**32), st.sampled_from([30, 80, 85, 93]))
def test_linked_sets_share_indexed_tokens(n, gone, new, seed, percent):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, n, dtype=np.uint64)
    b = np.concatenate([a[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)])
    common, union = max(n - gone, 0), n + new
    if 100 * common >= percent * union and common:
        x, y = np.sort(a), np.sort(b)
        assert len(set(x[: indexed(len(x), percent)]) & set(y[: indexed(len(y), percent)])) >= max(needed(len(x), percent), needed(len(y), percent))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB É\t\n\x0b\x1c c", max_size=30), max_size=5), st.integers(1, 4))
def test_shingle_counts(texts, k):
    assert [len(s) for s in Shingler(k).sets([t.encode() for t in texts])] == [len(sets(t, k)) for t in texts]


def test_shingles_of_long_text_do_not_depend_on_pieces(monkeypatch):
    from quire.llm import shingles

    text = ("word%d " * 5000 % tuple(range(5000))).encode()
    whole = next(iter(Shingler(3).sets([text])))
    monkeypatch.setattr(shingles, "CHUNK", 1000)
    assert np.array_equal(whole, next(iter(Shingler(3).sets([text]))))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7), (None, 1)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, 103: 100}


def test_group_kernel():
    rng = np.random.default_rng(4)
    for percent in (50, 80):
        base = rng.integers(0, 2**62, 300)
        sets = [np.unique(np.concatenate([base[rng.random(300) < 0.95], rng.integers(0, 2**62, int(rng.integers(0, 60)))])) for _ in range(40)]
        sets += [rng.integers(0, 2**62, 30)]
        for side in (np.zeros(41, dtype=int), np.arange(41) % 2):
            linked = lambda i, j: (side[i] != side[j] or not side.any()) and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))  # noqa: E731,B023
            label = list(range(41))
            for i in range(41):
                for j in range(i):
                    if linked(i, j):
                        x, y = sorted((label[i], label[j]))
                        label = [x if v == y else v for v in label]
            a, b = jaccard._spanning(np.array([len(s) for s in sets]), np.concatenate(sets), side, percent)
            found = list(range(41))
            for i, j in zip(a, b, strict=True):
                x, y = sorted((found[i], found[j]))
                found = [x if v == y else v for v in found]
            assert found == label


def test_late_links_between_components(spark, monkeypatch):
    # Sets far from their leader that link with one another are found by the second round only.
    monkeypatch.setattr(jaccard, "GROUP", 3)
    monkeypatch.setattr(jaccard, "FEW", 0)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        w = [x if rng.random() > rng.choice([0.02, 0.08, 0.14]) else f"e{i}x{j}" for j, x in enumerate(base)]
        docs.append((i, " ".join(w)))
    log = {}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, k=1, percent=80, log=log).collect())) == brute(docs, 1, 80)
    assert log["unsettled"] > 0
