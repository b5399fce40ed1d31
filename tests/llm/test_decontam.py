from __future__ import annotations

import hashlib
import random
import re

from quire.llm import decontam
from quire.llm.decontam import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    for i, text in docs:
        w, hit, got = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for g in {tuple(v[s : s + n]) for s in range(max(len(v) - n, 0) + 1)} if v else ():
                for s in range(len(w) - len(g) + 1):
                    if tuple(w[s : s + len(g)]) == g:
                        hit |= set(range(s, s + len(g)))
                        got.add(item)
        ids = sorted(str(x) for x in got if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r)[:1] + tuple(r)[2:] for r in decontaminate(d, b).collect()], key=repr)


def cases():
    rng = random.Random(3)
    vocab = ["the", "of", "É", "x1", "ab", "zu", "q", "Nd"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 8, 10, 14]))) for k in range(9)] + [(20, None), (21, ""), (22, "!!"), (None, text(9)), (3, text(12))]
    docs = [(k, text(rng.randrange(40))) for k in range(20)]
    docs += [(100 + k, f"{text(5)}, {(t or '').upper()}!\n{text(4)}") for k, (_, t) in enumerate(items)]
    docs += [(7, "other"), (50, None), (51, ""), (None, items[4][1]), (60, text(3000)), (60, "a")]
    return docs + docs[:2], items


def test_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(decontam, "BLOCK", 7)
    assert run(spark, docs[:25], items) == brute(docs[:25], items)


def test_empty(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert [r[2:] for r in run(spark, [(1, "a b")], [])] == [(0, 0, hashlib.sha256(b"").hexdigest(), False)]
