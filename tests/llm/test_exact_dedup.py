"""Exact dedup against grouping by the normalised text."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from quire.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, place int, part string, run int"


def plain(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0))
    out = []
    for norm, members in groups.items():
        _, none, best = min(members)
        keep = None if none else best
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(None if n else i, keep, len(members), digest) for _, n, i in members]
    return sorted(out, key=str)


def deduped(spark, rows, **k):
    return E.exact_dedup(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA), **k).collect()


def check(spark, rows, **k):
    got = deduped(spark, rows, **k)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    stays = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in stays}) == len(stays) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in stays)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_groups(spark, monkeypatch, parts):
    monkeypatch.setattr(E, "SAMPLE", 4)
    rng = random.Random(1)
    words = ["a", "b", " ", "\n", " ", "é", "\x0b", "😀"]
    rows = [(i, "".join(rng.choices(words, k=rng.randrange(0, 6)))) for i in range(500)]
    rows += [(i, "hot text " * 3 + " " * (i % 4)) for i in range(1000, 1400)]  # over many ranges
    rows += [(i, "same beginning of more than thirty-two bytes " * 2 + str(i % 90)) for i in range(2000, 2300)]
    rows += [(None, "hot text"), (None, None), (1, None), (1, "a b"), (1, "a b"), (5000, "long " * 100_000), (5001, "long" * 100_000)]
    rng.shuffle(rows)
    check(spark, rows, parts=parts)


def test_one_group_and_none(spark):
    check(spark, [(i, "x y" if i % 2 else "xy ") for i in range(300)], parts=7)
    check(spark, [(1, "a"), (2, " a")], parts=50)
    assert deduped(spark, []) == []


def test_only_native(spark):
    plan = E.exact_dedup(spark.createDataFrame([(1, "a", 1, "x", 2)], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
