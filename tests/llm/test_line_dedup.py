from __future__ import annotations

import random

from quire.llm.line_dedup import dedup_lines


def windows_of(lines, long_words):
    """(first line, lines) of every window; lines are counted without blank ones."""
    full = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
    out = [(k, full[k : k + 3]) for k in range(len(full) - 2)]
    if long_words is not None:
        out += [(k, [at]) for k, at in enumerate(full) if len(full) == 1 or len([w for w in lines[at].split(" ") if w]) > long_words]
        out += [(0, full)] if len(full) == 2 else []
    return out


def brute(docs, long_words=None):
    first, out, windows = {}, [], {}
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    for i, text in order:
        lines = [] if text is None else text.split("\n")
        windows[i] = lines, windows_of(lines, long_words)
        for k, at in windows[i][1]:
            key = tuple(lines[x] for x in at)
            first[key] = min(first.get(key, (i is None, i or 0, k)), (i is None, i or 0, k))
    for i, text in docs:
        lines, found = windows[i]
        gone = set()
        for k, at in found:
            f = first[tuple(lines[x] for x in at)]
            if f != (i is None, i or 0, k) and not (f[:2] == (i is None, i or 0) and k < f[2] + len(at)):
                gone |= set(at)
        out.append((i, len(lines), len(gone), text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=repr)


def run(spark, docs):
    names = "lines string, removed string, _id string, id string, hash string, key string, n_lines string"
    df = spark.createDataFrame([(*d, *"efghijk") for d in docs], f"doc_id long, text string, {names}")
    assert all((r.lines, r.removed, r._id, r.id, r.hash, r.key) == tuple("efghij") for r in dedup_lines(df).collect())
    return sorted([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in dedup_lines(df).collect()], key=repr)


def test_brute_force(spark):
    rng = random.Random(5)
    lines = ["a", "b", "", " ", "c\r", "é", "d"]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(14)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n\n"), (None, "a\nb\nc"), (103, "one long line " * 9000), (104, "r\n" * 2000)]
    assert run(spark, docs) == brute(docs)


def test_passage_and_clean(spark):
    passage = "\n".join(f"p{i} " + "word " * 20 for i in range(3))
    docs = [(1, f"start\n{passage}\nend"), (2, f"other\n{passage}\nmore\nx"), (3, "u\nv\nw\nx"), (4, passage)]
    got = {r[0]: r for r in run(spark, docs)}
    assert got[1][2] == 0 and got[2][3] == "other\nmore\nx" and got[3][3] == "u\nv\nw\nx" and got[4][2:] == (3, "")


def test_repeated_row_and_empty(spark):
    assert run(spark, [(1, "a\nb\nc\nd")] * 2) == [(1, 4, 0, "a\nb\nc\nd")] * 2
    assert run(spark, []) == []
