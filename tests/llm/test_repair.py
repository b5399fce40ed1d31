"""Repair of conversations against all ways of editing them, and the damage by hand."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from quire.llm import repair
from quire.llm.text import running_sums

SCHEMA = "conv_id long, turn long, role string, text string, place int, fault string"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        text_of = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        found = out.setdefault(conv, [])
        if kind == 0:
            continue
        row = [turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text]
        found.extend([row] * (2 if kind == 3 else 1))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def marked(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_way(rows):
    """(cost, audit, turns) of the best of all edits, with up to two inserts in a gap."""
    fits = re.compile(r"(s?(ua)+)?\Z")
    inserts = [()] + [(x,) for x in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    best = None
    options = []
    for role, text, fault in rows:
        stay = 3 if fault == "truncated" else 0
        ways = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            ways += [(stay, "K", [(role, text)])] + [(stay + 3, "R", [(x, text)]) for x in ("user", "assistant")]
        options.append(ways)
    for picked in itertools.product(*options):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(p[0] for p in picked) + 3 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            turns, audit = [(r, "") for r in put[0]], "I" * len(put[0])
            for p, more in zip(picked, put[1:], strict=True):
                turns += p[2] + [(r, "") for r in more]
                audit += p[1] + "I" * len(more)
            if fits.match("".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
    return best


def test_all_edits(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(70):
        for turn in range(rng.randrange(0, 4)):
            role = rng.choice(["user", "assistant", "system", "assistant", "user", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, rng.choice(["Yes.", "No", "Why?  \n", "", " \t", None, "ümlaut!"])))
        rows += [(conv, 9, "user", "Last.")] * (conv % 5 == 0)
    got = {r.conv_id: r for r in repair.repair(repair.damage(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))).collect()}
    want = damaged(rows)
    assert got.keys() == want.keys()
    for conv, found in want.items():
        faults, r = marked(found), got[conv]
        turns = [t for t, _, _ in found if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(sum(f[2] == x for f in faults) for x in ("blank", "duplicate", "truncated"))
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(faults)]
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        cost, audit, turns = every_way(faults)
        assert (r.cost, r.audit, [(t.role, t.text) for t in r.turns]) == (cost, audit, turns), (conv, faults)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "A."), (7, 0, "user", "x" * 2_000_000 + "."), (7, 1, "assistant", "Yes.")] + [(8, 2, "user", "Same.")] * 3
    got = {r.conv_id: r for r in repair.digests(repair.repair(repair.damage(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)))).collect()}
    want = damaged(rows)
    assert got.keys() == want.keys()
    assert any(len(t) > 1_000_000 for _, _, t in want[7])
    for conv in (None, 7, 8):
        cost, audit, turns = every_way(marked(want[conv]))
        assert (got[conv].cost, got[conv].audit) == (cost, audit)
        assert got[conv].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    assert repair.repair(repair.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_long_conversation(spark):
    turns = spark.range(8000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    (r,) = repair.repair(repair.damage(turns)).collect()
    want = damaged([(1, i, "assistant" if i % 2 else "user", f"Turn {i}.") for i in range(8000)])[1]
    assert len(re.sub("I", "", r.audit)) == len(want)
    assert re.fullmatch("(ua)+", "".join(t.role[0] for t in r.turns))
    kept = [text for (_, _, text), letter in zip(want, re.sub("I", "", r.audit), strict=True) if letter != "D"]
    assert [t.text for t in r.turns if t.text] == [t for t in kept if t]


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 10, 101):
        (got,) = spark.range(1).select(running_sums(F.array(*[F.lit(i * 3 % 7) for i in range(n)]).cast("array<int>"))).first()
        assert got == [sum(j * 3 % 7 for j in range(i)) for i in range(n)]
