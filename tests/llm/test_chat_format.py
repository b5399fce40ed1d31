from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quire.llm.chat_format import digests, format_chat, read_back

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def turns_of(spark, rows):
    out = format_chat(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    return out, {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", read_back(F.col("formatted")).alias("turns")).collect()}


def test_round_trip_and_merge(spark):
    rows = [
        (1, 2, "assistant", "b<|im_end|>&amp;&lt;|"), (1, 0, "user", "<|im_sep|>x&"), (1, 1, "user", "two\n<"), (1, 3, "assistant", None),
        (2, 0, None, ""), (2, None, "a\n&nl;b", "<|im_start|>user\n"), (3, 0, "user", "x" * 200_000), (3, 0, "user", "x" * 200_000),
    ]
    out, turns = turns_of(spark, rows)
    assert turns[1] == [("user", "<|im_sep|>x&"), ("user", "two\n<"), ("assistant", "b<|im_end|>&amp;&lt;|"), ("assistant", "")]
    assert turns[2] == [("a\n&nl;b", "<|im_start|>user\n"), ("", "")]
    assert turns[3] == [("user", "x" * 200_000)] * 2
    blocks = {r.conv_id: r.blocks for r in out.collect()}
    assert [b.role for b in blocks[1]] == ["user", "assistant"] and len(blocks[1][0].texts) == 2


def test_digests(spark):
    rows = [(7, 0, "user", "é"), (7, 1, "assistant", "<|im_end|>"), (7, 2, "assistant", "ü"), (8, 0, "user", "q")]
    got = {r.conv_id: r for r in digests(turns_of(spark, rows)[0]).collect()}
    assert got[7].n_turns == 3 and got[7].loss_chars == 11
    assert got[7].loss_sha256 == hashlib.sha256("<|im_end|>ü".encode()).hexdigest()
    assert got[7].turns_sha256 == hashlib.sha256("user\né\nassistant\n<|im_end|>\nassistant\nü\n".encode()).hexdigest()
    assert got[8].loss_chars == 0 and got[8].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty(spark):
    assert digests(format_chat(spark.createDataFrame([], SCHEMA))).count() == 0


def test_many_turns(spark):
    # Linear enough for a conversation of 20,000 turns, a third of them merged.
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], f"t{i} <|im_end|>&") for i in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = format_chat(df)
    got = out.first()
    assert [got.formatted[s.start - 1 : s.start - 1 + s.length] for s in got.loss_spans] == [t.replace("&", "&amp;").replace("<|", "&lt;|") for _, _, r, t in rows if r == "assistant"]
    d = digests(out).first()
    said = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (d.n_turns, d.loss_chars, d.loss_sha256) == (20_000, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
