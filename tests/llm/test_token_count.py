from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.token_count import Counter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER, LIBRARY = Counter(PATH), Tokenizer.from_file(PATH)

HARD = ["", " ", "aaaaaaaaaaaaa", "\x1c\x1d a", "a<|endoftext|>b<|endoftext|>", "don't WE'LL it's", "\u00a0\u3000 x", "  \n\n  y", "日本語 텍스트 🙂👩‍👩‍👧", "١٢٣ ½²", "\u0085z", "a" * 5000, " " * 3000 + "b", "\u200b\ufeff", "é" * 999]


def library(texts):
    return [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_hard_texts():
    assert COUNTER.count(HARD) == library(HARD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from("ab th' \n\t'sre12<|>")), max_size=60), max_size=4))
def test_any_text(texts):
    assert COUNTER.count(texts) == library(texts)


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r for r in count_tokens(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert {k: v.n_tokens for k, v in got.items()} == dict(zip([r.doc_id for r in rows], library([r.text or "" for r in rows]), strict=True))
    assert all(got[r.doc_id].n_bytes == len(r.text.encode()) for r in rows)


def test_null_and_long(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "a b", 1), (3, "xy " * 120_000, 2), (3, "x", 3)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.over_limit) for r in count_tokens(docs, PATH).collect())
    assert got == [(0, 2, False), (1, 0, False), (3, 1, False), (3, library(["xy " * 120_000])[0], True)]


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == n


def test_long_pretokens():
    import random
    import time

    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(1_000_000))
    few = "".join(rng.choice("aab") for _ in range(30_000))
    texts = [letters, few, "the" * 20_000, "é" * 5001, "=" * 70_001]
    began = time.perf_counter()
    got = Counter(PATH).count(texts)
    assert time.perf_counter() - began < 60 and got == library(texts)
