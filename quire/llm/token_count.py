"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

A batch of texts is split into pre-tokens; those not met before become one ragged numpy array of
symbol ids. In each round every sequence finds its lowest-ranked adjacent pair and all its
occurrences are merged at once (left to right where they overlap), for all sequences together;
sequences without a ranked pair are done, and the surviving symbols are counted. In a sequence of
more than ``LONG`` symbols pairs wait by rank instead, and a round touches only the pairs of its
lowest rank and their neighbours, so that the time is near linear in the length.

Cases: a null text counts as empty (no bytes, no tokens); the special strings of the vocabulary
count as one token each where they occur in a text; repeated rows give repeated results; a very
long text is split lazily, in bounded runs of pre-tokens; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published split pattern of byte-level BPE (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens in one run, and pre-tokens whose counts a worker remembers.
RUN, REMEMBERED = 200_000, 300_000
#: Symbols from which a sequence is merged on its own.
LONG = 1024


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [], 0
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


class RankMerger:
    """Counts symbols that survive all merges."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], np.arange(len(merges), dtype=np.int64)[order]
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.none = np.int64(len(merges))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def _long(self, word: bytes) -> int:
        """Tokens of one long word."""
        n = left = len(word)
        sym = self.byte_id[np.frombuffer(word, dtype=np.uint8)]
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        rank = np.append(self.ranks(sym[:-1], sym[1:]), self.none)  # of the pair that starts there
        waiting: dict[int, list[np.ndarray]] = {}
        lowest: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < self.none]
            at = at[np.argsort(rank[at], kind="stable")]
            of = rank[at]
            for part in np.split(at, np.flatnonzero(of[1:] != of[:-1]) + 1) if len(at) else []:
                key = int(rank[part[0]])
                if key not in waiting:
                    heappush(lowest, key)
                waiting.setdefault(key, []).append(part)

        put(np.arange(n - 1))
        while lowest:
            key = heappop(lowest)
            at = np.unique(np.concatenate(waiting.pop(key)))
            at = at[rank[at] == key]
            if not len(at):
                continue
            k = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.r_[True, after[at[:-1]] != at[1:]], k, 0))
            at = at[(k - first) % 2 == 0]
            gone = after[at]
            sym[at], rank[gone], after[at] = self.merged[key], self.none, after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            touched = np.unique(np.concatenate([at, before[at]]))
            touched = touched[touched >= 0]
            right = after[touched]
            rank[touched] = np.where(right < n, self.ranks(sym[touched], sym[np.minimum(right, n - 1)]), self.none)
            put(touched)
        return left

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            out = self.counts([w if len(w) <= LONG else b"" for w in words])
            out[long] = [self._long(words[i]) for i in long]
            return out
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = n.copy()
        seq = np.repeat(np.arange(len(words)), n)
        sym = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        while len(sym) > 1:
            same = seq[1:] == seq[:-1]
            rank = np.where(same, self.ranks(sym[:-1], sym[1:]), self.none)
            starts = np.flatnonzero(np.r_[True, ~same])
            padded = np.append(rank, self.none)
            least = np.minimum.reduceat(padded, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            each = np.repeat(least, sizes)
            hit = (padded == each) & (padded < self.none)
            if not hit.any():
                break
            # In a run of touching hits (a pair such as "aa" in "aaaa") every other one merges.
            at = np.flatnonzero(hit)
            run_start = np.r_[True, np.diff(at) > 1]
            first = at[np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))]
            at = at[(at - first) % 2 == 0]
            sym[at] = self.merged[padded[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            # Only sequences that merged can merge again.
            alive = np.repeat(least < self.none, sizes)
            keep &= alive
            np.subtract.at(out, seq[at], 1)
            sym, seq = sym[keep], seq[keep]
        return out


class Counter:
    """Token counts of texts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merger = RankMerger(spec["model"]["vocab"], merges)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # White space as Unicode defines it; the engine's own \s also takes some control characters.
        self.pattern = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, int] = {}

    def pretokens(self, text: str) -> Iterator[str]:
        for part in self.split.split(text) if self.split else [text]:
            yield from (m.group() for m in self.pattern.finditer(part))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(words)
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            self.known.update(zip(part, self.merger.counts([w.encode("utf-8", "surrogatepass") for w in part]).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; bounded runs of pre-tokens are held at a time."""
        out = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        n = 0

        def settle() -> None:
            self.learn(set().union(*(w for _, w in held)))
            get = self.known.__getitem__
            for k, words in held:
                out[k] += sum(map(get, words))
            held.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            parts = self.split.split(text) if self.split else [text]
            out[k] += len(parts) - 1
            for part in parts:
                if len(part) <= 100_000:
                    words = self.pattern.findall(part)
                    held.append((k, words))
                    n += len(words)
                else:
                    found = (m.group() for m in self.pattern.finditer(part))
                    while words := list(islice(found, RUN)):
                        held.append((k, words))
                        n += len(words)
                        if n >= RUN:
                            settle()
                            n = 0
                if n >= RUN:
                    settle()
                    n = 0
        settle()
        return out


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; ``tokenizer`` is the path of a vocabulary file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n = counter.count(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
