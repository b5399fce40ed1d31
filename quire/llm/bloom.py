"""Blocked Bloom filter: a key sets one bit in each of the eight words of one 512-bit block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shingles import mix

#: Bits for each listed key, and the most that a filter may have (32 MB). Beyond it false positives
#: rise, which the exact join behind every use of the filter removes; results stay the same.
BITS_A_KEY, MOST_BITS, WORDS = 12, 1 << 28, 8
_ODD = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hashed key and its eight one-bit masks."""
    h = keys.astype(np.int64).view(np.uint64)
    at = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    with np.errstate(over="ignore"):
        bits = (h[:, None] * _ODD[None, :]) >> np.uint64(58)
    return at.astype(np.int64), np.uint64(1) << bits


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at, masks = places(keys, len(words))
    return ((words[at] & masks) == masks).all(axis=1)


def build(hashes: DataFrame, n: int) -> np.ndarray:
    """The filter of the column ``h``: partial filters by partition, merged by block."""
    blocks = max(1, min(MOST_BITS, max(n, 1) * BITS_A_KEY) // (64 * WORDS))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, masks = places(b["h"].to_numpy(), blocks)
            order = np.argsort(at, kind="stable")
            at, masks = at[order], masks[order]
            if len(at):
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                merged = np.bitwise_or.reduceat(masks, first, axis=0).view(np.int64)
                yield pd.DataFrame({"block": at[first]} | {f"w{i}": merged[:, i] for i in range(WORDS)})

    names = [f"w{i}" for i in range(WORDS)]
    schema = "block long, " + ", ".join(f"{x} long" for x in names)
    rows = hashes.select("h").mapInPandas(partial, schema).groupBy("block").agg(*[F.bit_or(x).alias(x) for x in names])
    got = rows.toPandas()  # at most MOST_BITS bits
    filled = np.zeros((blocks, WORDS), dtype=np.uint64)
    filled[got["block"].to_numpy(dtype=np.int64)] = got[names].to_numpy(dtype=np.int64).view(np.uint64)
    return filled
