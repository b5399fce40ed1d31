"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in numpy; features are binned by quantiles, trees of a
fixed depth are grown level by level on gradient histograms, and the forest is flattened into
arrays (feature, threshold, value by node of a complete tree), which scoring walks for all rows
and trees at once.

The model is fitted on the driver on a bounded sample of labelled rows (``sample`` rows, chosen by
a hash of the id, in expectation; of several texts of one id the least); scoring runs over every row. Cases: a null or empty text has all-zero
statistics and is scored like any other; conflicting labels of one id are averaged; labels that are
null or without a document are ignored; without any label every score is 0.5; repeated rows
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.text import crc_mod

#: Bytes of a text that are split into words at a time; the statistics don't depend on it.
PIECE = 1 << 21
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n\r",
            "stop": b".,;:", "shout": b"!?", "quote": b"'\"()-", "symbol": b"#$%&*+/<=>@[\\]^_`{|}~"}
_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _c in enumerate(_CLASSES.values()):
    _OF[list(_c)] = _i
_OF[0x80:0xC0] = len(_CLASSES) + 1
_OF[0xC0:] = len(_CLASSES) + 2
FEATURES = 24


def _runs(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces that end at white space."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end]
        at = end


def _text(data: bytes) -> np.ndarray:
    n, size = len(data), 0
    count = np.zeros(len(_CLASSES) + 3)
    hashes = []
    for piece in _runs(data):
        count += np.bincount(_OF[np.frombuffer(piece, dtype=np.uint8)], minlength=len(_CLASSES) + 3)
        words = piece.split()
        size += sum(map(len, words))
        hashes.append(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)))
    h = np.concatenate(hashes)
    distinct = len(set(h.tolist()))
    with np.errstate(over="ignore"):
        pairs = len(set((h[:-1] * np.int64(0x9E3779B97F4A7C1) + h[1:]).tolist()))
    n_lines = long_line = 0
    lines: set[int] = set()
    for line in io.BytesIO(data):
        line = line.removesuffix(b"\n")
        if line.strip():
            n_lines += 1
            lines.add(hash(line))
            long_line = max(long_line, len(line))
    w, m = max(len(h), 1), max(n_lines, 1)
    letters = max(count[0] + count[1], 1)
    return np.concatenate(
        [
            count / n,
            [
                np.log1p(len(h)), size / w, distinct / w, pairs / w, count[0] / letters,
                n_lines / w, len(lines) / m, long_line / n, count[5] / w, count[6] / w, count[8] / w, (count[7] + count[2]) / w,
            ],
        ]
    )


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``FEATURES`` statistics a text."""
    out = np.zeros((len(texts), FEATURES))
    for i, t in enumerate(texts):
        if t:
            out[i] = _text(t)
    return out


@dataclass
class Forest:
    """Complete trees as arrays of shape (trees, nodes); a node that doesn't split sends all rows left."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        rows = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(trees)), dtype=np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return self.base + self.value[trees, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(x) > 1000:
            return np.concatenate([self.score(x[k : k + 1000]) for k in range(0, len(x), 1000)])
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Boost the logistic loss; a split must leave a hessian of ``least`` on both sides."""
    nodes = 2 ** (depth + 1) - 1
    if not len(y):
        return Forest(0.0, 0, np.zeros((0, 1), dtype=np.int64), np.zeros((0, 1)), np.zeros((0, 1)))
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    columns = np.arange(x.shape[1]) * bins
    margin = np.full(len(y), base)
    feature, threshold, value = np.zeros((trees, nodes), dtype=np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = (((at - first) * x.shape[1])[:, None] * bins + columns + binned).ravel()
            shape = (width, x.shape[1], bins)
            gs = np.bincount(cell, np.repeat(g, x.shape[1]), width * x.shape[1] * bins).reshape(shape).cumsum(axis=2)
            hs = np.bincount(cell, np.repeat(h, x.shape[1]), width * x.shape[1] * bins).reshape(shape).cumsum(axis=2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (g_all - gs) ** 2 / (h_all - hs + l2) - g_all**2 / (h_all + l2)
            gain[(hs < least) | (h_all - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + k], threshold[t, first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        sums = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value[t] = -rate * sums[0] / (sums[1] + l2)
        margin += value[t, at]
    return Forest(base, depth, feature, threshold, value)


def _texts(b: pa.RecordBatch) -> list[bytes | None]:
    return pc.cast(b.column(b.schema.get_field_index("text")), pa.binary()).to_pylist()


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, sample: int, doc_id: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most about ``sample`` labelled documents; ``learn`` is a filter on ``labels``."""
    marked = labels.where(learn).select(F.col("doc_id").alias("id"), F.col("quality").alias("q")).dropna()
    share = min(1.0, sample / max(marked.count(), 1))
    picked = marked.where((F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 11) / float(1 << 53)) < share)
    picked = picked.groupBy("id").agg((F.avg("q") >= 0.5).cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(_texts(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))  # one text an id, so no more rows than picked labels
    got = rows.select("y", "text").mapInArrow(run, "y double, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(len(y), FEATURES)
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order in which rows arrive
    return x[order], y[order]


def score_quality(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    model = docs.sparkSession.sparkContext.broadcast(forest)  # a few hundred kB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.score(statistics(_texts(part))))], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def score_column(spark: SparkSession, forest: Forest):
    """The score as a function of a text column, for filters that keep the other columns on the JVM's side."""
    model = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.value.score(statistics(pc.cast(text, pa.binary()).to_pylist())), pa.float64())

    return score


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = 12_000, doc_id: str = "doc_id", text: str = "text") -> Forest:
    """A forest from the labels whose fold isn't the held-out one."""
    return fit(*training_rows(docs, labels, crc_mod(F.col("doc_id"), folds) != held_out, sample, doc_id, text))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_out: int = 2, sample: int = 12_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    forest = fit_quality(docs, labels, folds, held_out, sample)
    return score_quality(docs, forest).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
