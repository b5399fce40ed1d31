"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and cut into character 1- to 3-grams, hashed into 2^16 buckets; a row's vector
is (1 + log tf) * idf, scaled to length 1. Document frequencies come from every training row. The
regression is trained example by example with FTRL-proximal (per-coordinate rates, elastic-net
penalty) on a sample of ``a_language`` distinct training texts, in expectation, for each language, a part of which
calibrates the temperature of the softmax instead.

Cases: a null text, or one without a letter, is ``und`` with score 0; rows without a language
don't train; without any training row everything is ``und``; long texts are counted in pieces, but
whole; repeated rows give repeated results; an empty table gives no rows; other columns
are ignored. Languages are assumed to be few (each costs 2^16 weights).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import crc_mod

BITS = 16
SIZE = 1 << BITS
PIECE = 1 << 20
_M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's 1- to 3-grams."""
    total = None
    for lo in range(0, max(len(text), 1), PIECE):
        before = 2 if lo else 0  # characters of the last piece, for the n-grams that span both
        c = np.frombuffer(text[lo - before : lo + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        with np.errstate(over="ignore"):
            a = c * _M[0]
            two = (a[:-1] ^ (a[:-1] >> np.uint32(15))) * _M[1] + a[1:] if len(c) > 1 else a[:0]
            three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _M[2] + a[2:] if len(c) > 2 else a[:0]
            one, two = a[before:], two[max(before - 1, 0) :]
            keys = np.concatenate([one ^ (one >> np.uint32(16)), (two + _M[1]) * _M[2], (three + _M[2]) * _M[1]])
        count = np.bincount(keys >> np.uint32(32 - BITS), minlength=SIZE)
        total = count if total is None else total + count
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x (SIZE + 1), the last one the bias
    temperature: float = 1.0

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[at]
        return x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ self.vector(at, count) + self.weights[:, SIZE]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        z = self.logits(*ngrams(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def train(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
    """FTRL-proximal with elastic net; a fifth of the rows sets the temperature by likelihood."""
    held, used = rows[::5] if len(rows) >= 10 else rows, [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 10 else rows
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)

    def current(at: np.ndarray) -> np.ndarray:
        zi, ni = z[:, at], n[:, at]
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    ready = [(np.append(at, SIZE), np.append(model.vector(at, c), 1.0), y) for at, c, y in used]
    for _ in range(epochs):
        for at, x, y in ready:
            w = current(at)
            g = _softmax(w @ x)
            g[y] -= 1
            g = g[:, None] * x[None, :]
            step = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - step * w
            n[:, at] += g * g
    model.weights = current(np.arange(SIZE + 1))
    scores = [(model.logits(at, c), y) for at, c, y in held]
    loss = lambda t: -sum(float(np.log(max(_softmax(s / t)[y], 1e-300))) for s, y in scores)
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 47))
    model.temperature = float(min(grid, key=loss)) if scores else 1.0


def fit_langid(docs: DataFrame, learn, text: str = "text", lang: str = "lang", a_language: int = 600) -> Model:
    """A model from the rows of ``docs`` that pass ``learn`` and have a language."""
    known = docs.where(learn & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    n_rows = sum(counts.values())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SIZE, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                df[ngrams(t)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "df"])

    got = known.select("text").mapInArrow(frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()  # 2^16 rows at most
    df = np.zeros(SIZE)
    df[got.column("bucket").to_numpy()] = got.column("df").to_numpy()
    model = Model(languages, np.log((1 + n_rows) / (1 + df)) + 1, np.zeros((len(languages), SIZE + 1)))

    shares = [F.when(F.col("lang") == k, min(1.0, a_language / n)) for k, n in counts.items()]
    place = F.shiftrightunsigned(F.xxhash64("text", F.lit("sample")), 11) / float(1 << 53)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ngrams(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["lang", "place", "at", "n"]
            )

    if languages:
        sample = known.withColumn("place", place).where(F.col("place") < F.coalesce(*shares)).dropDuplicates(["lang", "place"])
        kept = sample.select("lang", "place", "text").mapInArrow(features, "lang string, place double, at array<long>, n array<long>")
        rows = kept.toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])
        index = {k: i for i, k in enumerate(languages)}
        train(model, [(at.values.to_numpy(), n.values.to_numpy(), index[k.as_py()]) for k, at, n in zip(rows["lang"], rows["at"], rows["n"], strict=True)])
    return model


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 0.5 MB a language, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def predict_language(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; rows of the held-out fold don't train."""
    fold = F.coalesce(crc_mod(F.col("doc_id"), folds), F.lit(-1))
    model = fit_langid(docs, fold != held_out)
    return identify(docs, model).select("doc_id", (fold == held_out).alias("held_out"), "lang_pred", "score")
