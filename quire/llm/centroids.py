"""Centroid clustering (k-means) on integer vectors, with Elkan's bounds and exact integer results.

A component x becomes the integer floor(1024 * x). The ``k`` vectors whose ids have the least digests are the first
centroids. A round assigns every vector to its nearest centroid, ties to the smaller number, and moves every centroid
that has vectors to the componentwise floor of their mean; after the last round vectors are assigned once more.

Every vector carries an upper bound of the distance to its own centroid and a lower bound to each of the ``k``. When centroids move,
the upper bound grows by the own centroid's move and the lower ones shrink by theirs. A centroid is left out for a vector if
the upper bound is below its lower bound, or below half of its distance from the own centroid. All bounds are rounded
outwards and both tests are strict, so that a centroid at equal distance is never left out. What isn't left out is
compared by exact squared integer distance, and the last assignment computes the own distance of every vector.

Vectors and bounds are one written table, rewritten by each round (a narrow pass: no shuffle), in which each task adds one row a
cluster with the sums of its vectors; a round reads the columns of these rows and adds them up. Only centroids (``k`` times
``dim`` integers) go through the driver. Integers of 2**27 and more leave the 64-bit range; a table that has any is done in Python integers
without bounds, with the same results; a distance or sum of distances above the greatest long is given as that.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part; rows with equal ids are vectors
each; of equal ids the lesser vector comes first among the candidates for centroids; rows of a null id come after all others there, but are clustered;
fewer than ``k`` vectors are as many centroids; clusters that lose all vectors keep their centroid; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.plans.scratch import Scratch

#: Fixed values of the rule.
SCALE, K, DIM, ROUNDS, SEED = 1024, 8, 64, 10, 3
#: Integers below this keep squared distances of up to 64 components below 2**63; limbs of sums have so many bits.
NARROW, LIMB = 1 << 27, 30
#: Bounds are widened by this factor, well above what a square root, a sum and a conversion lose.
OUT, IN = 1 + 1e-12, 1 - 1e-12
_MOST = (1 << 63) - 1


def _exact(x: float) -> int:
    """floor(SCALE * x) whatever its size."""
    return math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE


def whole_numbers(x: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers, or Python's if ``wide``."""
    if not wide:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([_exact(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def squared(q: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = q - centroid
    return (d * d).sum(axis=1)


class Centroids:
    """The centroids of a round, how far each one moved, and half of the distances between them; all bounds rounded to the safe side."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        k = len(now)
        self.bounded = now.dtype != object
        if not self.bounded:
            return
        self.moved = np.sqrt(((now - before) ** 2).sum(axis=1).astype(np.float64)) * OUT if before is not None else np.zeros(k)
        self.half = np.stack([np.sqrt(squared(now, c).astype(np.float64)) for c in now]) * (0.5 * IN)

    def assign(self, q: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest centroids with new bounds, and how many distances were computed."""
        k = len(self.now)
        if not self.bounded:
            d = np.stack([squared(q, c) for c in self.now], axis=1)
            return np.array([min(range(k), key=lambda j, r=r: (r[j], j)) for r in d], dtype=np.int32), upper, lower, d.size
        upper = (upper + self.moved[own]) * OUT
        lower = np.maximum(lower - self.moved, 0.0) * IN
        maybe = ~((upper[:, None] < lower) | (upper[:, None] < self.half[own]))
        maybe[np.arange(len(q)), own] = False
        open_ = np.flatnonzero(maybe.any(axis=1))
        own, upper, count = own.copy(), upper.copy(), len(open_)
        if not len(open_):
            return own, upper, lower, count
        x, best, at = q[open_], np.empty(len(open_), dtype=np.int64), own[open_]
        for j in np.unique(at):  # the own distance first: it tightens the upper bound
            rows = at == j
            best[rows] = squared(x[rows], self.now[j])
        root = np.sqrt(best.astype(np.float64))
        upper[open_], lower[open_, at] = root * OUT, root * IN
        for j in range(k):
            tight = upper[open_]
            rows = np.flatnonzero(maybe[open_, j] & (at != j) & ~((tight < lower[open_, j]) | (tight < self.half[at, j])))
            if not len(rows):
                continue
            d = squared(x[rows], self.now[j])
            count += len(rows)
            root = np.sqrt(d.astype(np.float64))
            lower[open_[rows], j] = root * IN
            nearer = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
            won = rows[nearer]
            best[won], at[won] = d[nearer], j
            upper[open_[won]] = root[nearer] * OUT
        own[open_] = at
        return own, upper, lower, count


def _limbs(value: int, n: int) -> list[int]:
    """``value`` in base 2**LIMB, least first; the last limb has the sign."""
    return [(value >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(n - 1)] + [value >> (LIMB * (n - 1))]


def _round(state: DataFrame, step: Centroids, wide: bool, limbs: int, schema: str, last: bool) -> DataFrame:
    """The state with new clusters and bounds, and one row a task and cluster with the sums (none in the last pass)."""
    k, dim = step.now.shape
    kind = pa.list_(pa.float64() if "array<double>, own" in schema else pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), dtype=object), np.zeros(k, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            q = whole_numbers(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), wide)
            lower = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            own, upper, lower, _ = step.assign(q, b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False), lower)
            if last:
                d = np.empty(len(q), dtype=object if wide else np.int64)
                for j in np.unique(own):
                    d[own == j] = squared(q[own == j], step.now[j])
                distance = pa.array(np.minimum(d, _MOST).astype(np.int64) if wide else d)
            else:
                distance = pa.nulls(len(q), pa.int64())
                for j in np.unique(own):
                    sums[j] += q[own == j].sum(axis=0).astype(object)
                counts += np.bincount(own, minlength=k)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * k), pa.array(lower.ravel()))
            none = pa.nulls(len(q), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(upper), bounds, distance, none, pa.nulls(len(q), pa.list_(pa.int64()))], names)
        held = np.flatnonzero(counts)
        if len(held):
            parts = [[x for v in sums[j] for x in _limbs(int(v), limbs)] for j in held]
            blank = [pa.nulls(len(held), t) for t in (pa.int64(), kind)]
            yield pa.RecordBatch.from_arrays(
                [*blank, pa.array(held.astype(np.int32)), pa.nulls(len(held), pa.float64()), pa.nulls(len(held), pa.list_(pa.float64())),
                 pa.nulls(len(held), pa.int64()), pa.array(counts[held]), pa.array(parts, pa.list_(pa.int64()))], names
            )

    names = [c.split()[0] for c in schema.split(", ")]
    return state.select("vec_id", "vec", "own", "upper", "lower").mapInArrow(run, schema)


def _moved(state: DataFrame, now: np.ndarray, limbs: int) -> np.ndarray:
    """The floors of the means; a centroid without vectors stays."""
    parts = state.where("members IS NOT NULL")
    counts = {r.own: r.n for r in parts.groupBy("own").agg(F.sum("members").alias("n")).collect()}
    cells = parts.select("own", F.posexplode("sums").alias("at", "x")).groupBy("own", "at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(now.shape, dtype=object)
    for r in cells:
        total[r.own, r.at // limbs] += r.x << (LIMB * (r.at % limbs))
    after = now.copy()
    for j, n in counts.items():
        after[j] = [int(s) // n for s in total[j]]
    return after


def cluster(
    vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that takes part."""
    spark = vectors.sparkSession
    doubles = isinstance(vectors.schema[embedding].dataType.elementType, DoubleType)
    kind = "array<double>" if doubles else "array<float>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("vec")).where(
        f"vec IS NOT NULL AND size(vec) = {dim} AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    first = rows.select("vec", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    schema = f"vec_id long, vec {kind}, own int, upper double, lower array<double>, distance long, members long, sums array<long>"
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    size = rows.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("most"), F.count("*").alias("n")).first()
    largest = abs(_exact(size.most)) + SCALE
    wide = largest >= NARROW
    limbs = -(-(largest.bit_length() + size.n.bit_length() + 2) // LIMB)
    now, before = whole_numbers(np.array([r.vec for r in first], dtype=np.float64), wide), None
    state = rows.select("vec_id", "vec", F.lit(0).alias("own"), F.lit(float("inf")).alias("upper"), F.array(*[F.lit(0.0)] * len(now)).alias("lower"))
    held = None
    for turn in range(rounds + 1):
        after = Scratch(_round(state, Centroids(now, before), wide, limbs, schema, last=turn == rounds))
        if held:
            held.drop()
        held = after
        state = held.df.where("members IS NULL")
        if turn < rounds:
            now, before = _moved(held.df, now, limbs), now
    inertia = dict.fromkeys(range(len(now)), 0) | {r.own: int(r.d) for r in state.groupBy("own").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in now]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("own"))
    return state.select(
        "vec_id", F.col("own").alias("cluster"), "distance", of([min(inertia[j], _MOST) for j in range(len(now))]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), _MOST)).cast("long").alias("inertia"), of(digest).alias("centroid_sha256"),
    )
