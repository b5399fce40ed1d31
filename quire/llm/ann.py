"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search in it.

Equal vectors are one node, which keeps its least ids (no more of them can be among the nearest).
The graph starts from a few random-projection partitions, inside whose small buckets every node
takes its best neighbours, and from one random partition, so that a node alone in its direction has
neighbours too. Every node keeps ``degree`` of them, better ones or not, so a search never ends with
fewer nodes than a query needs. Then rounds of NN-descent: each node's neighbours and a sample of
the nodes that have it as a neighbour are joined with their vectors and compared with one another
(neighbours of neighbours), and every node keeps its ``degree`` best. Only pairs with a new
edge are compared, and rounds end when few edges change.

A query starts at its own node and keeps a beam of the best nodes met; in each round the best that
aren't yet expanded are joined with the graph and the vectors, until every node of the beam is
expanded. The beam is ranked anew with exact cosines in double precision on the original vectors.

Vectors in the graph are single-precision unit vectors; nothing is broadcast. Ids are integers. Cases:
components of any finite size are admitted, as vectors are scaled before their products; vectors
that are null, empty, zero, or hold null or non-finite components take no part, nor do rows of a
null id; where dimensions differ, the most frequent one (the least of equals) counts; of different
vectors under one id the least counts; ties go to smaller ids; with too few candidates all are
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.groups import by_group
from quire.plans.scratch import Scratch, free_shuffles, materialise

#: Neighbours kept a node, sampled reverse neighbours, random-projection partitions, nodes a bucket.
DEGREE, REVERSE, TREES, BUCKET = 32, 32, 2, 80
#: New edges that one comparison may offer a node.
OFFERS = 6
#: Vectors whose largest component is outside of these are multiplied by ``FAR`` or its inverse (all powers of two) before their products.
TINY, HUGE, FAR = 2.0**-300, 2.0**300, 2.0**600
#: Values that one block of comparisons holds at a time.
BLOCK = 4_000_000


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str, k: int) -> DataFrame:
    """``cid, vec, ids``: the distinct vectors that take part, with their ``k + 1`` least ids; cid is the least."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec")).where(
        "id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 "
        "AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vec, x -> x <> 0)"
    )
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size("vec") == (lengths["d"] if lengths else 0)).groupBy("id").agg(F.min("vec").alias("vec"))
    least = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
    salted = rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(least(F.collect_list("id")).alias("ids"))
    return salted.groupBy("vec").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.get("ids", F.lit(0)).alias("cid"), "vec", "ids")


def _halves(nodes: DataFrame) -> DataFrame:
    """``cid, h``: unit vectors in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=np.float64)
            if len(x):
                x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                x /= np.linalg.norm(x, axis=1, keepdims=True)
            flat, d = pa.array(x.astype(np.float32).ravel()), x.shape[1] if len(x) else 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), flat)], ["cid", "h"])

    return nodes.select("cid", "vec").mapInArrow(run, "cid long, h array<float>")


def _unpack(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _compare(best: int) -> Callable[[pa.Table, np.ndarray], pa.Table]:
    """All-with-all inside each group (v): for every member its best others above its bar, where one of the two is new."""

    def kernel(t: pa.Table, starts: np.ndarray) -> pa.Table:
        ids, bar, new = t.column("u").to_numpy(), t.column("bar").to_numpy(), t.column("new").to_numpy()
        h = _unpack(t.column("h"))
        sizes = np.diff(np.append(starts, len(ids)))
        out: list[tuple] = []
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            # Groups of like size together, as many as fit a block.
            take = order[at : at + max(1, BLOCK // int(sizes[order[min(at + 255, len(order) - 1)]] ** 2 + h.shape[1] * sizes[order[min(at + 255, len(order) - 1)]]))][:256]
            at += len(take)
            m = int(sizes[take].max())
            if m < 2:
                continue
            place = starts[take][:, None] + np.minimum(np.arange(m)[None, :], sizes[take][:, None] - 1)
            real = np.arange(m)[None, :] < sizes[take][:, None]
            x = h[place]
            sim = x @ x.transpose(0, 2, 1)
            fresh = new[place]
            ok = real[:, :, None] & real[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (sim > bar[place][:, :, None])
            ok &= ~np.eye(m, dtype=bool)
            sim = np.where(ok, sim, -9)
            if m > best:
                top = np.argpartition(-sim, best - 1, axis=2)[:, :, :best]
            else:
                top = np.broadcast_to(np.arange(m), sim.shape)
            got = np.take_along_axis(sim, top, axis=2)
            g, i, j = np.nonzero(got > -9)
            out.append((ids[place[g, i]], ids[place[g, top[g, i, j]]], got[g, i, j]))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (ids[:0], ids[:0], bar[:0])
        return pa.table({"cid": pa.array(a, pa.int64()), "nbr": pa.array(b, pa.int64()), "sim": pa.array(s, pa.float32())})

    return kernel


def _keep_best(edges: DataFrame, degree: int) -> DataFrame:
    """The best neighbours of each node (cid, nbr, sim, new); an edge that is there already stays old. One shuffle, by node."""
    once = edges.repartition("cid").groupBy("cid", "nbr").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.col("sim").desc(), "nbr"))
    return once.withColumn("r", rank).where(F.col("r") <= degree).drop("r")


def _partitioned(halves: DataFrame, n: int, tree: int) -> DataFrame:
    """``v, u, h, bar, new``: buckets of about ``BUCKET`` nodes by random projections; for a negative ``tree`` by a hash only."""
    row = lambda v: [v.alias("v"), "u", "h", F.lit(-2.0).cast("float").alias("bar"), F.lit(True).alias("new")]
    if tree < 0:
        return halves.select(F.col("cid").alias("u"), "h").select(*row(F.pmod(F.xxhash64("u", F.lit(tree)), F.lit(-(-max(n, 1) // BUCKET)))))
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / BUCKET))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            h = _unpack(b.column(1))
            if planes is None:
                planes = np.random.default_rng(tree).normal(size=(h.shape[1], bits)).astype(np.float32)
            code = ((h @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(h), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code.astype(np.int64))], ["u", "h", "code"])

    coded = halves.mapInArrow(run, "u long, h array<float>, code long")
    size = coded.groupBy("code").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("u", F.lit(tree)), F.ceil(F.col("size") / BUCKET))
    return coded.join(size, "code").select(*row(F.xxhash64("code", part)))


def build_graph(halves: DataFrame, n: int, rounds: int = 8, degree: int = DEGREE, settled: float = 0.05) -> DataFrame:
    """``cid, nbr, sim``: the neighbour graph; rounds end when less than ``settled`` of the edges are new."""
    found = None
    for tree in range(-1, TREES):
        part = by_group(_partitioned(halves, n, tree), "v", _compare(degree), "cid long, nbr long, sim float")
        found = part if found is None else found.unionByName(part)
    graph = Scratch(_keep_best(found.withColumn("new", F.lit(True)), degree))
    for turn in range(rounds):
        g = graph.df
        bar = g.groupBy("cid").agg(F.when(F.count("*") >= degree, F.min("sim")).otherwise(-2.0).cast("float").alias("bar"))
        known = halves.join(bar, "cid").select(F.col("cid").alias("u"), "h", "bar")
        back = Window.partitionBy("nbr").orderBy(F.col("new").desc(), F.xxhash64("cid", F.lit(turn)))
        reverse = g.select(F.col("nbr").alias("v"), F.col("cid").alias("u"), "new", F.row_number().over(back).alias("r")).where(F.col("r") <= REVERSE).drop("r")
        members = g.select(F.col("cid").alias("v"), F.col("nbr").alias("u"), "new").unionByName(reverse).groupBy("v", "u").agg(F.max("new").alias("new"))
        near = by_group(members.join(known, "u").select("v", "u", "h", "bar", "new"), "v", _compare(OFFERS), "cid long, nbr long, sim float")
        merged = g.withColumn("new", F.lit(False)).unionByName(near.withColumn("new", F.lit(True)))
        after = Scratch(_keep_best(merged, degree))
        fresh = after.df.where("new").count()
        graph.drop()
        graph = after
        free_shuffles(halves.sparkSession)
        if fresh <= settled * n * degree:
            break
    return graph.df.select("cid", "nbr", "sim")


def in_range(vec: Column) -> Column:
    """``vec``, multiplied by a power of two if squares of its components could leave the range of a double; the cosine is the same bit for bit."""
    most = F.array_max(F.transform(vec, F.abs))
    factor = F.when(most < TINY, F.lit(FAR)).when(most > HUGE, F.lit(1 / FAR))
    return F.when(factor.isNull(), vec).otherwise(F.transform(vec, lambda x: x * factor))


def _cosine(a: Column, b: Column) -> Column:
    """Of vectors that ``in_range`` has been over."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(graph: DataFrame, halves: DataFrame, starts: DataFrame, beam: int = 64, width: int = 16) -> DataFrame:
    """``q, cid`` for the nodes ``q`` in ``starts``: the best nodes that greedy search from q has met (q among them)."""
    back = Window.partitionBy("nbr").orderBy(F.col("sim").desc(), "cid")
    reverse = graph.select(F.col("nbr").alias("cid"), F.col("cid").alias("nbr"), F.row_number().over(back).alias("r")).where(F.col("r") <= REVERSE).drop("r")
    linked = materialise(graph.select("cid", "nbr").unionByName(reverse).distinct())
    queries = starts.join(halves, starts["q"] == halves["cid"]).select("q", F.col("h").alias("hq"))

    dot = F.aggregate(F.zip_with("hq", "h", lambda x, y: x * y), F.lit(0.0).cast("float"), lambda t, x: t + x)

    best = Window.partitionBy("q").orderBy(F.col("sim").desc(), "cid")
    state = Scratch(starts.select("q", F.col("q").alias("cid"), F.lit(1.0).cast("float").alias("sim"), F.lit(False).alias("done")))
    while True:  # the beam only gets better, so that a node which left it can't come back
        s = state.df
        open_ = s.where("NOT done").withColumn("r", F.row_number().over(best)).where(F.col("r") <= width).select("q", "cid")
        met = open_.join(linked, "cid").select("q", F.col("nbr").alias("cid")).distinct().join(s.select("q", "cid"), ["q", "cid"], "left_anti")
        scored = met.join(queries, "q").join(halves, "cid").select("q", "cid", dot.alias("sim"))
        closed = s.join(open_.withColumn("x", F.lit(True)), ["q", "cid"], "left").select("q", "cid", "sim", (F.col("done") | F.coalesce("x", F.lit(False))).alias("done"))
        merged = closed.unionByName(scored.withColumn("done", F.lit(False)))
        after = Scratch(merged.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"))
        state.drop()
        state = after
        if after.df.where("NOT done").isEmpty():
            break
    return state.df.select("q", "cid")


def nearest(vectors: DataFrame, query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", rounds: int = 8) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row that passes ``query`` (on ``vec_id``)."""
    nodes = materialise(nodes_of(vectors, vec_id, embedding, k))
    n = nodes.count()
    halves = materialise(_halves(nodes))
    graph = build_graph(halves, n, rounds)
    rows = vectors.where(query).select(F.col(vec_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("vec")).where("query_id IS NOT NULL")
    asked = materialise(rows.groupBy("query_id").agg(F.min("vec").alias("vec")).join(nodes.select("cid", "vec"), "vec").select("query_id", F.col("cid").alias("q")))
    found = search(graph, halves, asked.select("q").distinct())
    of = nodes.select(F.col("cid").alias("q"), in_range(F.col("vec")).alias("vq"))
    scored = found.join(nodes.select("cid", "ids", in_range(F.col("vec")).alias("vec")), "cid").join(of, "q").select("q", "ids", _cosine(F.col("vq"), F.col("vec")).alias("score"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    each = scored.select("q", F.explode("ids").alias("vec_id"), "score").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        asked.join(each, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
