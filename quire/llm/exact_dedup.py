"""Exact dedup by a content sort, with DataFrame functions only.

Two texts are equal when they agree in every byte after white space is taken out. Every row gets a
place: the first bytes of its normalised text, then the digest of the whole, then a salt of the row.
Places order equal texts next to each other; the digest tells texts apart that begin alike, and the
salt lets the copies of one text, however many, lie in several ranges. Splitters from a bounded
sample of places, weighted by the length of the text, cut the order into ranges of about equal size.
Rows are dealt to their ranges in one shuffle and sorted there (the sort spills), and each
normalised text is compared as a whole with the one before it; a difference starts a new run. The
row of a run that stays and the size of the run are found within the range.

A run may go on in the next range. So the first text of a range is compared, again as a whole, with
the last text of the range before it, and runs that go on are chained by a running sum over two small
rows a range. The runs of a chain share one result, which is broadcast: two rows a range at most.

Cases: a null text is an empty one; texts of white space only are equal to it. Of equal texts the row with the
most code points stays, then the smallest id (null last); of rows that repeat both one stays, whichever. An empty
table gives no rows; other columns, whatever their names, are ignored. The table is read three times (counted, sampled, dealt).
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch

#: Fixed value: what normalising takes out.
WHITE = r"[\x20\x09-\x0D]+"
#: Bytes of text at the head of a place, and bytes of the digest behind it.
HEAD, DIGEST = 32, 32
#: Rows of the sample for each range, in expectation.
SAMPLE = 40


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _placed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, row, chars, norm, place``: a place is head, digest and salt as one binary, compared byte by byte."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.char_length(F.col(text)), F.lit(0)).alias("chars"), normalised(F.col(text)).alias("norm"),
    )
    whole = F.col("norm").cast("binary")
    salt = F.unhex(F.lpad(F.hex(F.xxhash64("doc_id", "row")), 16, "0"))
    return rows.withColumn("place", F.concat(F.rpad(F.substring(whole, 1, HEAD), HEAD, F.lit(b"\0")), F.unhex(F.sha2(whole, 256)), salt))


def _splitters(docs: DataFrame, doc_id: str, text: str, parts: int) -> list[bytes]:
    """``parts - 1`` places at most, between which about equally much text lies, from about ``SAMPLE * parts`` sampled rows."""
    share = min(1.0, SAMPLE * parts / max(docs.count(), 1))
    sample = _placed(docs.select(doc_id, text).sample(share, seed=13), doc_id, text)
    found = sorted((bytes(r.place), r.weight) for r in sample.select("place", (F.char_length("norm") + 64).alias("weight")).collect())
    total, upto = sum(w for _, w in found), 0
    cuts = []
    for (place, weight), after in zip(found, accumulate(w for _, w in found), strict=True):
        if after * parts // total > upto * parts // total and upto:
            cuts.append(place)
        upto += weight
    return cuts[: parts - 1]


def _part(place: Column, splitters: list[bytes]) -> Column:
    """How many splitters are not above the place, by halving steps."""
    if not splitters:
        return F.lit(0)
    of = F.array(*[F.lit(s) for s in splitters])
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(of, at + s - 1) <= place, at + s).otherwise(at))


def _runs(docs: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """One row a document with its range and its run there: who stays of the run and its size; the first and last row of a range keep their text."""
    placed = _placed(docs, doc_id, text).withColumn("part", _part(F.col("place"), _splitters(docs, doc_id, text, parts)))
    in_order = Window.partitionBy("part").orderBy("place")
    near = placed.repartitionById(parts, "part").select(
        "*", F.lag("norm").over(in_order).alias("before"), F.lead("row").over(in_order).isNull().alias("last")
    )
    fresh = near.withColumn("first", F.col("before").isNull()).withColumn("new", (~F.col("norm").eqNullSafe(F.col("before"))).cast("int"))
    numbered = fresh.select(
        "part", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), "doc_id", "row", "first", "last",
        F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("id"), F.col("row").alias("row")).alias("rank"),
        F.substring("place", HEAD + 1, DIGEST).alias("digest"), F.when(F.col("first") | F.col("last"), F.col("norm")).alias("edge"),
    )
    run = Window.partitionBy("part", "run")
    return numbered.withColumn("best", F.min("rank").over(run)).withColumn("size", F.count("*").over(run)).drop("rank")


def _chains(runs: DataFrame) -> DataFrame:
    """``part, run, best, size`` of the runs that go on over the end of a range; two rows a range at most."""
    heads, tails = runs.where("first"), runs.where("last")
    before = heads.select("part", F.lag("part").over(Window.orderBy("part")).alias("prior"))
    ends = tails.select(F.col("part").alias("prior"), F.col("edge").alias("other"))
    onward = heads.select("part", "edge").join(before, "part").join(ends, "prior").where(F.col("edge") == F.col("other")).select("part", F.lit(0).alias("starts"))
    first = heads.select("part", "run", "best", "size").join(onward, "part", "left").withColumn("starts", F.coalesce("starts", F.lit(1)))
    last = tails.where("run > 1").select("part", "run", "best", "size", F.lit(1).alias("starts"))
    chain = F.sum("starts").over(Window.orderBy("part", "run").rowsBetween(Window.unboundedPreceding, 0))
    members = first.unionByName(last).select("part", "run", "best", "size", chain.alias("chain"))
    one = members.groupBy("chain").agg(F.min("best").alias("best"), F.sum("size").alias("size"), F.count("*").alias("n")).where("n > 1")
    return members.select("part", "run", "chain").join(one, "chain").select("part", "run", F.col("best").alias("chain_best"), F.col("size").alias("chain_size"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row; ``parts`` ranges (the session's shuffle partitions)."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = Scratch(_runs(docs, doc_id, text, parts)).df
    joined = runs.join(F.broadcast(_chains(runs)), ["part", "run"], "left")
    best = F.coalesce("chain_best", "best")
    return joined.select(
        "doc_id", best["id"].alias("keep_id"), F.coalesce("chain_size", "size").alias("group_size"),
        (best["row"] == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
