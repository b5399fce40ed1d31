"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

Every item is cut into windows of ``window`` consecutive words (a shorter item is one window). A
window is a set of word shingles, and a document contains the window only if it contains all of
them, so one shingle is a sufficient prefix: the rarest one by its count over all documents. One pass
over the documents writes the shingles that the benchmark has too, which gives the counts. Of these
only the prefix shingles are joined with the windows; a match is a candidate at a
known position, which must leave room for the whole window (positional and length bound), and
is then verified word by word.

The benchmark side is broadcast in blocks of at most ``BLOCK`` windows; a larger benchmark takes more
passes over the documents, never a larger broadcast.

Cases: a null text has no words; an item without words has no windows; items may share windows; a
null item id makes hits but is not listed among the items; rows that repeat a document (same id
and text) each get their result; rows with one id and different texts are judged apart; empty
tables give no rows, or no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import ALNUM_WORD, ascii_lower
from quire.plans.scratch import Scratch

#: Shingles of windows, or ids of items, in one broadcast: about 120 bytes each, so 60 MB.
BLOCK = 500_000


def words_of(text: Column) -> Column:
    """The words of a text; none of a null text."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(ALNUM_WORD), 0), F.array().cast("array<string>"))


def _shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j if j else at) for j in range(k)])


def _shingles(words: Column, k: int) -> Column:
    return F.transform(_positions(F.size(words)), lambda i: _shingle(words, i, k))


def _positions(n: Column) -> Column:
    """0 to n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``words, n, item_ids``: every distinct window and the items that have it."""
    w = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = _positions(F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, window))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("n", F.size("words"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row, plus ``text_hash``.

    ``n_hit`` counts the words of a document inside any occurrence of a window.
    """
    size = F.least(F.col("n"), F.lit(shingle))
    windows = Scratch(item_windows(items, item_id, item_text, window).withColumn("k", size).withColumn("window_id", F.xxhash64("words")))
    sizes = sorted(r[0] for r in windows.df.select("k").distinct().collect())  # at most `shingle` values
    parts = windows.df.select("window_id", "n", "k", F.explode(_positions(F.col("n") - F.col("k") + 1)).alias("offset"), "words")
    parts = reduce(DataFrame.unionByName, [
        parts.where(F.col("k") == k).select("window_id", "n", "k", "offset", _shingle(F.col("words"), F.col("offset"), k).alias("h"), F.slice("words", F.col("offset") + 1, F.col("k")).alias("gram"))
        for k in sizes
    ]) if sizes else parts.select("window_id", "n", "k", "offset", F.lit(None).cast("long").alias("h"), "words").withColumnRenamed("words", "gram")
    parts = Scratch(parts)
    blocks = max(1, -(-parts.df.count() // BLOCK))
    few_ids = (windows.df.agg(F.sum(F.size("item_ids"))).first()[0] or 0) <= BLOCK

    # One pass over the documents: a head row each, and every shingle that the benchmark has too, with its words.
    doc = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), words_of(F.col(text)).alias("w"))
    shingles = F.concat(F.array(F.lit(None).cast("long")), *[_shingles(F.col("w"), k) for k in sizes])
    doc = doc.withColumn("n_words", F.size("w")).withColumn("shingles", shingles)
    listed = parts.df.select("h", "k").distinct()
    found = []
    for b in range(blocks):
        base = doc if b == 0 else doc.where(F.col("n_words") > 0)
        # An outer generator: for an inner one Spark adds a filter that computes the array twice.
        placed = base.select("doc_id", "text_hash", "n_words", "w", F.posexplode_outer("shingles").alias("at", "h"))
        met = placed.join(F.broadcast(listed.where(F.pmod("h", F.lit(blocks)) == b)), "h", "left")
        at = F.pmod(F.col("at") - 1, F.greatest("n_words", F.lit(1)))
        head = (F.col("at") == 0) & F.lit(b == 0)
        found.append(
            met.where(head | F.col("k").isNotNull()).select(
                "doc_id", "text_hash", "n_words", F.when(F.col("k").isNotNull(), at).alias("at"), F.when(F.col("k").isNotNull(), F.col("h")).alias("h"),
                F.when(F.col("k").isNotNull(), F.slice("w", at + 1, F.col("k"))).alias("gram"),
            )
        )
    found = Scratch(reduce(DataFrame.unionByName, found))
    matches = found.df.where("h IS NOT NULL")

    # The prefix of a window: its shingle that is rarest by its count over all documents. One that no document has rules the window out.
    rarity = matches.groupBy("h").agg(F.count("*").alias("rarity"))
    rarest = parts.df.join(rarity, "h", "left").groupBy("window_id").agg(F.min(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "offset", "h")).alias("p"), F.first("n").alias("n"))
    prefix = Scratch(rarest.where("p.rarity > 0").select("window_id", "n", F.col("p.offset").alias("offset"), F.col("p.h").alias("h")))
    small = F.broadcast if blocks == 1 else lambda df: df
    start = F.col("at") - F.col("offset")
    where = ["doc_id", "text_hash", "window_id", "s"]
    candidates = matches.join(small(prefix.df), "h").where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("doc_id", "text_hash", "window_id", start.alias("s")).distinct()
    # Every shingle of a candidate must stand at its place, word by word.
    wanted = candidates.join(small(parts.df), "window_id").withColumn("at", F.col("s") + F.col("offset"))
    wanted = wanted.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).drop("h")
    there = matches.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text_hash", "at", "gram").distinct()
    whole = wanted.join(there, ["key", "text_hash", "at", "gram"]).groupBy(*where, "n").agg(F.countDistinct("offset").alias("c"), F.max("k").alias("k"))
    ids = windows.df.select("window_id", "item_ids")
    hits = whole.where("c = n - k + 1").join(F.broadcast(ids) if few_ids and blocks == 1 else ids, "window_id")
    spans = hits.select("doc_id", "text_hash", F.lit(None).cast("int").alias("n_words"), F.lit(0).alias("head"), F.struct("s", (F.col("s") + F.col("n")).alias("e")).alias("span"), "item_ids")
    heads = found.df.where("h IS NULL").select("doc_id", "text_hash", "n_words", F.lit(1).alias("head"), F.lit(None).cast(spans.schema["span"].dataType).alias("span"), F.lit(None).cast("array<string>").alias("item_ids"))
    grouped = heads.unionByName(spans).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum("head").cast("int").alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["e"], s["e"]).alias("e"), (acc["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(acc["e"], s["s"]))).alias("n")
        ),
        lambda acc: acc["n"].cast("long"),
    )
    return (
        grouped.withColumn("n_hit", covered)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select(
            "doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        )
    )
