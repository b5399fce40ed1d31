"""Line dedup over overlapping windows of three lines.

Lines that are not blank are taken three at a time (one window a line, overlapping), and each
window is hashed to 128 bits. Windows that occur more than once in the whole corpus are found by one
aggregation, which also keeps the first occurrence: the least document id, then the least
position. Lines that later occurrences cover are merged by document and removed. An
occurrence that overlaps the first one in the same document is not a later one, so that a run of
equal lines keeps its first three.

With ``long_words``, a line of more words than that is also a window of its own, and all lines of a
text of one or two lines that are not blank are a window.

Cases: a null text stays null and has no lines; a text of fewer than three lines that are not
blank has no window and stays, unless ``long_words`` is given; blank lines are never removed and never part of a window; null
ids come last in the order; rows that repeat a document (same id and text) keep equal results;
rows with one id and different texts count apart; an empty table gives no rows; other columns, whatever
their names, stay as they are, but for ``n_lines`` and ``n_removed``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import unused

WINDOW = 3


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.split(F.col(text), "\n", -1).alias("lines"))


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_words: int | None = None) -> DataFrame:
    """``doc_id, text_hash, removed``: the 0-based lines of each document that later occurrences cover."""
    full = F.filter(
        F.transform("lines", lambda line, i: F.struct(i.alias("i"), line.alias("line"))), lambda x: F.regexp(x["line"], F.lit(r"\S"))
    )
    kept = _lines(docs, doc_id, text).select("doc_id", "text_hash", full.alias("full"))
    line = lambda k, j: F.get("full", k + j)["line"]

    def window(k: Column, size: int) -> Column:
        of = [line(k, j) for j in range(size)]
        return F.struct(
            k.alias("k"),
            F.transform(F.slice("full", k + 1, size), lambda x: x["i"]).alias("at"),
            F.xxhash64(F.lit(1), *of).alias("h1"),
            F.xxhash64(*of[::-1], F.lit(2)).alias("h2"),
        )

    windows = F.transform(F.when(F.size("full") >= WINDOW, F.sequence(F.lit(0), F.size("full") - WINDOW)), lambda k: window(k, WINDOW))
    if long_words is not None:
        none = F.array().cast("array<int>")
        every = F.when(F.size("full") > 0, F.sequence(F.lit(0), F.size("full") - 1)).otherwise(none)
        alone = F.filter(every, lambda k: (F.size("full") == 1) | (F.regexp_count(line(k, 0), F.lit(r"\S+")) > long_words))
        pair = F.when(F.size("full") == 2, F.array(F.lit(0))).otherwise(none)
        windows = F.concat(
            F.when(windows.isNotNull(), windows).otherwise(F.transform(none, lambda k: window(k, WINDOW))),
            F.transform(alone, lambda k: window(k, 1)), F.transform(pair, lambda k: window(k, 2)),
        )
    # An outer generator: for an inner one Spark adds a filter that computes the windows twice.
    rows = kept.select("doc_id", "text_hash", windows.alias("windows")).select("doc_id", "text_hash", F.inline_outer("windows"))
    rows = rows.where(F.col("k").isNotNull())
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("k").alias("k"))
    firsts = (
        rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    )
    same = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash"))
    later = rows.join(firsts, ["h1", "h2"]).where(~(same & (F.col("k") < F.col("first.k") + F.size("at"))))
    return later.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("removed"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_words: int | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, plus ``n_lines`` and ``n_removed``."""
    id_, hash_, key, gone, split = unused([*docs.columns, "n_lines", "n_removed"], "id", "hash", "key", "removed", "lines")
    covered = repeated_windows(docs, doc_id, text, long_words).toDF(id_, hash_, gone)
    joined = docs.withColumn(key, F.xxhash64(F.col(text))).join(covered, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(hash_)), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    rest = F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")
    return (
        joined.withColumn(split, F.split(F.col(text), "\n", -1))
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long"))
        .withColumn("n_removed", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
        .withColumn(text, F.when(F.col("n_removed") > 0, rest).otherwise(F.col(text)))
        .drop(id_, hash_, key, split, gone)
    )
