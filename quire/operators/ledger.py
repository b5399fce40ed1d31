"""Work batches and the ledgers that show that everything is accounted for exactly once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import patterns as P
from quire.plans.groups import each_group
from quire.plans.ordering import group_places
from quire.plans.scratch import materialise


#: Entries of a book that one step packs at a time.
SEGMENT = 4096


def _next_starts(chars: np.ndarray, most: int, most_chars: int) -> np.ndarray:
    """Where the next batch starts if one starts at each entry: as many entries as fit, one at least."""
    upto = np.concatenate(([0], np.cumsum(chars)))
    at = np.arange(len(chars))
    return np.clip(np.searchsorted(upto, upto[:-1] + most_chars, side="right") - 1, at + 1, at + most)


def batches(entries: DataFrame, book: str, ident: str, chars: Column, most: int = P.BATCH_BLOCKS, most_chars: int = P.BATCH_CHARS) -> DataFrame:
    """``book, ident, chars, batch``: entries in byte order of ids, packed greedily; an entry over the limit has its own batch.

    Where a batch starts depends on all before it, but only by the place of the last start. So a book is cut into segments, and each
    segment says for each of its first ``most`` entries where the first batch of the next segment starts, and after how many
    batches, if a batch starts there. A pass over these small rows in order finds the real starts, and the segments are packed
    from there, each by its own task. Ids are to be unique in a book.
    """
    segment = max(SEGMENT, most)
    named = entries.select(F.col(book).alias("book"), F.col(ident).alias("_id"), chars.cast("long").alias("chars"))
    rows = materialise(group_places(named, "book", [F.col("_id")], "n").withColumn("segment", F.floor((F.col("n") - 1) / segment)))
    kind = rows.schema["book"].dataType.simpleString()
    ahead = rows.where((F.col("segment") > 0) & ((F.col("n") - 1) % segment < most)).withColumn("segment", F.col("segment") - 1)

    def leads(part: pd.DataFrame) -> pd.DataFrame:
        own = int(((part["n"] - 1) // segment == part["segment"]).sum())
        after = _next_starts(part["chars"].to_numpy(), most, most_chars)
        at = np.arange(min(most, own))
        count = np.zeros(len(at), dtype=np.int64)
        while (inside := at < own).any():
            count[inside] += 1
            at[inside] = after[at[inside]]
        return pd.DataFrame({"book": part["book"][:1], "segment": part["segment"][:1], "leads": [(at - own).tolist()], "counts": [count.tolist()]})

    maps = each_group(rows.drop("_id").unionByName(ahead.drop("_id")), ["book", "segment"], ["n"], leads, f"book {kind}, segment long, leads array<long>, counts array<long>")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, at, base = None, 0, 0
        for part in parts:
            starts = []
            for k, lead, count in zip(part["_key"], part["leads"], part["counts"], strict=True):
                if k != key:
                    key, at, base = k, 0, 0
                starts.append((at, base))
                base, at = (base + int(count[at]), int(lead[at])) if at < len(lead) else (base, at)
            yield part[["book", "segment"]].assign(at=[s[0] for s in starts], base=[s[1] for s in starts])

    keyed = maps.withColumn("_key", F.to_json(F.struct("book"), {"ignoreNullFields": "false"})).repartition("book").sortWithinPartitions("_key", "segment")
    starts = keyed.mapInPandas(walk, f"book {kind}, segment long, at long, base long").withColumnsRenamed({"book": "_book", "segment": "_segment"})

    def number(part: pd.DataFrame) -> pd.DataFrame:
        after = _next_starts(part["chars"].to_numpy(), most, most_chars)
        begins = np.zeros(len(part), dtype=np.int64)
        at = int(part["at"].iloc[0])
        while at < len(part):
            begins[at] = 1
            at = int(after[at])
        return part[["book", "_id", "chars"]].assign(batch=begins.cumsum() + int(part["base"].iloc[0]))

    joined = rows.join(starts, F.col("book").eqNullSafe(F.col("_book")) & (F.col("segment") == F.col("_segment"))).drop("_book", "_segment")
    ids = rows.schema["_id"].dataType.simpleString()
    packed = each_group(joined, ["book", "segment"], ["n"], number, f"book {kind}, _id {ids}, chars long, batch int")
    return packed.withColumnRenamed("_id", ident)


def progress(done: DataFrame, totals: DataFrame, book: str, order: str) -> DataFrame:
    """``book, order, blocks, chars, eta_ms`` after each finished batch: what is done so far, and the time that the rest takes at the speed of this session.

    ``done`` has book, n_blocks, n_chars, elapsed_ms (since the session began); ``totals`` has book, all_chars, reused_chars, which no session has to do again.
    """
    upto = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = done.withColumn("blocks", F.sum("n_blocks").over(upto)).withColumn("fresh", F.sum("n_chars").over(upto)).join(totals, book)
    eta = N.eta_ms(F.col("fresh"), F.greatest(F.col("all_chars") - F.col("reused_chars"), F.lit(0)), F.col("elapsed_ms"))
    return rows.select(book, order, "blocks", (F.col("fresh") + F.col("reused_chars")).alias("chars"), eta.alias("eta_ms"))


def halves(entries: DataFrame, group: str, ident: str, chars: str, both: bool = False) -> DataFrame:
    """The left half takes entries in order until it holds half of all characters, one at least; with ``both`` the right half of two or more gets the last one at least."""
    w = Window.partitionBy(group).orderBy(ident)
    before = F.sum(chars).over(w.rowsBetween(Window.unboundedPreceding, -1))
    target = F.floor(F.sum(chars).over(Window.partitionBy(group)) / 2)
    left = before < target
    if both:
        left = left & F.lead(ident).over(w).isNotNull()
    return entries.withColumn("side", F.when(before.isNull() | left, "left").otherwise("right"))


def missing(blocks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return blocks.join(done.select(key), key, "left_anti")


def reusable(blocks: DataFrame, stored: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Stored results of blocks that aren't blank, the last one of each."""
    valid = stored.where(F.trim(F.col(text)) != "").join(blocks.select(key), key, "left_semi")
    return valid.groupBy(key).agg(F.max_by(text, order).alias(text))


def key_equality(left: DataFrame, right: DataFrame, key: str, group: Column) -> DataFrame:
    """By group: keys of both sides, only left, only right, and whether the sets are equal."""
    a = left.select(F.col(key)).distinct().withColumn("l", F.lit(1))
    b = right.select(F.col(key)).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer").groupBy(group.alias("grp"))
    out = both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), F.count_if(F.col("r").isNull()).alias("n_left"), F.count_if(F.col("l").isNull()).alias("n_right"))
    return out.withColumn("equal", (F.col("n_left") == 0) & (F.col("n_right") == 0))


def exactly_once(expected: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, unknown or used more than once: ``keys, problem``."""
    n = used.groupBy(*keys).agg(F.count("*").alias("_n"))
    gone = expected.select(*keys).distinct().join(n, keys, "left_anti").withColumn("problem", F.lit("missing"))
    unknown = n.join(expected.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("unknown").alias("problem"))
    twice = n.where("_n > 1").select(*keys, F.lit("duplicate").alias("problem"))
    return gone.unionByName(unknown).unionByName(twice)


def placeholders(text: Column) -> Column:
    """The placeholders of a text as a sorted list, so that equal multisets are equal lists."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"\{\{GR[0-9]+\}\}"), 0))


def valid_translation(original: Column, translated: Column) -> Column:
    """Not blank, and the same placeholders as often."""
    return F.coalesce((F.trim(translated) != "") & (placeholders(original) == placeholders(translated)), F.lit(False))


def _paths(found: DataFrame, ident: str, path: str) -> DataFrame:
    return found.groupBy(ident).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(path)).alias("paths"))


def conflicting(found: DataFrame, ident: str, path: str) -> DataFrame:
    """``ident, n, detail``: one row for every id that was seen more than once; the detail lists its paths in order, null if none is known."""
    detail = F.when(F.size("paths") > 0, F.array_join("paths", "；"))
    return _paths(found, ident, path).where("n > 1").select(ident, "n", detail.alias("detail"))


def conflicts(found: DataFrame, ident: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Ids seen once, and one issue for every path of an id that was seen more often (it lists them all, so issues grow with the square of an id's paths)."""
    by = _paths(found, ident, path)
    once = by.where("n = 1").select(ident, F.get("paths", F.lit(0)).alias(path))
    issues = by.where("n > 1").select(F.explode("paths").alias(path), ident, F.array_join("paths", "；").alias("detail"))
    return once, issues
