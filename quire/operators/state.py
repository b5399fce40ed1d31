"""Keyed state from change logs: upserts, deletes, sequences, transitions, annotations, retention."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P

#: Legal moves of a question task; the states on the right of none are final.
MOVES = [("queued", "running"), ("queued", "paused"), ("queued", "stopped"), ("running", "completed"), ("running", "paused"), ("running", "stopped"), ("paused", "queued"), ("paused", "stopped")]


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins: one row a key, the greatest by ``order``. Partial maxima are merged, so a hot key is no bottleneck."""
    rest = [c for c in log.columns if c not in (*keys, *order)]
    best = log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in (*order, *rest)]).select(log.columns)


def valid_progress(log: DataFrame, chapter: str = "chapter_id", ratios: Sequence[str] = ("overall_progress",)) -> DataFrame:
    """Saves with a chapter and ratios from 0 to 1."""
    ok = F.trim(F.col(chapter)) != ""
    for r in ratios:
        ok = ok & F.col(r).between(0, 1)
    return log.where(ok)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the deleted ones."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def forget(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Counts of what a cascading delete takes away, by parent key of ``gone``."""
    p = parents.join(gone, parent_key, "left_semi").groupBy(parent_key).agg(F.count("*").alias("n_parents"))
    c = children.join(gone.select(F.col(parent_key).alias(child_key)), child_key, "left_semi").groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias("n_children"))
    return p.join(c, parent_key, "left").select(parent_key, "n_parents", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def append_sequence(old: DataFrame, new: DataFrame, task: str, seq: str, order: Sequence[str]) -> DataFrame:
    """New events numbered on from each task's greatest sequence."""
    top = old.groupBy(task).agg(F.max(seq).alias("_top"))
    n = F.row_number().over(Window.partitionBy(task).orderBy(*order))
    return new.withColumn("_n", n).join(top, task, "left").withColumn(seq, F.coalesce("_top", F.lit(0)) + F.col("_n")).drop("_n", "_top")


def retain(rows: DataFrame, group: str, order: Sequence[Column], keep: int = 7) -> DataFrame:
    """The ``keep`` first of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def transitions(log: DataFrame, key: str, order: Sequence[str], status: str) -> DataFrame:
    """Each status with the one before, and whether the move is legal (the first status always is)."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    legal = F.lit(False)
    for a, b in MOVES:
        legal = legal | ((F.col("before") == a) & (F.col(status) == b))
    return log.withColumn("before", before).withColumn("legal", F.col("before").isNull() | legal)


def one_active(tasks: DataFrame, book: str, status: str, final: Sequence[str] = ("completed", "stopped")) -> DataFrame:
    """Books with more than one task that isn't final."""
    return tasks.where(~F.col(status).isin(*final)).groupBy(book).agg(F.count("*").alias("n_active")).where("n_active > 1")


def recover(tasks: DataFrame, status: str = "status") -> DataFrame:
    """Tasks that a crash interrupted are paused."""
    return tasks.withColumn(status, F.when(F.col(status).isin("running", "queued"), "paused").otherwise(F.col(status)))


def annotation_error(kind: Column, color: Column, note: Column) -> Column:
    """Why an annotation is refused, or null."""
    return (
        F.when(kind == "highlight", F.when(~F.coalesce(color.isin("yellow", "green", "blue", "pink"), F.lit(False)), "color").when(note.isNotNull(), "note"))
        .when(kind == "note", F.when(F.coalesce(F.trim(note), F.lit("")) == "", "note").when(color.isNotNull(), "color"))
        .when(kind == "bookmark", F.when(color.isNotNull(), "color").when(note.isNotNull(), "note"))
        .otherwise("kind")
    )


def first_of_equal(annotations: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first of annotations that agree in all keys."""
    rest = [c for c in annotations.columns if c not in (*keys, *order)]
    best = annotations.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in (*order, *rest)]).select(annotations.columns)


def overlapping(highlights: DataFrame, keys: Sequence[str], ident: str, start: str, end: str) -> DataFrame:
    """Highlights that overlap another one of the same keys; touching ranges don't.

    One pass over each key in order of starts: a range overlaps an earlier one if it begins before the
    greatest end so far, and a later one if that one begins before its own end.
    """
    w = Window.partitionBy(*keys).orderBy(start, end, ident)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.lead(start).over(w)
    return highlights.withColumn("_r", reach).withColumn("_f", following).where((F.col(start) < F.col("_r")) | (F.col("_f") < F.col(end))).drop("_r", "_f")


def admit(highlights: DataFrame, keys: Sequence[str], ident: str, start: str, end: str) -> DataFrame:
    """``keys, ident, start, end``: highlights accepted in order of ``ident``; one is accepted iff it overlaps none accepted before.

    Ranges that chains of overlaps don't connect decide apart, so each key is cut into islands by the greatest end so
    far. In an island accepted ranges are disjoint and kept in order, where a new one has one neighbour to be compared with.
    Ranges that end before they start are never accepted.
    """
    w = Window.partitionBy(*keys).orderBy("s", "e", "i")
    rows = highlights.select(*keys, F.col(ident).alias("i"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s <= e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("_new", F.when(F.col("s") < reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    marked = islands.withColumn("_group", F.to_json(F.struct(*keys, "_island"), {"ignoreNullFields": "false"}))
    columns = [*keys, "i", "s", "e"]
    schema = ", ".join(f"`{c}` {marked.schema[c].dataType.simpleString()}" for c in columns)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, taken = None, []
        for part in parts:
            keep = []
            for g, s, e in zip(part["_group"], part["s"].tolist(), part["e"].tolist(), strict=True):
                if g != group:
                    group, taken = g, []
                at = bisect_left(taken, (e,))  # those that start before the new one ends; the last of them ends last
                ok = at == 0 or taken[at - 1][1] <= s
                if ok:
                    insort(taken, (s, e))
                keep.append(ok)
            yield part.loc[keep, columns]

    kept = marked.repartition(*keys, "_island").sortWithinPartitions("_group", "i").mapInPandas(run, schema)
    return kept.withColumnsRenamed({"i": ident, "s": start, "e": end})


def create_annotations(requests: DataFrame, keys: Sequence[str], block: Sequence[str], ident: str = "id") -> DataFrame:
    """``ident, result, existing`` of requests in order of ``ident``: refused (the error), created, existing, or overlap.

    ``requests`` has kind, color, note, start, end and the columns named: a request that agrees with a stored one in ``keys`` gives that one back
    (``existing``); a highlight that overlaps a stored one of its ``block`` is refused. Of equal requests only the first can be stored, and what refuses
    it refuses the others too.
    """
    judged = requests.withColumn("_error", annotation_error(F.col("kind"), F.col("color"), F.col("note")))
    valid = judged.where("_error IS NULL")
    firsts = valid.groupBy(*keys).agg(F.min(ident).alias("_first"))
    matched = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    both = matched[0]
    for m in matched[1:]:
        both = both & m
    asked = valid.alias("r").join(firsts.alias("f"), both).select("r.*", "f._first")
    stored = admit(asked.where((F.col("kind") == "highlight") & (F.col(ident) == F.col("_first"))), block, ident, "start", "end").select(F.col(ident).alias("_stored"))
    known = asked.join(stored, F.col("_first") == F.col("_stored"), "left")
    refused = (F.col("kind") == "highlight") & F.col("_stored").isNull()
    result = F.when(refused, "overlap").when(F.col(ident) == F.col("_first"), "created").otherwise("existing")
    done = known.select(ident, result.alias("result"), F.when(result == "existing", F.col("_first")).alias("existing"))
    return done.unionByName(judged.where("_error IS NOT NULL").select(ident, F.col("_error").alias("result"), F.lit(None).cast(requests.schema[ident].dataType).alias("existing")))


def absolute_ranges(blocks: DataFrame, ranges: DataFrame, book: str, block: str, order: str, length: str, start: str, end: str) -> DataFrame:
    """Block-relative ranges as offsets in the whole book, by the lengths of the blocks before."""
    before = F.coalesce(F.sum(length).over(Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.join(blocks.select(book, block, before.alias("_b"), F.col(length).alias("_l")), [book, block]).select(
        *ranges.columns, (F.col("_b") + F.least(start, "_l")).alias("abs_start"), (F.col("_b") + F.least(end, "_l")).alias("abs_end")
    )


def sustained_failures(log: DataFrame, key: str, ts: str, failed: Column, seconds: int = 90) -> DataFrame:
    """Unbroken runs of failures: ``key, first_s, last_s, n, aborted``; a success ends a run."""
    rows = log.select(F.col(key).alias("key"), F.unix_seconds(F.col(ts).cast("timestamp")).alias("s"), F.col("event_id"), failed.alias("bad"))
    island = F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(Window.partitionBy("key").orderBy("s", "event_id"))
    runs = rows.withColumn("run", island).where("bad").groupBy("key", "run").agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.count("*").alias("n"))
    return runs.select("key", "first_s", "last_s", "n", (F.col("last_s") - F.col("first_s") >= seconds).alias("aborted"))


def phase_of(kind: Column, text: Column) -> Column:
    """What a task is shown to do after an event: text deltas stay ``text_delta``, others become their label, or blank where nothing new is shown."""
    out = F.when(kind == "text_delta", kind).when(kind.isin("phase", "execution_error"), F.coalesce(text, F.lit(""))).when(kind == "tool_started", F.concat(F.lit(P.PHASE_TOOL), F.coalesce(text, F.lit(""))))
    for name, label in P.PHASES.items():
        out = out.when(kind == name, label)
    return out.otherwise("")


def fold_stream(log: DataFrame, task: str, seq: str, kind: str, text: str) -> DataFrame:
    """The live state of each task: text deltas in order, the last phase that isn't blank, the last sequence; a sequence counts once."""
    once = log.groupBy(task, seq).agg(F.min(F.struct(kind, text)).alias("r")).select(task, seq, F.col("r")[kind].alias("k"), F.col("r")[text].alias("t"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("k") == "text_delta", F.struct(F.col(seq), F.col("t")))))
    return once.groupBy(task).agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("partial"),
        F.max(F.when(~F.col("k").isin("text_delta", ""), F.struct(F.col(seq), F.col("k"))))["k"].alias("phase"),
        F.max(seq).alias("last_seq"),
    )


def events_since(log: DataFrame, seq: str, after: int) -> DataFrame:
    """Events behind a cursor; synthetic ones (sequence 0) always."""
    return log.where((F.col(seq) == 0) | (F.col(seq) > after))


def merge_events(old: DataFrame, new: DataFrame, *ident: str) -> DataFrame:
    """Union by id; the newer batch wins. An id that holds within one log only is named with the log's column."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return latest(both, ident, ["_v"]).drop("_v")


def stage_progress(stage: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in P.STAGE_PROGRESS.items() for x in kv])
    return F.element_at(table, stage)
