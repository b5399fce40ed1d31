"""The reading desk: notes, tasks, queues, events and summaries as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P


def edited_notes(annotations: DataFrame, edits: DataFrame) -> DataFrame:
    """``annotations`` (id, kind, note, updated_at) after ``edits`` (id, note, at): the last edit that isn't blank, of notes only."""
    said = edits.where(F.trim("note") != "").groupBy("id").agg(F.max(F.struct("at", F.trim("note").alias("text"))).alias("_e"))
    ours = F.col("_e").isNotNull() & (F.col("kind") == "note")
    joined = annotations.join(said, "id", "left")
    return joined.withColumn("note", F.when(ours, F.col("_e.text")).otherwise(F.col("note"))).withColumn("updated_at", F.when(ours, F.col("_e.at")).otherwise(F.col("updated_at"))).drop("_e")


def edit_errors(annotations: DataFrame, edits: DataFrame) -> DataFrame:
    """``id, at, error`` of edits that change nothing: blank ones, and those that find no note."""
    notes = annotations.where("kind = 'note'").select("id").distinct().withColumn("_note", F.lit(True))
    error = F.when(F.trim("note") == "", "blank").when(F.col("_note").isNull(), "no-note")
    return edits.join(notes, "id", "left").select("id", "at", error.alias("error")).where("error IS NOT NULL")


def cleared(tables: dict[str, DataFrame], books: DataFrame, book: str = "book_id") -> dict[str, DataFrame]:
    """The tables of a book's work (tasks, messages, sessions and the like) without those of ``books``; annotations aren't among them."""
    return {name: t.join(books.select(book).distinct(), book, "left_anti") for name, t in tables.items()}


def listed(annotations: DataFrame, kind: str = "all") -> DataFrame:
    return annotations if kind == "all" else annotations.where(F.col("kind") == kind)


def newest_first(rows: DataFrame, group: str, at: str, ident: str) -> DataFrame:
    """``rows`` with their ``place`` in the group, the newest first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(at), F.desc(ident))))


def by_offset(annotations: DataFrame, group: str, start: str, end: str, ident: str) -> DataFrame:
    """``annotations`` with their ``place`` in the text."""
    return annotations.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(start, end, ident)))


def at_key(rows: DataFrame, **keys: object) -> DataFrame:
    """The rows whose key columns have these values: a session by book and runtime, a setting by name."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def unfinished(status: Column) -> Column:
    return ~status.isin("completed", "cancelled")


def titled(annotations: DataFrame, chapters: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """Annotations with the title of their chapter; where it is unknown, the id."""
    return annotations.join(chapters.select(chapter, "title"), chapter, "left").withColumn("title", F.coalesce("title", chapter))


def answers(tasks: DataFrame, finished: DataFrame) -> DataFrame:
    """Messages of finished executions, with book and task of their task row: ``finished`` has task_id, content, at."""
    return tasks.join(finished, "task_id").select("book_id", "task_id", F.lit("assistant").alias("role"), "content", F.col("at").alias("created_at"))


def with_live(tasks: DataFrame, live: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks overlaid with their live state (phase, partial, sequence); an empty partial output is none."""
    shown = live.select(key, F.col("phase").alias("_p"), F.nullif("partial", F.lit("")).alias("_o"), F.col("sequence").alias("_s"), F.lit(True).alias("_l"))
    take = lambda a, b: F.when(F.col("_l"), F.col(a)).otherwise(F.col(b))
    joined = tasks.join(shown, key, "left")
    return joined.withColumn("phase", take("_p", "phase")).withColumn("partial", take("_o", "partial")).withColumn("sequence", take("_s", "sequence")).drop("_p", "_o", "_s", "_l")


def summaries(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Books with the addresses of cover, entry and chapters. ``books`` has id, title, entry, version; ``chapters`` id, ord, path, title, parallel."""
    url = F.concat(F.lit("/books/"), "id", F.lit("/"), "path")
    listed = F.array_sort(F.collect_list(F.struct("ord", url.alias("url"), F.col("parallel").isNotNull().alias("has_parallel"))))
    by = chapters.groupBy("id").agg(listed.alias("chapters"))
    cover = F.concat(F.lit("/api/books/"), "id", F.lit("/cover?v="), F.coalesce("version", F.lit(0)).cast("string"))
    entry = F.concat(F.lit("/books/"), "id", F.lit("/"), "entry")
    return books.select("id", "title", cover.alias("cover_url"), entry.alias("entry_url")).join(by, "id", "left")


def holds_string(json: Column, expected: str) -> Column:
    """Whether a JSON text holds the string as a value or as a key, at any depth; false for text that isn't JSON.

    Strings of a valid text are its quoted parts outside escapes, so no walk is needed: values and keys look alike.
    """
    quoted = F.regexp_extract_all(json, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)
    plain = F.transform(quoted, lambda q: F.get_json_object(F.concat(F.lit('["'), q, F.lit('"]')), "$[0]"))
    return F.coalesce(F.try_parse_json(json).isNotNull() & F.array_contains(plain, F.lit(expected)), F.lit(False))


def chosen_runtime(books: DataFrame, available: DataFrame) -> DataFrame:
    """``book_id, runtime``: the current one if it is available, else that of the active task, else the first. ``available`` has runtime, ord."""
    names = available.select("runtime")
    first = available.agg(F.min_by("runtime", "ord").alias("_first"))
    mark = lambda c, out: names.select(F.col("runtime").alias(c)).withColumn(out, F.lit(True))
    joined = books.join(mark("current", "_c"), "current", "left").join(mark("active", "_a"), "active", "left").join(F.broadcast(first), F.lit(True), "left")
    return joined.select("book_id", F.coalesce(F.when(F.col("_c"), F.col("current")), F.when(F.col("_a"), F.col("active")), F.col("_first"), F.lit("")).alias("runtime"))


def chars_of(blocks: DataFrame, ids: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """Characters of ids and texts of the blocks that ``ids`` names, one row."""
    picked = blocks.join(ids.select(ident).distinct(), ident, "left_semi")
    return picked.agg(F.coalesce(F.sum(F.char_length(F.col(ident).cast("string")) + F.char_length(text)), F.lit(0)).cast("long").alias("chars"))


def last_measured(events: DataFrame, group: str, order: str, measures: Sequence[str]) -> DataFrame:
    """The last event of each group that carries any of the measures."""
    some = reduce(or_, [F.col(m).isNotNull() for m in measures])
    best = events.where(some).groupBy(group).agg(F.max(F.struct(order, *measures)).alias("_m"))
    return best.select(group, "_m.*")


def swapped(queue: DataFrame, moves: DataFrame, group: str, ident: str, order: str) -> DataFrame:
    """Queues after one move each: ``moves`` (ident, step -1 or 1) swaps an entry with its neighbour, at the ends with none."""
    w = Window.partitionBy(group).orderBy(order, ident)
    rows = queue.join(moves.select(ident, "step"), ident, "left")
    near = lambda f, c: f(c).over(w)
    rows = rows.select(
        "*", *[near(f, c).alias(f"_{n}_{c}") for n, f in (("before", F.lag), ("after", F.lead)) for c in (order, "step")]
    )
    up = (F.col("step") == -1) & F.col(f"_before_{order}").isNotNull()
    down = (F.col("step") == 1) & F.col(f"_after_{order}").isNotNull()
    new = F.when(up, F.col(f"_before_{order}")).when(down, F.col(f"_after_{order}")).when(F.col("_after_step") == -1, F.col(f"_after_{order}")).when(F.col("_before_step") == 1, F.col(f"_before_{order}")).otherwise(F.col(order))
    return rows.withColumn(order, new).select(queue.columns)


def next_queued(tasks: DataFrame, group: str, ident: str, order: str, status: str = "status") -> DataFrame:
    """The queued task of least order in each group."""
    return tasks.where(F.col(status) == "queued").groupBy(group).agg(F.min_by(ident, F.struct(order, ident)).alias(ident))


def nearest(targets: DataFrame, blocks: DataFrame, group: str, at: str, place: str, ident: str) -> DataFrame:
    """``targets`` with the block of least distance in its group, the earlier one of equals; targets of groups without blocks are left out.

    Both sides are merged in order of place: the last block before a target and the first one behind it are the only ones in question. Rows
    are the sum of both sides. Of blocks at one place the least id counts; a null place is nowhere, for targets too.
    """
    there = blocks.where(F.col(place).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(place).cast("double").alias("_p")).agg(F.min(ident).alias("_b"))
    asks = targets.where(F.col(at).isNotNull()).select(F.col(group).alias("_g"), F.col(at).cast("double").alias("_p"), F.struct(*targets.columns).alias("_t"))
    both = asks.withColumn("_b", F.lit(None).cast(there.schema["_b"].dataType)).unionByName(there.withColumn("_t", F.lit(None).cast(asks.schema["_t"].dataType)))
    found = F.when(F.col("_t").isNull(), F.struct(F.col("_p").alias("p"), F.col("_b").alias("b")))
    rise = Window.partitionBy("_g").orderBy("_p", F.col("_t").isNotNull())  # a block at the target's own place comes before it
    fall = Window.partitionBy("_g").orderBy(F.desc("_p"), F.col("_t").isNotNull())
    upto = lambda w: F.last(found, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("_before", upto(rise)).withColumn("_behind", upto(fall)).where(F.col("_t").isNotNull() & (F.col("_before").isNotNull() | F.col("_behind").isNotNull()))
    closer = F.col("_behind").isNull() | (F.col("_p") - F.col("_before.p") <= F.col("_behind.p") - F.col("_p"))
    return near.select("_t.*", F.when(closer, F.col("_before.b")).otherwise(F.col("_behind.b")).alias(ident))


def merged_place(events: DataFrame, group: str, seq: str = "seq", at: str = "created_at", ident: str = "id") -> DataFrame:
    """Merged events with their ``place``: by sequence, but an event without one (0) stands by its time.

    An unnumbered event comes behind the last numbered one that isn't later than it, which is what comparing by time where
    either number is missing gives for logs whose numbers grow with time.
    """
    w = Window.partitionBy(group).orderBy(F.col(at), F.col(seq) == 0, seq, ident).rowsBetween(Window.unboundedPreceding, 0)
    anchored = events.withColumn("_a", F.when(F.col(seq) > 0, F.col(seq)).otherwise(F.coalesce(F.max(F.when(F.col(seq) > 0, F.col(seq))).over(w), F.lit(0))))
    order = Window.partitionBy(group).orderBy("_a", F.col(seq) == 0, at, ident)
    return anchored.withColumn("place", F.row_number().over(order)).drop("_a")


def issues_by_path(issues: DataFrame, group: str, path: str = "path", ident: str = "id") -> DataFrame:
    """``issues`` with their ``place`` in each group: by path, then problem, then id."""
    return issues.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(path, "problem", ident)))


def event_clock(ms: Column) -> Column:
    """HH:mm:ss of a time in milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "HH:mm:ss")


def process_start(text: Column) -> Column:
    """The time of a process listing such as ``Mon Jan  2 03:04:05 2006``; null for other text."""
    plain = F.regexp_replace(F.regexp_extract(F.trim(text), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+([A-Z][a-z]{2}\s+[0-9]{1,2}\s+[0-9:]{8}\s+[0-9]{4})$", 1), r"\s+", " ")
    return F.try_to_timestamp(F.when(plain != "", plain), F.lit("MMM d HH:mm:ss yyyy"))


def compact_count(n: Column) -> Column:
    """12.3万 from ten thousand on, else with separators."""
    return F.when(n >= 10_000, F.concat(F.format_string("%.1f", n / 10_000), F.lit("万"))).otherwise(F.format_number(n, 0))


def byte_count(n: Column) -> Column:
    """B, KB or MB, the latter two with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1024 / 1024), F.lit(" MB")))


def with_live_event(events: DataFrame, logs: DataFrame, group: str = "task_id") -> DataFrame:
    """``task_id, id, seq, detail, scope, created_at``: the event log plus, for every task whose worker runs, one event of sequence 0.

    ``logs`` has task, stdout, stderr, pid, at. The event shows the output, else the errors, else that the worker has started, and
    takes its scope from the last event of a batch or page.
    """
    scoped = F.lit(False)
    for start in P.BATCH_SCOPES:
        scoped = scoped | F.coalesce(F.col("scope").startswith(start), F.lit(False))
    last = events.groupBy(group).agg(F.max_by(F.col("scope"), F.when(scoped, F.col("seq"))).alias("scope"))
    detail = F.coalesce(F.nullif(F.trim("stdout"), F.lit("")), F.nullif(F.trim("stderr"), F.lit("")), F.when(F.col("pid").isNotNull(), "started"))
    live = logs.withColumn("detail", F.left(detail, F.lit(20_000))).where("detail IS NOT NULL").join(last, group, "left")
    shown = live.select(group, F.lit("live-output").alias("id"), F.lit(0).cast("long").alias("seq"), "detail", "scope", F.col("at").alias("created_at"))
    return events.select(group, "id", F.col("seq").cast("long").alias("seq"), "detail", "scope", "created_at").unionByName(shown)


def resumed(tasks: DataFrame, candidates: DataFrame, from_progress: int = 42) -> DataFrame:
    """Tasks that go on from a checkpoint: progress reached the contract and the candidate still is valid. ``candidates`` has task_id, error."""
    valid = candidates.where("error IS NULL").select("task_id")
    return tasks.where(F.col("progress") >= from_progress).join(valid, "task_id", "left_semi").withColumn("progress", F.greatest("progress", F.lit(from_progress)))


def attempts(log: DataFrame, group: str, order: str, outcome: str, invalid: int = P.INVALID_ATTEMPTS, most: int = P.ATTEMPTS) -> DataFrame:
    """``group, used, result``: how a loop of attempts ends. Outcomes are ok, invalid, transient and permanent.

    It stops at the first ok or permanent outcome, at the ``invalid``-th invalid one, or at attempt ``most``.
    """
    w = Window.partitionBy(group).orderBy(order)
    rows = log.select(group, outcome, F.row_number().over(w).alias("n"), F.sum((F.col(outcome) == "invalid").cast("int")).over(w).alias("bad"))
    ends = (F.col(outcome).isin("ok", "permanent")) | (F.col("bad") >= invalid) | (F.col("n") >= most)
    last = rows.groupBy(group).agg(F.min(F.when(ends, F.struct("n", F.col(outcome).alias("o")))).alias("e"), F.max("n").alias("seen"))
    return last.select(group, F.coalesce("e.n", "seen").alias("used"), F.when(F.col("e").isNull(), "open").when(F.col("e.o") == "ok", "ok").otherwise("failed").alias("result"))


def backup_due(settings: DataFrame, today: Column) -> DataFrame:
    """Whether the daily backup is still to be made: ``due, value`` (the date to write)."""
    last = settings.where("key = 'last_auto_backup_date'").agg(F.max("value").alias("last"))
    return last.select((~F.coalesce(F.col("last") == today, F.lit(False))).alias("due"), today.alias("value"))


def history(messages: DataFrame, group: str, order: str) -> DataFrame:
    """``group, lines``: the messages of a book as JSON lines, in order."""
    entry = F.to_json(F.struct("role", "content"))
    return messages.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, entry.alias("e")))), lambda x: x["e"]), "\n").alias("lines"))


def deletable(root: Column, path: Column) -> Column:
    """Only a direct child of the shelf folder may be deleted."""
    parent = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"^(.*)/[^/]+$", 1)
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    return (parent == F.regexp_replace(root, "/+$", "")) & ~name.isin("", ".", "..")


def map_blocks(blocks: DataFrame, results: DataFrame, key: str = "block_id") -> DataFrame:
    """A pluggable step over blocks: each takes the result that a worker gave for it (``results``: key, text), or keeps its own text."""
    given = results.groupBy(key).agg(F.max("text").alias("_t"))
    return blocks.join(given, key, "left").withColumn("text", F.coalesce(F.nullif(F.trim("_t"), F.lit("")), "text")).drop("_t")
