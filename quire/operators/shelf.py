"""The shelf: books with their reading progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import patterns as P
from quire.plans.ordering import global_places


def with_progress(books: DataFrame, progress: DataFrame, key: str = "book_id") -> DataFrame:
    """Every book, with its progress where there is one."""
    return books.join(progress, key, "left")


def bucket(progress: Column) -> Column:
    """unread, finished or reading; null for progress that is there and not above 0."""
    return F.when(progress.isNull(), "unread").when(progress >= P.FINISHED, "finished").when(progress > 0, "reading")


def bucket_counts(shelf: DataFrame, progress: str) -> DataFrame:
    """One row a filter, also where it is 0."""
    b = bucket(F.col(progress))
    counts = shelf.agg(*[F.count_if(b == name).alias(name) for name in ("unread", "reading", "finished")], F.count("*").alias("all"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(n).alias("n")) for n in ("all", "unread", "reading", "finished")])))


def matches(title: Column, original: Column, author: Column, query: str) -> Column:
    """The trimmed query is part of title, original title and author, whatever the case."""
    whole = F.lower(F.concat(title, F.lit(" "), F.coalesce(original, F.lit("")), F.lit(" "), author))
    return F.contains(whole, F.lower(F.trim(F.lit(query))))


def shelf_places(shelf: DataFrame, updated: str, title: str, ident: str) -> DataFrame:
    """``shelf`` with ``place``, 1 for the first book: those with progress by last change, then the others by title. No task sees the whole shelf."""
    return global_places(shelf, [F.col(updated).isNull(), F.col(updated).desc(), F.col(title), F.col(ident)])


def progress_label(progress: Column, chapter: Column) -> Column:
    percent = F.greatest(F.lit(1), F.floor(progress * 100 + 0.5)).cast("int")
    reading = F.concat(percent.cast("string"), F.lit("% · "), F.coalesce(chapter, F.lit("继续阅读")))
    return F.when(progress.isNull(), "未开始").when(progress >= P.FINISHED, "已读完").otherwise(reading)


def overall_progress(index: Column, chapter_progress: Column, chapters: Column) -> Column:
    return N.clamp((index + chapter_progress) / F.greatest(chapters, F.lit(1)), 0.0, 1.0)


def toc_label(index: Column) -> Column:
    """Two digits at least."""
    return F.when(index < 100, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string"))


def neighbours(chapters: DataFrame, book: str, order: str, ident: str) -> DataFrame:
    """Each chapter with the one before and after."""
    w = Window.partitionBy(book).orderBy(order)
    return chapters.withColumn("previous", F.lag(ident).over(w)).withColumn("next", F.lead(ident).over(w))


def task_order(status: str, queue: str, updated: str, ident: str) -> list[Column]:
    """Active tasks first: queued ones by their place, then running ones and the others by last change."""
    s = F.col(status)
    return [
        F.when(s.isin("running", "queued"), 0).otherwise(1), F.when(s == "queued", 0).otherwise(1),
        F.when(s == "queued", F.col(queue)), F.col(updated).desc(), F.col(ident),
    ]
