"""Operators on pages of HTML and on lines of paged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import numbers as N
from quire.functions import patterns as P
from quire.functions import text as X
from quire.functions import url as U
from quire.functions.arrays import bind
from quire.plans.scratch import Scratch


def blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Text blocks of every page in document order: ``page_id, block_ord, tag, block_id``."""
    clean = pages.select(F.col(page_id).alias("page_id"), H.block_tags(F.regexp_replace(F.col(html), P.SCRIPT, "")).alias("tags"))
    rows = clean.select("page_id", F.posexplode("tags").alias("pos", "tag"))
    return rows.select(
        "page_id", (F.col("pos") + 1).alias("block_ord"), X.lower_ascii(F.col("tag")).alias("tag"), F.format_string("%d-block-%04d", "page_id", F.col("pos") + 1).alias("block_id")
    )


def block_texts(chapters: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id, ord, block_id, tag, inner``: the marked blocks of chapters in document order.

    A body ends where ``</tag`` stands first behind the opening, and is empty if it stands nowhere.
    """
    rows = chapters.select(
        F.col(page_id).alias("page_id"), F.split(F.col(html), P.BLOCK_ELEMENT, -1).alias("parts"), F.regexp_extract_all(F.col(html), F.lit(P.BLOCK_ELEMENT), 0).alias("opening")
    )
    n = F.size("opening")

    def inner(i: Column, tag: Column) -> Column:
        close, part = F.concat(F.lit("</"), tag), F.get("parts", i + 1)
        cut = lambda text, other: bind(F.instr(X.lower_ascii(text), close), lambda at: F.when(at > 0, F.left(text, at - 1)).otherwise(other))
        # The closing tag is nearly always in front of the next opening; only else the rest of the page is put together.
        later = F.transform(F.when(i + 1 < n, F.sequence(i + 1, n - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.concat(F.get("opening", j), F.get("parts", j + 1)))
        return cut(part, cut(F.concat(part, F.array_join(later, "")), F.lit("")))

    def block(opening: Column, i: Column) -> Column:
        tag = X.lower_ascii(F.regexp_extract(opening, P.BLOCK_ELEMENT, 1))
        return bind(tag, lambda t: F.struct(i.alias("ord"), F.regexp_extract(opening, P.BLOCK_ELEMENT, 2).alias("block_id"), t.alias("tag"), inner(i, t).alias("inner")))

    # Bodies are cut inside the array, so that no block carries its whole page along.
    return rows.select("page_id", F.inline(F.transform("opening", block)))


def block_text_view(texts: DataFrame) -> DataFrame:
    """One text a page: ``## id``, a blank line and the text of every block that has one, in document order."""
    shown = texts.select("page_id", "ord", "block_id", X.strip_tags(F.col("inner")).alias("text")).where("text <> ''")
    parts = F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("## "), "block_id", F.lit("\n\n"), "text").alias("entry"))))
    return shown.groupBy("page_id").agg(F.array_join(F.transform(parts, lambda x: x["entry"]), "\n\n").alias("view"), F.count("*").alias("n_blocks"))


def link_candidates(pages: DataFrame, most: int = 200, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The page itself, then its links in scope in document order, each URL once: ``page_id, ord, id, url, title``."""
    found = F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(P.ANCHOR), 1).alias("href"), F.regexp_extract_all(F.col(html), F.lit(P.ANCHOR), 2).alias("inner")
    )
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("base"), F.col(html).alias("html"))
    first = base.select("page_id", F.lit(-1).alias("pos"), F.col("base").alias("url"), F.coalesce(H.title(F.col("html")), F.lit("当前页面")).alias("title"))
    links = base.select("page_id", "base", F.posexplode(found).alias("pos", "a")).select(
        "page_id", "base", "pos", U.resolve(F.col("base"), F.col("a.href")).alias("url"), X.visible_text(F.col("a.inner")).alias("text")
    )
    links = links.withColumn("a", U.parts(F.col("base"))).withColumn("b", U.parts(F.col("url"))).where(U.parts_in_scope(F.col("a"), F.col("b")))
    named = links.select("page_id", "pos", "url", F.when(F.col("text") == "", F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)).otherwise(F.col("text")).alias("title"))
    norm = U.without_fragment(F.col("url"))
    once = first.unionByName(named).withColumn("n", F.row_number().over(Window.partitionBy("page_id", norm).orderBy("pos"))).where("n = 1")
    ranked = once.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("ord") <= most)
    return ranked.select("page_id", "ord", F.format_string("candidate-%04d", "ord").alias("id"), "url", "title")


def split_pages(docs: DataFrame, n_pages: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Form-feed pages, cut or filled with empty ones to exactly ``n_pages``: ``doc_id, page, text``."""
    parts = F.split(F.col(text), "\f", -1)
    padded = docs.select(F.col(doc).alias("doc_id"), n_pages.cast("int").alias("n"), parts.alias("parts"))
    exact = F.slice(F.concat("parts", F.array_repeat(F.lit(""), F.greatest(F.col("n") - F.size("parts"), F.lit(0)))), F.lit(1), F.col("n"))
    return padded.select("doc_id", F.posexplode(exact).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page"), "text")


def info_value(text: Column, key: str) -> Column:
    """The first ``Key: value`` line of a key, whatever its case; null if none or blank."""
    pattern = rf"(?im)^\s*{key}\s*:[^\S\n]*(.*)$"
    return F.when(text.rlike(pattern), F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit("")))


def lines(pages: DataFrame, book: str, page: str, text: str = "text") -> DataFrame:
    """Trimmed lines that aren't blank: ``book, page, idx, total, line``."""
    kept = F.filter(F.transform(F.split(F.col(text), "\n", -1), X.collapse), lambda x: x != "")
    rows = pages.select(F.col(book).alias("book"), F.col(page).alias("page"), kept.alias("l"))
    return rows.select("book", "page", F.size("l").alias("total"), F.posexplode("l").alias("idx", "line"))


def repeated_edge_lines(pages: DataFrame, book: str, page: str, text: str = "text", longest: int = 40) -> DataFrame:
    """``book, line, n_pages, removable``: short first and last lines of pages; removable from 4/5 of the pages on."""
    kept = F.filter(F.transform(F.split(F.col(text), "\n", -1), X.collapse), lambda x: (x != "") & (F.char_length(x) <= longest))
    edges = pages.select(F.col(book).alias("book"), kept.alias("l"))
    ends = F.when(F.size("l") > 0, F.array_distinct(F.array(F.element_at("l", 1), F.element_at("l", -1)))).otherwise(F.array().cast("array<string>"))
    counted = edges.select("book", F.explode(ends).alias("line")).groupBy("book", "line").agg(F.count("*").alias("n_pages"))
    size = edges.groupBy("book").agg(F.count("*").alias("pages"))
    need = F.greatest(F.lit(1), F.floor((F.col("pages") * 4 + 4) / 5))
    return counted.join(size, "book").select("book", "line", "n_pages", (F.col("n_pages") >= need).alias("removable"))


def source_lines(pages: DataFrame, repeated: DataFrame, book: str, page: str, text: str = "text") -> DataFrame:
    """``book, page, line_id, line, removable``: page numbers at the edge of a page, and repeated lines, are removable."""
    edge = (F.col("idx") < 2) | (F.col("idx") + 2 >= F.col("total"))
    number = edge & F.col("line").rlike(P.PAGE_NUMBER)
    drop = repeated.where("removable").select("book", "line", F.lit(True).alias("again"))
    rows = lines(pages, book, page, text).join(drop, ["book", "line"], "left")
    return rows.select("book", "page", F.format_string("l%04d", F.col("idx") + 1).alias("line_id"), "line", (number | F.coalesce("again", F.lit(False))).alias("removable"))


def chapter_starts(pages: DataFrame, book: str, page: str, text: str = "text") -> DataFrame:
    """``book, page, title, ordinal``: the first chapter heading among the first 40 lines of each page, repeats of a title left out."""
    cand = lines(pages, book, page, text).where("idx < 40").where(F.char_length("line") <= 100).where(N.complete_heading(F.col("line")))
    cand = cand.where(F.col("line").rlike(P.HEADING_EN) | F.col("line").rlike(P.HEADING_ZH))
    first = cand.groupBy("book", "page").agg(F.min_by("line", "idx").alias("title")).withColumn("ordinal", N.chapter_ordinal(F.col("title"))).where("ordinal IS NOT NULL")
    before = F.lag("title").over(Window.partitionBy("book").orderBy("page"))
    return first.withColumn("before", before).where(~F.col("title").eqNullSafe(F.col("before"))).drop("before")


def chapter_ranges(starts: DataFrame, sizes: DataFrame, front: str = "前置内容") -> DataFrame:
    """``book, ord, title, first, last``: a chapter ends before the next one starts; pages before the first are front matter.

    ``starts`` has book, page, title; ``sizes`` has book, pages.
    """
    least = starts.groupBy("book").agg(F.min("page").alias("page")).where("page > 1").select("book", F.lit(1).cast("long").alias("page"), F.lit(front).alias("title"))
    by_page = Window.partitionBy("book").orderBy("page")
    rows = starts.select("book", F.col("page").cast("long").alias("page"), "title").unionByName(least).join(sizes, "book")
    return rows.select(
        "book", F.row_number().over(by_page).alias("ord"), "title", F.col("page").alias("first"), F.coalesce(F.lead("page").over(by_page) - 1, F.col("pages")).alias("last")
    )


def pages_in_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages (book, page) by the ranges (book, first, last) that hold them: ranges are unrolled, so that the join is an equi-join."""
    unrolled = ranges.where("last >= first").withColumn("page", F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long"))))
    return pages.withColumn("page", F.col("page").cast("long")).join(unrolled, ["book", "page"])


def chain_lengths(rows: DataFrame, book: str, at: str, ordinal: str) -> DataFrame:
    """``book, at, ordinal, next_at, length``: for each row the longest chain of ordinals that rise by one from there on.

    Of the rows with the next ordinal the nearest one behind is as good as any: whatever goes on from a later one goes on from it.
    So each row has one successor, found by a window over the rows of both ordinals, and lengths follow by doubling: a row
    takes the length of where it has got to, and where that has got to, in as many turns as the length has binary digits.
    Equal rows count once; rows of null ordinals or places are left out.
    """
    named = rows.select(F.col(book).alias("book"), F.col(at).alias("at"), F.col(ordinal).cast("long").alias("ordinal")).dropna(subset=["at", "ordinal"]).distinct()
    asks = named.select("book", "at", "ordinal", (F.col("ordinal") + 1).alias("wanted"), F.lit(0).alias("is"))
    both = asks.unionByName(named.select("book", "at", "ordinal", F.col("ordinal").alias("wanted"), F.lit(1).alias("is")))
    # In descending order the last answer so far is the nearest one behind; at an equal place the ask comes first, as only later ones count.
    behind = Window.partitionBy("book", "wanted").orderBy(F.desc("at"), "is").rowsBetween(Window.unboundedPreceding, -1)
    linked = both.withColumn("next_at", F.last(F.when(F.col("is") == 1, F.col("at")), ignorenulls=True).over(behind)).where("is = 0")
    state = Scratch(linked.select("book", "at", "ordinal", "next_at", F.lit(1).cast("long").alias("length"), F.col("next_at").alias("to_at"), (F.col("ordinal") + 1).alias("to")))
    while not state.df.where("to_at IS NOT NULL").isEmpty():
        s = state.df
        on = s.select(F.col("book").alias("b"), F.col("at").alias("a"), F.col("ordinal").alias("o"), F.col("length").alias("more"), F.col("to_at").alias("far_at"), F.col("to").alias("far"))
        joined = s.join(on, F.col("book").eqNullSafe(F.col("b")) & (F.col("to_at") == F.col("a")) & (F.col("to") == F.col("o")), "left")
        step = joined.select("book", "at", "ordinal", "next_at", (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), F.col("far_at").alias("to_at"), F.col("far").alias("to"))
        after = Scratch(step)
        state.drop()
        state = after
    return state.df.select("book", "at", "ordinal", "next_at", "length")


def longest_chain(rows: DataFrame, book: str, at: str, ordinal: str) -> DataFrame:
    """``book, length, start``: the longest run of ordinals that rise by one at rising places; later starts win ties."""
    best = F.max(F.struct("length", "at"))
    return chain_lengths(rows, book, at, ordinal).groupBy("book").agg(best.alias("r")).select("book", F.col("r.length").alias("length"), F.col("r.at").alias("start"))


def longest_chain_rows(rows: DataFrame, book: str, at: str, ordinal: str) -> DataFrame:
    """``book, at, ordinal``: the rows of the longest chain of each book.

    On the way from its first row lengths fall by one as ordinals rise by one, so only rows for which the two add up are looked at. Rows
    behind a marked one are marked by jumps of 1, 2, 4 ... rows, again in as many turns as the length has binary digits.
    """
    lengths = Scratch(chain_lengths(rows, book, at, ordinal)).df
    best = lengths.groupBy("book").agg(F.max(F.struct("length", "at", "ordinal")).alias("r")).select(F.col("book").alias("b"), "r.*")
    top = best.select("b", F.col("length").alias("whole"), F.col("at").alias("from_at"), F.col("ordinal").alias("from"))
    fits = (F.col("ordinal") - F.col("from") + F.col("length") == F.col("whole")) & (F.col("at") >= F.col("from_at"))
    first = (F.col("at") == F.col("from_at")) & (F.col("ordinal") == F.col("from"))
    near = lengths.join(top, F.col("book").eqNullSafe(F.col("b"))).where(fits)
    state = Scratch(near.select("book", "at", "ordinal", first.alias("on"), F.col("next_at").alias("to_at"), (F.col("ordinal") + 1).alias("to")))
    while not state.df.where("on AND to_at IS NOT NULL").isEmpty():
        s = state.df
        hits = s.where("on").select(F.col("book").alias("b"), F.col("to_at").alias("a"), F.col("to").alias("o"), F.lit(True).alias("hit"))
        far = s.select(F.col("book").alias("fb"), F.col("at").alias("fa"), F.col("ordinal").alias("fo"), F.col("to_at").alias("far_at"), F.col("to").alias("far"))
        marked = s.join(hits, F.col("book").eqNullSafe(F.col("b")) & (F.col("at") == F.col("a")) & (F.col("ordinal") == F.col("o")), "left")
        moved = marked.join(far, F.col("book").eqNullSafe(F.col("fb")) & (F.col("to_at") == F.col("fa")) & (F.col("to") == F.col("fo")), "left")
        after = Scratch(moved.select("book", "at", "ordinal", (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on"), F.col("far_at").alias("to_at"), F.col("far").alias("to")))
        state.drop()
        state = after
    return state.df.where("on").select("book", "at", "ordinal")


def page_profile(pages: DataFrame) -> DataFrame:
    """One row a page: titles, text length, language, links, images and blocks, and whether scripts make it up."""
    text = X.visible_text(F.col("html"))
    return pages.select("page_id", "html", text.alias("text")).select(
        "page_id", H.title(F.col("html")).alias("title"), H.meta_content(F.col("html"), "author").alias("author"), F.char_length("text").alias("n_chars"),
        X.language(F.col("text"))["language"].alias("language"), H.image_count(F.col("html")).alias("n_images"),
        F.size(H.block_tags(F.col("html"))).alias("n_blocks"), (H.has_scripts(F.col("html")) & (F.char_length("text") < 240)).alias("is_dynamic"),
    )
