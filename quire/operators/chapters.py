"""Chapters made of pages, their texts for translation, their pictures and the older side-by-side sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import patterns as P
from quire.functions import text as X
from quire.functions import url as U
from quire.functions.arrays import bind, sums_before
from quire.operators import documents as D

TITLE_ID = "metadata-title"


def chapters(pages: DataFrame, chapter_id: Column, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id, html, error``: every page as a chapter; an error leaves no html."""
    made = pages.select(F.col(page_id).alias("page_id"), H.chapter(F.col(html), chapter_id).alias("c"))
    return made.select("page_id", F.when(F.col("c.error").isNull(), F.col("c.html")).alias("html"), "c.error")


def title_key(chapter_id: Column) -> Column:
    """The key under which a chapter's title is translated."""
    return F.concat(F.lit("metadata-chapter-title:"), chapter_id)


def translation_blocks(chapters: DataFrame) -> DataFrame:
    """``page_id, key, text``: what is to be translated. ``chapters`` has page_id, chapter_id, title, html.

    Titles count where they need it; a preformatted block gives its visible text, others keep holes for their fragments.
    """
    titles = chapters.where(X.needs_chinese_translation(F.col("title"))).select("page_id", title_key(F.col("chapter_id")).alias("key"), F.col("title").alias("text"))
    inner = F.col("inner")
    text = F.when(F.col("tag") == "pre", X.visible_text(inner)).otherwise(H.protect(inner)["text"])
    return titles.unionByName(D.block_texts(chapters).select("page_id", F.col("block_id").alias("key"), text.alias("text")))


def localized(pages: DataFrame, most: int = P.LOCAL_IMAGES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, html, n_local``: pictures in the page's scope get local names, numbered through the page; others become a note."""
    found = [F.regexp_extract_all(F.col(html), F.lit(P.IMAGE_SOURCE), k) for k in (1, 2, 3)]
    images = F.arrays_zip(*[x.alias(n) for x, n in zip(found, ("head", "source", "tail"), strict=True)])
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("base"), F.split(F.col(html), P.IMAGE_SOURCE, -1).alias("parts"), images.alias("images"))
    each = base.select("page_id", "base", F.posexplode("images").alias("pos", "i"))
    target = U.resolve(F.col("base"), F.col("i.source"))
    each = each.select("page_id", "pos", "i", U.parts(F.col("base")).alias("a"), U.parts(target).alias("b"), target.alias("target"))
    allowed = F.coalesce(F.col("target").rlike("^(?i)https?:") & U.parts_in_scope(F.col("a"), F.col("b")), F.lit(False))
    order = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("ok", allowed).withColumn("n", F.sum(F.col("ok").cast("int")).over(order))
    kind = F.lower(F.regexp_extract(F.regexp_replace("target", r"[?#].*$", ""), r"\.([^./]+)$", 1))
    name = F.concat(F.lit("../assets/image-"), F.lpad(F.col("n").cast("string"), 5, "0"), F.lit("."), F.when(kind.isin(*P.IMAGE_TYPES), kind).otherwise("jpg"))
    local = F.col("ok") & (F.col("n") <= most)
    said = F.when(local, F.concat(F.col("i.head"), name, F.col("i.tail"))).otherwise(P.MISSING_IMAGE)
    by = each.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("said"), F.count_if(local).alias("n_local"))
    joined = base.select("page_id", "parts").join(by, "page_id", "left")
    none = F.array().cast("array<struct<pos:int,said:string>>")
    text = F.array_join(F.zip_with("parts", F.coalesce("said", none), lambda a, b: F.concat(a, F.coalesce(b["said"], F.lit("")))), "")
    return joined.select("page_id", text.alias("html"), F.coalesce("n_local", F.lit(0)).alias("n_local"))


def image_issues(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """``page_id, source, present``: every picture of a chapter; data URLs are there, others if ``files`` (page_id, path) lists them."""
    found = chapters.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(P.IMAGE_SOURCE), 2)).alias("source"))
    listed = files.select("page_id", F.col("path").alias("source")).distinct().withColumn("listed", F.lit(True))
    joined = found.join(listed, ["page_id", "source"], "left")
    return joined.select("page_id", "source", (F.col("source").startswith("data:") | F.coalesce("listed", F.lit(False))).alias("present"))


def side_blocks(html: Column, chapter_id: Column, first: Column, list_items: bool = False) -> Column:
    """Struct (html, n): blocks of an older chapter, numbered from ``first`` + 1; what stands inside a block is none.

    With ``list_items`` only these are blocks. A quotation counts if it is an epigraph. Every tag is told by a letter, a
    small one where it opens; in the string of these letters a block is a small letter and all up to its capital.
    """
    tags = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(P.SIDE_TAG), k).alias(n) for k, n in enumerate(("all", "close", "tag", "attributes"))])
    letters = F.create_map(*[F.lit(x) for x in ("p", "p", "li", "l", "blockquote", "q")])

    def letter(t: Column) -> Column:
        name = X.lower_ascii(t["tag"])
        counts = (F.lit(not list_items) | (name == "li")) & ((name != "blockquote") | t["attributes"].rlike(P.SIDE_QUOTE))
        return F.when(t["close"] == "/", F.upper(F.element_at(letters, name))).when(counts, F.element_at(letters, name)).otherwise(".")

    def marked(ts: Column) -> Column:
        blocks = F.regexp_extract_all(F.array_join(F.transform(ts, letter), ""), F.lit("p[^P]*P?|l[^L]*L?|q[^Q]*Q?|."), 0)
        return bind(blocks, lambda bs: F.struct(numbered(ts, bs).alias("out"), F.size(F.filter(bs, lambda b: b.rlike("^[plq]"))).alias("n")))

    def numbered(ts: Column, blocks: Column) -> Column:
        opens = F.transform(blocks, lambda b: b.rlike("^[plq]").cast("int"))
        none = F.lit(None).cast("int")
        places = F.flatten(F.zip_with(blocks, bind(opens, sums_before), lambda b, k: F.concat(F.array(F.when(b.rlike("^[plq]"), k + 1)), F.array_repeat(none, F.char_length(b) - 1))))
        return F.zip_with(ts, places, lambda t, k: F.when(k.isNull(), t["all"]).otherwise(
            F.concat(F.lit("<"), t["tag"], t["attributes"], F.lit(' data-block-id="'), chapter_id, F.lit("-b"), F.format_string("%04d", first + k), F.lit('">'))
        ))

    parts = F.split(html, P.SIDE_TAG, -1)
    whole = lambda m: F.struct(F.array_join(F.zip_with(parts, m["out"], lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("html"), m["n"].alias("n"))
    return bind(bind(tags, marked), whole)


def side_sources(files: DataFrame, marker: str = "window.EN_TEXT") -> DataFrame:
    """``path, side, content``: chapters beside whose ``x.html`` an ``x.en.js`` with the marker lies. ``files`` has path, content."""
    html = files.where(X.extension(F.col("path")).isin("html", "htm")).select("path", F.regexp_replace("path", r"\.[^./]*$", ".en.js").alias("side"))
    return html.join(files.where(F.contains("content", F.lit(marker))).select(F.col("path").alias("side"), "content"), "side").select("path", "side", "content")


def paired_originals(blocks: DataFrame, originals: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """``chapter, block_id, original, error``: blocks and originals by position; a chapter whose numbers differ is an error as a whole.

    ``blocks`` has chapter, ord, block_id; ``originals`` chapter, texts.
    """
    ids = blocks.groupBy(chapter).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id"))), lambda x: x["block_id"]).alias("ids"))
    both = originals.join(ids, chapter)
    same = F.size("ids") == F.size("texts")
    zipped = F.when(same, F.zip_with("ids", "texts", lambda b, t: F.struct(b.alias("block_id"), t.alias("original"))))
    rows = both.select(chapter, F.when(~same, F.format_string("%d blocks, %d originals", F.size("ids"), F.size("texts"))).alias("error"), F.explode_outer(zipped).alias("z"))
    return rows.select(chapter, "z.block_id", "z.original", "error")


def paired_by_place(selected: DataFrame, listed: DataFrame, book: str, left: str, right: str) -> DataFrame:
    """The n-th selected chapter with the n-th listed one; the shorter side ends a book. Both have book, ord."""
    place = F.row_number().over(Window.partitionBy(book).orderBy("ord"))
    a, b = selected.select(book, left, place.alias("place")), listed.select(book, right, place.alias("place"))
    return a.join(b, [book, "place"])


def chapter_at(requests: DataFrame, chapters: DataFrame) -> DataFrame:
    """``requests`` (book, path) with the chapter at the normalised path, or an empty id."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"/\./|//+", "/"), r"[^/]+/\.\./", "")
    known = chapters.select("book", plain(F.col("path")).alias("_at"), "chapter_id")
    joined = requests.withColumn("_at", plain(F.col("path"))).join(known, ["book", "_at"], "left")
    return joined.select(*requests.columns, F.coalesce("chapter_id", F.lit("")).alias("chapter_id"))


def side_text(requests: DataFrame, sides: DataFrame) -> DataFrame:
    """The blocks of the parallel text of one chapter each: ``requests`` (book, chapter) meet ``sides`` (book, chapter, block_id, text)."""
    return requests.join(sides, ["book", "chapter"])


def report(chapters: DataFrame, images: DataFrame, originals: DataFrame, book: str = "book") -> DataFrame:
    """Quality of a book: ``n_chapters, n_blocks, n_images, n_originals, n_translated, errors, warning``.

    ``chapters`` has book, page_id, target, html; ``images`` page_id, present; ``originals`` page_id, n.
    """
    blocks = F.regexp_count("html", F.lit(r"""data-block-id\s*=\s*["'][^"']+["']"""))
    seen = images.groupBy("page_id").agg(F.count_if(F.col("present")).alias("i"), F.count_if(~F.col("present")).alias("gone"))
    one = chapters.select(book, "page_id", "target", blocks.alias("b")).join(seen, "page_id", "left").join(originals.groupBy("page_id").agg(F.sum("n").alias("o")), "page_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = one.groupBy(book).agg(F.count("*").alias("n_chapters"), total("b").alias("n_blocks"), total("i").alias("n_images"), total("o").alias("n_originals"), total("gone").alias("n_gone"), F.max("target").alias("target"))
    few = (F.col("n_originals") > 0) & (F.col("n_originals") < F.col("n_blocks"))
    return sums.select(
        book, "n_chapters", "n_blocks", "n_images", "n_originals", F.when(F.col("target") == "zh-CN", F.col("n_blocks")).otherwise(0).alias("n_translated"),
        (F.col("n_gone") + (F.col("n_blocks") == 0).cast("long")).alias("n_errors"), F.when(few, F.format_string("%d/%d", "n_originals", "n_blocks")).alias("warning"),
    )


def publishable(reports: DataFrame, invalid: DataFrame, book: str = "book") -> DataFrame:
    """Books that may go on the shelf: no failed check of the package (``invalid`` has book) and no error in their report."""
    return reports.where("n_errors = 0").join(invalid.select(book).distinct(), book, "left_anti")


def pages_to_read(pages: DataFrame, images: DataFrame, doc: str = "doc", least: int = 20) -> DataFrame:
    """``doc, page``: pages of a paged text with hardly any letters that hold a picture, so that characters must be recognised."""
    sparse = pages.where(X.meaningful_chars(F.col("text")) < least).select(doc, "page")
    return sparse.join(images.select(doc, "page").distinct(), [doc, "page"], "left_semi")


def paged_kind(pages: DataFrame, images: DataFrame, mode: Column, doc: str = "doc") -> DataFrame:
    """``doc, kind, to_read, uncertain``: digital, mixed or scanned, and the pages that need recognition or attention.

    ``mode`` (auto, text or read) overrides what is read; ``pages`` carries the columns that it names, one value a document.
    """
    sparse = pages_to_read(pages, images, doc).withColumn("sparse", F.lit(True))
    joined = pages.withColumn("mode", mode).join(sparse, [doc, "page"], "left")
    found = F.array_sort(F.collect_list(F.when(F.col("sparse"), F.col("page"))))
    by = joined.groupBy(doc).agg(F.count("*").alias("n"), F.max("mode").alias("mode"), found.alias("found"), F.array_sort(F.collect_list("page")).alias("pages"))
    kind = F.when(F.size("found") == 0, "digital").when(F.size("found") == F.col("n"), "scanned").otherwise("mixed")
    none = F.array().cast("array<int>")
    to_read = F.when(F.col("mode") == "auto", F.col("found")).when(F.col("mode") == "read", F.col("pages")).otherwise(none)
    return by.select(doc, kind.alias("kind"), to_read.alias("to_read"), F.when(F.col("mode") == "text", F.col("found")).otherwise(none).alias("uncertain"))
