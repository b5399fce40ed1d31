"""Book packages: manifests, files and entries, checked by rule columns. The first rule that fails names the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import patterns as P
from quire.functions import text as X


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def safe_path(path: Column) -> Column:
    """A relative path that stays inside its folder."""
    return ~(path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike(r"\\|^[A-Za-z]:|\x00") | _blank(path))


def manifest_error(manifest: DataFrame, key: str = "id") -> DataFrame:
    """``key, error``: null for a manifest that keeps the contract."""
    c = F.col
    ids = F.transform("chapters", lambda x: x["id"])
    error = F.coalesce(
        F.when(~F.coalesce(c("schema_version") == 1, F.lit(False)), "schema-version"), F.when(~F.coalesce(c("id").rlike(P.UUID), F.lit(False)), "id"),
        F.when(_blank(c("title")), "title"), F.when(_blank(c("author")), "author"), F.when(~F.coalesce(c("language").rlike(P.LANGUAGE), F.lit(False)), "language"),
        F.when(F.coalesce(F.size("chapters"), F.lit(0)) < 1, "no-chapters"), F.when(F.exists(ids, lambda i: ~F.coalesce(i.rlike(P.SAFE_ID), F.lit(False))), "chapter-id"),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "chapter-twice"), F.when(F.exists("chapters", lambda x: ~safe_path(x["path"])), "chapter-path"),
        F.when(~safe_path(c("cover")) | ~safe_path(c("entry")), "path"),
    )
    return manifest.select(key, error.alias("error"))


def repeated_blocks(chapters: DataFrame) -> DataFrame:
    """Block ids that more than one chapter of a book has: ``book_id, block_id``."""
    found = chapters.select("book_id", "chapter_id", F.explode(F.regexp_extract_all("html", F.lit(r"""data-block-id\s*=\s*["']([^"']+)["']"""), 1)).alias("block_id"))
    return found.distinct().groupBy("book_id", "block_id").agg(F.count("*").alias("n")).where("n > 1").select("book_id", "block_id")


def chapter_errors(chapters: DataFrame) -> DataFrame:
    """``book_id, chapter_id, error``: passive HTML and at least one block."""
    blocks = F.regexp_count("html", F.lit(r"data-block-id\s*="))
    return chapters.select("book_id", "chapter_id", F.coalesce(H.violation(F.col("html")), F.when(blocks == 0, "no-blocks")).alias("error"))


def orphan_parallel(parallel: DataFrame, chapters: DataFrame) -> DataFrame:
    """Side texts whose block isn't in their chapter."""
    blocks = chapters.select("book_id", "chapter_id", F.explode(F.regexp_extract_all("html", F.lit(r"""data-block-id\s*=\s*["']([^"']+)["']"""), 1)).alias("block_id"))
    return parallel.join(blocks.distinct(), ["book_id", "chapter_id", "block_id"], "left_anti")


def file_errors(files: DataFrame, most: int = 64 << 20) -> DataFrame:
    """``path, error`` of the files of a package."""
    return files.select("path", F.when(F.col("size") > most, "size").when(~X.extension(F.col("path")).isin(*P.ALLOWED), "type").alias("error"))


def entry_of(files: DataFrame) -> DataFrame:
    """The entry page of each book: an index page of least depth, else the first page in natural order."""
    html = files.where(X.extension(F.col("path")).isin("html", "htm"))
    order = F.struct(
        (~F.lower("path").rlike(r"(^|/)index\.html?$")).alias("other"),
        F.when(F.lower("path").rlike(r"(^|/)index\.html?$"), F.size(F.split("path", "/"))).otherwise(0).alias("depth"), X.natural_key(F.col("path")).alias("key"),
    )
    return html.groupBy("book_id").agg(F.min_by("path", order).alias("entry"))


def chapters_of(files: DataFrame) -> DataFrame:
    """``book_id, path, ord, chapter_id``: pages below a chapter or content folder if there are any, else all but the entry."""
    html = files.where(X.extension(F.col("path")).isin("html", "htm")).join(entry_of(files), "book_id")
    inside = F.lower("path").rlike(r"(^|/)(chapters?|contents?)/")
    marked = html.withColumn("inside", inside).withColumn("any", F.max("inside").over(Window.partitionBy("book_id")))
    alone = F.count("*").over(Window.partitionBy("book_id")) == 1
    kept = marked.withColumn("alone", alone).where(F.when(F.col("any"), F.col("inside")).otherwise((F.col("path") != F.col("entry")) | F.col("alone")))
    ord_ = F.row_number().over(Window.partitionBy("book_id").orderBy(X.natural_key(F.col("path")), "path"))
    return kept.select("book_id", "path", ord_.alias("ord")).withColumn("chapter_id", F.format_string("chapter-%04d", "ord"))


def cover_of(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The cover of each book: the file whose name comes first in the list."""
    listed = F.array(*[F.lit(n) for n in names or P.COVERS])
    place = F.array_position(listed, F.lower(F.regexp_extract("path", r"([^/]*)$", 1)))
    return files.withColumn("_p", place).where("_p > 0").groupBy("book_id").agg(F.min_by("path", F.struct("_p", "path")).alias("cover"))


def image_format(data: Column) -> Column:
    """jpeg, png, gif or webp by its first bytes; null for others."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif").when(head.rlike("^52494646.{8}57454250"), "webp")
    )


def png_size(data: Column) -> Column:
    """Struct (width, height) from the header; null for what isn't a PNG."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    return F.when((image_format(data) == "png") & (F.octet_length(data) >= 24), F.struct(number(17).alias("width"), number(21).alias("height")))


def content_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in P.CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, X.extension(path)), F.lit("application/octet-stream"))


def request_error(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Why a build request is refused: ``id, error``. ``candidates`` has token, source; requests name a token."""
    asked = requests.select("id", "token", F.explode_outer("sources").alias("source"))
    unknown = asked.where("source IS NOT NULL").join(candidates.select("token", "source").distinct(), ["token", "source"], "left_anti").select("id").distinct().withColumn("unknown", F.lit(True))
    rule = F.coalesce(
        F.when(_blank(F.col("title")) | (F.char_length("title") > 240), "title"), F.when(F.coalesce(F.size("sources"), F.lit(0)) < 1, "no-chapters"),
        F.when(F.col("unknown"), "unknown-chapter"), F.when(F.col("preserve") & ~F.col("translate"), "preserve-needs-translate"),
        F.when((F.col("kind") == "pdf") & F.col("translate"), "pdf-translate"),
    )
    return requests.join(unknown, "id", "left").select("id", rule.alias("error"))


def conversion_warnings(stats: DataFrame, book: str, counters: dict[str, str]) -> DataFrame:
    """``book, warnings``: texts of the counters above 0, in the order given."""
    sums = stats.groupBy(F.col(book).alias("book")).agg(*[F.sum(c).alias(c) for c in counters])
    said = [F.when(F.col(c) > 0, F.format_string(t, F.col(c))) for c, t in counters.items()]
    return sums.select("book", F.filter(F.array(*said), lambda x: x.isNotNull()).alias("warnings"))


def index_page(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """``book, html``: a page of ordered links to the chapters (ord, title, path)."""
    item = F.concat(F.lit('<li><a href="'), X.escape_html(F.col("path")), F.lit('">'), X.escape_html(F.col("title")), F.lit("</a></li>"))
    links = F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"])
    return chapters.groupBy(F.col(book).alias("book")).agg(F.concat(F.lit("<ol>"), F.array_join(links, ""), F.lit("</ol>")).alias("html"))


def manifest_languages(source: Column) -> Column:
    return F.when(source == "zh-CN", "zh-CN").when(source == "mixed", "mul").otherwise("und")
