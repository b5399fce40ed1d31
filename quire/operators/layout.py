"""Page layouts over numbered source lines: the ledger that uses every line once, and the HTML made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X


def layout_errors(lines: DataFrame, layout: DataFrame, omitted: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, page, error``: the first rule that a page's layout breaks, or null.

    ``lines`` has doc, page, line_id, removable; ``layout`` doc, page, ord, kind, line_ids, crop;
    ``omitted`` doc, page, line_id; ``pages`` doc, page, width, height, has_image.
    """
    at = ["doc", "page"]
    used = layout.select(*at, F.explode("line_ids").alias("line_id"))
    known = lines.select(*at, "line_id", "removable")
    both = used.withColumn("how", F.lit("used")).unionByName(omitted.select(*at, "line_id").withColumn("how", F.lit("omitted")))
    counts = both.groupBy(*at, "line_id").agg(F.count("*").alias("n"), F.max(F.col("how") == "omitted").alias("left_out"))
    state = known.join(counts, [*at, "line_id"], "full_outer").groupBy(*at).agg(
        F.max(F.col("removable").isNull()).alias("unknown"), F.max(F.coalesce(F.col("n"), F.lit(0)) > 1).alias("twice"),
        F.max(F.col("n").isNull() & ~F.coalesce("removable", F.lit(False))).alias("missing"),
        F.max(F.coalesce("left_out", F.lit(False)) & ~F.coalesce("removable", F.lit(True))).alias("lost"),
    )
    crop = F.col("crop")
    outside = (crop["x"] < 0) | (crop["y"] < 0) | (crop["width"] < 1) | (crop["height"] < 1) | (crop["x"] + crop["width"] > F.col("width")) | (crop["y"] + crop["height"] > F.col("height"))
    kinds = layout.join(pages, at).groupBy(*at).agg(
        F.count("*").alias("blocks"), F.max(F.col("kind") == "figure").alias("figures"), F.max((F.col("kind") == "figure") & F.coalesce(outside, F.lit(True))).alias("bad_crop"),
        F.max((F.col("kind") != "figure") & crop.isNotNull()).alias("stray_crop"),
    )
    rows = pages.join(state, at, "left").join(kinds, at, "left")
    error = F.coalesce(
        F.when(F.coalesce("blocks", F.lit(0)) < 1, "no-blocks"), F.when(F.col("unknown"), "unknown-line"), F.when(F.col("twice"), "line-twice"),
        F.when(F.col("lost"), "omitted-line"), F.when(F.col("missing"), "missing-line"), F.when(F.col("bad_crop"), "crop"), F.when(F.col("stray_crop"), "stray-crop"),
        F.when(F.col("has_image") & ~F.coalesce("figures", F.lit(False)), "no-figure"),
    )
    return rows.select(*at, error.alias("error"))


def page_html(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """``doc, page, html``: blocks in order, each with its lines in the order that the layout names them."""
    at = ["doc", "page"]
    each = layout.select(*at, "ord", "kind", "level", "alt", F.posexplode_outer("line_ids").alias("pos", "line_id"))
    named = each.join(lines.select(*at, "line_id", "text"), [*at, "line_id"], "left")
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: X.escape_html(x["text"]))
    blocks = named.groupBy(*at, "ord", "kind", "level", "alt").agg(words.alias("words"))
    spaced = F.array_join("words", " ")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(2)))).cast("string")
    tag = lambda t, inner: F.concat(F.lit(f"<{t}>"), inner, F.lit(f"</{t}>"))
    html = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), spaced, F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "code", tag("pre", F.array_join("words", "\n")))
        .when(F.col("kind") == "list", tag("ul", F.array_join(F.transform("words", lambda w: F.concat(F.lit("<li>"), w, F.lit("</li>"))), "")))
        .when(F.col("kind") == "quote", tag("blockquote", spaced))
        .when(F.col("kind") == "figure", F.concat(F.lit('<figure><img alt="'), X.escape_html(F.coalesce("alt", F.lit(""))), F.lit('"></figure>')))
        .otherwise(tag("p", spaced))
    )
    done = blocks.select(*at, "ord", html.alias("html"))
    return done.groupBy(*at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "html"))), lambda x: x["html"]), "\n").alias("html"))


def apply_translations(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """``block_id, html``: the translation of a block, its fragments put back, else its own text.

    ``blocks`` has block_id, text, fragments; ``translations`` block_id, translated.
    """
    joined = blocks.join(translations, "block_id", "left")
    body = X.escape_html(F.coalesce("translated", "text"))
    numbered = F.transform("fragments", lambda f, i: F.struct(f.alias("f"), F.concat(F.lit("{{GR"), i.cast("string"), F.lit("}}")).alias("hole")))
    return joined.select("block_id", F.aggregate(numbered, body, lambda acc, x: F.replace(acc, x["hole"], x["f"])).alias("html"))


def citations(messages: DataFrame, blocks: DataFrame, text: str = "content") -> DataFrame:
    """References ``[chapter:<id>#<block>]`` in messages that name a block that is there."""
    pattern = F.lit(r"\[chapter:([^\]#]+)#([^\]]+)\]")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("c"), F.regexp_extract_all(text, pattern, 2).alias("b"))
    found = messages.select("id", F.posexplode(pairs).alias("pos", "x")).select("id", "pos", F.col("x.c").alias("chapter_id"), F.col("x.b").alias("block_id"))
    return found.join(blocks.select("chapter_id", "block_id").distinct(), ["chapter_id", "block_id"])
