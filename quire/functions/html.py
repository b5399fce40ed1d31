"""Column expressions on HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as X


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _first(html: Column, pattern: str) -> Column:
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def title(html: Column) -> Column:
    """The first title tag, else the first h1; null if the one that is there has no text."""
    return _blank_to_null(X.visible_text(F.coalesce(_first(html, P.TITLE), _first(html, P.H1))))


def heading(html: Column) -> Column:
    """The first h1, else the first title tag; null if the one that is there has no text."""
    return _blank_to_null(X.strip_tags(F.coalesce(_first(html, P.H1), _first(html, P.TITLE))))


def meta_content(html: Column, name: str) -> Column:
    """Content of a meta tag by name or property, in either order of its attributes."""
    quoted = "".join("\\" + ch if not ch.isalnum() else ch for ch in name)
    key = rf"""(?:name|property)\s*=\s*["']{quoted}["']"""
    forward, reverse = P.META_FORWARD.replace("{key}", key), P.META_REVERSE.replace("{key}", key)
    return F.trim(X.decode_entities(F.coalesce(_first(html, forward), _first(html, reverse))))


def main_html(html: Column) -> Column:
    body = F.coalesce(_first(html, P.BODY), html)
    return F.regexp_replace(body, P.NOT_MAIN, "")


def clean_css(css: Column) -> Column:
    css = F.regexp_replace(css, P.CSS_IMPORT, "")
    css = F.regexp_replace(css, P.CSS_EXTERNAL_URL, 'url("")')
    css = F.regexp_replace(css, P.CSS_EXPRESSION, "")
    return F.replace(css, F.lit("javascript:"), F.lit(""))


def sanitize(html: Column) -> Column:
    """HTML without active content; style blocks are cleaned one by one."""
    for pattern in (
        P.SCRIPT, P.STRAY_SCRIPT, P.ACTIVE_ELEMENT, P.ACTIVE_TAG, P.FORM_TAG, P.BASE_TAG, P.META_REFRESH_TAG, P.EXTERNAL_LINK_TAG,
        P.EVENT_ATTRIBUTE, P.UNSAFE_URL_ATTRIBUTE, P.UNSAFE_STYLE_ATTRIBUTE, P.OWN_ATTRIBUTE,
    ):
        html = F.regexp_replace(html, pattern, "")
    parts = F.split(html, P.STYLE_BLOCK, -1)
    blocks = F.transform(F.regexp_extract_all(html, F.lit(P.STYLE_BLOCK), 1), lambda c: F.concat(F.lit("<style>"), clean_css(c), F.lit("</style>")))
    return F.array_join(F.zip_with(parts, blocks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def violation(html: Column) -> Column:
    """The first rule that passive HTML breaks, or null."""
    low = X.lower_ascii(html)
    rules = [F.when(F.contains(low, F.lit(tag)), code) for tag, code in P.FORBIDDEN_TAGS]
    rules += [
        F.when(html.rlike(P.INLINE_EVENT), "inline-event"), F.when(html.rlike(P.SCRIPT_URL), "javascript-url"),
        F.when(html.rlike(P.META_REFRESH), "meta-refresh"), F.when(html.rlike(P.EXTERNAL_RESOURCE), "external-resource"),
        F.when(F.contains(low, F.lit('.svg"')) | F.contains(low, F.lit(".svg'")), "svg-reference"),
    ]
    return F.coalesce(*rules)


def css_violation(css: Column) -> Column:
    low = X.lower_ascii(css)
    return F.coalesce(
        F.when(F.contains(low, F.lit("@import")), "import"),
        F.when(F.contains(low, F.lit("expression(")) | F.contains(low, F.lit("javascript:")), "executable"),
        F.when(css.rlike(r"""(?i)url\(\s*["']?\s*(?:https?:|//)"""), "external-resource"),
    )


def has_scripts(html: Column) -> Column:
    return F.contains(X.lower_ascii(html), F.lit("<script"))


def is_dynamic(html: Column, least: int = 240) -> Column:
    """A script is there, and hardly any visible text."""
    return has_scripts(html) & (F.char_length(X.visible_text(html)) < least)


def image_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(P.IMAGE))


def block_tags(html: Column) -> Column:
    """Tags of block openings in document order."""
    return F.regexp_extract_all(html, F.lit(P.BLOCK_OPEN), 1)


def mark_blocks(fragment: Column, chapter_id: Column) -> Column:
    """Every block opening gets its number in the chapter; without any, all becomes one block."""
    parts = F.split(fragment, P.BLOCK_OPEN, -1)
    tags, attributes = (F.regexp_extract_all(fragment, F.lit(P.BLOCK_OPEN), k) for k in (1, 2))
    block = lambda n: F.concat(F.lit(' data-block-id="'), chapter_id, F.format_string("-block-%04d", n), F.lit('"'))
    opened = F.transform(
        F.arrays_zip(tags.alias("t"), attributes.alias("a")),
        lambda x, i: F.concat(F.lit("<"), x["t"], F.coalesce(x["a"], F.lit("")), block(i + 1), F.lit(">")),
    )
    marked = F.array_join(F.zip_with(parts, opened, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    alone = F.concat(F.lit("<div"), block(F.lit(1)), F.lit(">"), fragment, F.lit("</div>"))
    return F.when(F.size(tags) > 0, marked).otherwise(alone)


def protect(inner: Column, pattern: str = P.PROTECTED) -> Column:
    """Struct (text, fragments): protected fragments become ``{{GRn}}`` in the visible text."""
    parts = F.split(inner, pattern, -1)
    holes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i < F.size(parts), F.concat(F.lit("{{GR"), (i - 1).cast("string"), F.lit("}}"))).otherwise(F.lit("")))
    text = X.visible_text(F.array_join(F.zip_with(parts, holes, lambda a, b: F.concat(a, b)), ""))
    return F.struct(text.alias("text"), F.regexp_extract_all(inner, F.lit(pattern), 0).alias("fragments"))


def element(html: Column, opening: str, closing: str) -> Column:
    """Struct (before, opening, inner, after) around the first element; ``after`` starts at the closing tag and is null without one."""
    tag = F.regexp_extract(html, opening, 0)
    at = F.instr(html, tag)
    tail = F.substr(html, at + F.char_length(tag))
    close = F.regexp_extract(tail, closing, 0)
    end = F.when(close != "", F.instr(tail, close))
    return F.struct(
        F.left(html, at - 1).alias("before"), tag.alias("opening"), F.left(tail, end - 1).alias("inner"), F.substr(tail, end).alias("after")
    )


def content_tag(opening: Column, chapter_id: Column) -> Column:
    """An opening tag that is marked as the content of a chapter."""
    return F.concat(F.regexp_replace(opening, r">[^>]*$", ""), F.lit(' data-content data-chapter-id="'), chapter_id, F.lit('">'))


def chapter(html: Column, chapter_id: Column) -> Column:
    """Struct (html, error): the chapter made of a page. Content is the main element, else the body, else all of it."""
    whole = content_tag(F.lit("<main>"), chapter_id)
    main, body = element(html, P.MAIN_OPEN, P.MAIN_CLOSE), element(html, P.BODY_OPEN, P.BODY_CLOSE)
    in_main = F.concat(main["before"], content_tag(main["opening"], chapter_id), mark_blocks(main["inner"], chapter_id), main["after"])
    in_body = F.concat(body["before"], body["opening"], whole, mark_blocks(body["inner"], chapter_id), F.lit("</main>"), body["after"])
    alone = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"></head><body>'), whole, mark_blocks(html, chapter_id), F.lit("</main></body></html>"))
    has_main, has_body = html.rlike(P.MAIN_OPEN), html.rlike(P.BODY_OPEN)
    return F.struct(
        F.when(has_main, in_main).when(has_body, in_body).otherwise(alone).alias("html"),
        F.when(has_main, F.when(main["after"].isNull(), "unclosed-main")).when(has_body & body["after"].isNull(), "unclosed-body").alias("error"),
    )


def replace_element(html: Column, tag: str, original: Column, translated: Column, unmarked: bool = False) -> Column:
    """The first plain element of this tag and text says the translation instead; with ``unmarked`` a block of a chapter stays."""
    return _said_again(html, rf"(?is)(<{tag}\b[^>]*>\s*)", original, translated, rf"(\s*</{tag}\s*>)", unmarked)


def replace_anchor(html: Column, path: Column, original: Column, translated: Column) -> Column:
    """The same for the text of the first link to ``path``."""
    opening = F.concat(F.lit(r"""(?is)(<a\b[^>]*\bhref\s*=\s*["']"""), _quoted(path), F.lit(r"""["'][^>]*>\s*)"""))
    return _said_again(html, opening, original, translated, r"(\s*</a\s*>)", False)


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N}_\s])", r"\\$1")


def _said_again(html: Column, opening: str | Column, original: Column, translated: Column, closing: str, unmarked: bool) -> Column:
    opening = F.lit(opening) if isinstance(opening, str) else opening
    pattern = F.concat(opening, _quoted(X.escape_html(original)), F.lit(closing))
    found = F.regexp_extract_all(html, pattern, 0)
    first = F.get(found, F.lit(0))
    at = F.instr(html, first)
    head, tail = (F.get(F.regexp_extract_all(html, pattern, k), F.lit(0)) for k in (1, 2))
    new = F.concat(F.left(html, at - 1), head, X.escape_html(translated), tail, F.substr(html, at + F.char_length(first)))
    stays = (F.size(found) == 0) | (original == translated)
    if unmarked:
        stays = stays | F.contains(X.lower_ascii(head), F.lit("data-block-id"))
    return F.when(stays, html).otherwise(new)
