"""Column expressions on plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; ``lower`` itself where the text is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _AZ, _AZ.lower()))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def decode_entities(c: Column) -> Column:
    """Seven entities in a fixed order, so that ``&amp;lt;`` ends as ``<``."""
    for entity, char in P.ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def escape_html(c: Column, apostrophe: str = "&#39;") -> Column:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)]:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def strip_tags(c: Column) -> Column:
    return collapse(decode_entities(F.regexp_replace(c, P.TAG, " ")))


def visible_text(c: Column) -> Column:
    """Text without scripts, styles, templates and tags."""
    return strip_tags(F.regexp_replace(c, P.ACTIVE_TEXT, " "))


def count_of(c: Column, char_class: str) -> Column:
    """Characters of a regex class."""
    return F.char_length(F.regexp_replace(c, f"[^{char_class}]", ""))


def language(c: Column) -> Column:
    """Struct (han, latin, language, confidence) from counts of Han characters and ASCII letters."""
    return classify_language(count_of(c, P.HAN), count_of(c, "A-Za-z"))


def classify_language(han: Column, latin: Column) -> Column:
    total = han + latin
    chinese = han * 100 >= total * 35
    name = F.when(total < 80, "mixed").when(chinese, "zh-CN").when(latin * 100 >= total * 75, "non-zh").otherwise("mixed")
    trust = (
        F.when(total < 80, "low").when(chinese & (han * 100 >= total * 60), "high").when(chinese, "medium")
        .when(latin * 100 >= total * 75, "high").otherwise("medium")
    )
    return F.struct(han.alias("han"), latin.alias("latin"), name.alias("language"), trust.alias("confidence"))


def meaningful_chars(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", ""))


def needs_chinese_translation(c: Column) -> Column:
    return ~c.rlike(f"[{P.HAN}]")


def slug(c: Column) -> Column:
    """Lower-cased ASCII letters and digits, runs of others as one dash, cut while it grows to 40 characters."""
    body = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-+", "")
    cut = F.regexp_replace(F.substring(F.lower(body), 1, 40), "^-+|-+$", "")
    return F.when(cut == "", "book").otherwise(cut)


def file_stem_title(path: Column, index: Column) -> Column:
    """A title from a file name; the n-th chapter where nothing is left."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    title = collapse(F.translate(stem, "-_", "  "))
    return F.when(title == "", F.concat(F.lit("第 "), index.cast("string"), F.lit(" 章"))).otherwise(title)


def extension(path: Column) -> Column:
    return lower_ascii(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def truncate(c: Column, n: int, suffix: str = "…") -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(suffix))).otherwise(c)


def tail_chars(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def natural_key(c: Column) -> Column:
    """A string whose byte order is natural order: digit runs by trimmed length, digits, then raw length."""
    runs = F.regexp_extract_all(lower_ascii(c), F.lit("([0-9]+|[^0-9]+)"), 1)

    def key(run: Column) -> Column:
        trimmed = F.regexp_replace(run, "^0+(?=[0-9])", "")
        number = F.concat(
            F.lit("0"), F.lpad(F.length(trimmed).cast("string"), 6, "0"), trimmed, F.lpad(F.length(run).cast("string"), 6, "0")
        )
        return F.when(run.rlike("^[0-9]"), number).otherwise(run)

    return F.array_join(F.transform(runs, key), "")


def contains_any(c: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def failure_class(c: Column) -> Column:
    """permanent, transient or unknown; the permanent list goes first."""
    detail = lower_ascii(c)
    return F.when(contains_any(detail, P.PERMANENT_FAILURES), "permanent").when(contains_any(detail, P.TRANSIENT_FAILURES), "transient").otherwise("unknown")


def provider_error_class(c: Column) -> Column:
    detail = F.lower(c)
    return (
        F.when(contains_any(detail, ["auth", "login", "认证"]), "authentication")
        .when(contains_any(detail, ["提前退出", "意外退出"]), "process-exited")
        .when(contains_any(detail, ["json-rpc", "stream-json"]), "transport")
        .otherwise("provider")
    )


def should_split(c: Column) -> Column:
    return contains_any(c, P.SPLIT_TRIGGERS)
