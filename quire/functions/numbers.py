"""Column expressions on numbers, durations and ordinals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def duration_label(ms: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds; truncating."""
    s = _div(ms, 1000)
    m, h = _div(s, 60), _div(s, 3600)
    return F.when(h > 0, _join(h, "小时", m % 60, "分钟")).when(m > 0, _join(m, "分", s % 60, "秒")).otherwise(_join(s, "秒"))


def shelf_duration(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5))
    h, m = _div(s, 3600), _div(s % 3600, 60)
    return F.when(h > 0, _join(h, "小时", m, "分")).when(m > 0, _join(m, "分", s % 60, "秒")).otherwise(_join(s % 60, "秒"))


def reader_duration(ms: Column) -> Column:
    s = F.greatest(F.lit(1), F.floor(ms / 1000 + 0.5))
    m, r = _div(s, 60), s % 60
    return F.when(s < 60, _join(s, " 秒")).when(r > 0, _join(m, " 分 ", r, " 秒")).otherwise(_join(m, " 分钟"))


def eta_ms(done: Column, total: Column, elapsed: Column) -> Column:
    """Null at the edges; else elapsed * remaining / done, truncating."""
    return F.when((done > 0) & (done < total) & (elapsed > 0), F.floor(elapsed * (total - done) / done).cast("long"))


def stage_progress(done: Column, total: Column, base: int = 56, span: int = 27, top: int = 83) -> Column:
    return F.least(F.lit(base) + F.floor(done * span / F.greatest(total, F.lit(1))), F.lit(top)).cast("int")


def retry_seconds(attempt: Column) -> Column:
    table = F.array(*[F.lit(x) for x in P.RETRY_SECONDS])
    return F.element_at(table, F.greatest(F.lit(1), F.least(attempt, F.lit(len(P.RETRY_SECONDS)))).cast("int"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def setting_value(key: Column, value: Column) -> Column:
    """A numeric setting clamped to its range and rounded; null where the value isn't a number; others as they are."""
    out = value
    for name, (low, high) in P.SETTING_RANGES.items():
        number = value.try_cast("double")
        rounded = F.floor(clamp(number, low, high) + 0.5).cast("long").cast("string")
        out = F.when(key == name, F.when(number.isNotNull(), rounded)).otherwise(out)
    return out


def parse_clamped(value: Column, fallback: float, low: float, high: float) -> Column:
    """The fallback for null, blank or non-finite values, else the value clamped; not rounded."""
    number = F.trim(value).try_cast("double")
    good = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(good, clamp(number, low, high)).otherwise(F.lit(fallback))


def card_percent(progress: Column) -> Column:
    """0 without progress, else at least 1 of 100."""
    return F.when(progress.isNull(), 0).otherwise(F.greatest(F.lit(1), F.floor(clamp(progress, 0.0, 1.0) * 100 + 0.5))).cast("int")


def compact_count(n: Column) -> Column:
    return F.when(n >= 10_000, F.concat(F.format_string("%.1f", n / 10_000), F.lit("万"))).otherwise(F.format_number(n, 0))


def page_list(pages: Column) -> Column:
    """Up to 18 page numbers, then how many there are."""
    shown = F.array_join(F.transform(F.slice(pages, 1, 18), lambda p: p.cast("string")), "、")
    return F.when(F.size(pages) <= 18, shown).otherwise(_join(shown, " 等 ", F.size(pages), " 页"))


def roman(c: Column) -> Column:
    """Roman numeral, subtracting from right to left; null for other letters or a result that isn't positive."""
    values = F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv])
    digits = F.transform(F.reverse(F.split(F.upper(c), "")), lambda ch: F.element_at(values, ch))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))

    def step(acc: Column, v: Column) -> Column:
        total = F.when(v < acc["last"], acc["total"] - v).otherwise(acc["total"] + v)
        return F.struct(F.when(acc["total"] >= 0, total).alias("total"), F.greatest(acc["last"], v).alias("last"))

    total = F.aggregate(digits, start, step)["total"]
    return F.when(c.rlike("(?i)^[IVXLCDM]+$") & (total > 0), total)


def chinese(c: Column) -> Column:
    """Plain digits, or tens and hundreds in Chinese; null otherwise."""
    digits = F.create_map(*[F.lit(x) for i, ch in enumerate("一二三四五六七八九") for x in (ch, i + 1)])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("pending"))

    def step(acc: Column, ch: Column) -> Column:
        unit = F.when(ch == "百", 100).when(ch == "十", 10)
        total = F.when(unit.isNotNull(), acc["total"] + F.greatest(acc["pending"], F.lit(1)) * unit).otherwise(acc["total"])
        return F.struct(total.alias("total"), F.when(unit.isNotNull(), 0).otherwise(F.element_at(digits, ch)).alias("pending"))

    total = F.aggregate(F.split(c, ""), start, step, lambda acc: acc["total"] + acc["pending"])
    plain = F.when(c.rlike("^[0-9]{1,9}$"), c).try_cast("int")
    return F.coalesce(plain, F.when(c.rlike("^[一二三四五六七八九十百]+$") & (total > 0), total))


def chapter_ordinal(heading: Column) -> Column:
    """The number of a chapter heading in English (digits or Roman) or Chinese."""
    token = F.regexp_extract(heading, P.HEADING_EN, 1)
    english = F.coalesce(F.when(token.rlike("^[0-9]{1,9}$"), token).try_cast("int"), roman(token))
    return F.when(heading.rlike(P.HEADING_EN), english).when(heading.rlike(P.HEADING_ZH), chinese(F.regexp_extract(heading, P.HEADING_ZH, 1)))


def complete_heading(c: Column) -> Column:
    """Brackets of four kinds come in equal numbers."""
    ok = F.lit(True)
    for a, b in ("()", "（）", "[]", "【】"):
        n = lambda ch: F.char_length(c) - F.char_length(F.replace(c, F.lit(ch), F.lit("")))
        ok = ok & (n(a) == n(b))
    return ok


def page_range(source: Column, n_pages: Column) -> Column:
    """Struct (first, last) of ``pages:a-b``; null unless 1 <= a <= b <= n."""
    first = F.regexp_extract(source, r"^pages:([0-9]{1,9})-([0-9]{1,9})$", 1).try_cast("int")
    last = F.regexp_extract(source, r"^pages:([0-9]{1,9})-([0-9]{1,9})$", 2).try_cast("int")
    return F.when((first >= 1) & (first <= last) & (last <= n_pages), F.struct(first.alias("first"), last.alias("last")))
