from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import numbers as N
from quire.functions import text as X
from quire.functions import url as U


def values(spark, f, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_text(spark):
    assert values(spark, X.visible_text, ["<p>a<script>x</script>b</p>&amp;lt;  c", "<style>p</style>　"]) == ["a b < c", ""]
    assert values(spark, X.slug, ["Ünï Code 12!", "--", "a" * 60, "A--b__C"]) == ["n-code-12", "book", "a" * 40, "a-b-c"]
    assert values(spark, X.needs_chinese_translation, ["abc", "中文", "㐀"]) == [True, False, False]
    assert values(spark, X.extension, ["a/B.HTML", "x", "a.b/c", ".hidden"]) == ["html", "", "", ""]
    assert values(spark, lambda c: X.file_stem_title(c, F.lit(3)), ["d/my-great_book.html", "d/-.html"]) == ["my great book", "第 3 章"]
    got = values(spark, lambda c: X.language(c), ["这是中文。" * 40, "Only English words here. " * 8, "short", "中a" * 60])
    assert [(r.language, r.confidence) for r in got] == [("zh-CN", "high"), ("non-zh", "high"), ("mixed", "low"), ("zh-CN", "medium")]
    assert values(spark, X.failure_class, ["HTTP Status Code: 503", "Please Login; timeout", "odd"]) == ["transient", "permanent", "unknown"]


def test_natural_order(spark):
    names = ["chapter10", "chapter2", "part01", "part1", "Part2", "a", "a1b"]
    df = spark.createDataFrame([(n,) for n in names], "x string").orderBy(X.natural_key(F.col("x")))
    assert [r.x for r in df.collect()] == ["a", "a1b", "chapter2", "chapter10", "part1", "part01", "Part2"]


def test_html(spark):
    pages = ["<title> </title><h1>H</h1>", "<h1>A &amp; B</h1><title>T</title>", "none"]
    assert values(spark, H.title, pages) == [None, "T", None] and values(spark, H.heading, pages) == ["H", "A & B", None]
    meta = ['<meta name="author" content="X &amp; Y">', "<meta content='Z' property='author'>", "<meta>"]
    assert values(spark, lambda c: H.meta_content(c, "author"), meta) == ["X & Y", "Z", None]
    bad = ["<SCRIPT>", "<p onclick=1>", "&lt;button onclick=1&gt;", '<a href="javascript:x">', '<img src="https://x">', "<img src='a.svg'>", '<meta http-equiv="refresh">', "<p>"]
    assert values(spark, H.violation, bad) == ["script", "inline-event", None, "javascript-url", "external-resource", "svg-reference", "meta-refresh", None]
    dirty = ['<p onclick="x">a</p><script>', "<style media=x>@import url(a);b{width:expression(1)}</style>t<style>c</style>", '<a href="https://e/x" id=1>k</a><form><b>']
    assert values(spark, H.sanitize, dirty) == ["<p>a</p>", "<style>b{width:}</style>t<style>c</style>", "<a id=1>k</a><b>"]
    assert values(spark, lambda c: H.mark_blocks(c, F.lit("c1")), ["<p>a</p><li x=1>b", "text"]) == [
        '<p data-block-id="c1-block-0001">a</p><li x=1 data-block-id="c1-block-0002">b', '<div data-block-id="c1-block-0001">text</div>',
    ]
    got = values(spark, H.protect, ["a <code>x</code> b<img src=y>"])[0]
    assert (got.text, got.fragments) == ("a {{GR0}} b{{GR1}}", ["<code>x</code>", "<img src=y>"])
    assert values(spark, H.css_violation, ["@IMPORT x", "a{b:expression(1)}", "url( 'http://x')", "p{}"]) == ["import", "executable", "external-resource", None]


def test_numbers(spark):
    assert values(spark, N.roman, ["MCMXCIV", "iv", "A", ""]) == [1994, 4, None, None]
    assert values(spark, N.chinese, ["二十三", "百", "零", "7"]) == [23, 100, None, 7]
    heads = ["Chapter IX: x", "chapter 12", "第十二章 题", "Chapter", "第 3 章"]
    assert values(spark, N.chapter_ordinal, heads) == [9, 12, 12, None, 3]
    assert values(spark, N.complete_heading, ["a (b)", "a (b", "【x】"]) == [True, False, True]
    assert values(spark, N.duration_label, [999, 61_000, 3_660_000], "long") == ["0秒", "1分1秒", "1小时1分钟"]
    assert values(spark, N.reader_duration, [0, 60_000, 61_500], "long") == ["1 秒", "1 分钟", "1 分 2 秒"]
    assert values(spark, N.retry_seconds, [0, 1, 3, 9], "int") == [5, 5, 30, 120]
    assert values(spark, N.compact_count, [9999, 12345], "long") == ["9,999", "1.2万"]
    assert values(spark, lambda c: N.setting_value(F.lit("sidebar-width"), c), ["10", "300.5", "x"]) == ["280", "301", None]
    assert values(spark, lambda c: N.parse_clamped(c, 5.0, 1.0, 9.0), [None, " ", "NaN", "20", "3"]) == [5.0, 5.0, 5.0, 9.0, 3.0]
    got = values(spark, lambda c: N.page_range(c, F.lit(9)), ["pages:2-9", "pages:3-2", "pages:1-10", "x"])
    assert [tuple(r) if r else None for r in got] == [(2, 9), None, None, None]


def test_urls(spark):
    urls = ["https://Example.com/a", "http://10.0.0.1/", "http://172.20.1.1", "http://u:p@x.com", "ftp://x.com", "http://localhost:3", "http://192.168.1.1", "http://8.8.8.8/"]
    assert values(spark, U.is_public, urls) == [True, False, False, False, False, False, False, True]
    base = F.lit("https://x.com/b/c.html?q")
    refs = ["d.html", "/b/e", "//x.com/b/f", "https://y.com/b/g", "?z", "/other"]
    full = values(spark, lambda c: U.resolve(base, c), refs)
    assert full == ["https://x.com/b/d.html", "https://x.com/b/e", "https://x.com/b/f", "https://y.com/b/g", "https://x.com/b/c.html?z", "https://x.com/other"]
    assert values(spark, lambda c: U.in_scope(base, c), full) == [True, True, True, False, True, False]
    assert values(spark, lambda c: U.in_scope(F.lit("http://x.com:80/a/"), c), ["http://x.com/a/b", "http://x.com:81/a/b"]) == [True, False]
