"""Script texts against a parser that goes character by character, large scripts and chapters, and publishing."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quire.functions.arrays import sums_before
from quire.operators import chapters as C
from quire.sources import legacy, publish

ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", "`": "`"}


def parse(source, marker="translations"):
    found = re.search(re.escape(marker) + r"[^\[]*\[", source or "")
    if not found:
        return None
    i, out, n = found.end(), [], len(source)
    while i < n:
        ch = source[i]
        if ch == "]":
            return out
        if ch in ", \t\r\n":
            i += 1
        elif source.startswith("//", i):
            i = n if (end := source.find("\n", i)) < 0 else end
        elif source.startswith("/*", i):
            if (end := source.find("*/", i + 2)) < 0:
                return None
            i = end + 2
        elif ch == "`":
            i, text = i + 1, []
            while i < n and source[i] != "`":
                if source.startswith("${", i) or (source[i] == "\\" and source[i + 1 : i + 2] not in ESCAPED):
                    return None
                if source[i] == "\\":
                    text.append(ESCAPED[source[i + 1]])
                    i += 1
                else:
                    text.append(source[i])
                i += 1
            if i >= n:
                return None
            out.append("".join(text))
            i += 1
        else:
            return None
    return None


def texts(spark, sources):
    df = spark.createDataFrame(list(enumerate(sources)), "i int, s string")
    return [r.t for r in df.select("i", legacy.parallel_texts(F.col("s")).alias("t")).orderBy("i").collect()]


def test_scripts(spark):
    rng = random.Random(7)
    bits = ["`", "`", "`a b`", "`x`,", ",", " ", "\n", "\\n", "\\`", "\\\\", "\\q", "\\", "$", "${", "//", "/*", "*/", "*", "/", "]", "w", "é", "\t", "\x0b"]
    sources = ["x translations = [" + "".join(rng.choices(bits, k=rng.randrange(9))) + rng.choice(["]", "", "];"]) for _ in range(1500)]
    sources += [None, "", "translations", "translations [", "translations = []", "translations: ['a']", "/* translations */ [`a`]", "translations [`a /*/ b`, /*/ */ `c`]", "translations [//]\n`a`]"]
    got = texts(spark, sources)
    assert got == [parse(s) for s in sources] and sum(bool(t) for t in got) > 20


def test_large_script(spark):
    source = "translations = [" + ",\n".join(f"`text {i} \\n end` // c" for i in range(20_000)) + "\n]"
    began = time.time()
    assert texts(spark, [source, "translations = [`" + "long \\n " * 100_000 + "`]"]) == [parse(source), ["long \n " * 100_000]]
    assert time.time() - began < 400


def test_sums_before(spark):
    for n in (0, 1, 2, 3, 10, 101):
        (got,) = spark.range(1).select(sums_before(F.array(*[F.lit(i * 3 % 7) for i in range(n)]).cast("array<int>"))).first()
        assert got == [sum(j * 3 % 7 for j in range(i)) for i in range(n)]


def test_side_blocks_of_a_large_chapter(spark):
    html = "<p>a<li>b</p><li>c</li>" * 10_000 + "<blockquote>no</blockquote><blockquote class='epigraph'>yes<p>in</blockquote><p>open<li>"
    began = time.time()
    r = spark.createDataFrame([(html,)], "h string").select(C.side_blocks(F.col("h"), F.lit("c"), F.lit(5)).alias("b")).first().b
    assert r.n == 20_002 and time.time() - began < 400
    assert r.html.startswith('<p data-block-id="c-b0006">a<li>b</p><li data-block-id="c-b0007">c</li>')
    assert r.html.endswith("""<blockquote>no</blockquote><blockquote class='epigraph' data-block-id="c-b20006">yes<p>in</blockquote><p data-block-id="c-b20007">open<li>""")
    assert re.sub(r' data-block-id="[^"]*"', "", r.html) == html


def test_publish(spark, tmp_path):
    root = str(tmp_path / "shelf")
    rows = [(b, i, f"c{i}", None if i == 3 else f"text {i}\n# not a heading\r\nend") for b in ("a", "007", "bad", "../up") for i in range(1, 5)]
    chapters = spark.createDataFrame(rows, "book_id string, ord int, chapter_id string, text string")
    passed = spark.createDataFrame([("a",), ("007",), ("../up",), ("unknown",), ("a",)], "book_id string")
    assert publish.versions(spark, root) == []
    assert {tuple(r) for r in publish.publish(chapters, passed, root, "v1").collect()} == {("a", 4), ("007", 4)}
    assert publish.versions(spark, root) == ["v1"]
    assert not [f for f in tmp_path.rglob("*") if "bad" in str(f) or "up" in f.name or "staging" in str(f)]
    lines = {}
    for r in publish.published(spark, root, "v1").orderBy("n").collect():
        lines.setdefault(r.book_id, []).append(r.line)
    want = "\n".join(f"# {c}\n\n{t or ''}\n" for b, _, c, t in rows if b == "a").split("\n")
    assert lines == {"a": want, "007": want}
    with pytest.raises(FileExistsError):
        publish.publish(chapters, passed, root, "v1")
    with pytest.raises(ValueError):
        publish.publish(chapters, passed, root, "../v2")
    assert publish.publish(chapters, passed.limit(0), root, "v2").collect() == []
    (tmp_path / "shelf/v1/_PUBLISHED").unlink()
    with pytest.raises(ValueError):
        publish.published(spark, root, "v1")


def test_publish_no_book(spark, tmp_path):
    root = str(tmp_path / "shelf")
    chapters = spark.createDataFrame([("a", 1, "c1", "text")], "book_id string, ord int, chapter_id string, text string")
    assert publish.publish(chapters, spark.createDataFrame([], "book_id string"), root, "v1").collect() == []
    lines = publish.published(spark, root, "v1")
    assert lines.collect() == [] and lines.columns == ["book_id", "n", "line"]
