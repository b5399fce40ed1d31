from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import agents as A
from quire.operators import documents as D
from quire.operators import layout as Y
from quire.operators import ledger as L
from quire.operators import packages as K
from quire.operators import state as S
from quire.sources import files, legacy, snapshots


def test_repeated_lines(spark):
    def found(pages):
        df = spark.createDataFrame([("b", i, t) for i, t in enumerate(pages)], "book string, page int, text string")
        return {r.line for r in D.repeated_edge_lines(df, "book", "page").collect() if r.removable}

    assert found(["x" * 50 + f"\nend {i}" for i in range(3)]) == set()
    assert found([f"start {i}\nsame\nend {i}" for i in range(3)]) == set()
    assert found([f"Head\nbody {i}" for i in range(10)]) == {"Head"}
    assert found(["Head\na", "x\nb", "y\nc"]) == set()


def test_chapters(spark):
    pages = ["cover", "Chapter 1 (a)\nx", "Chapter 1 (a)", "y\nCHAPTER II", "Chapter 3 (open", "Chapter III\nz"]
    df = spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(pages)], "book string, page int, text string")
    starts = D.chapter_starts(df, "book", "page")
    assert [(r.page, r.ordinal) for r in starts.orderBy("page").collect()] == [(2, 1), (4, 2), (6, 3)]
    ranges = D.chapter_ranges(starts, spark.createDataFrame([("b", 6)], "book string, pages int"))
    assert [(r.first, r.last) for r in ranges.orderBy("ord").collect()] == [(1, 1), (2, 3), (4, 5), (6, 6)]
    assert D.pages_in_ranges(df.select("book", "page"), ranges).count() == 6


def test_longest_chain(spark):
    rows = [(1, i, o) for i, o in enumerate([5, 1, 2, 9, 3, 6, 7, 8])]
    got = D.longest_chain(spark.createDataFrame(rows, "book long, at long, o long"), "book", "at", "o").first()
    assert (got.length, got.start) == (4, 0)


def test_pages_and_info(spark):
    df = spark.createDataFrame([(1, "a\fb\f"), (2, "")], "doc_id int, text string")
    got = {(r.doc_id, r.page): r.text for r in D.split_pages(df, F.lit(3)).collect()}
    assert got == {(1, 1): "a", (1, 2): "b", (1, 3): "", (2, 1): "", (2, 2): "", (2, 3): ""}
    info = spark.createDataFrame([("Title: x y\nPages:  12\nAuthor:\n",)], "t string")
    assert tuple(info.select(D.info_value(F.col("t"), "pages"), D.info_value(F.col("t"), "Author"), D.info_value(F.col("t"), "None")).first()) == ("12", None, None)


def test_batches(spark):
    df = spark.createDataFrame([("b", f"{i:05d}", 100) for i in range(4576)] + [("b", "99999", 20_000)], "book string, id string, n int")
    got = L.batches(df, "book", "id", F.col("n")).groupBy("batch").agg(F.count("*").alias("k"), F.sum("chars").alias("n")).collect()
    assert len(got) >= 50 and all(r.k <= 80 and (r.n <= 12_000 or r.k == 1) for r in got) and sum(r.k for r in got) == 4577


def test_annotations(spark):
    rows = [("a", 1, 0, 4), ("b", 1, 2, 6), ("c", 1, 4, 8), ("d", 1, 7, 9)]
    df = spark.createDataFrame(rows, "id string, blk int, s int, e int")
    assert {r.id for r in S.admit(df, ["blk"], "id", "s", "e").collect()} == {"a", "c"}
    assert {r.id for r in S.overlapping(df, ["blk"], "id", "s", "e").collect()} == {"a", "b", "c", "d"}
    kinds = spark.createDataFrame([("highlight", "green", None), ("highlight", None, None), ("note", None, " "), ("bookmark", None, "x"), ("other", None, None)], "k string, c string, n string")
    assert [r[0] for r in kinds.select(S.annotation_error(F.col("k"), F.col("c"), F.col("n"))).collect()] == [None, "color", "note", "note", "kind"]


def test_state(spark):
    log = spark.createDataFrame([("b", 1, "x"), ("b", 3, "z"), ("b", 2, "y"), ("c", 1, "w")], "k string, t int, v string")
    assert {(r.k, r.v) for r in S.latest(log, ["k"], ["t"]).collect()} == {("b", "z"), ("c", "w")}
    moves = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "completed"), (1, 4, "paused")], "k int, t int, s string")
    assert [r.legal for r in S.transitions(moves, "k", ["t"], "s").orderBy("t").collect()] == [True, True, True, False]
    assert {r.s for r in S.recover(moves, "s").collect()} == {"paused", "completed"}
    assert S.without(log, log.where("k = 'c'"), "k").count() == 3


def test_packages(spark):
    schema = "schema_version int, id string, title string, author string, language string, cover string, entry string, chapters array<struct<id:string,path:string>>"
    good = (1, "12345678-1234-1234-1234-123456789abc", "T", "A", "en", "c.jpg", "i.html", [("c1", "c1.html")])
    rows = [good, (2, *good[1:]), (1, "x", *good[2:]), (*good[:7], [("c\" onclick", "p")]), (*good[:7], [("c1", "../p")]), (*good[:7], [("c1", "a"), ("c1", "b")]), (*good[:7], [])]
    got = [r.error for r in K.manifest_error(spark.createDataFrame(rows, schema)).collect()]
    assert got == [None, "schema-version", "id", "chapter-id", "chapter-path", "chapter-twice", "no-chapters"]
    f = spark.createDataFrame([("b", p) for p in ("x/index.html", "index.html", "chapters/c10.html", "chapters/c2.html", "cover.png", "a.html")], "book_id string, path string")
    assert K.entry_of(f).first().entry == "index.html" and K.cover_of(f).first().cover == "cover.png"
    assert [(r.path, r.chapter_id) for r in K.chapters_of(f).orderBy("ord").collect()] == [("chapters/c2.html", "chapter-0001"), ("chapters/c10.html", "chapter-0002")]
    png = bytes.fromhex("89504E470D0A1A0A0000000D494844520000012C000000C8")
    size = spark.createDataFrame([(png,), (b"\xff\xd8\xff\xe0",)], "d binary").select(K.image_format(F.col("d")).alias("f"), K.png_size(F.col("d")).alias("s")).collect()
    assert [(r.f, tuple(r.s) if r.s else None) for r in size] == [("png", (300, 200)), ("jpeg", None)]
    dup = spark.createDataFrame([("b", "1", '<p data-block-id="x">'), ("b", "2", "<p data-block-id='x'>")], "book_id string, chapter_id string, html string")
    assert K.repeated_blocks(dup).count() == 1
    paths = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "id string, path string")
    once, issues = L.conflicts(paths, "id", "path")
    assert [r.id for r in once.collect()] == ["y"] and {r.detail for r in issues.collect()} == {"a；b"}


def test_layout(spark):
    lines = spark.createDataFrame([("d", 1, f"l{i}", f"t{i}", i == 3) for i in range(1, 4)], "doc string, page int, line_id string, text string, removable boolean")
    pages = spark.createDataFrame([("d", 1, 100, 100, False)], "doc string, page int, width int, height int, has_image boolean")
    schema = "doc string, page int, ord int, kind string, line_ids array<string>, level int, crop struct<x:int,y:int,width:int,height:int>, alt string"

    def error(blocks, omitted=()):
        b = spark.createDataFrame([("d", 1, i, *x) for i, x in enumerate(blocks)], schema)
        o = spark.createDataFrame([("d", 1, x) for x in omitted], "doc string, page int, line_id string")
        return Y.layout_errors(lines, b, o, pages).first().error

    para = lambda *ids: ("paragraph", list(ids), None, None, None)
    assert error([para("l2", "l1")], ["l3"]) is None and error([para("l1")]) == "missing-line" and error([para("l1", "l2", "l2")]) == "line-twice"
    assert error([para("l1", "l2", "l9")]) == "unknown-line" and error([para("l1")], ["l2"]) == "omitted-line" and error([]) == "no-blocks"
    assert error([para("l1", "l2"), ("figure", [], None, (0, 0, 200, 5), None)]) == "crop"
    html = Y.page_html(lines, spark.createDataFrame([("d", 1, 0, "heading", ["l2"], 1, None, None), ("d", 1, 1, "paragraph", ["l3", "l1"], None, None, None)], schema)).first().html
    assert html == "<h1>t2</h1>\n<p>t3 t1</p>"
    blocks = spark.createDataFrame([("a", "x {{GR0}}", ["<b>$1</b>"]), ("b", "y", [])], "block_id string, text string, fragments array<string>")
    done = Y.apply_translations(blocks, spark.createDataFrame([("a", "z {{GR0}} <")], "block_id string, translated string"))
    assert {r.block_id: r.html for r in done.collect()} == {"a": "z <b>$1</b> &lt;", "b": "y"}


def test_agents(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate([
        '{"type":"assistant","message":{"content":[{"text":"whole"}]}}', '{"type":"stream_event","event":{"delta":{"text":"d1"}}}',
        '{"type":"assistant","message":{"content":[{"text":"again"}]}}', '{"type":"result","result":"r"}'])], "task int, n int, line string")
    assert [r.text for r in A.stream_events(lines, "task", "n").orderBy("n").collect()] == ["whole", "d1"]
    rpc = spark.createDataFrame([(1, 0, '{"method":"item/agentMessage/delta","params":{"delta":"a"}}'), (1, 1, '{"method":"turn/completed","params":{"turn":{"status":"failed"}}}'), (1, 2, "x")], "task int, n int, line string")
    assert [(r.answer, r.failed) for r in A.final_answer(A.rpc_events(rpc), "task", "n").collect()] == [("a", True)]
    tools = spark.createDataFrame([(1, 0, "tool", "t", "running"), (1, 1, "tool", "t", "completed"), (1, 2, "step_finish", None, None), (1, 3, "tool", "u", "running")], "task int, n int, type string, tool string, state string")
    assert [(r.tool, r.started, r.ended) for r in A.tool_states(tools, "task", "tool", "n", "state").collect()] == [("t", 0, 1)]
    spans = spark.createDataFrame([(1, 0, "start", 0, "a"), (1, 1, "start", 1, "b"), (1, 2, "stop", 0, None)], "task int, n int, type string, idx int, name string")
    assert {(r.name, r.stopped) for r in A.tool_spans(spans, "task", "n").collect()} == {("a", 2), ("b", None)}
    logs = spark.createDataFrame([("", 'x\n{"error":"bad"}\nlast'), (" boom ", "y"), ("", "p\nq\n")], "stderr string, stdout string")
    assert [r.detail for r in A.failure_detail(logs).collect()] == ["bad", "boom", "q"]
    assert spark.createDataFrame([('a\n{"type":"item.completed","item":{"text":"b"}}\n{"k":1}',)], "x string").select(A.summary(F.col("x"))).first()[0] == "a\nb"


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.html").write_text("hello")
    (tmp_path / ".hidden").write_text("no")
    found = files.listing(spark, f"file://{tmp_path}", ("html",))
    assert found.count() == 1 and files.over_limits(found).first().error is None
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    rows = spark.createDataFrame([('{"a":1}',), ('{"a":1,"b":2}',), ("x",)], "j string").select(files.strict_json(F.col("j"), schema).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in rows] == [(1,), None, None]
    seqs = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 0, 7), (1, 1, 0), (1, 2, 9)], "p int, i int, seq long")
    assert [r.seq for r in files.number_events(seqs, "p", "i").orderBy("p", "i").collect()] == [1, 2, 7, 8, 9]
    img = spark.createDataFrame([("page num type width height",), ("1 0 image 300 200",), ("2 0 image 50 200",)], "line string")
    assert [r.page for r in files.image_pages(img).collect()] == [1]
    src = ["const translations = [`a\\n`, // c\n `b\\``, /* x */ `c`];", "translations = [`${x}`]", "none", None]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(src)], "i int, s string").select("i", legacy.parallel_texts(F.col("s")).alias("t")).orderBy("i")
    assert [r.t for r in got.collect()] == [["a\n", "b`", "c"], None, None, None]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    df = spark.createDataFrame([(1,)], "a int")
    for name in ("manual-20260101-000000", "auto-20260102-000000"):
        snapshots.write_snapshot({"t": df}, root, name)
    assert [r.name for r in snapshots.snapshots(spark, root).collect()] == ["auto-20260102-000000", "manual-20260101-000000"]
    assert snapshots.restore(spark, root, "manual-20260101-000000")["t"].count() == 1
    assert snapshots.retained(snapshots.snapshots(spark, root), 1).count() == 1
