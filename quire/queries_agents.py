"""Queries on worker logs, book packages and page layouts.

``events`` stand for the lines of worker logs (a user is a task), ``part`` for books, files and workers, ``lineitem`` for
source lines of pages and ``conversations`` for messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import numbers as N
from quire.functions import patterns as P
from quire.functions import text as X
from quire.functions import url as U
from quire.operators import agents as A
from quire.operators import layout as Y
from quire.operators import packages as B
from quire.register import filer
from quire.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
query = filer(QUERIES, ORACLES)

def _e() -> Column:
    return F.col("event_id")


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(n: Column, *options: str | Column) -> Column:
    return F.get(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), F.pmod(n, F.lit(len(options))).cast("int"))


def _lines(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("task"), line.alias("line"))


_RPC = """x AS (SELECT event_id, user_id AS task, event_id % 8 AS k FROM events), r AS (SELECT event_id, task, CASE k WHEN 0 THEN 'text_delta' WHEN 1 THEN 'phase' WHEN 2 THEN 'tool_started' WHEN 3 THEN 'message' WHEN 4 THEN 'tool_finished'
  WHEN 5 THEN CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'error' END ELSE 'error' END AS type, CASE k WHEN 0 THEN 'd' || event_id || ' ' WHEN 3 THEN 'm' || event_id WHEN 6 THEN 'e"' || event_id END AS text,
  CASE k WHEN 2 THEN 'commandExecution' WHEN 3 THEN 'agentMessage' WHEN 4 THEN 'webSearch' END AS name FROM x WHERE k < 7)"""


def _rpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _pick(
        _e(), _say('{"method":"item/agentMessage/delta","params":{"delta":"d', _e(), ' "}}'), '{"method":"turn/started"}',
        '{"method":"item/started","params":{"item":{"type":"commandExecution"}}}', _say('{"method":"item/completed","params":{"item":{"type":"agentMessage","text":"m', _e(), '"}}}'),
        '{"method":"item/completed","params":{"item":{"type":"webSearch"}}}', _say('{"method":"turn/completed","params":{"turn":{"status":"', F.when(_e() % 3 == 0, "completed").otherwise("failed"), '"}}}'),
        _say('{"method":"error","params":{"error":{"message":"e\\"', _e(), '"}}}'), "no json",
    )
    return A.rpc_events(_lines(spark, sf_dir, line))


@query(f"WITH {_RPC} SELECT event_id, type, text, name FROM r")
def rpc_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rpc(spark, sf_dir).select("event_id", "type", "text", "name")


@query(f"""WITH {_RPC} SELECT task, coalesce(string_agg(text, '' ORDER BY event_id) FILTER (type = 'text_delta'), arg_max(text, event_id) FILTER (type = 'message')) AS answer, bool_or(type = 'error') AS failed FROM r GROUP BY task""")
def rpc_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.final_answer(_rpc(spark, sf_dir), "task", "event_id")


@query("""WITH x AS (SELECT event_id, user_id AS task, event_id % 6 AS k, user_id % 3 AS u FROM events), c AS (SELECT event_id, task, CASE k WHEN 0 THEN 'stream_event' WHEN 1 THEN 'assistant' WHEN 2 THEN 'assistant' WHEN 3 THEN 'result' WHEN 4 THEN 'tool' END AS type,
  CASE WHEN k = 0 AND u = 0 THEN 'd' || event_id END AS delta, CASE WHEN k = 1 AND u < 2 THEN 'a' || event_id || 'b' WHEN k = 2 AND u < 2 THEN 'only' END AS message, CASE WHEN k = 3 THEN 'r' || event_id END AS result FROM x),
s AS (SELECT *, coalesce(bool_or(delta IS NOT NULL) OVER w, false) AS seen FROM c WINDOW w AS (PARTITION BY task ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, CASE WHEN delta IS NOT NULL THEN delta WHEN type = 'assistant' AND NOT seen THEN message END AS said FROM s),
a AS (SELECT *, coalesce(bool_or(trim(said) <> '') OVER w, false) AS had FROM d WINDOW w AS (PARTITION BY task ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), f AS (SELECT task, event_id, CASE WHEN type = 'result' AND NOT had THEN result ELSE said END AS text FROM a)
SELECT task, event_id, text FROM f WHERE text IS NOT NULL""")
def stream_log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 3
    blocks = lambda x: F.when(u < 2, x).otherwise('{"type":"assistant","message":{"content":[]}}')
    line = _pick(
        _e(), F.when(u == 0, _say('{"type":"stream_event","event":{"delta":{"text":"d', _e(), '"}}}')).otherwise('{"type":"stream_event","event":{}}'),
        blocks(_say('{"type":"assistant","message":{"content":[{"type":"text","text":"a', _e(), '"},{"type":"tool_use","name":"x"},{"type":"text","text":"b"}]}}')),
        blocks(F.lit('{"type":"assistant","message":{"content":[{"type":"tool_use","name":"y"},{"type":"text","text":"only"}]}}')),
        _say('{"type":"result","result":"r', _e(), '"}'), '{"type":"tool"}', "{}",
    )
    return A.stream_events(_lines(spark, sf_dir, line), "task", "event_id")


@query("""WITH t AS (SELECT user_id AS task, event_id % 5 AS idx, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'start' WHEN event_type = 'purchase' THEN 'stop' ELSE 'x' END AS type FROM events),
w AS (SELECT *, lead(type) OVER o AS then_, lead(event_id) OVER o AS nxt FROM t WHERE type <> 'x' WINDOW o AS (PARTITION BY task, idx ORDER BY event_id)) SELECT task, idx, 'n' || idx AS name, event_id AS started, CASE WHEN then_ = 'stop' THEN nxt END AS stopped FROM w WHERE type = 'start'""")
def tool_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "start").when(F.col("event_type") == "purchase", "stop").otherwise("x")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), (_e() % 5).alias("idx"), _say("n", _e() % 5).alias("name"), "event_id", kind.alias("type"))
    return A.tool_spans(rows, "task", "event_id")


@query("""WITH t AS (SELECT user_id AS task, CASE WHEN event_id % 3 > 0 THEN 't' || event_id % 20 END AS tool, event_id, ['pending', 'running', 'completed', 'error'][(event_id // 3 % 4 + 1)::INT] AS state, CASE WHEN event_type = 'error' AND event_id > 600 THEN 'step_finish' ELSE 'tool' END AS type FROM events),
s AS (SELECT *, min(event_id) FILTER (type = 'step_finish') OVER (PARTITION BY task) AS stop FROM t), k AS (SELECT * FROM s WHERE (stop IS NULL OR event_id <= stop) AND tool IS NOT NULL)
SELECT task, tool, min(event_id) AS started, min(event_id) FILTER (state IN ('completed', 'error')) AS ended, arg_min(state, event_id) FILTER (state IN ('completed', 'error')) AS result FROM k GROUP BY ALL""")
def tool_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("event_type") == "error") & (_e() > 600), "step_finish").otherwise("tool")
    state = _pick(F.floor(_e() / 3), "pending", "running", "completed", "error")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.when(_e() % 3 > 0, _say("t", _e() % 20)).alias("tool"), "event_id", state.alias("state"), kind.alias("type"))
    return A.tool_states(rows, "task", "tool", "event_id", "state")


@query("SELECT user_id AS task, coalesce(string_agg('p' || event_id, '' ORDER BY event_id) FILTER (event_id % 4 = 1), '') AS answer, arg_min('m' || event_id, event_id) FILTER (event_id % 4 = 2) AS model, arg_min('s' || event_id, event_id) FILTER (event_id % 4 = 3) AS session FROM events GROUP BY 1")
def one_shot_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _pick(_e(), "{}", _say('{"type":"text","part":{"text":"p', _e(), '"}}'), _say('{"type":"init","model":"m', _e(), '"}'), _say('{"session":{"id":"s', _e(), '"}}'))
    lines = _lines(spark, sf_dir, line)
    return A.joined_parts(lines, "task", "event_id").join(A.first_known(lines, "task", "event_id", {"model": "$.model", "session": "$.session.id"}), "task")


@query("""WITH v AS (SELECT event_id, user_id AS task, event_id % 5 = 3 AS invalid FROM events WHERE event_id % 5 NOT IN (0, 1)), n AS (SELECT *, sum(invalid::INT) OVER (PARTITION BY task ORDER BY event_id) AS n FROM v)
SELECT event_id, task, invalid, (SELECT min(m.event_id) FROM n m WHERE m.task = n.task AND m.n >= 2) AS aborted_at FROM n""")
def shown_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _pick(_e(), '{"type":"thinking","x":1}', '{"type":"reasoning"}', '{"type":"text"}', '{"type":"text", broken', "plain words")
    shown = A.visible_lines(_lines(spark, sf_dir, line))
    stops = A.aborted_at(shown, "task", "event_id").withColumnRenamed("at", "aborted_at")
    return shown.join(stops, "task", "left").select("event_id", "task", "invalid", "aborted_at")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'broken pipe ' || event_id WHEN 1 THEN 'e' || event_id WHEN 2 THEN 'r' || event_id WHEN 3 THEN 'last words' ELSE '' END AS detail,
CASE event_id % 5 WHEN 3 THEN 'first' || chr(10) || 'last words' ELSE '""" + P.LOG_NOTHING + """' END AS summary, event_id % 5 = 0 AND event_id % 2 = 0 AS network FROM events""")
def failure_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _pick(_e(), "", _say('{"error":"x"}\n{"error":"e', _e(), '"}\n\n'), _say('{"result":"r', _e(), '"}\n  '), "first\n\nlast words\n", " ")
    err = F.when(_e() % 5 == 0, _say(" broken pipe ", _e(), "\n")).otherwise("")
    rows = table(spark, sf_dir, "events").select("event_id", F.regexp_replace(err, r"^\s+|\s+$", "").alias("stderr"), out.alias("stdout"), _say(F.when(_e() % 2 == 0, "Connection lost ").otherwise("fine "), err).alias("log"))
    said = A.failure_detail(rows).select("event_id", "detail", A.summary(F.col("stdout")).alias("summary"), ((_e() % 5 == 0) & A.reports_network_failure(F.col("log"))).alias("network"))
    return said


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'custom' WHEN 1 THEN 'custom' ELSE 'builtin' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'a,' || p_partkey ELSE '' END AS arguments, p_partkey % 3 = 2 AS streams,
CASE p_partkey % 4 WHEN 0 THEN 'path' WHEN 1 THEN 'too-many-arguments' WHEN 2 THEN 'argument-size' END AS error, CASE p_partkey % 3 WHEN 0 THEN 'blank' WHEN 1 THEN 'too-long' END AS question FROM part""")
def worker_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("label"), F.lit("/bin/x").alias("command"), F.when(k % 3 == 0, _say('["a", "', k, '"]')).otherwise("[broken").alias("arguments_json"))
    both = A.runtimes(part.where("id % 3 = 2"), part.where("id % 3 < 2"))
    i = F.col("id")
    command = F.when(i % 4 == 0, "bin/x").otherwise("/bin/x")
    arguments = F.when(i % 4 == 1, F.array_repeat(F.lit("a"), 33)).when(i % 4 == 2, F.array(F.repeat(F.lit("é"), F.lit(600)))).otherwise(F.array(F.lit("ok")))
    asked = F.when(i % 3 == 0, "  ").when(i % 3 == 1, F.repeat(F.lit("x"), F.lit(20_001))).otherwise("why?")
    return both.select("id", "kind", F.array_join("arguments", ",").alias("arguments"), "streams", A.runtime_error(command, arguments).alias("error"), A.question_error(asked).alias("question"))


_UUID = "00000000-0000-0000-0000-00000000000"


@query("SELECT p_partkey, ['schema-version', 'id', 'title', 'language', 'no-chapters', 'chapter-id', 'chapter-twice', 'chapter-path', 'path', NULL][(p_partkey % 10 + 1)::INT] AS error FROM part")
def package_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 10
    chapter = lambda i, p: F.struct(F.lit(i).alias("id"), F.lit(p).alias("path"))
    bad = lambda n, wrong, right: F.when(k == n, wrong).otherwise(right)
    chapters = (
        F.when(k == 4, F.array().cast("array<struct<id:string,path:string>>")).when(k == 5, F.array(chapter("!bad", "a.html"))).when(k == 6, F.array(chapter("c1", "a.html"), chapter("c1", "b.html")))
        .when(k == 7, F.array(chapter("c1", "../a.html"))).otherwise(F.array(chapter("c1", "a.html"), chapter("c2", "b/c.html")))
    )
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey"), bad(0, 2, 1).alias("schema_version"), bad(1, "no uuid", _UUID + "1").alias("id"), bad(2, " ", "T").alias("title"), F.lit("A").alias("author"), bad(3, "e", "en-US").alias("language"),
        chapters.alias("chapters"), F.lit("cover.jpg").alias("cover"), bad(8, "/etc/x", "index.html").alias("entry"),
    )
    return B.manifest_error(rows, "p_partkey")


@query("""WITH c AS (SELECT o_custkey AS book_id, o_orderkey, 'b' || o_orderkey % 40 AS block_id FROM orders) SELECT book_id, block_id FROM c GROUP BY ALL HAVING count(DISTINCT o_orderkey) > 1""")
def repeated_block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("chapter_id"), _say('<p data-block-id="b', F.col("o_orderkey") % 40, '">x</p>').alias("html"))
    return B.repeated_blocks(chapters)


@query("""SELECT o_custkey AS book_id, o_orderkey AS chapter_id, CASE o_orderkey % 4 WHEN 0 THEN 'no-blocks' WHEN 1 THEN 'script' END AS error, o_orderkey % 5 = 0 AS orphan FROM orders""")
def chapter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    block = _say('<p data-block-id="b', k, '">x</p>')
    chapters = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), k.alias("chapter_id"), F.when(k % 4 == 0, "<p>x</p>").when(k % 4 == 1, F.concat(block, F.lit("<script>"))).otherwise(block).alias("html"))
    full = chapters.withColumn("html", _say('<p data-block-id="b', F.col("chapter_id"), '">'))
    side = chapters.select("book_id", "chapter_id", _say("b", F.col("chapter_id") + F.when(F.col("chapter_id") % 5 == 0, 1).otherwise(0)).alias("block_id"))
    orphans = B.orphan_parallel(side, full).select("chapter_id", F.lit(True).alias("o"))
    return B.chapter_errors(chapters).join(orphans, "chapter_id", "left").select("book_id", "chapter_id", "error", F.coalesce("o", F.lit(False)).alias("orphan"))


_FILES = """f AS (SELECT p_brand AS book_id, CASE p_size % 5 WHEN 0 THEN 'x' || p_partkey || '.html' WHEN 1 THEN 'chapters/c' || p_partkey || '.htm' WHEN 2 THEN 'sub/index.html' WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Cover.png' ELSE 'img/cover.jpeg' END ELSE 'a' || p_partkey || '.css' END AS path,
  p_partkey FROM part)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = _pick(F.col("p_size"), _say("x", k, ".html"), _say("chapters/c", k, ".htm"), "sub/index.html", F.when(k % 2 == 0, "Cover.png").otherwise("img/cover.jpeg"), _say("a", k, ".css"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_id"), path.alias("path"), k.alias("size")).dropDuplicates(["book_id", "path"])


@query(f"""WITH {_FILES}, d AS (SELECT DISTINCT book_id, path, CASE WHEN path LIKE 'x%' THEN regexp_extract(path, '[0-9]+')::INT END AS n, CASE WHEN path LIKE 'chapters/%' THEN regexp_extract(path, '[0-9]+')::INT END AS m FROM f)
SELECT book_id, CASE WHEN bool_or(path = 'sub/index.html') THEN 'sub/index.html' WHEN min(m) IS NOT NULL THEN arg_min(path, m) FILTER (m IS NOT NULL) ELSE arg_min(path, n) FILTER (n IS NOT NULL) END AS entry,
CASE WHEN bool_or(path = 'img/cover.jpeg') THEN 'img/cover.jpeg' WHEN bool_or(path = 'Cover.png') THEN 'Cover.png' END AS cover FROM d GROUP BY book_id HAVING bool_or(path LIKE '%.htm%')""")
def package_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return B.entry_of(files).join(B.cover_of(files), "book_id", "left")


@query(f"""WITH {_FILES}, d AS (SELECT DISTINCT book_id, path, path LIKE 'chapters/%' AS inside, TRY_CAST(regexp_extract(path, '[0-9]+') AS INT) AS n FROM f WHERE path LIKE '%.htm%'),
e AS (SELECT *, bool_or(inside) OVER w AS some_in, count(*) OVER w AS k, first_value(path) OVER (PARTITION BY book_id ORDER BY path <> 'sub/index.html', NOT inside, n) AS entry FROM d WINDOW w AS (PARTITION BY book_id)),
r AS (SELECT book_id, path, row_number() OVER (PARTITION BY book_id ORDER BY n NULLS FIRST)::INT AS ord FROM e WHERE CASE WHEN some_in THEN inside ELSE path <> entry OR k = 1 END)
SELECT book_id, path, ord, printf('chapter-%04d', ord) AS chapter_id FROM r""")
def package_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chapters_of(_files(spark, sf_dir))


@query("""SELECT p_partkey, ['jpeg', 'png', 'gif', 'webp', NULL][(p_partkey % 5 + 1)::INT] AS format, CASE WHEN p_partkey % 5 = 1 THEN 256 + p_size END AS width, CASE WHEN p_partkey % 5 = 1 THEN 7 END AS height,
['text/css; charset=utf-8', 'image/png', 'image/webp', 'application/octet-stream', 'font/woff2'][(p_partkey % 5 + 1)::INT] AS content_type, p_partkey % 5 <> 3 AS safe, CASE p_partkey % 5 WHEN 0 THEN 'size' WHEN 3 THEN 'type' END AS error,
[NULL, 'import', 'executable', 'external-resource', NULL][(p_partkey % 5 + 1)::INT] AS css FROM part""")
def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452000001"), F.lpad(F.hex(F.col("p_size")), 2, "0"), F.lit("00000007"))
    head = F.unhex(_pick(k, "FFD8FFE0", png, "474946383961AA", "52494646000000005745425056", "0011"))
    path = _pick(k, "a.CSS", "b/c.png", "d.webp", "../e.exe", "f.woff2")
    css = _pick(k, "p{color:red}", "@IMPORT 'x'", "a{b:Expression(1)}", "p{background:url( 'https://x/y')}", "p{background:url(y.png)}")
    rows = table(spark, sf_dir, "part").select("p_partkey", head.alias("b"), path.alias("path"), F.when(k % 5 == 0, 65 << 20).otherwise(9).alias("size"), css.alias("css"))
    errors = B.file_errors(rows.select(_say(F.col("p_partkey"), "/", F.col("path")).alias("path"), "size")).select(F.split("path", "/")[0].cast("long").alias("p_partkey"), "error")
    told = rows.select("p_partkey", B.image_format(F.col("b")).alias("format"), B.png_size(F.col("b")).alias("s"), B.content_type(F.col("path")).alias("content_type"), B.safe_path(F.col("path")).alias("safe"), H.css_violation(F.col("css")).alias("css"))
    return told.join(errors, "p_partkey").select("p_partkey", "format", "s.width", "s.height", "content_type", "safe", "error", "css")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 300 = 0 OR o_custkey % 300 > 240 THEN 'title' WHEN o_orderstatus = 'P' THEN 'no-chapters' WHEN o_orderstatus = 'F' AND left(o_orderpriority, 1) NOT IN ('1', '2') THEN 'unknown-chapter'
WHEN o_totalprice > 300000 AND NOT contains(o_orderpriority, 'H') THEN 'preserve-needs-translate' WHEN o_custkey % 4 = 0 AND contains(o_orderpriority, 'H') THEN 'pdf-translate' END AS error FROM orders""")
def build_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    custom, status, priority = F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    token = _say("t", custom)
    sources = F.when(status == "P", F.array().cast("array<string>")).when(status == "F", F.array(F.lit("a"), F.left(priority, F.lit(1)))).otherwise(F.array(F.lit("a"), F.lit("b")))
    orders = table(spark, sf_dir, "orders")
    requests = orders.select(
        F.col("o_orderkey").alias("id"), token.alias("token"), F.repeat(F.lit("x"), (custom % 300).cast("int")).alias("title"), sources.alias("sources"),
        (F.col("o_totalprice") > 300000).alias("preserve"), F.contains(priority, F.lit("H")).alias("translate"), F.when(custom % 4 == 0, "pdf").otherwise("web").alias("kind"),
    )
    return B.request_error(requests, orders.select(token.alias("token"), F.explode(F.array(*map(F.lit, "ab12"))).alias("source")).distinct())


@query("""WITH s AS (SELECT o_custkey AS book, sum((o_orderstatus = 'F')::INT)::BIGINT AS a, sum((o_orderstatus = 'P')::INT)::BIGINT AS b FROM orders GROUP BY 1)
SELECT book, CASE WHEN a > 0 THEN a || ' skipped' ELSE '' END || CASE WHEN a > 0 AND b > 0 THEN '; ' ELSE '' END || CASE WHEN b > 0 THEN b || ' renamed' ELSE '' END AS warnings FROM s""")
def conversion_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("skipped"), (F.col("o_orderstatus") == "P").cast("int").alias("renamed"))
    return B.conversion_warnings(stats, "o_custkey", {"skipped": "%d skipped", "renamed": "%d renamed"}).select("book", F.array_join("warnings", "; ").alias("warnings"))


@query("""SELECT o_custkey AS book, '<ol>' || string_agg('<li><a href="c' || o_orderkey || '.html">A &amp; &lt;' || o_orderkey || '&gt;</a></li>', '' ORDER BY o_orderkey) || '</ol>' AS html FROM orders GROUP BY 1""")
def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return B.index_page(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), k.alias("ord"), _say("A & <", k, ">").alias("title"), _say("c", k, ".html").alias("path")))


_LAYOUT = "WITH g AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS line FROM lineitem), p AS (SELECT doc, list(line ORDER BY line) AS lines FROM g GROUP BY doc)"


def _layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line")).distinct()
    lines = lines.select("doc", F.lit(1).alias("page"), "line", _say("l", F.col("line")).alias("line_id"), _say("t<", F.col("line"), ">").alias("text"), (F.col("line") == 1).alias("removable"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("line", "line_id"))), lambda x: x["line_id"])
    return lines, lines.groupBy("doc", "page").agg(ids.alias("ids"))


@query(f"{_LAYOUT} SELECT doc, CASE doc % 6 WHEN 0 THEN 'unknown-line' WHEN 1 THEN 'line-twice' WHEN 2 THEN CASE WHEN lines[len(lines)] > 1 THEN 'missing-line' END WHEN 3 THEN 'crop' WHEN 4 THEN CASE WHEN lines[1] > 1 THEN 'omitted-line' END END AS error FROM p")
def layout_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, pages = _layout(spark, sf_dir)
    k = F.col("doc") % 6
    used = (
        F.when(k == 0, F.array_append("ids", F.lit("l99"))).when(k == 1, F.array_append("ids", F.get("ids", F.lit(0)))).when(k == 2, F.slice("ids", 1, F.size("ids") - 1))
        .when(k == 4, F.slice("ids", 2, F.size("ids") - 1)).otherwise(F.col("ids"))
    )
    box = lambda w: F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(w).alias("width"), F.lit(5).alias("height"))
    blocks = pages.select("doc", "page", F.lit(1).alias("ord"), F.lit("paragraph").alias("kind"), used.alias("line_ids"), F.lit(None).cast("struct<x:int,y:int,width:int,height:int>").alias("crop"))
    figures = pages.select("doc", "page", F.lit(2).alias("ord"), F.lit("figure").alias("kind"), F.array().cast("array<string>").alias("line_ids"), F.when(k == 3, box(101)).otherwise(box(50)).alias("crop"))
    omitted = pages.where("doc % 6 = 4").select("doc", "page", F.get("ids", F.lit(0)).alias("line_id"))
    sizes = pages.select("doc", "page", F.lit(100).alias("width"), F.lit(100).alias("height"), F.lit(True).alias("has_image"))
    return Y.layout_errors(lines, blocks.unionByName(figures), omitted, sizes).select("doc", "error")


@query(f"""{_LAYOUT}, s AS (SELECT doc, list_transform(lines, lambda x: 't&lt;' || x || '&gt;') AS w FROM p)
SELECT doc, '<h3>' || w[1] || '</h3>' || chr(10) || CASE doc % 4 WHEN 0 THEN '<pre>' || array_to_string(w, chr(10)) || '</pre>' WHEN 1 THEN '<ul>' || array_to_string(list_transform(w, lambda x: '<li>' || x || '</li>'), '') || '</ul>'
WHEN 2 THEN '<blockquote>' || array_to_string(w, ' ') || '</blockquote>' ELSE '<p>' || array_to_string(w, ' ') || '</p>' END || chr(10) || '<figure><img alt="a&amp;b"></figure>' AS html FROM s""")
def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, pages = _layout(spark, sf_dir)
    none = F.array().cast("array<string>")
    block = lambda n, kind, ids, level: F.struct(F.lit(n).alias("ord"), kind.alias("kind"), ids.alias("line_ids"), F.lit(level).alias("level"), F.lit("a&b").alias("alt"))
    blocks = pages.select("doc", "page", F.inline(F.array(
        block(1, F.lit("heading"), F.slice("ids", 1, 1), 3), block(2, _pick(F.col("doc"), "code", "list", "quote", "paragraph"), F.col("ids"), 0), block(3, F.lit("figure"), none, 0),
    )))
    return Y.page_html(lines, blocks).select("doc", "html")


@query("""WITH t AS (SELECT *, '<code>' || o_orderpriority || '</code>' AS f0, '<b>' || o_custkey || '</b>' AS f1 FROM orders)
SELECT o_orderkey AS block_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ' &lt;' || f1 || '&gt; &quot;' || f0 || '&quot;' ELSE 'old ' || f0 || ' &amp; ' || o_orderdate::DATE || ' ' || f1 END AS html FROM t""")
def translated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    fragments = F.array(_say("<code>", F.col("o_orderpriority"), "</code>"), _say("<b>", F.col("o_custkey"), "</b>"))
    blocks = orders.select(F.col("o_orderkey").alias("block_id"), _say("old {{GR0}} & ", F.col("o_orderdate").cast("date"), " {{GR1}}").alias("text"), fragments.alias("fragments"))
    return Y.apply_translations(blocks, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("block_id"), _say(F.col("o_orderpriority"), ' <{{GR1}}> "{{GR0}}"').alias("translated")))


@query("""WITH k AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant'), m AS (SELECT row_number() OVER () AS i, conv_id * 1000 + turn AS id, conv_id, turn FROM conversations)
SELECT m.id, p.pos, 'c' || m.conv_id AS chapter_id, 'b' || k.turn AS block_id FROM m, (VALUES (0, 0), (1, 1)) p(pos, step) JOIN k ON k.conv_id = m.conv_id AND k.turn = m.turn + p.step""")
def message_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    messages = rows.select((F.col("conv_id") * 1000 + t).alias("id"), _say("see [chapter:c", F.col("conv_id"), "#b", t, "] and [chapter:c", F.col("conv_id"), "#b", t + 1, "] or [chapter:x]").alias("content"))
    blocks = rows.where("role = 'assistant'").select(_say("c", F.col("conv_id")).alias("chapter_id"), _say("b", t).alias("block_id"))
    return Y.citations(messages, blocks).select("id", "pos", "chapter_id", "block_id")


_ESCAPED = "replace(replace(replace(replace(replace(left(html, 300), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


@query(f"""SELECT page_id, CASE page_id % 3 WHEN 2 THEN NULL ELSE 'A & ' || length(html) END AS author, regexp_extract(lower(substr(url, page_id % 2 + 1)), '^([a-z][a-z0-9+.-]*):', 1) IN ('http', 'https', 'mailto') AS link_ok,
{_ESCAPED} AS escaped, 'dir ' || length(html) || '.tar' AS stem FROM pages""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("page_id"), F.char_length("html")
    meta = F.when(k % 3 == 0, _say('<meta name="author" x=1 content=" A &amp; ', n, ' ">')).when(k % 3 == 1, _say("<META content='A &amp; ", n, "' property='author'>")).otherwise('<meta name="authors" content="x">')
    rows = table(spark, sf_dir, "pages").select("page_id", n.alias("n"), F.left("html", F.lit(300)).alias("start"), F.concat("html", meta).alias("html"), F.substr("url", (k % 2 + 1).cast("int")).alias("link"))
    return rows.select(
        "page_id", H.meta_content(F.col("html"), "author").alias("author"), U.opens_externally(F.col("link")).alias("link_ok"), X.escape_html(F.col("start")).alias("escaped"),
        X.file_stem_title(_say("x/dir_", F.col("n"), ".tar.html"), k).alias("stem"),
    )


def _mod(n: str, m: int) -> str:
    return f"((({n}) % {m} + {m}) % {m} + 1)::INT"


def _spelled(n: Column, *places: tuple[int, list[str]]) -> Column:
    """A number by its decimal digits: for each place the words of 0 to 9."""
    return F.concat(*[_pick(F.floor(n / place), *words) for place, words in places])


def _roman(n: Column) -> Column:
    words = lambda a, b, c: ["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c]
    return _spelled(n, (100, words("c", "d", "m")), (10, words("x", "l", "c")), (1, words("i", "v", "x")))


def _chinese(n: Column) -> Column:
    words = lambda unit: ["", *[d + unit for d in "一二三四五六七八九"]]
    return _spelled(n, (100, words("百")), (10, words("十")), (1, words("")))


_OPEN, _CLOSE = "(（[【", ")）]】"
_BALANCED = " AND ".join(f"length(b) - length(replace(b, '{x}', '')) = length(b) - length(replace(b, '{y}', ''))" for x, y in zip(_OPEN, _CLOSE, strict=True))


@query(f"""WITH p AS (SELECT *, {_mod("p_partkey + p_size", 6)} AS kind, {_mod("p_partkey * 100 + p_size", 999)} AS n FROM part),
t AS (SELECT *, ['', '', '', '', '', '【'][kind] || p_name || CASE WHEN contains(p_brand, '1') THEN ' ' || {list(_OPEN)}[{_mod("p_partkey", 4)}] ELSE '' END || CASE WHEN p_size % 3 = 0 THEN {list(_CLOSE)}[{_mod("p_partkey + p_size // 30", 4)}] ELSE '' END AS b FROM p)
SELECT p_partkey, CASE WHEN kind <= 4 AND b IS NOT NULL THEN n END AS number, ({_BALANCED}) AS complete, CASE WHEN p_partkey % 7 BETWEEN 1 AND p_size AND p_size <= 40 THEN p_partkey % 7 END AS first,
CASE WHEN p_partkey % 7 BETWEEN 1 AND p_size AND p_size <= 40 THEN p_size END AS last FROM t""")
def heading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings numbered in digits, Roman and Chinese, or in no way that counts; brackets of four kinds, some open or closed by another kind; ranges of pages, some not valid."""
    k, size = F.col("p_partkey"), F.col("p_size")
    opened = F.when(F.contains("p_brand", F.lit("1")), _say(" ", _pick(k, *_OPEN))).otherwise("")
    closed = F.when(size % 3 == 0, _pick(k + F.floor(size / 30), *_CLOSE)).otherwise("")
    n, tail = F.pmod(k * 100 + size, F.lit(999)) + 1, F.concat("p_name", opened, closed)
    heading = _pick(
        k + size, _say("Chapter ", n, ": ", tail), _say("CHAPTER ", _roman(n), " ", tail), _say("第 ", _chinese(n), " 章 ", tail), _say("第", n, "章 ", tail),
        _say("Chapters ", n, " ", tail), _say("【chapter ", n, " ", tail),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", heading.alias("h"), N.page_range(_say("pages:", k % 7, "-", size), F.lit(40)).alias("r"))
    return rows.select("p_partkey", N.chapter_ordinal(F.col("h")).alias("number"), N.complete_heading(F.col("h")).alias("complete"), "r.first", "r.last")


_KIND = "(event_id * 7 + user_id) % 9"


@query(f"""WITH e AS (SELECT user_id AS task, event_id, {_KIND} AS k, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
s AS (SELECT task, event_id, CASE k WHEN 0 THEN '{P.LOG_INIT}' WHEN 1 THEN event_type || event_id WHEN 2 THEN 'd' || event_id WHEN 3 THEN '{P.LOG_SAID["thread.started"]}' WHEN 4 THEN '{P.LOG_SAID["turn.started"]}'
  WHEN 5 THEN 'i' || event_type WHEN 6 THEN '{P.LOG_SAID["result"]}' WHEN 7 THEN 'plain ' || event_type END AS said FROM e WHERE back <= 80)
SELECT task, coalesce(string_agg(said, chr(10) ORDER BY event_id), '{P.LOG_NOTHING}') AS summary FROM s GROUP BY task""")
def log_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    line = _pick(
        e * 7 + F.col("user_id"), '{"type":"system","subtype":"init"}', _say('{"type":"assistant","message":{"content":[{"type":"text","text":" ', kind, e, ' "},{"type":"tool"},{"text":"  "}]}}'),
        _say('{"type":"stream_event","event":{"delta":{"text":"d', e, '"}}}'), '{"type":"thread.started"}', '{"type":"turn.started"}', _say('{"type":"item.completed","item":{"text":"i', kind, '"}}'),
        '{"type":"result","result":"r"}', _say("  plain ", kind, " "), '{"type":"other"}',
    )
    logs = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "event_id", line.alias("line")).groupBy("task").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("x"))
    return logs.select("task", A.summary(F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n"))).alias("summary"))


@query("""WITH e AS (SELECT user_id AS task, event_id AS i, event_type, event_id % 6 AS r FROM events),
k AS (SELECT task, arg_min('m' || event_type, i) FILTER (event_type = 'view') AS model, arg_min('s' || i, i) FILTER (event_type = 'view') AS session FROM e GROUP BY task),
a AS (SELECT *, last_value(CASE WHEN r < 5 THEN i END IGNORE NULLS) OVER (PARTITION BY task ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ai, max(i) FILTER (r IN (2, 3, 4)) OVER (PARTITION BY task) AS since FROM e WHERE event_type = 'purchase'),
v AS (SELECT *, CASE WHEN r = 2 THEN 's' || i WHEN ai % 6 IN (1, 3) THEN 'v' || ai END AS value FROM a),
f AS (SELECT task, arg_max(CASE WHEN ai IS NULL THEN '' WHEN ai % 6 IN (1, 3) THEN '{"translations":{"a":"v' || ai || '"}}' ELSE 'text ' || ai END, i) AS answer, arg_min(value, i) FILTER (value IS NOT NULL AND (since IS NULL OR i >= since)) AS structured FROM v GROUP BY task)
SELECT task, session, model, coalesce(answer, '') AS answer, structured FROM k LEFT JOIN f USING (task)""")
def structured_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text, read = _say('"result":"text ', e, '"'), _say('"result":"{\\"translations\\":{\\"a\\":\\"v', e, '\\"}}"')
    output = _pick(e, text, read, _say(text, ',"structured_output":{"translations":{"a":"s', e, '"}}'), _say(read, ',"structured_output":{"other":1}'), _say(text, ',"structured_output":{"other":1}'), '"x":1')
    line = F.when(F.col("event_type") == "purchase", _say('{"type":"result",', output, "}")).when(F.col("event_type") == "view", _say('{"model":"m', F.col("event_type"), '","session_id":"s', e, '"}')).otherwise("{broken")
    found = A.structured_results(_lines(spark, sf_dir, line), "task", "event_id", "translations map<string, string>")
    return found.select("task", "session", "model", "answer", F.col("structured.translations")["a"].alias("structured"))
