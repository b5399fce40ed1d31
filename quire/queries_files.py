"""Queries over files that Spark derives from the tables: script texts, published books, event logs, snapshots; and chapter headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import numbers as N
from quire.operators import chapters as C
from quire.operators import desk as K
from quire.operators import documents as D
from quire.operators import state as S
from quire.plans.scratch import scratch_folder
from quire.queries_documents import book_of
from quire.queries_library import _HOST, _QUALITY, _quality
from quire.register import filer
from quire.sources import files, legacy, publish, snapshots
from quire.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
query = filer(QUERIES, ORACLES)


@query(r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
g AS (SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS whole, count(*) AS n, max(length(text)) AS longest, sum(length(text)) AS total FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN longest % 7 <> 0 AND total % 11 <> 0 AND total % 13 <> 0 THEN n END AS n_texts, CASE WHEN longest % 7 <> 0 AND total % 11 <> 0 AND total % 13 <> 0 THEN md5(whole) END AS digest FROM g""")
def script_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts made of conversations: escaped literals among comments; some hold ``${``, a stray word, or no closing bracket, and are null."""
    text = F.coalesce("text", F.lit(""))
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`")), F.lit("\n"), F.lit("\\n"))
    literal = F.concat(F.when(F.col("role") == "system", "// `system` ]\n").otherwise(F.lit("/* ` ] ${ /*/ ")), F.lit("`"), escaped, F.lit("`,\n"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", literal.alias("s")))).alias("t"), F.max(F.char_length(text)).alias("longest"), F.sum(F.char_length(text)).alias("total"))
    odd = F.when(F.col("longest") % 7 == 0, "`a ${b}`").when(F.col("total") % 11 == 0, "word").otherwise("")
    script = F.concat(F.lit("window.x = 1;\nconst translations = ["), F.array_join(F.transform("t", lambda x: x["s"]), ""), odd, F.when(F.col("total") % 13 != 0, "]; // end").otherwise(""))
    texts = turns.select("conv_id", script.alias("script")).select("conv_id", legacy.parallel_texts(F.col("script")).alias("texts"))
    return texts.select("conv_id", F.when(F.col("texts").isNotNull(), F.size("texts")).cast("long").alias("n_texts"), F.md5(F.array_join("texts", "|").cast("binary")).alias("digest"))


@query(f"""WITH {_QUALITY.replace('FILTER (NOT present)', 'FILTER (NOT present AND page_id % 2 = 0)')}, ok AS (SELECT book FROM r WHERE n_errors = 0 AND length(book) % 3 <> 0),
v AS (SELECT {_HOST} AS book, page_id, '# c' || page_id || chr(10) || chr(10) || coalesce(html, '') || chr(10) AS value FROM pages)
SELECT book AS book_id, sum(len(string_split(value, chr(10))))::BIGINT AS n_lines, md5(string_agg(value, chr(10) ORDER BY page_id)) AS digest FROM v JOIN ok USING (book) GROUP BY book""")
def published_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that pass the gate, published as text and read back from the marked version."""
    pages = table(spark, sf_dir, "pages")
    book = book_of(F.col("url"))
    passed = C.publishable(_quality(spark, sf_dir, "present OR page_id % 2 = 0"), pages.select(book.alias("book")).where("char_length(book) % 3 = 0"))
    root = scratch_folder(spark)
    chapters = pages.select(book.alias("book_id"), F.col("page_id").alias("ord"), F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("chapter_id"), F.col("html").alias("text"))
    publish.publish(chapters, passed.select(F.col("book").alias("book_id")), root, "v1")
    lines = publish.published(spark, root, "v1")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("book_id").agg(F.count("*").alias("n_lines"), F.md5(whole.cast("binary")).alias("digest"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type FROM events),
s AS (SELECT *, CASE WHEN n <= 4 OR event_id % 3 = 0 THEN 0 ELSE n * 2 END AS given FROM e),
a AS (SELECT *, count(nullif(given, 0)) OVER (PARTITION BY user_id ORDER BY n) AS anchor, coalesce(max(given) OVER (PARTITION BY user_id ORDER BY n), 0) AS known FROM s)
SELECT user_id::VARCHAR AS task, event_id, event_type AS kind, known + row_number() OVER (PARTITION BY user_id, anchor ORDER BY n) - CASE WHEN anchor = 0 THEN 0 ELSE 1 END AS seq FROM a""")
def event_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event logs as files: older arrays of the first four events of each task, then lines; events without a number are numbered on.

    Tasks share files, which name the task in each event: as many files as partitions, however many tasks there are.
    """
    root = scratch_folder(spark)
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task"), "event_id", F.col("event_type").alias("kind"))
    events = events.withColumn("n", F.row_number().over(Window.partitionBy("task").orderBy("event_id")))
    seq = F.when((F.col("n") <= 4) | (F.col("event_id") % 3 == 0), 0).otherwise(F.col("n") * 2).cast("long")
    json = F.to_json(F.struct("task", "event_id", "kind", seq.alias("seq")))
    old = events.where("n <= 4").select("task", "n", json.alias("json")).groupBy("task").agg(F.array_sort(F.collect_list(F.struct("n", "json"))).alias("x"))
    array = F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["json"]), ",\n"), F.lit("]"))
    old.select(array.alias("value")).write.option("lineSep", files.APART).text(f"{root}/arrays")
    events.where("n > 4").select(json.alias("value")).write.text(f"{root}/lines")  # the window leaves each task in one partition, in order
    return files.event_logs(spark, StructType.fromDDL("event_id long, kind string, seq long"), f"{root}/lines", f"{root}/arrays", files.APART)


@query("""WITH s AS (SELECT user_id, event_type, event_id FROM events), half AS (SELECT max(event_id) // 2 AS h FROM events)
SELECT user_id, event_type, max(event_id) AS seq FROM s, half WHERE event_id <= h GROUP BY user_id, event_type""")
def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a state table, then the older one restored by its place in the list."""
    root = scratch_folder(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"))
    half = (events.agg(F.max("seq")).first()[0] or 0) // 2
    for name, rows in (("auto-20260101-000000", events.where(F.col("seq") <= half)), ("manual-20260102-000000", events)):
        snapshots.write_snapshot({"progress": S.latest(rows, ["user_id", "event_type"], ["seq"])}, root, name)
    names = [r.name for r in snapshots.retained(snapshots.snapshots(spark, root)).collect()]  # seven at most
    return snapshots.restore(spark, root, names[-1])["progress"]


@query("""WITH p AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, CASE WHEN doc_id % 3 <> 0 THEN length(text) // 400 % 30 + 1 END AS k, lang FROM documents WHERE source IS NOT NULL),
t AS (SELECT book, page, k, CASE WHEN lang = 'en' THEN 'Chapter ' || k || ': Of things' ELSE '第' || k || '章 事物' END AS title FROM p WHERE k IS NOT NULL),
b AS (SELECT *, lag(title) OVER (PARTITION BY book ORDER BY page) AS before FROM t)
SELECT book, page, title, k AS ordinal FROM b WHERE before IS DISTINCT FROM title""")
def heading_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter headings found among the lines of pages, repeats of a title left out."""
    k = (F.floor(F.char_length("text") / 400) % 30 + 1).cast("string")
    title = F.when(F.col("lang") == "en", F.concat(F.lit("Chapter "), k, F.lit(": Of things"))).otherwise(F.concat(F.lit("第"), k, F.lit("章 事物")))
    pages = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(
        F.col("source").alias("book"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("page"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("\n"), title, F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"),
    )
    return D.chapter_starts(pages, "book", "page").select("book", "page", "title", F.col("ordinal").cast("long").alias("ordinal"))


@query("SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'paused' WHEN 'P' THEN 'paused' ELSE 'completed' END AS status FROM orders")
def recovered_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks after a crash: what was running or queued is paused."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return S.recover(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status")))


@query("""WITH w AS (SELECT user_id, event_id, ['reader-font-size', 'sidebar-width', 'ai-sidebar-width', 'theme'][(event_id % 4 + 1)::INT] AS key, value * 10 AS v FROM events),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY event_id DESC) = 1)
SELECT user_id, key, CASE WHEN key = 'theme' THEN 'v' || event_id ELSE floor(least(CASE key WHEN 'reader-font-size' THEN 160 WHEN 'sidebar-width' THEN 560 ELSE 720 END, greatest(CASE key WHEN 'reader-font-size' THEN 80 WHEN 'sidebar-width' THEN 280 ELSE 340 END, v)) + 0.5)::BIGINT::VARCHAR END AS value FROM l""")
def saved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by key, numbers clamped and rounded, the last write of each reader and key."""
    e = F.col("event_id")
    key = F.get(F.array(*map(F.lit, ("reader-font-size", "sidebar-width", "ai-sidebar-width", "theme"))), (e % 4).cast("int"))
    value = F.when(e % 4 == 3, F.concat(F.lit("v"), e.cast("string"))).otherwise((F.col("value") * 10).cast("string"))
    writes = table(spark, sf_dir, "events").select("user_id", key.alias("key"), "event_id", value.alias("value"))
    return S.latest(writes.withColumn("value", N.setting_value(F.col("key"), F.col("value"))), ["user_id", "key"], ["event_id"]).select("user_id", "key", "value")


@query("""SELECT user_id AS book_id, event_type AS runtime, 's' || event_id AS session, event_id AS updated_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def saved_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker sessions by book and runtime, the last write of each."""
    e = F.col("event_id")
    writes = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.col("event_type").alias("runtime"), e.alias("updated_at"), F.concat(F.lit("s"), e.cast("string")).alias("session"))
    return S.latest(writes, ["book_id", "runtime"], ["updated_at"])


@query("""WITH d AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 16 ELSE 2048 END)::BIGINT AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024 + 0.000001) || ' KB' ELSE printf('%.1f', n / 1048576 + 0.000001) || ' MB' END AS size FROM d""")
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of texts as shown in lists."""
    k = F.col("doc_id") % 3
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * F.when(k == 0, 1).when(k == 1, 16).otherwise(2048)
    return table(spark, sf_dir, "documents").select("doc_id", K.byte_count(n).alias("size"))
