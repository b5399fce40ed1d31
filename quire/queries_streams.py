"""Queries that run as streams: a table replayed in parts, the query being restarted from its checkpoint between them; and the worker over blocks."""

from __future__ import annotations

import hashlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators import documents as D
from quire.operators import mapper as M
from quire.plans.scratch import scratch_folder
from quire.register import filer
from quire.sources.tables import table
from quire.streaming import events as E
from quire.streaming.keyed import KeyedTable

QUERIES: dict = {}
ORACLES: dict = {}
query = filer(QUERIES, ORACLES)

TURNS = 3


_TASK_EVENTS = f"""te AS (SELECT user_id::VARCHAR AS task_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type, value FROM events),
tf AS (SELECT task_id, CASE WHEN event_id % 10 = 3 THEN greatest(1, n - 2) ELSE n END AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'text_delta' ELSE event_type END AS type,
  CASE WHEN event_type IN ('view', 'click') THEN event_type || ':' || event_id || ';' ELSE '' END AS text, ((event_id * {TURNS}) // (SELECT max(event_id) + 1 FROM events))::INT AS turn FROM te)"""


def _task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of tasks in three parts; every tenth comes late, under a number that another one has already."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    last = rows.agg(F.max("event_id").alias("last")).first()["last"] or 0
    delta = F.col("event_type").isin("view", "click")
    return rows.select(
        F.col("user_id").cast("string").alias("task_id"), F.when(F.col("event_id") % 10 == 3, F.greatest(F.lit(1), F.col("n") - 2)).otherwise(F.col("n")).cast("long").alias("sequence"),
        F.when(delta, "text_delta").otherwise(F.col("event_type")).alias("type"), F.when(delta, F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"), F.lit(";"))).otherwise("").alias("text"),
        F.floor(F.col("event_id") * TURNS / F.lit(last + 1)).cast("int").alias("turn"),
    )


@query(f"""WITH {_TASK_EVENTS}, seen AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY task_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tf),
once AS (SELECT * FROM seen WHERE seq > before QUALIFY row_number() OVER (PARTITION BY task_id, turn, seq ORDER BY type, text) = 1)
SELECT task_id, coalesce(string_agg(text, '' ORDER BY seq) FILTER (type = 'text_delta'), '') AS partial, arg_max(type, seq) FILTER (type <> 'text_delta') AS phase, max(seq)::BIGINT AS last_seq FROM once GROUP BY task_id""")
def live_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of task events as a stateful stream into a keyed table, over three runs from one checkpoint."""
    folder = scratch_folder(spark)
    schema = StructType.fromDDL(E.LIVE)
    live = KeyedTable(spark, f"{folder}/live", schema, ["task_id"], "last_seq", compact_after=2)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.ROCKS)
    try:
        E.replay(_task_events(spark, sf_dir), "turn", TURNS, f"{folder}/in", lambda stream: E.upsert_to(E.live_state(stream), live, f"{folder}/checkpoint", "update"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return live.read()


@query("""WITH s AS (SELECT user_id AS book_id, event_type AS chapter_id, event_id AS seq, value, event_id % 9 = 0 AS gone FROM events)
SELECT book_id, chapter_id, seq, value FROM s QUALIFY row_number() OVER (PARTITION BY book_id, chapter_id ORDER BY seq DESC) = 1 AND NOT gone""")
def progress_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress saves streamed into a keyed table that is merged when read: last write wins, some saves delete."""
    folder = scratch_folder(spark)
    e = F.col("event_id")
    saves = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.col("event_type").alias("chapter_id"), e.alias("seq"), "value", (e % 9 == 0).alias("gone"), F.pmod(F.xxhash64("event_id"), F.lit(TURNS)).alias("turn"))
    kept = KeyedTable(spark, f"{folder}/progress", saves.drop("turn").schema, ["book_id", "chapter_id"], "seq", "gone", compact_after=2)
    E.replay(saves, "turn", TURNS, f"{folder}/in", lambda stream: E.upsert_to(stream, kept, f"{folder}/checkpoint"))
    return kept.read().drop("gone")


_KEEP = 12
_LOG = "lg AS (SELECT user_id AS task, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type AS body, value FROM events), hd AS (SELECT task, max(seq) AS head FROM lg GROUP BY task)"


@query(f"""WITH {_LOG}, sn AS (SELECT task, head - head % 5 AS version, (SELECT string_agg(body, ',' ORDER BY seq) FROM lg l WHERE l.task = hd.task AND l.seq <= hd.head - hd.head % 5 AND l.seq > hd.head - hd.head % 5 - 3) AS body, head FROM hd),
po AS (SELECT event_id AS poll, task, CASE WHEN value < 2 THEN NULL ELSE seq - 1 END AS cursor FROM lg),
ju AS (SELECT po.*, version, sn.body AS snapshot, cursor IS NULL OR cursor < greatest(head - {_KEEP} + 1, 1) - 1 AS lags FROM po JOIN sn USING (task))
SELECT poll, task, 'snapshot' AS kind, version AS seq, snapshot AS body FROM ju WHERE lags
UNION ALL SELECT poll, task, 'event', lg.seq, lg.body FROM ju JOIN lg USING (task) JOIN hd USING (task) WHERE lg.seq > head - {_KEEP} AND lg.seq > CASE WHEN lags THEN version ELSE cursor END""")
def subscriber_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls as a stream against a snapshot and a log that keeps the last events: whoever lags gets the snapshot again."""
    from pyspark.sql import Window

    folder = scratch_folder(spark)
    numbered = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("task"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"), F.col("event_type").alias("body"), "value")
    log = numbered.select("task", "seq", "body")
    heads = log.groupBy("task").agg(F.max("seq").alias("head")).select("task", (F.col("head") - F.col("head") % 5).alias("version"))
    recent = log.join(heads, "task").where((F.col("seq") <= F.col("version")) & (F.col("seq") > F.col("version") - 3)).groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda x: x["body"]), ",").alias("body"))
    snapshots = heads.join(recent, "task", "left")
    polls = numbered.select(F.col("event_id").alias("poll"), "task", F.when(F.col("value") >= 2, F.col("seq") - 1).alias("cursor"), F.pmod(F.xxhash64("event_id"), F.lit(TURNS)).alias("turn"))
    sent = lambda stream: E.catch_up(stream, snapshots, log, _KEEP).writeStream.format("parquet").option("path", f"{folder}/sent").option("checkpointLocation", f"{folder}/checkpoint")
    E.replay(polls, "turn", TURNS, f"{folder}/in", sent)
    return spark.read.parquet(f"{folder}/sent")


def _worker(batch: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Says what it was given; fails on some texts, leaves some out, gives some twice, others blank."""
    if any("#" in text for _, text in batch):
        raise ValueError("marked text")
    out = []
    for ident, text in batch:
        if text.endswith(("?", "!")):
            continue
        out += [(ident, "  " if len(text) % 29 == 0 else f"{len(text)}:{hashlib.md5(text.encode()).hexdigest()}")] * (2 if len(text) % 31 == 0 else 1)
    return out


@query("""WITH RECURSIVE e AS (SELECT source AS book, doc_id::VARCHAR AS block_id, coalesce(text, '') AS text, length(doc_id::VARCHAR) + length(coalesce(text, '')) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id::VARCHAR) AS n FROM documents),
b AS (SELECT book, block_id, text, chars, n, 1 AS batch, 1 AS size, chars AS total FROM e WHERE n = 1
  UNION ALL SELECT e.book, e.block_id, e.text, e.chars, e.n, CASE WHEN b.size >= 80 OR b.total + e.chars > 12000 THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.size >= 80 OR b.total + e.chars > 12000 THEN 1 ELSE b.size + 1 END, CASE WHEN b.size >= 80 OR b.total + e.chars > 12000 THEN e.chars ELSE b.total + e.chars END
  FROM b JOIN e ON e.book IS NOT DISTINCT FROM b.book AND e.n = b.n + 1),
k AS (SELECT book, block_id, chars, batch, text, CASE WHEN contains(text, '#') THEN 'error' WHEN regexp_matches(text, '[?!]$') THEN 'missing' WHEN length(text) % 29 = 0 AND length(text) % 31 = 0 THEN 'duplicate'
  WHEN length(text) % 29 = 0 THEN 'invalid' WHEN length(text) % 31 = 0 THEN 'duplicate' END AS bad FROM b),
r AS (SELECT 1 AS turn, book, printf('%06d', batch) AS grp, block_id, chars, bad FROM k
  UNION ALL SELECT turn + 1, book, grp || CASE WHEN before IS NULL OR before < whole // 2 AND NOT ends THEN 'l' ELSE 'r' END, block_id, chars, bad FROM (
    SELECT *, sum(chars) OVER (PARTITION BY book, grp ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(chars) OVER (PARTITION BY book, grp) AS whole,
      lead(block_id) OVER (PARTITION BY book, grp ORDER BY block_id) IS NULL AS ends, count(bad) OVER (PARTITION BY book, grp) AS n_bad, count(*) OVER (PARTITION BY book, grp) AS n FROM r) WHERE n_bad > 0 AND n > 1),
z AS (SELECT book, block_id, arg_max(grp, turn) AS grp, max(turn) AS turn FROM r GROUP BY book, block_id)
SELECT z.book, z.block_id, z.grp, z.turn, CASE WHEN bad IS NULL THEN length(text) || ':' || md5(text) ELSE text END AS text, bad AS problem FROM z JOIN k ON k.block_id = z.block_id AND k.book IS NOT DISTINCT FROM z.book""")
def mapped_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").cast("string").alias("block_id"), F.coalesce("text", F.lit("")).alias("text"))
    return M.map_in_batches(docs, _worker)


@query(r"""WITH RECURSIVE e AS (SELECT user_id AS book, event_id AS i, regexp_extract(props, '"k":\s*([0-9]+)', 1)::BIGINT AS o FROM events),
c AS (SELECT book, i AS s, i, o, 1 AS n FROM e UNION SELECT c.book, c.s, e.i, e.o, c.n + 1 FROM c JOIN e ON e.book = c.book AND e.i > c.i AND e.o = c.o + 1),
f AS (SELECT book, s, max(n) AS n FROM c GROUP BY book, s), best AS (SELECT book, arg_max(s, (n, s)) AS i FROM f GROUP BY book),
w AS (SELECT e.* FROM e JOIN best USING (book, i) UNION ALL SELECT book, i, o FROM (
  SELECT e.*, row_number() OVER (PARTITION BY e.book ORDER BY e.i) AS k FROM w JOIN e ON e.book = w.book AND e.i > w.i AND e.o = w.o + 1) WHERE k = 1)
SELECT book, i AS "at", o AS ordinal FROM w""")
def longest_chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("ordinal"))
    return D.longest_chain_rows(rows, "book", "at", "ordinal")
