"""Structured Streaming forms: tailing an event log, folding live state, upserting progress, catching up, windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from quire.operators.state import latest
from quire.streaming.keyed import KeyedTable

#: The state store that stateful operators in Python need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """The JSON lines that are appended to a folder; the checkpoint of the query is the reader's cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


class LiveState(StatefulProcessor):
    """Text so far, last phase that isn't blank and last sequence of a task; events at or before the last sequence are ignored, repeats within a batch too."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("live", "partial string, phase string, last_seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        partial, phase, last = self.state.get() if self.state.exists() else ("", None, 0)
        added: list[str] = []
        batch = pd.concat(list(rows))  # the rows of a key come in parts; their order counts over all of them
        batch = batch.assign(type=batch["type"].fillna(""), text=batch["text"].fillna("")).sort_values(["sequence", "type", "text"])
        for seq, kind, text in batch[["sequence", "type", "text"]].itertuples(index=False):
            if seq <= last:
                continue
            last = int(seq)
            if kind == "text_delta":
                added.append(text)
            elif kind:
                phase = kind
        partial += "".join(added)
        self.state.update((partial, phase, last))
        yield pd.DataFrame({"task_id": [key[0]], "partial": [partial], "phase": [phase], "last_seq": [last]})

    def close(self) -> None:
        pass


LIVE = "task_id string, partial string, phase string, last_seq long"


def live_state(events: DataFrame) -> DataFrame:
    """One updated row a task and batch, of events (task_id, sequence, type, text). Needs the RocksDB state store (``ROCKS``)."""
    rows = events.where("sequence IS NOT NULL AND task_id IS NOT NULL").select("task_id", F.col("sequence").cast("long").alias("sequence"), "type", "text")
    return rows.groupBy("task_id").transformWithStateInPandas(LiveState(), LIVE, "Update", "None")


def latest_by_key(events: DataFrame, key: str, order: str) -> DataFrame:
    """Running last-write-wins state, for a sink in complete or update mode."""
    rest = [c for c in events.columns if c not in (key, order)]
    best = events.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in (order, *rest)])


def upsert_to(events: DataFrame, table: KeyedTable, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Each batch becomes a delta of the table; a batch that is repeated after a failure counts once."""
    return events.writeStream.outputMode(mode).foreachBatch(lambda batch, batch_id: table.upsert(batch, batch_id)).option("checkpointLocation", checkpoint)


def with_snapshot(snapshot: DataFrame, delta: DataFrame, ident: str, final: tuple[str, ...] = ("completed", "stopped"), status: str = "status") -> DataFrame:
    """What a subscriber sees: the snapshot with newer rows laid over it, ended tasks taken out."""
    both = snapshot.withColumn("_v", F.lit(0)).unionByName(delta.withColumn("_v", F.lit(1)))
    return latest(both, [ident], ["_v"]).drop("_v").where(~F.col(status).isin(*final))


def retained_log(log: DataFrame, task: str, seq: str, keep: int) -> DataFrame:
    """The last ``keep`` events of each task by number, with ``_oldest``, the least number that is kept."""
    head = log.groupBy(task).agg(F.max(seq).alias("_head"))
    return log.join(head, task).where(F.col(seq) > F.col("_head") - keep).withColumn("_oldest", F.greatest(F.col("_head") - keep + 1, F.lit(1))).drop("_head")


def catch_up(polls: DataFrame, snapshots: DataFrame, log: DataFrame, keep: int, task: str = "task", seq: str = "seq") -> DataFrame:
    """What each poll is sent: ``poll, task, kind, seq, body``. ``polls`` (poll, task, cursor) may be a stream.

    A reader whose cursor is within the retained log gets the events behind it. One that lags (an event that it hasn't seen is no longer kept)
    or has no cursor yet gets the snapshot again, and the events behind the snapshot's version. ``snapshots`` has task,
    version, body, one row a task, of a version that the log goes on from; ``log`` has task, seq, body. A poll meets ``keep`` rows of the log at most.
    """
    kept = retained_log(log, task, seq, keep)
    oldest = kept.groupBy(task).agg(F.min("_oldest").alias("_oldest"))
    known = snapshots.select(task, F.col("version").alias("_version"), F.col("body").alias("_snapshot")).join(oldest, task)
    asked = polls.select("poll", task, "cursor").join(known, task)
    lags = F.col("cursor").isNull() | (F.col("cursor") < F.col("_oldest") - 1)
    judged = asked.withColumn("_lags", lags).withColumn("_from", F.when(F.col("_lags"), F.col("_version")).otherwise(F.col("cursor")))
    events = kept.groupBy(task).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col("body").alias("body")))).alias("_events"))  # ``keep`` a task at most
    joined = judged.join(events, task)
    whole = F.when(F.col("_lags"), F.array(F.struct(F.lit("snapshot").alias("kind"), F.col("_version").alias("seq"), F.col("_snapshot").alias("body")))).otherwise(
        F.array().cast("array<struct<kind:string,seq:bigint,body:string>>")
    )
    behind = F.transform(F.filter("_events", lambda e: e["seq"] > F.col("_from")), lambda e: F.struct(F.lit("event").alias("kind"), e["seq"].alias("seq"), e["body"].alias("body")))
    return joined.select("poll", task, F.inline(F.concat(whole, behind)))


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by kind in windows of event time; rows later than the watermark are dropped, repeats by id too."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), kind).count().select(F.col("window.start").alias("start"), kind, "count")


def drain(query: DataStreamWriter) -> StreamingQuery:
    """Process what is there, then stop."""
    running = query.trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def replay(rows: DataFrame, turn: str, turns: int, folder: str, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Feed a table to a streaming query in ``turns`` parts (the column ``turn`` from 0), the query being stopped and started anew from its checkpoint for each.

    ``start`` makes the query of the stream; it must name the same checkpoint every time.
    """
    schema = rows.drop(turn).schema
    for k in range(turns):
        rows.where(F.col(turn) == k).drop(turn).write.mode("append").parquet(folder)
        drain(start(rows.sparkSession.readStream.schema(schema).parquet(folder)))
