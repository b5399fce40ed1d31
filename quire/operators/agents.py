"""Logs of external text workers: lines of JSON become typed events, answers, failures and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import patterns as P
from quire.functions import text as X


def _get(c: str, path: str) -> Column:
    return F.get_json_object(c, path)


def rpc_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Method dispatch of JSON-RPC lines to ``type, text, name``; other lines are left out."""
    method = _get(line, "$.method")
    kind = (
        F.when(method == "item/agentMessage/delta", "text_delta").when(method == "turn/started", "phase")
        .when((method == "item/started") & _get(line, "$.params.item.type").isin("commandExecution", "mcpToolCall", "webSearch", "fileChange"), "tool_started")
        .when((method == "item/completed") & (_get(line, "$.params.item.type") == "agentMessage"), "message")
        .when(method == "item/completed", "tool_finished").when(method == "turn/completed", "completed").when(method == "error", "error")
    )
    text = F.coalesce(_get(line, "$.params.delta"), _get(line, "$.params.item.text"), _get(line, "$.params.error.message"))
    rows = lines.withColumn("type", kind).withColumn("text", text).withColumn("name", _get(line, "$.params.item.type")).withColumn("status", _get(line, "$.params.turn.status"))
    return rows.where("type IS NOT NULL").withColumn("type", F.when((F.col("type") == "completed") & (F.coalesce("status", F.lit("completed")) != "completed"), "error").otherwise(F.col("type")))


def final_answer(events: DataFrame, task: str, order: str) -> DataFrame:
    """The deltas of a task in order; where there are none, its last whole message."""
    deltas = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "text_delta", F.struct(order, "text")))), lambda x: x["text"]), "")
    last = F.max_by("text", F.when(F.col("type") == "message", F.col(order)))
    return events.groupBy(task).agg(F.coalesce(F.nullif(deltas, F.lit("")), last).alias("answer"), F.max(F.col("type") == "error").alias("failed"))


def _message_text(line: str) -> Column:
    """The text of all text blocks of a message (a block without a type counts as one); null if there is none."""
    blocks = F.from_json(_get(line, "$.message.content"), "array<struct<type string, text string>>")
    texts = F.filter(blocks, lambda b: (F.coalesce(b["type"], F.lit("text")) == "text") & b["text"].isNotNull())
    return F.nullif(F.array_join(F.transform(texts, lambda b: b["text"]), ""), F.lit(""))


def stream_events(lines: DataFrame, task: str, order: str, line: str = "line") -> DataFrame:
    """Stream-JSON lines: whole messages count only where no delta came before, a result only where nothing did."""
    kind = _get(line, "$.type")
    delta = _get(line, "$.event.delta.text")
    rows = lines.select(task, order, kind.alias("type"), delta.alias("delta"), _message_text(line).alias("message"), _get(line, "$.result").alias("result"))
    before = Window.partitionBy(task).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seen", F.coalesce(F.max(F.col("delta").isNotNull()).over(before), F.lit(False)))
    rows = rows.withColumn("said", F.when(F.col("delta").isNotNull(), F.col("delta")).when((F.col("type") == "assistant") & ~F.col("seen"), F.col("message")))
    any_ = F.coalesce(F.max(F.trim("said") != "").over(before), F.lit(False))
    return rows.withColumn("text", F.when((F.col("type") == "result") & ~any_, F.col("result")).otherwise(F.col("said"))).where("text IS NOT NULL").select(task, order, "text")


def tool_spans(lines: DataFrame, task: str, order: str) -> DataFrame:
    """Tool starts and stops paired by block index: ``task, idx, name, started, stopped``. ``lines`` has type, idx, name."""
    w = Window.partitionBy(task, "idx").orderBy(order)
    rows = lines.where(F.col("type").isin("start", "stop")).withColumn("then", F.lead("type").over(w)).withColumn("at", F.lead(order).over(w))
    return rows.where("type = 'start'").select(task, "idx", "name", F.col(order).alias("started"), F.when(F.col("then") == "stop", F.col("at")).alias("stopped"))


def tool_states(rows: DataFrame, task: str, tool: str, order: str, state: str) -> DataFrame:
    """Each tool once: where it starts (or is first seen) and how it ends; rows behind the first end of the task are left out."""
    stop = F.min(F.when(F.col("type").isin("step_finish", "error"), F.col(order))).over(Window.partitionBy(task))
    kept = rows.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).where(F.col(tool).isNotNull())
    ended = F.col(state).isin("completed", "error")
    return kept.groupBy(task, tool).agg(F.min(order).alias("started"), F.min(F.when(ended, F.col(order))).alias("ended"), F.min_by(state, F.when(ended, F.col(order))).alias("result"))


def joined_parts(lines: DataFrame, task: str, order: str, line: str = "line") -> DataFrame:
    """The text parts of a one-shot log, in order."""
    text = F.when(_get(line, "$.type") == "text", _get(line, "$.part.text"))
    return lines.groupBy(task).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order, text.alias("t"))))), lambda x: x["t"]), "").alias("answer"))


def first_known(lines: DataFrame, task: str, order: str, paths: dict[str, str], line: str = "line") -> DataFrame:
    """The first value of each JSON path in a log, such as the model or the session."""
    return lines.groupBy(task).agg(*[F.min_by(_get(line, p), F.when(_get(line, p).isNotNull(), F.col(order))).alias(n) for n, p in paths.items()])


def visible_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines without private reasoning; a structured result that isn't valid JSON is marked."""
    kind = _get(line, "$.type")
    shown = lines.where(F.coalesce(~kind.isin("thinking", "reasoning"), F.lit(True)))
    return shown.withColumn("invalid", F.try_parse_json(line).isNull() & F.col(line).rlike(r"^\s*[{\[]"))


def aborted_at(lines: DataFrame, task: str, order: str, invalid: str = "invalid", most: int = 2) -> DataFrame:
    """Where a task has had ``most`` invalid outputs: ``task, at``."""
    n = F.sum(F.col(invalid).cast("int")).over(Window.partitionBy(task).orderBy(order))
    return lines.withColumn("_n", n).where(F.col("_n") >= most).groupBy(task).agg(F.min(order).alias("at"))


def failure_detail(logs: DataFrame, stderr: str = "stderr", stdout: str = "stdout", longest: int = 1500) -> DataFrame:
    """The end of the error stream, else the last result with an error, else the last line that isn't blank."""
    rows = F.filter(F.split(stdout, "\n"), lambda x: F.trim(x) != "")
    told = F.filter(F.transform(rows, lambda x: F.coalesce(F.get_json_object(x, "$.error"), F.get_json_object(x, "$.result"), F.get_json_object(x, "$.message"))), lambda x: x.isNotNull())
    detail = F.coalesce(F.nullif(F.trim(stderr), F.lit("")), F.try_element_at(told, F.lit(-1)), F.try_element_at(rows, F.lit(-1)), F.lit(""))
    return logs.withColumn("detail", F.right(detail, F.lit(longest)))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def summary(c: Column, most: int = 80) -> Column:
    """What the last ``most`` lines of a log say: by the type of each JSON line, other lines as they are; a fixed text if that is nothing."""
    lines = F.split(F.regexp_replace(c, r"\n\z", ""), r"\r?\n", -1)
    tail = F.slice(lines, F.greatest(F.size(lines) - most + 1, F.lit(1)), F.lit(most))

    def said(x: Column) -> Column:
        kind = F.get_json_object(x, "$.type")
        blocks = F.transform(F.from_json(F.get_json_object(x, "$.message.content"), "array<struct<text string>>"), lambda b: _trimmed(b["text"]))
        one = (
            F.when(F.try_parse_json(x).isNull(), _trimmed(x)).when((kind == "system") & (F.get_json_object(x, "$.subtype") == "init"), P.LOG_INIT)
            .when(kind == "stream_event", _trimmed(F.get_json_object(x, "$.event.delta.text"))).when(kind == "item.completed", _trimmed(F.get_json_object(x, "$.item.text")))
        )
        for name, text in P.LOG_SAID.items():
            one = one.when(kind == name, text)
        return F.when(F.coalesce(kind == "assistant", F.lit(False)), F.coalesce(blocks, F.array().cast("array<string>"))).otherwise(F.array(one))

    told = F.filter(F.flatten(F.transform(tail, said)), lambda x: x != "")
    return F.when(F.size(told) > 0, F.array_join(told, "\n")).otherwise(P.LOG_NOTHING)


def structured_results(lines: DataFrame, task: str, order: str, schema: str, line: str = "line") -> DataFrame:
    """``task, session, model, answer, structured``: the first session and model of a log, its last answer, and its result of ``schema``.

    A result line's ``structured_output`` replaces what was known, even if it isn't of the schema; where nothing is known, the last answer so far
    is read as JSON. So the result is that of the last line with an output, or else the first answer from there on that can be read.
    """
    known = first_known(lines, task, order, {"session": "$.session_id", "model": "$.model"}, line)
    read = lambda c: F.when(F.from_json(c, schema).isNotNull() & (F.size(F.array_compact(F.array(*[F.from_json(c, schema)[n] for n in _names(schema)]))) > 0), F.from_json(c, schema))
    upto = Window.partitionBy(task).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(_get(line, "$.type") == "result").select(task, order, _get(line, "$.result").alias("said"), _get(line, "$.structured_output").alias("given"))
    rows = rows.withColumn("answer", F.last("said", ignorenulls=True).over(upto)).withColumn("from", F.max(F.when(F.col("given").isNotNull(), F.col(order))).over(Window.partitionBy(task)))
    value = F.coalesce(F.when(F.col("given").isNotNull(), read(F.col("given"))), read(F.col("answer")))
    after = F.col("from").isNull() | (F.col(order) >= F.col("from"))
    found = rows.groupBy(task).agg(F.max_by("answer", order).alias("answer"), F.min_by(value, F.when(after & value.isNotNull(), F.col(order))).alias("structured"))
    return known.join(found, task, "left").select(task, "session", "model", F.coalesce("answer", F.lit("")).alias("answer"), "structured")


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


def reports_network_failure(c: Column) -> Column:
    return X.contains_any(X.lower_ascii(c), P.NETWORK)


def runtimes(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-in and custom workers with their abilities; arguments that don't parse are none."""
    args = F.coalesce(F.from_json("arguments_json", "array<string>"), F.array().cast("array<string>"))
    own = custom.select("id", "label", "command", args.alias("arguments"), F.lit("custom").alias("kind"))
    both = builtin.select("id", "label", "command", F.array().cast("array<string>").alias("arguments"), F.lit("builtin").alias("kind")).unionByName(own)
    return both.withColumn("streams", F.col("kind") == "builtin").withColumn("translates", F.lit(True))


def runtime_error(command: Column, arguments: Column) -> Column:
    """Custom workers need an absolute path, at most 32 arguments of at most 1,024 bytes each."""
    return F.coalesce(F.when(~command.startswith("/"), "path"), F.when(F.size(arguments) > 32, "too-many-arguments"), F.when(F.exists(arguments, lambda a: F.octet_length(a) > 1024), "argument-size"))


def question_error(c: Column) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "blank").when(F.char_length(F.trim(c)) > 20_000, "too-long")
