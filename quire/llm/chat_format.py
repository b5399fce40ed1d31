"""Chat formatting with Spark expressions only.

A conversation becomes one string: its turns are collected as structs and sorted, adjacent
turns of one role are merged into blocks by array functions, and blocks are concatenated as
``<|im_start|>role\\ntext<|im_end|>\\n``. Inside a block the texts of merged turns are kept apart by
``<|im_sep|>``, so that the format can be read back turn by turn. Control strings inside texts and
roles are escaped: ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``; both steps reverse exactly.

Cases: a null text or role is empty; a null turn number sorts first; turns of equal number are
ordered by role, then text; repeated rows are turns of their own; rows of the null conversation
form one conversation; an empty table gives no rows; other columns are ignored. One conversation
is one output row, so a single conversation must fit in Spark's 2 GB limit for a string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_chat(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row a conversation: ``conv_id, blocks, formatted, loss_spans``.

    ``blocks`` are the merged turns (role, texts). ``loss_spans`` are (start, length) in code
    points, start from 1: the parts of ``formatted`` that count for the loss, one span a turn.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    bounded = sorted_turns.withColumn("starts", starts)
    block = lambda i, k: F.struct(
        F.get("turns", i)["role"].alias("role"),
        F.transform(
            F.slice("turns", i + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - i), lambda t: t["text"]
        ).alias("texts"),
    )
    merged = bounded.select("conv_id", F.transform("starts", block).alias("blocks"))
    # Per block its head, its escaped texts and whether they count; a block ends with END and a line feed.
    piece = lambda b: F.struct(
        F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n")).alias("head"),
        F.transform(b["texts"], escape).alias("texts"),
        b["role"].isin(*loss_roles).alias("loss"),
    )
    pieces = merged.withColumn("pieces", F.transform("blocks", piece))
    whole = lambda p: F.concat(p["head"], F.array_join(p["texts"], SEP), F.lit(END + "\n"))
    formatted = F.array_join(F.transform("pieces", whole), "")
    of = lambda p: F.transform(
        p["texts"],
        lambda t, k: F.struct(
            F.when(k == 0, F.char_length(p["head"])).otherwise(len(SEP)).alias("before"),
            F.char_length(t).alias("length"),
            F.when(k == F.size(p["texts"]) - 1, len(END) + 1).otherwise(0).alias("after"),
            p["loss"].alias("loss"),
        ),
    )
    spans = _bind(
        F.flatten(F.transform("pieces", of)),
        lambda x: F.filter(
            F.zip_with(x, _starts(x), lambda y, s: F.struct((s + 1).alias("start"), y["length"].alias("length"), y["loss"].alias("loss"))),
            lambda y: y["loss"],
        ),
    )
    return pieces.select(
        "conv_id", "blocks", formatted.alias("formatted"),
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
    )


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(numbers: Column, first: Column) -> Column:
    """``first`` plus the sums of what stands before each number."""
    return F.slice(F.aggregate(numbers, F.array(first), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n)), 1, F.size(numbers))


def _starts(pieces: Column) -> Column:
    """Where the text of each piece (before, length, after) starts, from 0.

    A running sum over an array appends to an array, so it is taken in runs of about the root of the
    length: no more than n * root(n) numbers are copied.
    """
    run = F.ceil(F.sqrt(F.size(pieces))).cast("int")
    runs = F.when(F.size(pieces) > 0, F.transform(F.sequence(F.lit(0), ((F.size(pieces) - 1) / run).cast("int")), lambda c: F.slice(pieces, c * run + 1, run)))
    size = lambda x: x["before"] + x["length"] + x["after"]
    sums = lambda rs: F.transform(rs, lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + size(x)))
    each = lambda rs: F.flatten(F.zip_with(rs, _fold(sums(rs), F.lit(0)), lambda r, at: _fold(F.transform(r, size), at)))
    return F.zip_with(pieces, _bind(F.coalesce(runs, F.array(pieces)), each), lambda x, at: at + x["before"])


def _pieces(formatted: Column) -> Column:
    """What a formatted string holds, text by text: role, text (both still escaped), and the characters around the text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)
    blocks = F.transform(
        parts,
        lambda p: F.struct(
            F.substring_index(p, "\n", 1).alias("role"),
            F.split(F.substr(p, F.instr(p, F.lit("\n")) + 1, F.char_length(p) - F.instr(p, F.lit("\n")) - len(END) - 1), r"<\|im_sep\|>", -1).alias("texts"),
        ),
    )
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                b["texts"],
                lambda t, k: F.struct(
                    b["role"].alias("role"),
                    t.alias("text"),
                    F.when(k == 0, F.char_length(b["role"]) + len(START) + 1).otherwise(len(SEP)).alias("before"),
                    F.char_length(t).alias("length"),
                    F.when(k == F.size(b["texts"]) - 1, len(END) + 1).otherwise(0).alias("after"),
                ),
            ),
        )
    )


def _turns(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.struct(unescape_role(p["role"]).alias("role"), unescape(p["text"]).alias("text")))


def read_back(formatted: Column) -> Column:
    """The turns that a formatted string holds: array of (role, text)."""
    return _turns(_pieces(formatted))


def under_mask(pieces: Column, spans: Column) -> Column:
    """The text under the spans, unescaped. Spans and pieces are sorted together, so each span meets the piece that starts where it does."""
    mark = lambda at, kind, text: F.struct(at.alias("at"), F.lit(kind).alias("kind"), text.alias("text"))
    found = F.zip_with(pieces, _starts(pieces), lambda p, s: mark(s + 1, 1, p["text"]))
    asked = F.transform(spans, lambda s: mark(s["start"], 0, F.lit(None).cast("string")))
    both = F.array_sort(F.concat(asked, found))
    meets = lambda all_: F.filter(all_, lambda x, i: (i > 0) & (x["kind"] == 1) & (F.get(all_, i - 1)["kind"] == 0) & (F.get(all_, i - 1)["at"] == x["at"]))
    return F.array_join(F.transform(_bind(both, meets), lambda x: unescape(x["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted strings say when read back: counts and digests of turns and of the loss mask."""
    flat = lambda p: F.array_join(F.transform(_turns(p), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = lambda p: F.struct(
        F.size(p).cast("long").alias("n_turns"), F.sha2(flat(p).cast("binary"), 256).alias("turns_sha256"), under_mask(p, F.col("loss_spans")).alias("loss")
    )
    return chats.select("conv_id", _bind(_pieces(F.col("formatted")), read).alias("r"), F.char_length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "r.n_turns", "r.turns_sha256", F.char_length("r.loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("r.loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
