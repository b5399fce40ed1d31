"""Repair of the structure of conversations: the cheapest edits that give ``(s?(ua)+)?``, s, u and a being first letters of roles.

Windows over each conversation, in order of turns, flag the faults of its rows (the first that fits counts): ``blank``, without
anything but white space; ``duplicate``, with role and text of an earlier row; ``truncated``, not ended by a full
stop, exclamation or question mark. Turns are then collected, sorted, and folded by ``aggregate``. The
fold carries four (cost, audit) structs: the cheapest way to have read nothing yet, a system turn, a user turn
or an assistant turn. A row is kept, given another role or deleted, and turns are inserted between; each step takes the least
struct, so that equal costs go to the least audit. No two ways of equal cost have audits of which one begins the
other (what follows would be inserts only, which cost), so the least way to a state stays least whatever comes after.

The audit says everything: letter for letter K(eep), R(erole), D(elete), I(nsert). ``repaired`` reads it back.
One shuffle, by conversation; a conversation is folded whole, its audit being one string, so it must fit in one task.

Cases: null roles and texts are one space (so a blank text); turns of equal number are ordered by role, then text, null
numbers first; the rows of the null conversation are one conversation; an empty table gives no rows; other columns are
ignored. Roles are never trimmed; a role that starts with another letter can't be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import running_sums

#: Costs of the edits, what a truncated row that stays costs, and what repaired roles are called.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
USER, ASSISTANT = "user", "assistant"
#: White space and sentence ends of the rules.
VISIBLE, SENTENCE_END = r"[^\x20\x09-\x0D]", r"[.!?]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
#: Above every cost.
_NEVER = 1 << 50


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copy, gone``: every row after the damage that crc32 of ``conv:turn`` deals it; dropped rows are marked ``gone``.

    Nulls are one space, but for the numbers of conversations and turns themselves.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(or_space(conv), F.lit(":"), or_space(turn)).cast("binary")), F.lit(20))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, F.lit(USER)).otherwise(or_space(role)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(or_space(text), SENTENCE_END, "")).otherwise(or_space(text)).alias("text"),
        (kind == 0).alias("gone"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("copies").alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copy, gone) with ``place`` in its conversation, ``fault`` and ``illegal``, dealt by conversation.

    ``illegal`` marks a row that may not follow the one before: anything but su, ua and au.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    whole = Window.partitionBy("conv_id", "gone")  # dropped rows are no part of a conversation
    in_order = whole.orderBy(*order)
    placed = rows.repartition("conv_id").withColumn("place", F.row_number().over(in_order)).withColumn("before", F.lag(F.left("role", F.lit(1))).over(in_order))
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("place"))
    fault = (
        F.when(~F.col("text").rlike(VISIBLE), "blank").when(F.col("again") > 1, "duplicate")
        .when(~F.col("text").rlike(_ENDED), "truncated")
    )
    pair = F.concat("before", F.left("role", F.lit(1)))
    return placed.withColumn("again", again).withColumn("fault", fault).withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))).drop("again", "before")


def _plus(way: Column, cost: Column | int, letter: str) -> Column:
    return F.struct((way["cost"] + cost).alias("cost"), F.concat(way["audit"], F.lit(letter)).alias("audit"))


def _inserted(ways: list[Column]) -> list[Column]:
    """The four ways after what may be inserted: a user turn, an assistant turn, or both."""
    nothing, system, user, assistant = ways
    user = F.least(user, _plus(F.least(nothing, system, assistant), INSERT, "I"))
    return [nothing, system, user, F.least(assistant, _plus(user, INSERT, "I"))]


def _names(ways: list[Column]) -> Column:
    return F.struct(*[w.alias(n) for w, n in zip(ways, ("nothing", "system", "user", "assistant"), strict=True)])


def _each(state: Column) -> list[Column]:
    return [state[n] for n in ("nothing", "system", "user", "assistant")]


def _bind(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _step(state: Column, row: Column) -> Column:
    """The four ways after one more row (initial, must go, extra cost if it stays)."""
    never = F.struct(F.lit(_NEVER).cast("long").alias("cost"), F.lit("").alias("audit"))

    def after(ready: Column) -> Column:
        nothing, system, user, assistant = _each(ready)
        before_user = F.least(nothing, system, assistant)
        stays = lambda way, letter: F.when(~row["must_go"] & (row["initial"] == letter), _plus(way, row["extra"], "K")).otherwise(never)
        named = lambda way: F.when(~row["must_go"], _plus(way, row["extra"] + REROLE, "R")).otherwise(never)
        gone = lambda way: _plus(way, DELETE, "D")
        return _names([
            gone(nothing), F.least(gone(system), stays(nothing, "s")), F.least(gone(user), stays(before_user, "u"), named(before_user)),
            F.least(gone(assistant), stays(user, "a"), named(user)),
        ])

    return _bind(_names(_inserted(_each(state))), after)


def cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest repair of an array of (initial, must_go, extra)."""
    way = lambda cost: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("audit"))

    def finish(state: Column) -> Column:
        nothing, _, _, assistant = _inserted(_each(state))
        return F.least(nothing, assistant)

    return F.aggregate(turns, _names([way(0), way(_NEVER), way(_NEVER), way(_NEVER)]), _step, finish)


def repaired(turns: Column, audit: Column) -> Column:
    """The turns (role, text) that an audit makes of an array of (role, text).

    Every row of the conversation is one letter of the audit that isn't I, with the inserts before it. How many turns were
    put out before says whose turn it is, counted from the first user turn.
    """
    tokens = F.regexp_extract_all(audit, F.lit("I*[KRD]"), 0)
    made = lambda token: F.char_length(token) - F.when(F.endswith(token, F.lit("D")), 1).otherwise(0)
    name = lambda at: F.when(at % 2 == 0, F.lit(USER)).otherwise(F.lit(ASSISTANT))
    some = F.filter(F.zip_with(tokens, turns, lambda t, x: F.struct(t.alias("t"), x["role"].alias("role"))), lambda x: x["t"] != "D")
    lead = F.coalesce((F.endswith(F.get(some, F.lit(0))["t"], F.lit("K")) & F.startswith(F.get(some, F.lit(0))["role"], F.lit("s"))).cast("int"), F.lit(0))

    def entries(x: Column, at: Column) -> Column:
        """What one token puts out: inserted turns, then its row."""
        none = F.array().cast("array<struct<role:string,text:string>>")
        n = F.regexp_count(x["token"], F.lit("I"))
        put = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(name(at + k).alias("role"), F.lit("").alias("text")))
        role = F.when(F.endswith(x["token"], F.lit("R")), name(at + n)).otherwise(x["role"])
        own = F.when(F.endswith(x["token"], F.lit("D")) | F.endswith(x["token"], F.lit("I")), none).otherwise(F.array(F.struct(role.alias("role"), x["text"].alias("text"))))
        return F.concat(put, own)

    tail = F.regexp_extract(audit, "I*$", 0)
    rows = F.concat(
        F.zip_with(tokens, turns, lambda t, x: F.struct(t.alias("token"), x["role"].alias("role"), x["text"].alias("text"))),
        F.when(tail != "", F.array(F.struct(tail.alias("token"), F.lit("").alias("role"), F.lit("").alias("text")))).otherwise(F.array().cast("array<struct<token:string,role:string,text:string>>")),
    )
    read = lambda xs: F.flatten(F.zip_with(xs, running_sums(F.transform(xs, lambda x: made(x["token"]))), lambda x, at: entries(x, F.pmod(at - lead, F.lit(2)))))
    return _bind(rows, read)


def repair(rows: DataFrame) -> DataFrame:
    """Each conversation of ``rows`` (conv_id, turn, role, text, copy, gone): what is wrong with it, the cheapest repair, and the repaired turns.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns``; a conversation whose rows are all gone has zeros and an empty audit.
    """
    marked = faults(rows).withColumn("here", ~F.col("gone"))
    one = F.struct(
        "place", "role", "text", F.left("role", F.lit(1)).alias("initial"), F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"),
        F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).alias("extra"),
    )
    turn = F.when(F.col("here"), F.col("turn"))
    grouped = marked.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.size(F.collect_set(turn)), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("here") & (F.col("fault") == f)).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if(F.col("here") & F.col("illegal")).alias("illegal"), F.array_sort(F.collect_list(F.when(F.col("here"), one))).alias("turns"),
    )
    solved = grouped.withColumn("way", cheapest(F.col("turns")))
    return solved.select(
        "conv_id", F.col("gaps").cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "way.cost", "way.audit", repaired(F.col("turns"), F.col("way.audit")).alias("turns")
    )


def digests(found: DataFrame) -> DataFrame:
    """``repaired_sha256`` in place of the turns: of ``role:text``, joined by line feeds."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).drop("turns")
