"""A worker run over blocks in packed batches, with every batch checked and failed ones halved until single blocks are left.

Blocks are packed into batches by book. A caller's function runs in the tasks, over one whole batch at a time. What it
gives back for a batch is accepted if every block of the batch is there exactly once, no other is, and each text is valid for its
original (not blank, the same placeholders). A batch that isn't accepted, or in which the function raised, is
halved by characters (either half gets one block at least) and run again; a single block that fails keeps its own text and its problem. The driver only
learns whether batches are left: each turn is a written table, and later turns hold failed batches only.

Cases: a null text is an empty one; a book of no blocks has no rows; ids are to be unique in a book, as results are matched by them;
a worker is to give the same for the same batch, as tasks may run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.operators import ledger as L
from quire.plans.scratch import Scratch

#: Takes the (id, text) pairs of a batch and gives back such pairs; it may raise.
Worker = Callable[[list[tuple[str, str]]], list[tuple[str, str]]]


def run_batches(pending: DataFrame, worker: Worker) -> DataFrame:
    """``book, grp, ident, text, error``: what the worker gives for each batch (book, grp) of ``pending``; if it raises, one row with the error and no id."""
    schema = "book string, grp string, ident string, text string, error string"

    def batch(book: str, grp: str, items: list[tuple[str, str]]) -> list[tuple]:
        try:
            return [(book, grp, ident, text, None) for ident, text in worker(items)]
        except Exception as problem:  # whatever a worker raises fails its batch, not the job
            return [(book, grp, None, None, f"{type(problem).__name__}: {problem}"[:200])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["book", "grp", "ident", "text", "error"])

        key, held = None, []
        for b in batches:
            done: list[tuple] = []
            for book, grp, ident, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key is not None and key != (book, grp):
                    done += batch(*key, held)
                    held = []
                key = (book, grp)
                held.append((ident, text))
            yield from out(done)
        if key is not None:
            yield from out(batch(*key, held))

    rows = pending.select("book", "grp", "ident", F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("book", "grp").sortWithinPartitions("book", "grp", "ident").mapInArrow(run, schema)


def problems(pending: DataFrame, results: DataFrame) -> DataFrame:
    """``book, grp, problem`` of batches that aren't accepted, the least problem of each."""
    keys = ["book", "grp", "ident"]
    raised = results.where("error IS NOT NULL").select("book", "grp", F.lit("error").alias("problem"))
    given = results.where("error IS NULL")
    counted = L.exactly_once(pending, given, keys).select("book", "grp", "problem")
    both = given.join(pending.select(*keys, F.coalesce("text", F.lit("")).alias("original")), keys)
    invalid = both.where(~L.valid_translation(F.col("original"), F.col("text"))).select("book", "grp", F.lit("invalid").alias("problem"))
    return raised.unionByName(counted).unionByName(invalid).groupBy("book", "grp").agg(F.min("problem").alias("problem"))


def map_in_batches(
    blocks: DataFrame, worker: Worker, book: str = "book", ident: str = "block_id", text: str = "text",
    most: int = P.BATCH_BLOCKS, most_chars: int = P.BATCH_CHARS, turns: int | None = None,
) -> DataFrame:
    """``book, ident, grp, turn, text, problem`` for every block: the worker's text, or its own with a problem.

    ``grp`` is the batch's number and an l or r for each time that it was halved; ``turn`` counts from 1. After ``turns`` turns (by
    default as many as it takes, ``most`` at the utmost) blocks of batches that still fail have that batch's problem.
    """
    named = blocks.select(F.col(book).cast("string").alias("book"), F.col(ident).cast("string").alias("ident"), F.col(text).alias("text"))
    named = Scratch(named.withColumn("chars", (F.char_length("ident") + F.coalesce(F.char_length("text"), F.lit(0))).cast("long"))).df
    packed = L.batches(named.select("book", "ident", "chars"), "book", "ident", F.col("chars"), most, most_chars)
    pending = Scratch(named.join(packed.select("book", "ident", "batch"), ["book", "ident"]).withColumn("grp", F.format_string("%06d", "batch")).drop("batch")).df
    accepted: list[DataFrame] = []
    turn = 1
    while True:
        results = Scratch(run_batches(pending, worker)).df
        failed = Scratch(problems(pending, results)).df
        batch = ["book", "grp"]
        size = pending.groupBy(*batch).agg(F.count("*").alias("n"))
        judged = size.join(failed, batch, "left")
        over = F.lit(turn == turns) | (F.col("n") == 1)
        good = results.join(judged.where("problem IS NULL").select(*batch), batch).select(*batch, "ident", "text", F.lit(None).cast("string").alias("problem"))
        ended = pending.join(judged.where(F.col("problem").isNotNull() & over).select(*batch, "problem"), batch).select(*batch, "ident", "text", "problem")
        accepted.append(good.unionByName(ended).withColumn("turn", F.lit(turn)))
        again = pending.join(judged.where(F.col("problem").isNotNull() & ~over).select(*batch), batch)
        key: Column = F.concat_ws("/", "book", "grp")
        halved = L.halves(again.withColumn("_k", key), "_k", "ident", "chars", both=True)
        pending = Scratch(halved.select("book", "ident", "text", "chars", F.concat("grp", F.left("side", F.lit(1))).alias("grp"))).df
        if pending.isEmpty():
            break
        turn += 1
    whole = accepted[0]
    for part in accepted[1:]:
        whole = whole.unionByName(part)
    return whole.select("book", F.col("ident").alias(ident), "grp", "turn", "text", "problem")
