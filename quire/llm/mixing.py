"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every source gets a target: its share of all words by its weight, at most ``most`` times its own
size, what is cut off going to the others by weight (water-filling, solved in closed form over the
sources sorted by the level at which each fills up). A source gives complete epochs while its
target holds them; the rest is a fraction of one more epoch. For it every document has an
exponential key, -ln(u) / quality weight, and documents are taken in the order of their keys until
their running size reaches the rest; the last one is taken if its middle lies within.

The running sums never sort a whole source in one task: keys are dealt into ``BUCKETS`` ranges by
their probability, sums by range say which range holds the end, and only that range is sorted.

Quality weights are measured, not guessed: documents fall into cells by three statistics of the whole text, and a cell
weighs the share of its labelled documents that are good.

Cases: a null text has size 0; a null source is a source, the last one; sources whose size is 0 have
target 0; the key of a null id comes from its text; equal keys are ordered by id, then size; repeated rows
have equal keys and count one by one; weights below ``LEAST_WEIGHT`` count as that, above 1 as 1; labels of unknown or null ids
and null labels tell nothing; an empty table gives no rows; other columns are ignored.
One row a source is held in one task, so sources are to be millions at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import SPACED_WORD
from quire.plans.scratch import Scratch, materialise

BUCKETS = 4096
#: Fixed values of the cells: what counts as a symbol and as the end of a sentence, and how many steps each statistic has.
SYMBOL, SENTENCE_END = r"[0-9#$%&*+/<=>@^_`{|}~]", r"[.!?]"
STEPS = 10
#: Source tables up to this many rows are broadcast.
BROADCAST_SOURCES = 100_000


#: Quality weights are from here to 1; the ranges of keys stay even for them.
LEAST_WEIGHT = 0.05
#: The weight of documents in cells without labelled ones.
UNKNOWN = 0.5


def quality_cell(text: Column, size: Column) -> Column:
    """One of ``STEPS`` ** 3 cells, by characters a word, symbols a hundred characters (by twos) and sentence ends a hundred words (by twos)."""
    chars, words = F.greatest(F.char_length(text), F.lit(1)), F.greatest(size, F.lit(1))
    step = lambda x: F.least(F.floor(x), F.lit(STEPS - 1))
    cell = (step(F.char_length(text) / words) * STEPS + step(F.regexp_count(text, F.lit(SYMBOL)) * 50 / chars)) * STEPS + step(F.regexp_count(text, F.lit(SENTENCE_END)) * 50 / words)
    return F.coalesce(cell.cast("int"), F.lit(0))


def measured_weights(cells: DataFrame, labels: DataFrame, label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``cell, w``: the share of good documents among the labelled ones (doc_id, cell) of each cell, with one of either kind added; a row a cell at most."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col(label_id).alias("label_id"), F.col(label).cast("double").alias("label"))
    share = (F.sum("label") + 1.0) / (F.count("label") + 2.0)
    return cells.join(marked, F.col("doc_id") == F.col("label_id")).groupBy("cell").agg(F.greatest(share, F.lit(LEAST_WEIGHT)).alias("w"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: int = 3,
    seed: str = "mix",
    weight: Column | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row.

    Sources by code point take ``weights`` in turn. A document's quality weight is ``weight``, if it is given; else, with ``labels``
    (doc_id, quality 0 or 1), the measured share of good documents among those like it; else all weigh the same.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    part = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))).cast("binary")), 1, 12), 16, 10)
    u = (part.cast("double") + 0.5) / float(1 << 48)
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), u.alias("u"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), quality_cell(F.col(text), size).alias("cell"),
    )
    if weight is None and labels is not None:
        sized = materialise(sized.drop("w"))
        cells = Scratch(measured_weights(sized.select("doc_id", "cell"), labels))
        known = cells.df.select(F.col("cell").alias("c"), "w")  # STEPS ** 3 rows at most
        sized = sized.join(F.broadcast(known), F.col("cell") == F.col("c"), "left").withColumn("w", F.coalesce("w", F.lit(UNKNOWN)))
    # exp(-key) = u ** (1 / w): large for small keys. Its root spreads over (0, 1) without crowding for any weight.
    clamped = F.least(F.greatest(F.col("w"), F.lit(LEAST_WEIGHT)), F.lit(1.0))
    keyed = sized.select("doc_id", "source", "size", F.pow("u", 1.0 / clamped).alias("v"))
    base = materialise(keyed.withColumn("bucket", F.floor((1.0 - F.pow("v", F.lit(LEAST_WEIGHT))) * BUCKETS).cast("int")))

    sums = materialise(base.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    sources = sums.groupBy("source").agg(F.sum("n").alias("source_size"))
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", share).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    level = ranked.withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    filled = level.withColumn(
        "cut", F.coalesce(F.sum(most * F.col("source_size")).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("open_weight", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    tried = filled.withColumn("lambda", (F.col("total") - F.col("cut")) / F.col("open_weight"))
    solved = tried.withColumn(
        "solution", F.min(F.when(F.col("lambda") <= F.col("full_at"), F.struct("full_at", "lambda"))).over(Window.partitionBy())
    )
    target = F.when(F.col("full_at") <= F.col("solution.lambda"), (most * F.col("source_size")).cast("double")).otherwise(
        F.col("solution.lambda") * F.col("weight")
    )
    targets = solved.select("source", "source_size", target.alias("target")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    # The range in which each source's fraction ends, and the words before it.
    running = Window.partitionBy("source").orderBy("bucket")
    ranges = sums.withColumn("upto", F.sum("n").over(running))
    ends = (
        ranges.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .groupBy("s", "source_size", "target", "epochs", "rest")
        .agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")))).alias("end"))
    )
    ends = materialise(ends.select("s", "source_size", "target", "epochs", "rest", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before")))
    small = ends.count() <= BROADCAST_SOURCES
    rows = base.join(F.broadcast(ends) if small else ends, F.col("source").eqNullSafe(F.col("s")))
    clear = rows.where(F.col("end_bucket").isNull() | (F.col("bucket") != F.col("end_bucket"))).withColumn(
        "picked", F.when(F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")), 1).otherwise(0)
    )
    order = Window.partitionBy("source").orderBy(F.col("v").desc(), F.col("doc_id"), F.col("size")).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(F.col("bucket") == F.col("end_bucket")).withColumn("seen", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("picked", F.when(2 * F.col("seen") + F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)).drop("seen")
    return clear.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("picked"))).alias("taken")
    )
