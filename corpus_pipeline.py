"""A training corpus from raw documents: five stages over the operators of ``quire.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared
scratch folder and reads it back as the next stage's documents. All stages but the last keep every column
of their input, whatever its name, and only take rows away or lines out of ``text``. Repeated rows get equal
results, but for near copies rows that share an id are one document; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, line_dedup, mixing, quality
from quire.llm.text import unused
from quire.plans.scratch import Scratch, free_shuffles
from quire.sources.tables import table

#: Documents below this quality score go; near copies are those of this similarity on shingles of this many words.
LEAST_SCORE, SHINGLE, PERCENT = 0.7, 5, 80
#: A line of more words is a window of its own in line dedup.
LONG_LINE = 50


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Every row is judged by its own text; a null text is judged as an empty one."""
    forest = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(spark, forest)(F.coalesce(F.col("text"), F.lit(""))) >= LEAST_SCORE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later occurrences of a repeated window cover; those of which nothing is left go.

    Besides three lines, a line of more than ``LONG_LINE`` words is a window, and so is a text of one or two lines. Null and
    empty texts have no lines and stay; of rows without an id the text decides which comes first.
    """
    n_lines, n_removed = unused(docs.columns, "n_lines", "n_removed")
    kept = docs.withColumnsRenamed({"n_lines": n_lines, "n_removed": n_removed})  # no-op for names that aren't there
    clean = line_dedup.dedup_lines(kept, long_words=LONG_LINE)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"\S")
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.where(left).withColumn("n_chars", chars).select(kept.columns).toDF(*docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group of near copies.

    Rows that share an id stay or go together; rows of a null id and texts without words link with nothing and stay.
    """
    found = jaccard.jaccard_components(docs, k=SHINGLE, percent=PERCENT)
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Every text is judged by itself, of a shared or null id too; null texts stay."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    ident, digest = unused(docs.columns, "id", "hash")
    bad = found.where("contaminated").select(F.col("doc_id").alias(ident), F.col("text_hash").alias(digest)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(digest))
    return docs.join(bad, same, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture of sources takes, one row for every row.

    Documents weigh by the share of good ones among labelled documents like them. A null source is a source; rows of a null id are keyed by their
    text; equal keys are ordered by id, then size; repeated rows count one by one.
    """
    return mixing.mix_sources(docs, labels=table(spark, sf_dir, "labels"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", keep_one_of_copies),
    ("decontamination", drop_contaminated),
    ("mix", mix),
]

#: The first stage is a trained model, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        done = Scratch(stage(spark, docs, sf_dir))
        if held:
            held.drop()
        docs, held = done.df, done
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
