"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is a host and a path prefix with a verdict. It fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's path; the longest fitting rule (host plus
path) decides. Every URL is canonicalised to its host suffixes joined with the prefixes of its path
whose lengths occur in the rules. These keys are probed in the Bloom filter of the listed keys;
what passes is joined exactly with the rules, which removes the filter's false positives.

Cases: a null url, or one without ``://``, has an empty host and path and takes the default
verdict; repeated rows give repeated result rows; rules that share host and path are reduced to one
(block wins); rules with a null host, path or verdict are ignored; an empty rule table gives the
default everywhere; empty pages give no rows; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import bloom

#: The rules are broadcast up to this many; beyond it the join is shuffled.
BROADCAST_RULES = 200_000

def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has host, path (with its leading ``/``) and verdict (allow or block).
    """
    spark = pages.sparkSession
    listed = (
        rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("key", F.concat("host", "path"))
        .groupBy("key").agg(F.max(F.struct(F.char_length("path").alias("n"), "host", "path", "verdict")).alias("r"))
        .select("key", "r.verdict", F.xxhash64("key").alias("h"), F.col("r.n").alias("n"))
    )
    n_rules = listed.count()
    lengths = [r[0] for r in listed.select("n").distinct().orderBy("n").collect()]  # bounded by the longest path
    listed_bits = spark.sparkContext.broadcast(bloom.build(listed, n_rules))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.passes(listed_bits.value, h.to_numpy()))

    host, path = url_parts(F.col("_url"))
    parts = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    n_path = F.char_length("path")
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n).cast("int") for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= n_path),
        lambda n: F.substr("path", F.lit(1), n),
    )
    # Rows with a key that may be listed go to the join; the head of every page goes past it, so that no row is joined on a null.
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    probed = parts.select("page_id", "host", "path", F.explode(keys).alias("key")).where(possible(F.xxhash64(F.col("key"))))
    side = listed.select("key", "verdict")
    fits = F.struct(F.char_length("key").alias("n"), "key", "verdict")
    found = probed.join(F.broadcast(side) if n_rules <= BROADCAST_RULES else side, "key").select("page_id", "host", "path", F.lit(0).alias("head"), fits.alias("r"))
    heads = parts.select("page_id", "host", "path", F.lit(1).alias("head"), F.lit(None).cast(found.schema["r"].dataType).alias("r"))
    best = heads.unionByName(found).groupBy("page_id", "host", "path").agg(F.max("r").alias("r"), F.sum("head").cast("int").alias("copies"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("r.key").alias("rule"),
        F.coalesce("r.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")
