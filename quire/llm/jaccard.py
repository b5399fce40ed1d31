"""N-gram Jaccard join over a token-group matrix.

A document is the set of its distinct word shingles. Two documents link if the Jaccard similarity
of their sets reaches a threshold, and the operator returns connected components of links.

1. Equal sets are one class; its least id stands for it.
2. Groups. Every set puts its least tokens (by hash, so in one order for all) under an index. Of these two
   linked sets share a known number at least, so a set with fewer shared ones links with nothing and
   is done. The others name the leader they share most tokens with; sets that leaders hold
   together are a family, cut into groups of about ``GROUP`` members and ``TOKENS`` tokens.
3. Matrix. A group's row of the matrix is the union of its members' tokens. Every set asks its own group and
   the first group of its family: the tokens that it has in the union bound its overlap with every
   member, and only sets and groups whose bound reaches the threshold are opened and compared exactly.
   Links found make components.
4. What may still link: a link between two components needs tokens that both have, so a token within one
   component counts for nothing, and a set with too few other tokens is done. The number of the others
   also bounds the size of sets it may link with. This is repeated until it takes few sets away or few are left.
5. The sets left, mostly none, are grouped again, and groups ask groups: pairs of groups of different
   components that share a token of their members' prefixes are bounded and opened as in 3.

Work by token is linear, and as a document has a token once, no token has more than a small share of
the rows of an index, however many documents share it. What is joined with one another are groups, never members, and pairs
inside a group are never listed: a group gives a spanning tree of its links. Comparisons are exact on
64-bit shingle hashes. Cases: a text of fewer words than a shingle is one shingle; a text without
words (or null) has an empty set and links with nothing; rows of a null id are judged alone
(component null); rows that share an id are one document with several sets; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import bloom
from quire.llm.components import connected
from quire.llm.groups import by_group
from quire.llm.shingles import Shingler, mix
from quire.plans.scratch import Scratch, free_shuffles

#: Members and tokens of a group, and sets that a worker remembers to skip equal ones.
GROUP, TOKENS, REMEMBERED = 256, 131_072, 200_000
#: Columns of the matrix that a comparison holds at a time, and sets that are compared without asking once more whether they may link.
COLUMNS, FEW = 16_384, 2_000
#: Rows (of a few numbers) of a side that is broadcast; beyond it both sides of the join are dealt by their key.
SENT = 500_000


def _sent(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= SENT else side


def least_common(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with every set that it links with, at least."""
    return -(-n * percent // 100)


def _spare(n: int, percent: int) -> int:
    return min(1 + n // 16, least_common(n, percent))


def indexed(n: int, percent: int) -> int:
    """How many of its least tokens a set of ``n`` puts under the index."""
    return min(n, n - least_common(n, percent) + _spare(n, percent))


def needed(n: int, percent: int) -> int:
    """How many indexed tokens it shares with every set that it links with, at least.

    Of ``c`` common tokens the k-th least is among the first n - c + k of either set.
    """
    return _spare(least_common(n, percent), percent)


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(tokens * np.uint64(0x8CB92BA72F3D8DD7 | 1)).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def _texts(b: pa.RecordBatch, name: str) -> list[bytes | None]:
    return pc.cast(b.column(b.schema.get_field_index(name)), pa.binary()).to_pylist()


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """``id, n, h1, h2`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            found = [(len(s), *_set_hash(s)) for s in shingler.sets(_texts(b, "text"))]
            n, h1, h2 = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["id", "n", "h1", "h2"])

    return rows.select("id", "text").mapInArrow(run, "id long, n long, h1 long, h2 long")


def _index(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``key, h, need`` for every indexed token of every set (by its hash ``h``), but for equal sets that a worker has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        met: set[int] = set()

        def batch(held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
            sizes = [len(k) for k, _, _ in held]
            hs, needs = (np.repeat(np.array(x, dtype=kind), sizes) for x, kind in (([h[1] for h in held], np.int64), ([h[2] for h in held], np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in held]).view(np.int64)), pa.array(hs), pa.array(needs)], ["key", "h", "need"])

        for b in batches:
            held, n = [], 0
            for s in shingler.sets(_texts(b, "text")):
                if not len(s) or (h := _set_hash(s)[0]) in met:
                    continue
                if len(met) < REMEMBERED:
                    met.add(h)
                keys = s[: indexed(len(s), percent)]
                held.append((keys, h, needed(len(s), percent)))
                n += len(keys)
                if n >= 100_000:
                    yield batch(held)
                    held, n = [], 0
            if n:
                yield batch(held)

    return rows.where(F.col("id").isNotNull()).select("text").mapInArrow(run, "key long, h long, need int")


def _tokens(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``wanted`` (rep, ...) with ``n, tokens`` (least first) of these documents: a Bloom filter spares the others, an exact join settles it."""
    spark = rows.sparkSession
    words = spark.sparkContext.broadcast(bloom.build(wanted.select(F.xxhash64("rep").alias("h")), wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        kind = pa.list_(pa.int64())
        for b in batches:
            b = b.filter(pa.array(bloom.passes(words.value, b.column(1).to_numpy())))
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                sets = list(shingler.sets(_texts(part, "text")))
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), flat).cast(kind)], ["rep", "tokens"])

    found = rows.where(F.col("id").isNotNull()).select(F.col("id").alias("rep"), F.xxhash64("id").alias("h"), "text").mapInArrow(run, "rep long, tokens array<long>")
    return found.where("size(tokens) > 0").join(_sent(wanted), "rep").withColumn("n", F.size("tokens"))


def _spanning(sizes: np.ndarray, flat: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that hold the linked sets of a group together: all with all, or side 0 with side 1 where there are two."""
    m = len(sizes)
    none = np.zeros(0, dtype=np.int64)
    if side.all():
        return none, none  # nobody asks: a part of the family without members
    who = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    v, who = flat[order], who[order]
    col = np.cumsum(np.r_[0, v[1:] != v[:-1]])
    if side.any():
        right = np.bincount(col, side[who])
        useful = (right > 0) & (np.bincount(col) > right)  # the unions of both sides have it
    else:
        useful = np.bincount(col) > 1  # the union of the others has it
    keep = useful[col]
    # The bound: tokens that a set has in the union limit its overlap with every member, of which none is smaller than the least.
    if side.any():
        smallest = np.where(side == 0, sizes[side != 0].min(), sizes[side == 0].min())
    else:
        smallest = np.full(m, sizes.min())
    ok = np.bincount(who[keep], minlength=m) * (100 + percent) >= (sizes + np.maximum(smallest, sizes * percent // 100)) * percent
    if ok.sum() < 2:
        return none, none
    row = np.cumsum(ok) - 1
    keep &= ok[who]
    place, line, n = (np.cumsum(useful) - 1)[col[keep]], row[who[keep]], sizes[ok]
    common = np.zeros((len(n), len(n)), dtype=np.float64)
    cut = np.searchsorted(place, np.arange(0, int(useful.sum()) + COLUMNS, COLUMNS))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if hi > lo:
            block = np.zeros((len(n), int(place[hi - 1] - place[lo]) + 1), dtype=np.float32)
            block[line[lo:hi], place[lo:hi] - place[lo]] = 1
            common += block @ block.T
    link = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(link, False)
    if side.any():
        link &= side[ok][:, None] != side[ok][None, :]
    label = np.arange(len(n))
    while True:
        after = np.minimum(label, np.where(link, label[None, :], len(n)).min(axis=1))
        after = after[after]
        if (after == label).all():
            break
        label = after
    at = np.flatnonzero(ok)
    moved = label != np.arange(len(n))
    return at[moved], at[label[moved]]


def _open(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components inside groups; ``groups`` has ``gid, side, rep, label, tokens``."""

    def kernel(t: pa.Table, starts: np.ndarray) -> pa.Table:
        rep, label, side = (t.column(c).to_numpy() for c in ("rep", "label", "side"))
        tokens = t.column("tokens").combine_chunks()
        sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, at = tokens.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
        a, b = [], []
        for lo, hi in zip(starts, np.append(starts[1:], len(rep)), strict=True):
            if hi - lo > 1 and (label[lo:hi] != label[lo]).any():
                x, y = _spanning(sizes[lo:hi], flat[at[lo] : at[hi]], side[lo:hi], percent)
                a.append(rep[lo + x])
                b.append(rep[lo + y])
        return pa.table({"a": np.concatenate(a) if a else rep[:0], "b": np.concatenate(b) if b else rep[:0]})

    return by_group(groups.select("gid", "side", "rep", "label", "tokens"), "gid", kernel, "a long, b long")


def _grouped(sets: DataFrame) -> DataFrame:
    """``sets`` (rep, n, fam, ...) with their group ``part`` of the family and its number of ``parts``; the family's first leader is in part 0."""
    sizes = sets.groupBy("fam").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / TOKENS)).alias("parts"), F.count("*").alias("members"))
    part = F.when(F.col("rep") == F.col("fam"), 0).otherwise(F.pmod(F.xxhash64("rep"), "parts"))
    return sets.join(sizes, "fam").withColumn("part", part.cast("long"))


def _unsettled(alive: Scratch, tokens: DataFrame, percent: int) -> Scratch:
    """Those of ``alive`` (rep, n, label) that have enough tokens in common with other components.

    Sets of ``n`` and ``m`` tokens that link have (n + m) * percent / (100 + percent) in common at least, so the
    ``c`` tokens that a set shares with others also say how large (``most``) a set can be that it links with.
    """
    first = Scratch(alive.df.withColumn("most", (F.col("n") * 100 / percent).cast("int")))
    alive.drop()
    alive, turn, n = first, 0, first.df.count()
    token = "OVER (PARTITION BY token)"
    while n and (turn == 0 or n > FEW):
        each = tokens.select("rep", "tokens").join(_sent(alive.df), "rep").select("rep", "n", "label", "most", F.explode("tokens").alias("token"))
        least = each.withColumn("least", F.expr(f"min(struct(n, label)) {token}")).withColumn("next", F.expr(f"min(CASE WHEN label <> least.label THEN n END) {token}"))
        other = F.when(F.col("label") == F.col("least.label"), F.col("next")).otherwise(F.col("least.n"))
        counted = least.where(other <= F.col("most")).groupBy("rep").agg(F.count("*").alias("c"), F.min("n").alias("m")).where(f"c * 100 >= m * {percent}")
        size = F.least(F.col("most"), F.floor(F.col("c") * (100 + percent) / percent).cast("int") - F.col("m"))
        after = Scratch(alive.df.join(counted, "rep").select("rep", "label", "n", F.greatest(size, F.lit(0)).alias("most")))
        alive.drop()
        free_shuffles(alive.df.sparkSession)
        alive, before, n, turn = after, n, after.df.count(), turn + 1
        if turn > 1 and n > 0.9 * before:
            break
    return alive


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, log: dict | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: sets link at a similarity of ``percent`` / 100.

    ``log`` takes the number of sets and links by step.
    """
    spark = docs.sparkSession
    log = {} if log is None else log
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    plain = Scratch(_classes(rows, k))
    reps = Scratch(plain.df.where("n > 0 AND id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    several = reps.df.where("rep <> last").drop("last")
    classes = Scratch(
        plain.df.join(several, ["n", "h1", "h2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    )
    plain.drop()

    # Indexed tokens that more than one set has, and the sets that have enough of them.
    ends = F.expr("min(h) OVER (PARTITION BY key)"), F.expr("max(h) OVER (PARTITION BY key)")
    shared = Scratch(_index(rows, k, percent).select("key", "h", "need", ends[0].alias("leader"), ends[1].alias("last")).where("leader < last").drop("last"))
    free_shuffles(spark)
    enough = shared.df.groupBy("h").agg(F.countDistinct("key").alias("c"), F.max("need").alias("need")).where("c >= need").select("h")
    nodes = Scratch(reps.df.select(F.col("h1").alias("h"), "rep", F.col("n").cast("int").alias("n")).join(enough, "h", "left_semi"))
    reps.drop()

    # Families: sets that leaders, and the leaders of these, hold together.
    votes = shared.df.where("h <> leader").groupBy("h", "leader").agg(F.count("*").alias("votes"), F.max("need").alias("need")).where("votes >= need")
    pairs = (
        votes.join(nodes.df.select("h", F.col("rep").alias("a"), F.col("n").alias("na")), "h")
        .join(nodes.df.select(F.col("h").alias("leader"), F.col("rep").alias("b"), F.col("n").alias("nb")), "leader")
        .where(f"a <> b AND na * 100 >= nb * {percent} AND nb * 100 >= na * {percent}")
        .groupBy("a").agg(F.max_by("b", F.struct("votes", -F.col("b"))).alias("b"))
    )
    led = connected(pairs)
    sets = Scratch(
        nodes.df.join(led.select(F.col("node").alias("rep"), F.col("label").alias("fam")), "rep", "left")
        .select("h", "rep", "n", F.coalesce("fam", "rep").alias("fam"))
    )
    nodes.drop()
    shared.drop()
    # Dealt to groups by their sizes first, so that tokens move to their groups only.
    groups = Scratch(_grouped(sets.df.groupBy("rep", "fam").agg(F.max("n").alias("n"))))
    tokens = Scratch(_tokens(rows, groups.df.drop("n"), k))
    free_shuffles(spark)

    # Every set asks its own group and the first group of its family.
    placed = tokens.df
    of = lambda *x: F.xxhash64("fam", *x)
    columns = ["rep", F.col("rep").alias("label"), "tokens"]
    alone = placed.where("members > 1").select(of("part").alias("gid"), F.lit(0).alias("side"), *columns)
    head = F.lit("head")
    asks = placed.where("part > 0").select(of("part", head).alias("gid"), F.lit(0).alias("side"), *columns)
    heads = placed.where("part = 0 AND parts > 1").withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts") - 1).cast("array<long>")))
    heads = heads.select(of("part", head).alias("gid"), F.lit(1).alias("side"), *columns)
    links = _open(alone.unionByName(asks).unionByName(heads), percent)
    # Rows that share an id but not a set are one document.
    known = classes.df.where("n > 0 AND id IS NOT NULL").select("id", "rep")
    least = known.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("id", "a")
    same = known.join(least, "id").select("a", F.col("rep").alias("b")).where("a <> b")
    first = Scratch(links.unionByName(same))
    free_shuffles(spark)
    final = connected(first.df)

    # What may still link with another component.
    labels = final.select(F.col("node").alias("rep"), "label")
    alive = Scratch(sets.df.groupBy("rep").agg(F.min("n").alias("n")).join(labels, "rep", "left").select("rep", "n", F.coalesce("label", "rep").alias("label")))
    log |= {"classes_indexed": sets.df.count(), "edges_first": first.df.count()}
    sets.drop()
    groups.drop()
    free_shuffles(spark)
    alive = _unsettled(alive, tokens.df, percent)
    log["unsettled"] = alive.df.count()
    if log["unsettled"]:
        # Sets with the same most frequent token are grouped anew; groups ask groups that share a token of a prefix with them.
        held = Scratch(tokens.df.select("rep", "n", "tokens").join(_sent(alive.df.select("rep", "label")), "rep"))
        each = held.df.select("rep", F.explode("tokens").alias("token"))
        each = each.withColumn("df", F.expr("count(*) OVER (PARTITION BY token)"))
        home = each.groupBy("rep").agg(F.max_by("token", F.struct("df", "token")).alias("fam"))
        left = _grouped(held.df.join(home, "rep")).withColumn("gid", F.xxhash64("fam", "part"))
        groups = Scratch(left.select("gid", "rep", "n", "label", "tokens"))
        held.drop()
        prefix = F.expr(f"slice(tokens, 1, n - CAST(ceil(n * {percent} / 100) AS INT) + 1)")
        lines = groups.df.select("gid", "label", F.explode(prefix).alias("token")).groupBy("token", "gid").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        several = lines.groupBy("token").agg(F.min("gid").alias("x"), F.max("gid").alias("y")).where("x < y").select("token")
        lines = Scratch(lines.join(several, "token"))
        x, y = (lines.df.select("token", *(F.col(c).alias(c + s) for c in ("gid", "low", "high"))) for s in "xy")
        meet = x.join(y, "token").where("gidx < gidy AND NOT (lowx = highx AND lowy = highy AND lowx = lowy)").select("gidx", "gidy").distinct()
        pair = F.xxhash64("gidx", "gidy", F.lit("pair")).alias("pair")
        sides = meet.select(F.col("gidx").alias("gid"), pair, F.lit(0).alias("side")).unionByName(meet.select(F.col("gidy").alias("gid"), pair, F.lit(1).alias("side")))
        own = groups.df.select("gid", F.lit(0).alias("side"), "rep", "label", "tokens")
        late = Scratch(_open(groups.df.join(sides, "gid").drop("gid").withColumnRenamed("pair", "gid").select(own.columns).unionByName(own), percent))
        log["edges_late"] = late.df.count()
        final = connected(first.df.unionByName(late.df))
        for used in (late, lines, groups):
            used.drop()
    for used in (alive, first, tokens):
        used.drop()
    free_shuffles(spark)
    return classes.df.join(final.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id")
    )
