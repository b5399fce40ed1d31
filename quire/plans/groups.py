"""Small per-group steps in Python over whole groups, many groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def each_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``step`` over the rows of each group, in order. Groups are to be bounded by their makers: one is held at once.

    One shuffle by ``keys``; batches are cut at the ends of groups, so small groups cost no call of Spark's own each.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(part: pd.DataFrame, number: pd.Series) -> Iterator[pd.DataFrame]:
            out = [step(g.reset_index(drop=True)) for _, g in part.groupby(number.to_numpy(), sort=False)]
            if out:
                yield pd.concat(out, ignore_index=True)

        held: list[pd.DataFrame] = []
        for b in batches:
            if b.empty:
                continue
            if held and b["_group"].iloc[-1] == held[0]["_group"].iloc[0]:
                held.append(b)
                continue
            part = pd.concat([*held, b], ignore_index=True) if held else b
            last = part["_group"] == part["_group"].iloc[-1]
            if not last.all():
                yield from done(part[~last].drop(columns="_group"), part.loc[~last, "_group"])
            held = [part[last]]
        if held:
            part = pd.concat(held, ignore_index=True)
            yield from done(part.drop(columns="_group"), part["_group"])

    marked = rows.withColumn("_group", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    return marked.repartition(*keys).sortWithinPartitions("_group", *order).mapInPandas(run, schema)
