"""Kernels over whole groups of rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_group(rows: DataFrame, key: str, kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Run ``kernel(rows, starts of groups)`` over whole groups of the long column ``key``, many at a time.

    Groups are to be bounded by their makers: one group is held in memory at once.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                v = table.column(0).to_numpy()
                yield from kernel(table, np.flatnonzero(np.r_[True, v[1:] != v[:-1]])).select(names).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            v = b.column(0).to_numpy()
            if held[0].column(0)[0].as_py() == v[-1]:
                continue  # one group so far
            table = pa.concat_tables(held)
            cut = table.num_rows - (len(v) - int(np.searchsorted(v, v[-1])))
            yield from done(table.slice(0, cut))
            held = [table.slice(cut)]
        if held:
            yield from done(pa.concat_tables(held))

    first = [key] + [c for c in rows.columns if c != key]
    return rows.select(*first).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
