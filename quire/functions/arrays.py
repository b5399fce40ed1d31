"""Array expressions whose cost stays near linear in the length of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(numbers: Column) -> Column:
    """What stands before each number, summed. A fold that appends to an array copies it, so it runs over runs of about the root of the length."""
    fold = lambda xs, first: F.slice(F.aggregate(xs, F.array(first), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)), 1, F.size(xs))
    run = F.greatest(F.ceil(F.sqrt(F.size(numbers))).cast("int"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(numbers) - 1, F.lit(0)) / run).cast("int")), lambda c: F.slice(numbers, c * run + 1, run))
    total = lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + x)
    return bind(runs, lambda rs: F.flatten(F.zip_with(rs, fold(F.transform(rs, total), F.lit(0)), fold)))
