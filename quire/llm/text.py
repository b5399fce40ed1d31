"""Column expressions shared by the operators on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed values of the word rules: letters and digits of ASCII plus all other code points; and runs without ASCII white space.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; the slow path runs only where there is non-ASCII text."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fold of a row."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores added until none of ``columns`` is called so."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running_sums(numbers: Column) -> Column:
    """What stands before each number, summed. A sum that appends to an array copies it, so it runs in runs of about the root of the length."""
    fold = lambda xs, first: F.slice(F.aggregate(xs, F.array(first), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)), 1, F.size(xs))
    run = F.greatest(F.ceil(F.sqrt(F.size(numbers))).cast("int"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(0), (F.greatest(F.size(numbers) - 1, F.lit(0)) / run).cast("int")), lambda c: F.slice(numbers, c * run + 1, run))
    total = lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + x)
    each = lambda rs: F.flatten(F.zip_with(rs, fold(F.transform(rs, total), F.lit(0)), fold))
    return F.get(F.transform(F.array(runs), each), F.lit(0))
