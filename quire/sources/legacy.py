"""Side-by-side texts in older script files: an array of back-quoted strings after a marker.

The script behind the marker is cut into small tokens by one pattern, and each token is told by a letter. Over the string of
these letters a second pattern finds whole literals, comments and separators, so that nothing is read character by character: a text
of a literal is a slice of the tokens, joined. All of it is expressions on the JVM, near linear in the number of tokens.

The rule: between literals only commas, white space and comments (``//`` to the end of the line, ``/* */``) may stand; in a literal a backslash may stand before
n, r, t, a backslash or a back quote only, and no ``${``. Anything else before the closing bracket, or no closing bracket, makes the whole null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.arrays import bind, sums_before

#: The tokens, and what they are called (in the order of the tests below).
TOKEN = r"(?s)\\[nrt\\`]|\$\{|[^\\$`/*\n\], \t\r]+|."
ESCAPES = {"\\n": "\n", "\\r": "\r", "\\t": "\t", "\\\\": "\\", "\\`": "`"}
#: Over letters: q back quote, e escape, b other backslash, d opening of an expression, n line feed, s separator, z closing bracket, x others; / and * are themselves.
PIECE = r"(?s)q[^qbd]*q|//[^n]*|/\*.*?\*/|z|[sn]+|."


def _letter(token: Column) -> Column:
    return (
        F.when(token == "`", "q").when(token.isin(*ESCAPES), "e").when(token == "\\", "b").when(token == "${", "d").when(token == "\n", "n")
        .when(token.isin(",", " ", "\t", "\r"), "s").when(token == "]", "z").when(token.isin("/", "*"), token).otherwise("x")
    )


def _plain(token: Column) -> Column:
    out = token
    for escape, char in ESCAPES.items():
        out = F.when(token == escape, char).otherwise(out)
    return out


def parallel_texts(source: Column, marker: str = "translations") -> Column:
    """The strings of the first array behind ``marker``; null without one, or if anything else stands in it."""
    behind = F.regexp_extract(source, rf"(?s){re.escape(marker)}[^\[]*\[(.*)", 1)
    there = source.rlike(rf"(?s){re.escape(marker)}[^\[]*\[")

    def read(tokens: Column) -> Column:
        letters = F.array_join(F.transform(tokens, _letter), "")
        pieces = F.regexp_extract_all(F.concat(letters, F.lit("")), F.lit(PIECE), 0)
        return bind(pieces, lambda ps: texts(tokens, ps))

    def texts(tokens: Column, pieces: Column) -> Column:
        end = F.array_position(pieces, F.lit("z"))
        inner = F.slice(pieces, 1, F.greatest(end.cast("int") - 1, F.lit(0)))
        wrong = F.exists(inner, lambda p: ~p.rlike(r"^(q.*q|//.*|/\*.*\*/|[sn]+)$"))
        literals = lambda ps: F.filter(F.zip_with(ps, sums_before(F.transform(ps, F.char_length)), lambda p, at: F.struct(p.alias("p"), at.alias("at"))), lambda x: F.startswith(x["p"], F.lit("q")))
        text = lambda x: F.array_join(F.transform(F.slice(tokens, x["at"] + 2, F.char_length(x["p"]) - 2), _plain), "")
        return F.when((end > 0) & ~wrong, F.transform(bind(inner, literals), text))

    return F.when(there, bind(F.regexp_extract_all(behind, F.lit(TOKEN), 0), read))
