"""Naming an intermediate value within a column expression, so that what follows refers to it instead of repeating it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, evaluated once. The expression grows by what it says, not by how often it uses the value."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row: a generator of one row, which the optimizer does not inline where they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


#: What counts as white space: the ASCII controls 9 to 13, the blank, and the spaces of Unicode (the no-break space among them).
SPACES = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def spaced(pattern: str) -> str:
    r"""The pattern with ``\s`` for all of ``SPACES``, inside of classes and outside."""
    out, k, inside = "", 0, False
    while k < len(pattern):
        c = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        if c == r"\s":
            out += SPACES if inside else f"[{SPACES}]"
        else:
            inside = (inside or c == "[") and c != "]"
            out += c
        k += len(c)
    return out


def strip(c: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(c, spaced(r"^\s+|\s+$"), "")
