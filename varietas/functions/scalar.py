"""Scalar column expressions (T4, T5, M1, M2, M4) — all built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rstrip_line(col: Column, chars: str = "\n ") -> Column:
    """``str.rstrip(chars)`` for a set of literal characters (T5; default ``'\\n '``)."""
    cls = "".join("\\n" if c == "\n" else ("\\" + c if c in "\\]^-[" else c) for c in chars)
    return F.regexp_replace(col, "[" + cls + "]+$", "")


def join_tokens(tokens: Column) -> Column:
    """``' '.join(tokens)`` (T4)."""
    return F.array_join(tokens, " ")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equal-length numeric arrays, summed left to right in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of a vector as ``array<double>`` (M1); a zero vector gives NULL."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def arc_cost(sim: Column) -> Column:
    """Lattice arc weight of a neighbour, ``-ln(sim)/1000`` (M4)."""
    return -F.log(sim) / F.lit(1000.0)
