"""Vector expressions over arrays of doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, null or zero vectors and for unequal lengths."""
    a, b = doubles(a), doubles(b)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))).otherwise(F.lit(0.0))


def literal(v: list[float]) -> Column:
    """An array of doubles, parsed as one expression: a column for each number takes seconds to build and to analyze."""
    if v and all(map(math.isfinite, v)):
        return F.expr("array(" + ",".join(f"{float(x)!r}D" for x in v) + ")")
    return F.array(*(F.lit(float(x)) for x in v))
