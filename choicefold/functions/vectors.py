"""Vectors as ``ARRAY<DOUBLE>`` columns.

Sizes are small and known (parameters, items), so sums are written out term by term: that stays
inside whole-stage code generation, which higher-order functions don't.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def item(v: Column | str, k: int) -> Column:
    return F.get(F.col(v) if isinstance(v, str) else v, k)


def total(parts: Sequence[Column]) -> Column:
    """Sum of columns, from the left."""
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def dot(a: Column | str, b: Column | str, size: int) -> Column:
    """Inner product of two vectors of a known size."""
    return total([item(a, k) * item(b, k) for k in range(size)])


def first_max(scores: Sequence[Column]) -> tuple[Column, Column]:
    """Greatest score and the place (from 0) of the first that has it."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    at = F.lit(len(scores) - 1)
    for k in range(len(scores) - 2, -1, -1):
        at = F.when(scores[k] == best, k).otherwise(at)
    return best, at
