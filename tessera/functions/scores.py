"""Vector and scoring arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero, null where one is null."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def novelty_threshold(n: Column, start: float = 0.55, most: float = 0.92, half: float = 150.0) -> Column:
    """The rising threshold of a registry of n concepts; 0 while it is empty."""
    return F.when(n == 0, F.lit(0.0)).otherwise(most - (most - start) * half / (half + n))


def npmi(together: Column, a: Column, b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information; 1 for a pair that is everywhere."""
    p = together / n
    return F.when(together == n, F.lit(1.0)).otherwise(F.try_divide(F.ln(p / ((a / n) * (b / n))), -F.ln(p)))
