"""Vector expressions on ``array<float>`` columns (D20, D21, C10), JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v) -> Column:
    return F.sqrt(_sum(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a, b) -> Column:
    """Cosine of two equal-length vectors, in double; null when either norm is zero."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def l2_normalize(v) -> Column:
    """v / |v| as array<float>; the zero vector has no direction and becomes null."""
    n = norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: (x.cast("double") / n).cast("float")))


def has_dim(v, dim: int) -> Column:
    """Collection contract: vector present, exact dimension, no null/NaN element."""
    c = _c(v)
    return (c.isNotNull() & (F.size(c) == dim)
            & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)))
