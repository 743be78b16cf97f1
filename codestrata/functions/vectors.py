"""Column expressions on vectors, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-10))
    return F.transform(a, lambda x: x.cast("double") / n)


def usable(a: Column, dim: int) -> Column:
    return (F.size(a) == dim) & F.exists(a, lambda x: x != 0)
