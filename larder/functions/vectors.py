"""Vector arithmetic on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*(F.lit(float(x)) for x in values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column, least: float = 1e-9) -> Column:
    """The vector over its length, or over ``least`` if that is more."""
    length = F.greatest(norm(v), F.lit(least))
    return F.transform(doubles(v), lambda x: x / length)


def wide(v: str, dim: int) -> list[Column]:
    """Columns dim_0 to dim_{dim - 1}."""
    return [F.get(F.col(v), F.lit(i)).alias(f"dim_{i}") for i in range(dim)]
