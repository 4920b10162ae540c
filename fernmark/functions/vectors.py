"""Arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine distance; pass norms that are stored already. Null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


#: Distances by name.
DISTANCES = {"l2": l2, "l1": l1, "cosine": cosine}


def surprise(p: Column) -> Column:
    """-ln p, never -0; infinite for p = 0."""
    return F.when(p == 0, F.lit(float("inf"))).otherwise(F.abs(F.ln(p)))


def unpack(a: Column, n: int, prefix: str) -> list[Column]:
    """One column for each element, for sinks without arrays."""
    return [F.element_at(a, k + 1).alias(f"{prefix}_{k}") for k in range(n)]


def pack(columns: list[str]) -> Column:
    return F.array(*[F.col(c) for c in columns])
