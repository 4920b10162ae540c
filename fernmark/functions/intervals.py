"""Closed intervals as structs {lo, hi}; infinite ends are allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def contains(a: Column, x: Column) -> Column:
    return (a["lo"] <= x) & (x <= a["hi"])


def covers(a: Column, b: Column) -> Column:
    return (a["lo"] <= b["lo"]) & (b["hi"] <= a["hi"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])


def clamp(x: Column, a: Column) -> Column:
    return F.least(F.greatest(x, a["lo"]), a["hi"])


def hull(a: Column, b: Column) -> Column:
    return interval(F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"]))


def intersection(a: Column, b: Column) -> Column:
    """Null if they don't overlap."""
    return F.when(overlaps(a, b), interval(F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"])))


def json_number(x: Column) -> Column:
    """A number for JSON, which has no infinities or NaN: those become strings."""
    finite = ~(F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(finite, x.cast("string")).when(F.isnan(x), '"NaN"').when(x > 0, '"Infinity"').otherwise('"-Infinity"')
