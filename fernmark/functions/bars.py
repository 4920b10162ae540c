"""Bars of how often something is present."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least share for each bar width from 1 to 9. Fixed values.
STEPS = (0.0, 0.003, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6)
FULL, EMPTY = "■", "—"


def bar_width(p: Column, steps: tuple[float, ...] = STEPS) -> Column:
    """How many steps a share reaches; 0 for null."""
    reached = sum((F.when(p >= s, 1).otherwise(0) for s in steps), F.lit(0))
    return F.coalesce(reached, F.lit(0)).cast("int")


def bar(p: Column, steps: tuple[float, ...] = STEPS) -> Column:
    w = bar_width(p, steps)
    return F.concat(F.repeat(F.lit(FULL), w), F.repeat(F.lit(EMPTY), F.lit(len(steps)) - w))
