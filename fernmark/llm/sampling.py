"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Draws are 62-bit numbers, so a share of many billions of rows is still not 0.
_SCALE = 1 << 62


def thresholds(counts: dict, per_class: int | dict) -> dict:
    """The draw under which a row of each class is taken, so that about ``per_class`` rows (or so many for each class) are."""
    most = {c: per_class[c] if isinstance(per_class, dict) else per_class for c in counts}
    return {c: min(_SCALE, _SCALE * most[c] // n) for c, n in counts.items() if n}


def capped(rows: DataFrame, class_col: str, keys: list[str], per_class: int | dict) -> DataFrame:
    """The first ``per_class`` rows of each class by the hash of ``keys``; each task cuts its own rows to that before the shuffle."""
    top = max(per_class.values()) if isinstance(per_class, dict) else per_class
    w = Window.partitionBy(class_col).orderBy(F.xxhash64(*keys, F.lit("sample")), *keys)
    ranked = rows.withColumn("fernmark place", F.row_number().over(w)).where(F.col("`fernmark place`") <= top)
    if isinstance(per_class, dict):
        own = F.element_at(F.create_map(*[F.lit(x) for pair in per_class.items() for x in pair]), F.col(class_col))
        ranked = ranked.where(F.col("`fernmark place`") <= own)
    return ranked.drop("fernmark place")


def bounded_sample(rows: DataFrame, class_col: str, keys: list[str], per_class: int | dict) -> DataFrame:
    """``per_class`` rows (or so many for each class) at most, chosen by the hash of ``keys``; all of a smaller class.

    One count by class, then a filter: no shuffle of the rows themselves. Rows
    alike in ``keys`` share their draw, so the rows that pass are capped.
    """
    draw = F.shiftrightunsigned(F.xxhash64(*keys, F.lit("sample")), 2)
    found = rows.where(F.col(class_col).isNotNull()).groupBy(class_col).agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()
    if not found:
        return rows.limit(0)
    below = thresholds({r[class_col]: r["n"] for r in found}, per_class)
    # The row with the least draw is always taken, so no class is left without one.
    limits = F.create_map(*[F.lit(x) for r in found for x in (r[class_col], max(below[r[class_col]], r["least"] + 1))])
    return capped(rows.where(draw < F.element_at(limits, F.col(class_col))), class_col, keys, per_class)
