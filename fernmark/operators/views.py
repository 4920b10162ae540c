"""Rows as a page shows them: texts without HTML, joined lists, places from the large to the small, short numbers, no nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernmark.functions import text


def shown(x: Column) -> Column:
    """Two significant digits, whole numbers from ten on, no zero before the point; what is next to nothing is 0, null is empty."""
    scale = F.pow(F.lit(10.0), 1 - F.floor(F.log10(F.abs(x))))
    short = F.ltrim((F.bround(x * scale) / scale).cast("string"), F.lit("0"))
    return F.when(x.isNull() | F.isnan(x), "").when(F.abs(x) <= 1e-3, "0").when(x >= 10, F.bround(x).cast("long").cast("string")).otherwise(short)


def place_reversed(place: Column) -> Column:
    """"Town, County, Country" as "Country, County, Town"."""
    return F.array_join(F.reverse(F.split(place, ", ")), ", ")


def record_view(df: DataFrame, *, texts: Sequence[str] = (), lists: Sequence[str] = (), places: Sequence[str] = (), numbers: Sequence[str] = (), dates: dict[str, tuple[str, str]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` as it is, and the other named columns as texts. ``dates``: a name for each pair of a year and a month-and-day column."""
    clean = [F.coalesce(text.strip_html(F.col(c)), F.lit("")).alias(c) for c in texts]
    joined = [F.array_join(F.transform(F.coalesce(F.col(c), F.array()), text.strip_html), " ").alias(c) for c in lists]
    turned = [F.coalesce(place_reversed(text.strip_html(F.col(c))), F.lit("")).alias(c) for c in places]
    days = [F.coalesce(F.concat(F.col(y).cast("int").cast("string"), F.lit("-"), F.col(md)), F.lit("")).alias(name) for name, (y, md) in (dates or {}).items()]
    return df.select(*keep, *clean, *joined, *turned, *[shown(F.col(c).cast("double")).alias(c) for c in numbers], *days)
