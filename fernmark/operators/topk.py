"""Top rows, over all or by group. Every order ends in an id, so that ties don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts groups to ``k`` before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def round_robin(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first row of every group, then the second, up to ``n`` rows."""
    ranked = top_k_per_group(df, group, order, n, "turn")
    return ranked.orderBy("turn", *group).limit(n)


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's place in an order, from 1. For lists that are cut already: their order is one window."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


#: Orders of search results by name: direction by column, always ending in the newest id.
def orders(id_col: str = "id") -> dict[str, list[Column]]:
    last = F.col(id_col).desc()
    ascending, descending = ("quality", "month_day", "time", "species", "place"), ("date", "year", "duration_s", "lat")
    return {c: [F.col(c).asc(), last] for c in ascending} | {c: [F.col(c).desc(), last] for c in descending}
