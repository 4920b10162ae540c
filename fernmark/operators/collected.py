"""Lists and maps by key, and values that have to be the same for all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernmark.operators.topk import top_k_per_group


def lists_per_key(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], most: int | None = None) -> DataFrame:
    """keys and ``value`` as an array in an order, nulls left out; with ``most`` the first so many of each key.

    A list is one row, so a key's values have to fit one; ``most`` cuts before the shuffle.
    """
    rows = df.where(F.col(value).isNotNull())
    if most is not None:
        rows = top_k_per_group(rows, list(keys), [F.col(c) for c in (*order, value)], most)
    pairs = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.transform("_p", lambda p: p["v"]).alias(value))


def map_per_key(df: DataFrame, keys: Sequence[str], name: str, value: str, order: Sequence[str] = ()) -> DataFrame:
    """keys and ``map``: the last value by ``order`` of each name, names in order; null names left out.

    Rows of one name are reduced before they are collected, so a map is as large as a key has names.
    """
    last = F.max(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(value).alias("v")))
    one = df.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(last.alias("_l"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col("_l.v").alias("value"))))
    return one.groupBy(*keys).agg(F.map_from_entries(entries).alias("map"))


def the_only(value: Column, what: str) -> Column:
    """An aggregate: the value that all rows of a group share, nulls apart; an error where they differ."""
    low, high = F.min(value), F.max(value)
    return F.when(low.eqNullSafe(high), low).otherwise(F.raise_error(F.concat(F.lit(f"{what} differs within a group: "), low.cast("string"), F.lit(", "), high.cast("string"))))


def passed_through(df: DataFrame, keys: Sequence[str], passed: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by key, and columns that the key determines; that it does is checked as they are computed."""
    return df.groupBy(*keys).agg(*[the_only(F.col(c), c).alias(c) for c in passed], *aggregates)
