"""Joins to dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def audit(left: DataFrame, right: DataFrame, key: str) -> dict[str, DataFrame]:
    """Keys of either side that the other lacks, and the full outer join."""
    return {
        "left_only": left.join(right, key, "left_anti"),
        "right_only": right.join(left, key, "left_anti"),
        "both": left.join(right, key, "full"),
    }


def cascade(df: DataFrame, tables: Sequence[tuple[DataFrame, str, str]], value: str, default: object | None = None) -> DataFrame:
    """``value`` from the first of several tables that knows the row; (table, column of ``df``, key of the table) each."""
    found = []
    for k, (dim, on, key) in enumerate(tables):
        name = f"_value{k}"
        dim = dim.select(F.col(key).alias(f"_key{k}"), F.col(value).alias(name)).dropDuplicates([f"_key{k}"])
        df = df.join(dim, F.col(on) == F.col(f"_key{k}"), "left").drop(f"_key{k}")
        found.append(F.col(name))
    if default is not None:
        found.append(F.lit(default))
    return df.withColumn(value, F.coalesce(*found)).drop(*[f"_value{k}" for k in range(len(tables))])


def key_table(dim: DataFrame, keys: Sequence[str], id_col: str, position: str) -> DataFrame:
    """(key, id): normalised keys of a dimension; the earlier column wins, and within one the later row."""
    entries = F.array(*[F.struct(F.lit(k).alias("rank"), F.replace(F.lower(F.col(c)), F.lit("'"), F.lit("")).alias("key")) for k, c in enumerate(keys)])
    rows = dim.select(F.col(id_col).alias("id"), F.col(position).alias("at"), F.explode(entries).alias("e")).select("id", "at", "e.rank", "e.key")
    rows = rows.where("key is not null and key <> ''")
    order = Window.partitionBy("key").orderBy("rank", F.col("at").desc())
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("key", "id")


def group_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Each row with the number of rows of its key, by aggregate and join (a hot key fills no window)."""
    return df.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left")
