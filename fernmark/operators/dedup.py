"""Duplicates, sets of ids, and first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_one(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest version of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in (*key, version)]
    newest = df.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("r"))
    return newest.select(*key, "r.*").select(*df.columns)


def missing_ids(df: DataFrame, id_col: str, stop: int | None = None) -> DataFrame:
    """Ids from 0 to ``stop`` - 1, or to the largest there is, that no row has."""
    spark = df.sparkSession
    if stop is None:
        last = df.agg(F.max(id_col)).first()[0]
        stop = 0 if last is None else last + 1
    return spark.range(stop).withColumnRenamed("id", id_col).join(df.select(id_col), id_col, "left_anti")


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the first position of each, and their order by it."""
    found = df.groupBy(value).agg(F.min(position).alias("first_position"))
    return found.withColumn("seen_order", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_position", value)) - 1)


def concat_aligned(frames: list[DataFrame], fill: dict[str, object] | None = None) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are null there, or what ``fill`` says."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna(fill) if fill else out
