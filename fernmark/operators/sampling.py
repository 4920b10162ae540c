"""Deterministic samples: the order is the md5 of id and seed, which any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(key: str | Column, seed: str = "") -> Column:
    """A pseudo-random order of keys."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(seed)).cast("binary"))


def sample_rows(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    return df.orderBy(draw(key, seed), key).limit(n)


def sample_share(df: DataFrame, key: str, per_cent: int, seed: str = "") -> DataFrame:
    """About so many per cent; rows with the same key stay together. No shuffle."""
    return df.where(F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") % 100 < per_cent)


def sample_groups(df: DataFrame, group: str, n: int, seed: str = "") -> DataFrame:
    """All rows of ``n`` groups. The chosen keys are at most ``n`` rows, so they are broadcast."""
    chosen = sample_rows(df.select(group).where(F.col(group).isNotNull()).distinct(), group, n, seed)
    return df.join(F.broadcast(chosen) if n <= 100_000 else chosen, group, "left_semi")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: str = "") -> DataFrame:
    """At most ``n`` rows of each group."""
    order = Window.partitionBy(group).orderBy(draw(key, seed), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def groups_at_least(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups with ``least`` rows or more. Counts and semi-join: no window holds a group."""
    counts = df.groupBy(group).count().where(F.col("count") >= least).select(group)
    return df.join(counts, group, "left_semi")


def funnel(df: DataFrame, group: str, key: str, *, least: int | None = None, n_groups: int | None = None, per_group: int | None = None, seed: str = "") -> DataFrame:
    """Large enough groups, some of these, some rows of each: each stage only if asked for."""
    if least is not None:
        df = groups_at_least(df, group, least)
    if n_groups is not None:
        df = sample_groups(df, group, n_groups, seed)
    if per_group is not None:
        df = sample_per_group(df, group, key, per_group, seed)
    return df


#: Parts of the range of draws in which a class's test rows are counted.
_PARTS = 4096


def stratified_split(df: DataFrame, group: str, key: str, test_share: float, seed: str = "") -> DataFrame:
    """Adds ``is_test``: the first ceil(share x size) rows of each class with two rows or more, by the draw.

    Counts of classes by parts of the draws' range say in which part the last test row
    is. Rows of earlier parts are test rows, and only within a part rows are
    numbered, so a large class is many windows.
    """
    part = F.conv(F.substring(draw(key, seed), 1, 3), 16, 10).cast("int")  # three digits: _PARTS parts
    rows = df.where(F.col(group).isNotNull()).withColumn("_part", part)
    counts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    by_class = Window.partitionBy(group)  # _PARTS rows at most
    upto = F.sum("_n").over(by_class.orderBy("_part"))
    size = F.sum("_n").over(by_class)
    cuts = counts.withColumn("_before", upto - F.col("_n")).withColumn("_want", F.when(size >= 2, F.ceil(size * test_share)).otherwise(0))
    cuts = cuts.withColumn("_left", F.col("_want") - F.col("_before")).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_left", "_n")
    met = rows.join(cuts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(draw(key, seed), key))
    return met.withColumn("is_test", (F.col("_left") > 0) & ((F.col("_left") >= F.col("_n")) | (place <= F.col("_left")))).select(*df.columns, "is_test")


def batched(df: DataFrame, key: str, n: int, seed: str = "", name: str = "batch") -> DataFrame:
    """Adds a batch number, 0 to ``n`` - 1, drawn by key: each batch is a random part, and one of them a subset. No shuffle."""
    return df.withColumn(name, (F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") % n).cast("int"))


def valid(df: DataFrame, size: str, megabytes: str, most: float = 100.0) -> DataFrame:
    """Rows of recordings that have samples and aren't too large to load; unknown sizes are invalid."""
    return df.where((F.col(size) != 0) & (F.col(megabytes) <= most))
