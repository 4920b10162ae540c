"""Runs of flags over time, and clips of sample arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def majority(df: DataFrame, key: str, order: str, flag: str, reach: int) -> DataFrame:
    """Adds ``smooth``: whether most of the rows within ``reach`` before and after have the flag."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn("smooth", F.sum(F.col(flag).cast("int")).over(w) * 2 > F.count("*").over(w))


def runs(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Maximal runs of equal flags: key, run, flag, first, last, n."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.col(flag) == F.lag(flag).over(w), 0).otherwise(1)
    numbered = df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run", flag).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def events(df: DataFrame, key: str, order: str, flag: str, *, least: int, gap: int) -> DataFrame:
    """Runs with the flag set, joined over gaps of at most ``gap`` rows, of at least ``least`` rows: key, first, last, n."""
    found = runs(df, key, order, flag)
    w = Window.partitionBy(key).orderBy("run")
    # A short gap between two runs with the flag belongs to them.
    closed = found.withColumn("_in", F.col(flag) | ((F.col("n") <= gap) & F.lag(flag).over(w).isNotNull() & F.lead(flag).over(w).isNotNull()))
    change = F.when(F.col("_in") == F.lag("_in").over(w), 0).otherwise(1)
    grouped = closed.withColumn("_c", change).withColumn("event", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.where("_in").groupBy(key, "event").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return merged.where(F.col("n") >= least).select(key, "first", "last", "n")


def clip(samples: Column, rate: float, start_s: Column, end_s: Column) -> Column:
    """Samples of the half-open time [start, end), within what there is."""
    n = F.size(samples)
    first = F.least(F.greatest(F.floor(start_s * rate).cast("int"), F.lit(0)), n)
    last = F.least(F.greatest(F.floor(end_s * rate).cast("int"), first), n)
    return F.slice(samples, first + 1, last - first)


def padded(samples: Column, n: int) -> Column:
    """Zeros after the samples, up to ``n``."""
    return F.when(F.size(samples) < n, F.concat(samples, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(samples)))).otherwise(samples)


def with_gain(samples: Column, decibels: Column) -> Column:
    return F.transform(samples, lambda x: x * F.pow(F.lit(10.0), decibels / 20))


def edited(samples: Column, rate: float, clips: Column) -> Column:
    """The clips {time: {lo, hi}, gain} of an edit, one after another."""
    return F.flatten(F.transform(clips, lambda c: with_gain(clip(samples, rate, c["time"]["lo"], c["time"]["hi"]), F.coalesce(c["gain"], F.lit(0.0)))))
