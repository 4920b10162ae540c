"""Summaries of tables: types, nulls, cardinalities, frequent values, totals and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.scratch import kept, small


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error that names what it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {lacking}; there are {df.columns}")
    return df


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    """``df`` itself, or an error if it is empty. Runs a job: for the edges of an interface."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def summary(df: DataFrame) -> DataFrame:
    """column, kind, n, n_null, n_distinct: one pass over the table."""
    aggs = [F.count("*").alias("_n")]
    for k, c in enumerate(df.columns):
        aggs += [F.count(c).alias(f"_c{k}"), F.countDistinct(F.col(c).cast("string")).alias(f"_d{k}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("kind"), F.col("_n").alias("n"), (F.col("_n") - F.col(f"_c{k}")).alias("n_null"), F.col(f"_d{k}").alias("n_distinct")) for k, (c, t) in enumerate(df.dtypes)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def value_counts(df: DataFrame, exprs: dict[str, str], n: int) -> DataFrame:
    """The ``n`` most frequent values of each SQL expression: name, value, count."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.expr(e).cast("string").alias("value")) for k, e in exprs.items()])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.name", "p.value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), F.col("value").asc_nulls_last())))
    return ranked.where(F.col("rank") <= n)


def with_totals(df: DataFrame, keys: Sequence[str], value: str, cube: bool = False) -> DataFrame:
    """Sums by all keys, and for each prefix (or every subset) of them; a total's keys are null."""
    grouped = df.cube(*keys) if cube else df.rollup(*keys)
    return grouped.agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key, and its share of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def day_sections(df: DataFrame, ts: str, item: list[str], limit: int) -> DataFrame:
    """The newest ``limit`` rows, listed by day, newest first."""
    newest = df.orderBy(F.desc(ts), *[F.desc(c) for c in item]).limit(limit)
    order = Window.partitionBy("day").orderBy(F.desc(ts), *[F.desc(c) for c in item])
    return newest.withColumn("day", F.to_date(ts)).withColumn("at", F.row_number().over(order))


def zero_filled(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Counts over every pair of values of two dimensions, 0 where there is none. For dimensions, not for ids."""
    counts = df.groupBy(a, b).agg(F.sum(value).alias(value))
    grid = df.select(a).distinct().crossJoin(small(kept(df.select(b).distinct(), "dimension")))
    return grid.join(counts, [a, b], "left").fillna(0, [value])


def columns_once(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, each once, where it is named first."""
    return df.select(*dict.fromkeys(names))


def arranged(df: DataFrame, *, rename: dict[str, str] | None = None, assign: dict[str, Column] | None = None, drop: Sequence[str] = (), first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """Renamed, added and dropped columns, in an order: ``first``, the others as they were, ``last``."""
    out = df.withColumnsRenamed(rename or {}).withColumns(assign or {}).drop(*drop)
    return out.select(*first, *[c for c in out.columns if c not in (*first, *last)], *last)
