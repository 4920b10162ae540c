"""Ranking metrics of class scores, as column expressions and aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.scratch import kept, small


def long_scores(df: DataFrame, classes: Column | Sequence[str], scores: Column, keep: Sequence[str]) -> DataFrame:
    """One row for each class: keep, class, score."""
    names = classes if isinstance(classes, Column) else F.array(*map(F.lit, classes))
    return df.select(*keep, F.explode(F.arrays_zip(names.alias("c"), scores.alias("s"))).alias("z")).select(*keep, F.col("z.c").alias("class"), F.col("z.s").alias("score"))


def ranked_classes(classes: Column, scores: Column) -> Column:
    """Classes by falling score, ties by name: array of {p, class}."""
    pairs = F.zip_with(scores, classes, lambda s, c: F.struct((-s).alias("m"), c.alias("class")))
    return F.transform(F.array_sort(pairs), lambda z: F.struct((-z["m"]).alias("p"), z["class"].alias("class")))


def coverage_error(classes: Column, scores: Column, truth: Column) -> Column:
    """How far down the ranking the true class is: scores not below its own, ties counted; infinite if unknown."""
    clean = F.transform(scores, lambda s: F.nanvl(s.cast("double"), F.lit(0.0)))
    own = F.try_element_at(clean, F.array_position(classes, truth).cast("int"))
    known = F.array_contains(classes, truth)
    return F.when(known, F.size(F.filter(clean, lambda s: s >= F.when(known, own))).cast("double")).otherwise(F.lit(float("inf")))


def score(df: DataFrame, error: str, by: Sequence[str] = ()) -> DataFrame:
    """-median error, with its quartiles. Errors are places in a ranking: few distinct values, which is what an exact percentile holds."""
    q = df.groupBy(*by).agg(F.percentile(error, [0.25, 0.5, 0.75]).alias("_q"), F.count("*").alias("n"))
    return q.select(*by, (-F.col("_q")[1]).alias("score"), *[F.col("_q")[k].alias(p) for k, p in enumerate(("p25", "p50", "p75"))], "n")


_BINS = 4096


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between neighbours) of finite values by group: by and a column for each of ``shares``.

    Two aggregates that combine before their shuffle find, by a histogram of each
    group's range, the bins that hold the wanted ranks; only the distinct values
    of these bins are ordered. So no task gets a group, however large.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    one = [*by, "_k"]
    rows = rows.withColumn("_k", F.lit(0))
    ends = small(kept(rows.groupBy(*one).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n")), "ends"))
    step = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _BINS), F.lit(_BINS - 1))
    binned = rows.join(ends, one).withColumn("_b", F.coalesce(F.when(F.col("_hi") > F.col("_lo"), step), F.lit(0)).cast("int"))
    counts = binned.groupBy(*one, "_b").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*one).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = list(shares)
    ranks = F.array(*[F.struct(F.lit(k).alias("q"), (side((F.col("_n") - 1) * shares[n])).cast("long").alias("r")) for k, n in enumerate(names) for side in (F.floor, F.ceil)])
    holds = counts.withColumn("_before", before).withColumn("_ranks", F.filter(ranks, lambda x: (x["r"] >= F.col("_before")) & (x["r"] < F.col("_before") + F.col("_c")))).where(F.size("_ranks") > 0)
    wanted = small(kept(holds.select(*one, "_b", "_before", "_ranks"), "bins"))
    values = binned.join(wanted, [*one, "_b"]).groupBy(*one, "_b", "_v").agg(F.count("*").alias("_c"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"), F.first("_n").alias("_n"))
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*one, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_before")
    hit = values.withColumn("_at", inside).select(*by, "_v", "_n", F.explode(F.filter("_ranks", lambda x: (x["r"] >= F.col("_at")) & (x["r"] < F.col("_at") + F.col("_c")))).alias("x"))
    pairs = hit.groupBy(*by, "_n", F.col("x.q").alias("q")).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.min("x.r").alias("r"))
    # As percentile() does: the nearer neighbour weighs more.
    at = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(shares[n]) for n in names]), F.col("q") + 1)
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.col("r") + 1 - at) * F.col("low") + (at - F.col("r")) * F.col("high"))
    return pairs.withColumn("_x", between).groupBy(*by).agg(*[F.max(F.when(F.col("q") == k, F.col("_x"))).alias(n) for k, n in enumerate(names)])


def confusion(df: DataFrame, truth: str, classes: Column | Sequence[str], scores: Column) -> DataFrame:
    """Summed scores by true and predicted class, and each as a share of its true class."""
    cells = long_scores(df, classes, scores, [truth]).groupBy(truth, "class").agg(F.sum("score").alias("total"))
    rows = cells.groupBy(truth).agg(F.sum("total").alias("row_total"))
    return cells.join(rows, truth).withColumn("share", F.coalesce(F.try_divide("total", "row_total"), F.lit(0.0)))


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (the furthest values within 1.5 interquartile ranges) and how many values lie outside."""
    q = kept(exact_quantiles(df, by, value, {"q1": 0.25, "med": 0.5, "q3": 0.75}), "quartiles")
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(lo, hi)
    joined = df.join(small(q), list(by)) if by else df.crossJoin(F.broadcast(q))
    whiskers = [F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high")]
    return joined.groupBy(*by, "q1", "med", "q3").agg(*whiskers, F.countDistinct(F.when(~inside, F.col(value))).alias("n_outliers"))


def known_classes(df: DataFrame, truth: str, classes: Column | Sequence[object]) -> DataFrame:
    """Rows whose true class a model has."""
    return df.where(F.array_contains(classes if isinstance(classes, Column) else F.array(*map(F.lit, classes)), F.col(truth)))


def merged_confusion(folds: Sequence[DataFrame], truth: str) -> DataFrame:
    """Confusions of several folds (truth, class, total) as one, shares anew."""
    cells = reduce(DataFrame.unionByName, [f.select(truth, "class", "total") for f in folds]).groupBy(truth, "class").agg(F.sum("total").alias("total"))
    rows = cells.groupBy(truth).agg(F.sum("total").alias("row_total"))
    return cells.join(rows, truth).withColumn("share", F.coalesce(F.try_divide("total", "row_total"), F.lit(0.0)))


def unpivot_splits(df: DataFrame, ids: Sequence[str], pattern: str = r"^split(\d+)_(.+)$") -> DataFrame:
    """Columns split<k>_<metric> as rows (ids, split, metric columns)."""
    import re

    found = [c for c in df.columns if re.match(pattern, c)]
    long = df.unpivot(list(ids), found, "column", "value")
    long = long.withColumn("split", F.regexp_extract("column", pattern, 1).cast("int")).withColumn("metric", F.regexp_extract("column", pattern, 2))
    metrics = sorted({re.match(pattern, c)[2] for c in found})
    return long.groupBy(*ids, "split").pivot("metric", metrics).agg(F.first("value"))
