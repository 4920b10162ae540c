"""Statistics and windows of array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def bound(value: Column, f) -> Column:
    """f(value), computed once: a value used inside another lambda would be computed for each element there."""
    return F.element_at(F.transform(F.array(value), f), 1)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def mean(a: Column) -> Column:
    return F.try_divide(_sum(a), F.size(a))


def _moment(a: Column, k: int) -> Column:
    return bound(mean(a), lambda m: F.try_divide(_sum(F.transform(a, lambda v: F.pow(v - m, k))), F.size(a)))


def std(a: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(_moment(a, 2))


def skew(a: Column) -> Column:
    """Biased."""
    return F.try_divide(_moment(a, 3), F.pow(_moment(a, 2), 1.5))


def kurtosis(a: Column) -> Column:
    """Excess, biased."""
    return F.try_divide(_moment(a, 4), F.pow(_moment(a, 2), 2)) - 3


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    lower, upper = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.try_element_at(s, lower) + F.try_element_at(s, upper)) / 2)


def difference(a: Column) -> Column:
    """First differences; empty for fewer than two elements."""
    n = F.size(a)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(1))), F.slice(a, 1, F.greatest(n - 1, F.lit(1))), lambda x, y: x - y))


#: Summaries by name, in the order in which a feature vector holds them.
SUMMARIES = {
    "mean": mean,
    "std": std,
    "min": F.array_min,
    "max": F.array_max,
    "median": median,
    "skew": skew,
    "kurtosis": kurtosis,
    "dmean": lambda a: mean(difference(a)),
    "dstd": lambda a: std(difference(a)),
    "d2mean": lambda a: mean(difference(difference(a))),
    "d2std": lambda a: std(difference(difference(a))),
}


def patches(matrix: Column, width: int) -> Column:
    """Windows of ``width`` columns of a matrix given by rows: one flattened array each, row by row."""
    steps = F.size(matrix[0]) - width + 1
    return F.when(steps > 0, F.transform(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), lambda i: F.flatten(F.transform(matrix, lambda row: F.slice(row, i, width))))).otherwise(
        F.array().cast("array<array<double>>")
    )


def transpose(matrix: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(matrix[0])), lambda i: F.transform(matrix, lambda row: F.element_at(row, i)))


def median_clipped(matrix: Column) -> Column:
    """Each row less its median, not below 0."""
    return F.transform(matrix, lambda row: bound(median(row), lambda m: F.transform(row, lambda v: F.greatest(v - m, F.lit(0.0)))))


def rms_normalised(matrix: Column) -> Column:
    """Divided by the root mean square of all elements."""
    flat = F.flatten(matrix)
    rms = F.sqrt(_sum(F.transform(flat, lambda v: v * v)) / F.size(flat))
    return bound(rms, lambda r: F.transform(matrix, lambda row: F.transform(row, lambda v: F.try_divide(v, r))))


def features(a: Column, names: Sequence[str] = tuple(SUMMARIES)) -> Column:
    """The named summaries of an array as one array, in that order."""
    return F.array(*[SUMMARIES[n](a).cast("double") for n in names])


def feature_vector(matrix: Column, names: Sequence[str] = tuple(SUMMARIES)) -> Column:
    """The features of all rows of a matrix: all rows' first summary, then all rows' second, and so on."""
    of = lambda n: lambda row: SUMMARIES[n](row).cast("double")
    return F.flatten(F.array(*[F.transform(matrix, of(n)) for n in names]))


def slice_times(matrix: Column, times: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The columns of a matrix at times in [start, end), and these times counted from ``start``."""
    inside = lambda t: (t >= start) & (t < end)
    chosen = F.filter(F.transform(times, lambda t, i: F.when(inside(t), i)), lambda i: i.isNotNull())
    cut = F.transform(matrix, lambda row: F.transform(chosen, lambda i: F.get(row, i)))
    return cut, F.transform(F.filter(times, inside), lambda t: t - start)
