"""Calendar bins of 48 "weeks" a year: four to a month, of 7, 7, 7 and the remaining days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKS = 48
#: Bin widths in weeks that divide the year and are in use. Fixed values.
WIDTHS = (1, 2, 3, 4, 6, 12, 24, 48)


def week(date: Column) -> Column:
    """0 to 47: month and quarter of the month."""
    return ((F.month(date) - 1) * 4 + F.least(F.floor((F.dayofmonth(date) - 1) / 7), F.lit(3))).cast("int")


def normal_week(n: Column) -> Column:
    """Any integer, negative ones included, as a week of the year."""
    return F.pmod(n, F.lit(WEEKS)).cast("int")


def first_day(n: Column, year: int | Column) -> Column:
    """The date on which a week begins."""
    year = F.lit(year) if isinstance(year, int) else year
    return F.make_date(year, F.floor(n / 4).cast("int") + 1, (n % 4 * 7 + 1).cast("int"))


def date_bin(n: Column, width: int) -> Column:
    """The first week of the bin of ``width`` weeks that holds week ``n``."""
    if width not in WIDTHS:
        raise ValueError(f"width must be one of {WIDTHS}")
    return (F.floor(n / width) * width).cast("int")


def enclosing_bins(date: Column, width: int) -> Column:
    """The date's bin and the neighbour that is nearer to it, ascending; one bin if the year is one."""
    n = week(date)
    own = date_bin(n, width)
    if width == WEEKS:
        return F.array(own)
    position = F.least(F.dayofmonth(date) - 1, F.lit(27)) / 7 if width == 1 else n / width
    early = position - F.floor(position) < 0.5
    other = F.pmod(F.when(early, own - width).otherwise(own + width), F.lit(WEEKS)).cast("int")
    return F.array_sort(F.array(own, other))
