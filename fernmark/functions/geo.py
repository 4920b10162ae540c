"""Geohashes at any number of bits, as column arithmetic.

A hash of p bits is a cell (x, y) of a grid with ceil(p / 2) bits of longitude
and floor(p / 2) of latitude; its text interleaves them, longitude first, five
bits a character, padded with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.functions.arrays import bound

#: The base-32 alphabet of geohashes. Fixed value.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Mean radius of the earth in metres.
EARTH_RADIUS_M = 6371008.8
#: Width of a cell in miles, as named, and its bits. Fixed values.
BITS_BY_WIDTH = {
    "12407mi": 1, "6204mi": 3, "3102mi": 5, "1551mi": 7, "775mi": 9, "388mi": 11, "194mi": 13, "97mi": 15,
    "48mi": 17, "24mi": 19, "12mi": 21, "6mi": 23, "3mi": 25, "1.5mi": 27, ".8mi": 29, ".4mi": 31,
}


def _axes(bits: int) -> tuple[int, int]:
    return (bits + 1) // 2, bits // 2


def cell_x(lon: Column, bits: int) -> Column:
    n = 1 << _axes(bits)[0]
    return F.when(lon.isNotNull(), F.least(F.floor((lon + 180) / 360 * n), F.lit(n - 1)).cast("long"))


def cell_y(lat: Column, bits: int) -> Column:
    n = 1 << _axes(bits)[1]
    return F.when(lat.isNotNull(), F.least(F.floor((lat + 90) / 180 * n), F.lit(n - 1)).cast("long"))


def cell_text(x: Column, y: Column, bits: int) -> Column:
    """The text of a cell. One character for every five bits."""
    if bits == 0:
        return F.lit("")
    of_x, of_y = _axes(bits)
    chars = []
    for at in range(0, bits, 5):
        value = F.lit(0).cast("long")
        for k in range(at, at + 5):
            bit = F.lit(0).cast("long")
            if k < bits:
                axis, left = (x, of_x - 1 - k // 2) if k % 2 == 0 else (y, of_y - 1 - k // 2)
                bit = F.shiftright(axis, left).bitwiseAND(F.lit(1))
            value = value * 2 + bit
        chars.append(F.substring(F.lit(ALPHABET), value.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def number_of(x: Column, y: Column, bits: int) -> Column:
    """A cell as a number: the bits of its geohash. Shifted to the right by n it is the cell of n bits less that holds it."""
    of_x, of_y = _axes(bits)
    out = F.lit(0).cast("long")
    for k in range(bits):
        axis, left = (x, of_x - 1 - k // 2) if k % 2 == 0 else (y, of_y - 1 - k // 2)
        out = out * 2 + F.shiftright(axis, left).bitwiseAND(F.lit(1).cast("long"))
    return out


def number_text(number: Column, bits: Column, most: int) -> Column:
    """The text of a cell's number, whose bits (``most`` at most) may differ by row."""
    n = -(-most // 5)
    padded = F.call_function("shiftleft", number, (F.lit(5 * n) - bits).cast("int"))
    chars = bound(padded, lambda v: F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(v, 5 * (n - 1 - k)).bitwiseAND(F.lit(31).cast("long")).cast("int") + 1, F.lit(1)) for k in range(n)]))
    return F.substring(chars, F.lit(1), F.ceil(bits / 5).cast("int"))


def geohash(lat: Column, lon: Column, bits: int) -> Column:
    """Geohash of a point at ``bits`` bits."""
    return cell_text(cell_x(lon, bits), cell_y(lat, bits), bits)


def text_to_int(text: Column, bits: int) -> Column:
    """The first ``bits`` bits (at most 60) of a geohash text as a number; missing characters are zeros."""
    chars = -(-bits // 5)

    def number(padded: Column) -> Column:
        value = F.lit(0).cast("long")
        for k in range(chars):
            value = value * 32 + F.position(F.substring(padded, k + 1, 1), F.lit(ALPHABET)).cast("long") - 1
        return F.shiftright(value, chars * 5 - bits) if chars * 5 > bits else value

    return bound(F.rpad(text, chars, "0"), number) if chars else F.lit(0).cast("long")


def _int_axis(value: Column, bits: int, first: int) -> Column:
    """Every second bit of a number of ``bits`` bits, from the ``first`` one on, high to low."""
    out = F.lit(0).cast("long")
    for k in range(first, bits, 2):
        out = out * 2 + F.shiftright(value, bits - 1 - k).bitwiseAND(F.lit(1))
    return out


def cell_of_text(text: Column, bits: int) -> tuple[Column, Column]:
    value = text_to_int(text, bits)
    return bound(value, lambda v: _int_axis(v, bits, 0)), bound(value, lambda v: _int_axis(v, bits, 1))


def at_bits(text: Column, bits: int) -> Column:
    """A geohash cut to, or padded with zeros to, ``bits`` bits."""
    x, y = cell_of_text(text, bits)
    return bound(F.struct(x.alias("x"), y.alias("y")), lambda c: cell_text(c["x"], c["y"], bits))


def box(x: Column, y: Column, bits: int) -> dict[str, Column]:
    """Edges of a cell: south, west, north, east."""
    nx, ny = (1 << n for n in _axes(bits))
    return {"south": y * (180.0 / ny) - 90, "west": x * (360.0 / nx) - 180, "north": (y + 1) * (180.0 / ny) - 90, "east": (x + 1) * (360.0 / nx) - 180}


def around(x: Column, y: Column, bits: int) -> Column:
    """Distinct cells {x, y} of a cell and its neighbours; longitude wraps, latitude ends at the poles."""
    if bits == 0:
        return F.array().cast("array<struct<x:bigint,y:bigint>>")
    nx, ny = (1 << n for n in _axes(bits))
    steps = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    cells = F.array(*[F.struct(F.pmod(x + dx, F.lit(nx)).alias("x"), (y + dy).alias("y")) for dx, dy in steps])
    return F.array_distinct(F.filter(cells, lambda c: (c["y"] >= 0) & (c["y"] < ny)))


def expand(text: Column, bits: int) -> Column:
    """Texts of a cell and its neighbours, sorted."""
    x, y = cell_of_text(text, bits)
    return F.array_sort(F.transform(around(x, y, bits), lambda c: cell_text(c["x"], c["y"], bits)))


def smooth(lat: Column, lon: Column, bits: int) -> Column:
    """The cells of ``bits`` bits that touch the point's cell of two bits more, or its neighbours: at most four."""
    fine = around(cell_x(lon, bits + 2), cell_y(lat, bits + 2), bits + 2)
    return F.array_sort(F.array_distinct(F.transform(fine, lambda c: cell_text(F.shiftright(c["x"], 1), F.shiftright(c["y"], 1), bits))))


def wrap_longitude(lon: Column) -> Column:
    """Into [-270, 90): a map that starts in the Pacific."""
    return F.pmod(lon + 270, F.lit(360.0)) - 270


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def within_m(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    """Within a distance of a point: a band of latitudes, which scans can prune by, then the distance."""
    band = metres / EARTH_RADIUS_M * 57.29577951308232
    return lat.between(lat0 - band, lat0 + band) & (haversine_m(lat, lon, F.lit(lat0), F.lit(lon0)) <= metres)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Within a box, edges included; one whose west is east of its east spans the date line. Plain comparisons, which scans can prune by."""
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def all_cells(spark: SparkSession, bits: int) -> DataFrame:
    """Every cell of ``bits`` bits with its neighbours, itself among them: cell, around."""
    if not 0 < bits <= 40:
        raise ValueError("bits must be 1 to 40")
    nx, ny = (1 << n for n in _axes(bits))
    x, y = F.pmod("id", F.lit(nx)), F.expr(f"id div {nx}")
    cells = spark.range(nx * ny).select(x.alias("x"), y.alias("y"))
    return cells.select(cell_text(F.col("x"), F.col("y"), bits).alias("cell"), F.array_sort(F.transform(around(F.col("x"), F.col("y"), bits), lambda c: cell_text(c["x"], c["y"], bits))).alias("around"))


def cells_with_neighbours(df: DataFrame, lat: str, lon: str, bits: int) -> DataFrame:
    """The cells that a table's points have, each with its neighbours, itself among them: cell, around."""
    cells = df.select(cell_x(F.col(lon), bits).alias("x"), cell_y(F.col(lat), bits).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct()
    return cells.select(cell_text(F.col("x"), F.col("y"), bits).alias("cell"), F.array_sort(F.transform(around(F.col("x"), F.col("y"), bits), lambda c: cell_text(c["x"], c["y"], bits))).alias("around"))
