"""Points near a place without reading all of them: a table laid out by cell, and covers of circles by ranges of cells.

``write_layout`` adds each point's cell as a number (a geohash's bits, so cells
that are near are often near in number), range-partitions by it and sorts, so each file and row group
holds few ranges of cells. ``cover`` says which ranges a circle needs, and ``within`` filters by
these, which Parquet scans skip by, and then by the exact distance. ``near_each`` does so for
many circles: their ranges meet the table by an equal-join on coarser cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.functions import geo

#: Bits of cells in a layout, most ranges of a cover.
BITS, MOST = 30, 48


def cell_number(lat: Column, lon: Column, bits: int = BITS) -> Column:
    """A point's cell as a number of ``bits`` bits: those of its geohash."""
    return geo.number_of(geo.cell_x(lon, bits), geo.cell_y(lat, bits), bits)


def _boxes(lat: float, lon: float, metres: float) -> list[tuple[float, float, float, float]]:
    """South, west, north, east of boxes that hold a circle: two if it crosses the date line; all longitudes if it holds a pole."""
    arc = metres / geo.EARTH_RADIUS_M * (1 + 1e-9) + 1e-9
    south, north = lat - math.degrees(arc), lat + math.degrees(arc)
    if south <= -90 or north >= 90 or arc >= math.pi / 2:
        return [(max(south, -90.0), -180.0, min(north, 90.0), 180.0)]
    wide = math.degrees(math.asin(min(1.0, math.sin(arc) / math.cos(math.radians(lat))))) + 1e-7
    west, east = lon - wide, lon + wide
    if west < -180:
        return [(south, west + 360, north, 180.0), (south, -180.0, north, east)]
    if east > 180:
        return [(south, west, north, 180.0), (south, -180.0, north, east - 360)]
    return [(south, west, north, east)]


def cover(lat: float, lon: float, metres: float, *, bits: int = BITS, most: int = MOST) -> list[tuple[int, int]]:
    """Ranges [low, high] of cell numbers, in order, that hold every cell of a circle; at most ``most``, the smallest gaps closed."""
    boxes = _boxes(lat, lon, metres)
    out: list[tuple[int, int]] = []
    level = [(0, 0, -90.0, -180.0, 90.0, 180.0)]  # bits so far, number, box

    def emit(depth: int, number: int) -> None:
        left = bits - depth
        out.append((number << left, ((number + 1) << left) - 1))

    while level:
        below = []
        for depth, number, s, w, n, e in level:
            touching = [b for b in boxes if b[0] <= n and b[2] >= s and b[1] <= e and b[3] >= w]
            if not touching:
                continue
            if depth == bits or any(b[0] <= s and b[2] >= n and b[1] <= w and b[3] >= e for b in touching):
                emit(depth, number)
            elif depth % 2 == 0:
                below += [(depth + 1, 2 * number, s, w, n, (w + e) / 2), (depth + 1, 2 * number + 1, s, (w + e) / 2, n, e)]
            else:
                below += [(depth + 1, 2 * number, s, w, (s + n) / 2, e), (depth + 1, 2 * number + 1, (s + n) / 2, w, n, e)]
        if len(below) > 4 * most:  # fine enough: what is left is taken whole
            for depth, number, *_ in below:
                emit(depth, number)
            below = []
        level = below
    merged: list[list[int]] = []
    for low, high in sorted(out):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    while len(merged) > most:
        k = min(range(len(merged) - 1), key=lambda i: merged[i + 1][0] - merged[i][1])
        merged[k][1] = merged.pop(k + 1)[1]
    return [(low, high) for low, high in merged]


def write_layout(df: DataFrame, lat: str, lon: str, path: str, *, files: int = 64, bits: int = BITS) -> None:
    """``df`` and its ``cell`` as Parquet, range-partitioned and sorted by cell. Points without a place are left out."""
    rows = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("cell", cell_number(F.col(lat), F.col(lon), bits))
    rows.repartitionByRange(files, "cell").sortWithinPartitions("cell").write.option("parquet.block.size", 32 << 20).parquet(path)


def within(table: DataFrame, lat: str, lon: str, lat0: float, lon0: float, metres: float, *, bits: int = BITS) -> DataFrame:
    """The rows of a layout within ``metres`` of a point."""
    inside, ranges = F.lit(False), cover(lat0, lon0, metres, bits=bits)
    for low, high in ranges:
        inside = inside | F.col("cell").between(low, high)
    return table.where(F.col("cell").between(ranges[0][0], ranges[-1][1]) & inside & (geo.haversine_m(F.col(lat), F.col(lon), F.lit(lat0), F.lit(lon0)) <= metres))


def near_each(spark: SparkSession, table: DataFrame, lat: str, lon: str, points: list[tuple[str, float, float]], metres: float, *, bits: int = BITS, coarse: int = 12) -> DataFrame:
    """The rows of a layout near each of several points (name, lat, lon): all columns, and ``point``. Points are what a caller lists, so they are broadcast."""
    left = bits - coarse
    ranges = [(name, a, b, low, high, c) for name, a, b in points for low, high in cover(a, b, metres, bits=bits) for c in range(low >> left, (high >> left) + 1)]
    wanted = spark.createDataFrame(ranges, "point string, _lat double, _lon double, _low long, _high long, _c long")
    every = [(min(r[3] for r in ranges), max(r[4] for r in ranges))] if ranges else [(0, -1)]
    rows = table.where(F.col("cell").between(*every[0])).withColumn("_c", F.shiftright("cell", left))
    met = rows.join(F.broadcast(wanted), "_c").where(F.col("cell").between(F.col("_low"), F.col("_high")))
    return met.where(geo.haversine_m(F.col(lat), F.col(lon), F.col("_lat"), F.col("_lon")) <= metres).select(*table.columns, "point")
