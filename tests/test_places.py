"""Layouts by cell, nested priors and agglomeration of large groups."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fernmark.functions import geo
from fernmark.operators import clustering, microclusters, places, priors


def number(lat, lon, bits=places.BITS):
    """A cell's number by halving."""
    s, n, w, e, out = -90.0, 90.0, -180.0, 180.0, 0
    for k in range(bits):
        out *= 2
        if k % 2 == 0:
            m = (w + e) / 2
            out, w, e = (out + 1, m, e) if lon >= m else (out, w, m)
        else:
            m = (s + n) / 2
            out, s, n = (out + 1, m, n) if lat >= m else (out, s, m)
    return out


def far(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(h, 1)))


CIRCLES = [(37.9, -122.0, 50_000), (0, 179.9, 400_000), (-16, -179.99, 90_000), (89.0, 10, 300_000), (-90, 0, 1_000_000), (51.5, 0.0, 500), (10, 20, 15_000_000), (45, 45, 0)]


@pytest.mark.parametrize("lat, lon, metres", CIRCLES)
def test_covers_hold_their_circles(lat, lon, metres):
    rng = random.Random(lat)
    for bits, most in ((30, 48), (30, 3), (11, 20)):
        ranges = places.cover(lat, lon, metres, bits=bits, most=most)
        assert len(ranges) <= most and all(a <= b for a, b in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
        for _ in range(300):
            turn, away = rng.uniform(0, 2 * math.pi), metres * math.sqrt(rng.random()) / geo.EARTH_RADIUS_M
            p = math.radians(lat)
            q = math.asin(math.sin(p) * math.cos(away) + math.cos(p) * math.sin(away) * math.cos(turn))
            d = math.radians(lon) + math.atan2(math.sin(turn) * math.sin(away) * math.cos(p), math.cos(away) - math.sin(p) * math.sin(q))
            a, b = math.degrees(q), (math.degrees(d) + 540) % 360 - 180
            if far(lat, lon, a, b) <= metres:
                assert any(x <= number(a, b, bits) <= y for x, y in ranges)
    if metres == 500:
        assert sum(b - a + 1 for a, b in places.cover(lat, lon, metres)) < 2000  # of a thousand million cells


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(4000)] + [(9001, 90.0, 180.0), (9002, -90.0, -180.0), (9003, None, 1.0)]
    path = str(tmp_path_factory.mktemp("layout") / "t")
    places.write_layout(spark.createDataFrame(rows, "id long, lat double, lon double"), "lat", "lon", path, files=16)
    return path, [r for r in rows if r[1] is not None]


@pytest.mark.parametrize("lat, lon, metres", [*CIRCLES, (90, 0, 10)])
def test_rows_within(spark, laid_out, lat, lon, metres):
    path, rows = laid_out
    got = places.within(spark.read.parquet(path), "lat", "lon", lat, lon, metres)
    assert sorted(r.id for r in got.collect()) == sorted(i for i, a, b in rows if far(lat, lon, a, b) <= metres)


def test_scans_are_given_ranges_and_skip_files(spark, laid_out):
    path, rows = laid_out
    table = spark.read.parquet(path)
    assert [r.id for r in table.where(F.col("cell") != places.cell_number(F.col("lat"), F.col("lon"))).collect()] == []
    assert all(number(min(r.lat, 89.999999), min(r.lon, 179.999999)) == r.cell for r in table.limit(500).collect())
    found = places.within(table, "lat", "lon", 37.9, -122.0, 300_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cell" in plan and "LessThanOrEqual(cell" in plan
    files = table.groupBy(F.input_file_name().alias("f")).agg(F.min("cell").alias("lo"), F.max("cell").alias("hi")).collect()
    ranges = places.cover(37.9, -122.0, 300_000)
    assert sum(any(a <= f.hi and b >= f.lo for a, b in ranges) for f in files) <= len(files) / 4


def test_near_each_of_several(spark, laid_out):
    path, rows = laid_out
    points = [("a", 37.9, -122.0), ("b", 0.0, 179.9), ("c", 38.5, -121.0)]
    got = places.near_each(spark, spark.read.parquet(path), "lat", "lon", points, 900_000)
    assert sorted((r.point, r.id) for r in got.collect()) == sorted((n, i) for n, x, y in points for i, a, b in rows if far(x, y, a, b) <= 900_000)


def test_nested_and_smoothed_presence_of_lists_in_several_cells(spark):
    """Distinct counts where checklists move: they count once in each cell that holds any of their places."""
    rng = random.Random(8)
    rows = [(f"c{rng.randrange(60)}", rng.choice("xyz"), rng.randrange(2), rng.choice([-60.0, 10.0, 10.2, 70.0]), rng.choice([-170.0, 20.0, 20.1, 175.0])) for _ in range(400)]
    rows += [(f"d{k}", rng.choice("xyz"), k % 2, 40.0 + k, 5.0) for k in range(30)] + [("e", "x", 0, None, 1.0)]
    obs = spark.createDataFrame(rows, "checklist string, kind string, week int, lat double, lon double")
    got = priors.nested_presence(obs, "lat", "lon", [5, 11, 21], ["week"], "checklist", "kind")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand ") == 1
    want = []
    for bits in (5, 11, 21):
        loc = lambda a, b, n=bits: number(a, b, n)
        bins: dict = {}
        for c, k, w, a, b in rows:
            if a is not None:
                bins.setdefault((loc(a, b), w), {}).setdefault(k, set()).add(c)
        for (cell, w), kinds in bins.items():
            n = len(set().union(*kinds.values()))
            want += [(bits, w, k, len(s), n) for k, s in kinds.items()]
    assert sorted((r.bits, r.week, r.kind, r.n_present, r.n) for r in got.collect()) == sorted(want)
    placed = obs.withColumns({"x": geo.cell_x(F.col("lon"), 7), "y": geo.cell_y(F.col("lat"), 7)})
    smooth = priors.smoothed_presence(placed, "x", "y", 7, "checklist", "kind")
    spread = priors.smooth_places(placed.where("x IS NOT NULL AND y IS NOT NULL"), "x", "y", 7, ["checklist", "kind"])
    plain = priors.presence(spread, ["loc"], "checklist", "kind")
    assert sorted(map(str, smooth.select("loc", "kind", "n_present", "n", "p").collect())) == sorted(map(str, plain.select("loc", "kind", "n_present", "n", "p").collect()))


def _vectors(spark, n, seed, groups=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(5, 8)) * 8
    rows = [(k, k % groups, [float(v) for v in x[k % 5] + rng.normal(size=8)]) for k in range(n)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "g", "v"]), "id long, g int, v array<double>"), rows


def test_trees_below_the_bound_are_exact(spark):
    df, rows = _vectors(spark, 120, 1, groups=2)
    got = {r.id: (r.g, r.sort_order, r.cluster) for r in microclusters.agglomerate(df, "g", "id", "v", 4).collect()}
    for g in (0, 1):
        mine = [r for r in rows if r[1] == g]
        tree = clustering.merges(np.array([r[2] for r in mine]))
        order, of = clustering.leaf_order(len(mine), tree), clustering.cut(len(mine), tree, 4)
        assert [got[mine[k][0]][1] for k in order] == list(range(len(mine)))
        assert [got[r[0]][2] for r in mine] == of


@pytest.mark.parametrize("n, most, share", [(900, 100, 5), (2500, 60, 3)])
def test_groups_over_the_bound(spark, n, most, share):
    """Places are a permutation, clusters are runs of it and are the blobs; several levels of summaries."""
    df, rows = _vectors(spark, n, 2)
    df = df.union(spark.createDataFrame([(-1, 7, [1.0] * 8), (-2, None, [2.0] * 8), (-3, None, [3.0] * 8)], df.schema))
    got = {r.id: r for r in microclusters.agglomerate(df, "g", "id", "v", 5, most=most, share=share).collect()}
    assert len(got) == n + 3 and got[-1].sort_order == 0 and {got[-2].sort_order, got[-3].sort_order} == {0, 1}
    big = [got[r[0]] for r in rows]
    assert sorted(r.sort_order for r in big) == list(range(n))
    by_blob = {}
    for r in big:
        by_blob.setdefault(r.id % 5, set()).add(r.cluster)
    assert all(len(c) == 1 for c in by_blob.values()) and len(set().union(*by_blob.values())) == 5
    in_order = [r.cluster for r in sorted(big, key=lambda r: r.sort_order)]
    assert sum(a != b for a, b in zip(in_order, in_order[1:])) == 4


def test_weighted_merges_are_merges_of_copies():
    x, counts = np.random.default_rng(3).normal(size=(7, 3)), np.array([1, 4, 2, 1, 3, 1, 5])
    tree = clustering.merges(x, "ward", counts)
    every = clustering.merges(np.repeat(x, counts, axis=0))
    assert np.allclose(sorted(d for _, _, d in tree), sorted(d for _, _, d in every)[-6:])
