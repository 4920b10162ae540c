"""Nearest neighbours through the inverted file against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernmark.operators import inverted_file


def brute(ids, x, asked, k, digits=6):
    """Rows (q_id, id, distance, rank), ties to the lowest id."""
    n = np.linalg.norm(x, axis=1)
    out = []
    for q in asked:
        i = ids.index(q)
        if n[i] == 0:
            continue
        far = [(round(round(1 - float(x[i] @ x[j]) / (n[i] * n[j]), digits + 3), digits) + 0.0, ids[j]) for j in range(len(ids)) if ids[j] != q and n[j] > 0]
        out += [(q, j, d, r + 1) for r, (d, j) in enumerate(sorted(far)[:k])]
    return sorted(out)


def run(spark, x, asked, k, cells=None, first=4):
    ids = list(range(10, 10 + len(x)))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "id long, v array<double>")
    index = inverted_file.build(df, "id", "v", cells)
    found = inverted_file.nearest(index, df.where(F.col("id").isin(asked)), k, first=first).collect()
    return sorted((r.q_id, r.id, r.d_cosine, r["rank"]) for r in found), brute(ids, x, asked, k), sum(r.looked for r in found)


def test_clustered_rows_at_a_fraction_of_the_pairs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=16) * 6 + rng.normal(size=(60, 16)) for _ in range(25)])
    asked = list(range(10, 1510, 50))
    got, want, _ = run(spark, x, asked, 5, cells=25, first=1)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_pairs_that_are_looked_at(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=16) * 6 + rng.normal(size=(60, 16)) for _ in range(25)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    index = inverted_file.build(df, "id", "v", 25)
    asked = df.where("id % 50 = 0")
    opened = inverted_file.nearest(index, asked, 5, first=1).agg(F.sum("looked")).first()[0]
    assert opened < 0.3 * len(x) * asked.count()


def test_rows_without_order(spark):
    """Nothing can be left out, and nothing is lost."""
    x = np.random.default_rng(3).normal(size=(300, 24))
    got, want, _ = run(spark, x, [10, 60, 110], 7)
    assert [g[:2] for g in got] == [w[:2] for w in want]


@pytest.mark.parametrize("block", [7, 4096])
def test_awkward_rows(spark, monkeypatch, block):
    """Many rows alike, zeros, nulls, fewer rows than asked for."""
    monkeypatch.setattr(inverted_file, "BLOCK", block)
    x = np.array([[1.0, 2, 0]] * 40 + [[0, 0, 0]] * 3 + [[0, 1, 1], [-1, -2, 0]])
    got, want, _ = run(spark, x, [10, 50, 53, 54], 50, first=1)
    assert got == want
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [2.0, 0.0])], "id long, v array<double>")
    found = inverted_file.nearest(inverted_file.build(df, "id", "v"), df, 3).collect()
    assert sorted((r.q_id, r.id, r.d_cosine) for r in found) == [(1, 4, 0.0), (4, 1, 0.0)]
    nothing = inverted_file.build(df.limit(0), "id", "v")
    assert inverted_file.nearest(nothing, df, 3).count() == 0


def test_batches_over_the_bound_go_through_the_index(spark, monkeypatch):
    from fernmark.operators import search

    x = np.random.default_rng(5).normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 8)], "id long, v array<double>")
    asked = df.where("id % 20 = 0")
    plain = search.batch_nearest(df, asked, "v", "id", 4).collect()
    monkeypatch.setattr(search, "MAX_PAIRS", 10)
    found = search.batch_nearest(df, asked, "v", "id", 4)
    assert found.columns == ["q_id", "id", "d_cosine", "rank"] and sorted(map(tuple, found.collect())) == sorted(map(tuple, plain))
