"""Clusters of vectors: k-means, spherical k-means, and the trees, orders and cuts of agglomeration (``microclusters`` runs it by group)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalised(vectors: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(n > 0, n, 1)


def merges(vectors: np.ndarray, method: str = "ward", counts: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (a, b, distance) by the Lance-Williams recurrence; the k-th makes cluster n + k.

    Vectors may be centres of ``counts`` rows each.
    """
    n = len(vectors)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    d = np.maximum(norms[:, None] + norms[None] - 2 * vectors @ vectors.T, 0)
    if method != "ward":
        d = np.sqrt(d)
    size = np.ones(n) if counts is None else counts.astype(float)
    if method == "ward" and counts is not None:
        d = d * (2 * size[:, None] * size / (size[:, None] + size))
    np.fill_diagonal(d, np.inf)
    name, out = list(range(n)), []
    alive = np.ones(n, bool)
    near = d.argmin(axis=1) if n else np.zeros(0, int)  # of each row, kept up to date: a merge looks at n numbers, not n * n
    least = d[np.arange(n), near]
    for k in range(n - 1):
        i, j = sorted((int(np.argmin(least)), int(near[np.argmin(least)])))
        dist = d[i, j]
        out.append((min(name[i], name[j]), max(name[i], name[j]), float(np.sqrt(dist) if method == "ward" else dist)))
        others = alive.copy()
        others[[i, j]] = False
        a, b, s = size[i], size[j], size[others]
        if method == "ward":
            new = ((a + s) * d[i, others] + (b + s) * d[j, others] - s * dist) / (a + b + s)
        elif method == "complete":
            new = np.maximum(d[i, others], d[j, others])
        else:
            new = (a * d[i, others] + b * d[j, others]) / (a + b)
        d[i, others] = d[others, i] = new
        d[j, :] = d[:, j] = np.inf
        alive[j], size[i], name[i] = False, a + b, n + k
        least[j] = np.inf
        stale = np.flatnonzero(alive & ((near == i) | (near == j)))
        for r in {i, *stale.tolist()}:
            near[r] = d[r].argmin()
            least[r] = d[r, near[r]]
        closer = np.flatnonzero(alive & ((d[:, i] < least) | ((d[:, i] == least) & (i < near))))
        near[closer], least[closer] = i, d[closer, i]
    return out


def leaf_order(n: int, tree: list[tuple[int, int, float]]) -> list[int]:
    """Leaves from first to last, the left child of every merge first; the end with more of the larger branch leads."""
    if n == 0:
        return []
    count = {**{k: 1 for k in range(n)}}
    for k, (a, b, _) in enumerate(tree):
        count[n + k] = count[a] + count[b]
    order, stack = [], [n + len(tree) - 1 if tree else 0]
    while stack:
        c = stack.pop()
        if c < n:
            order.append(c)
        else:
            a, b, _ = tree[c - n]
            stack += [b, a]
    if tree and count[tree[-1][0]] < count[tree[-1][1]]:
        order.reverse()
    return order


def cut(n: int, tree: list[tuple[int, int, float]], k: int) -> list[int]:
    """Cluster numbers, 0 to k - 1, of the leaves before the last k - 1 merges."""
    parent = list(range(n + len(tree)))
    for m, (a, b, _) in enumerate(tree[: max(0, n - k)]):
        parent[a] = parent[b] = n + m
    roots = []
    for leaf in range(n):
        while parent[leaf] != leaf:
            leaf = parent[leaf]
        roots.append(leaf)
    seen = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return [seen[r] for r in roots]


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 0, cosine: bool = False) -> DataFrame:
    """Adds ``cluster`` by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", distanceMeasure="cosine" if cosine else "euclidean").fit(rows)
    return model.transform(rows).drop("_v")


def spherical_kmeans(df: DataFrame, id_col: str, vector: str, k: int, rounds: int = 100, moved: float = 0.01) -> tuple[np.ndarray, DataFrame]:
    """(centres, id and cluster): unit centres gather the projections of their vectors and are scaled to one again.

    A round is one pass of tasks that return k sums each; it ends when at most a
    share ``moved`` of vectors changed. The first centres are the vectors of the
    lowest ids' hashes, so runs agree.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    first = rows.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(k).toPandas()["v"]
    centres = normalised(np.stack(first.to_numpy()))
    sc = df.sparkSession.sparkContext

    def assign(at):
        def run(batches):
            for b in batches:
                x = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, at.value.shape[1]))
                yield pd.DataFrame({"id": b["id"], "cluster": (x @ at.value.T).argmax(axis=1)})

        return run

    def sums(now, before):
        def run(batches):
            total, n, changed = np.zeros_like(now.value), 0, 0
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["v"].to_numpy())
                s = x @ now.value.T
                best = s.argmax(axis=1)
                changed += int((best != (x @ before.value.T).argmax(axis=1)).sum())
                np.add.at(total, best, x * s[np.arange(len(x)), best][:, None])
                n += len(x)
            yield pd.DataFrame({"total": [total.ravel().tolist()], "n": [n], "changed": [changed]})

        return run

    before = centres
    for step in range(rounds):
        made = rows.mapInPandas(sums(sc.broadcast(centres), sc.broadcast(before)), "total array<double>, n long, changed long").toPandas()
        if step and made["changed"].sum() <= moved * max(1, made["n"].sum()):
            break
        before = centres
        centres = normalised(centres + np.sum(np.stack(made["total"].to_numpy()), axis=0).reshape(centres.shape))
    kind = dict(df.dtypes)[id_col]
    return centres, rows.mapInPandas(assign(sc.broadcast(centres)), f"id {kind}, cluster int").withColumnRenamed("id", id_col)
