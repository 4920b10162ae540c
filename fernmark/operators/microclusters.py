"""Agglomeration of groups that no task could hold: summaries first, a tree over these, places joined back.

A summary is a clustering feature: count, sum and sum of squares of its members.
Groups of more than ``most`` rows are dealt to chunks of at most so many; each chunk is agglomerated
and cut into ``share`` times fewer summaries, and again over the summaries, until a
group has at most ``most``. The tree of a group then weighs summaries by their counts. A row's place is
its place in its chunk plus the places before its summary, a level after another, so no window holds
a group. Groups of at most ``most`` rows have one chunk and no summaries: their trees are exact.

Ward's distance of two summaries needs centres and counts only; complete and average links are
taken between centres, so for groups over the bound these two are approximations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernmark.operators import clustering
from fernmark.scratch import kept

SHARE = 50


def _placed(tree: list, n: int, counts: np.ndarray) -> np.ndarray:
    """Rows before each leaf, in the tree's order, when leaf k stands for counts[k] rows."""
    order = clustering.leaf_order(n, tree)
    before = np.empty(n, np.int64)
    before[order] = np.cumsum(counts[order]) - counts[order]
    return before


def _tree(x: np.ndarray, counts: np.ndarray, method: str) -> list:
    return clustering.merges(x, method, counts)


def _summarised(method: str, share: int):
    """Members of one chunk -> for each its summary (by number in the chunk), rows before it there, and the summary itself on its first member's row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("member").reset_index(drop=True)
        counts = rows["n"].to_numpy(np.int64)
        sums = np.stack(rows["total"].to_numpy()).astype(float)
        tree = _tree(sums / counts[:, None], counts, method)
        k = max(1, len(rows) // share)
        of = np.array(clustering.cut(len(rows), tree, k))
        before = _placed(tree, len(rows), counts)
        first = pd.Series(before).groupby(of).transform("min").to_numpy()
        made = {c: i for i, c in reversed(list(enumerate(of.tolist())))}  # first member of each
        heads = [made[c] == i for i, c in enumerate(of.tolist())]
        total, squares = np.zeros((k, sums.shape[1])), np.zeros(k)
        np.add.at(total, of, sums)
        np.add.at(squares, of, rows["squares"].to_numpy(float))
        n = np.bincount(of, counts, k).astype(np.int64)
        return pd.DataFrame({
            "g": rows["g"], "chunk": rows["chunk"], "member": rows["member"], "summary": of.astype(np.int64), "ahead": before - first,
            "n": [int(n[c]) if h else None for c, h in zip(of, heads)], "total": [total[c].tolist() if h else None for c, h in zip(of, heads)], "squares": [float(squares[c]) if h else None for c, h in zip(of, heads)],
        }).astype({"n": "Int64"})

    return run


def agglomerate(df: DataFrame, group: str, id_col: str, vector: str, k: int, method: str = "ward", cosine: bool = False, most: int = 2000, share: int = SHARE) -> DataFrame:
    """group, id, sort_order, cluster (of ``k``) of all rows with a vector."""
    v = F.col(vector).cast("array<double>")
    if cosine:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        v = F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), v.alias("total")).where(F.col("total").isNotNull())
    square = F.aggregate("total", F.lit(0.0), lambda a, x: a + x * x)
    sizes = kept(rows.groupBy("g").agg(F.count("*").alias("rows")), "sizes")
    kind = rows.schema["g"].dataType.simpleString()
    id_kind = rows.schema["id"].dataType.simpleString()
    same = lambda a, b: a["g"].eqNullSafe(b["g"])
    large = sizes.where(F.col("rows") > most)
    small_ones = rows.join(sizes, same(rows, sizes)).where(F.col("rows") <= most).select(rows["g"], "id", "total", F.lit(1).cast("long").alias("n"))
    steps = []
    members = None
    if not large.isEmpty():
        big = rows.join(large, same(rows, large)).select(rows["g"], "id", "total", "rows")
        members = kept(big.select("g", F.concat(F.lit("row "), F.col("id").cast("string")).alias("member"), "id", F.lit(1).cast("long").alias("n"), "total", square.alias("squares")), "members")
        first = members
        while True:
            counted = members.groupBy("g").agg(F.count("*").alias("rows"))
            if counted.where(F.col("rows") > most).isEmpty():
                break
            # Chunks of half the bound on average, so that hashing overfills none beyond it by much.
            dealt = members.join(counted.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2"))).withColumn("chunk", F.pmod(F.xxhash64("member"), F.ceil(F.col("rows") / (most / 2))).cast("long"))
            schema = f"g {kind}, chunk long, member string, summary long, ahead long, n long, total array<double>, squares double"
            made = kept(dealt.select("g", "chunk", "member", "n", "total", "squares").groupBy("g", "chunk").applyInPandas(_summarised(method, share), schema), "summaries")
            name = F.concat_ws(" ", F.lit(len(steps)), "chunk", "summary")
            members = made.where("n IS NOT NULL").select("g", name.alias("member"), "n", "total", "squares")
            steps.append(made.select("g", "member", name.alias("parent"), "ahead"))

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order"]).reset_index(drop=True)
        counts = part["n"].to_numpy(np.int64)
        x = np.stack(part["total"].to_numpy()).astype(float) / counts[:, None]
        tree = _tree(x, counts, method)
        return pd.DataFrame({"g": part["g"], "name": part["name"], "ahead": _placed(tree, len(part), counts), "cluster": clustering.cut(len(part), tree, k)})

    direct = small_ones.select("g", F.col("id").alias("name"), F.col("id").alias("order"), "n", "total").groupBy("g").applyInPandas(whole, f"g {kind}, name {id_kind}, ahead long, cluster int")
    out = direct.select("g", F.col("name").alias("id"), F.col("ahead").cast("int").alias("sort_order"), "cluster")
    if members is not None:
        tops = members.select("g", F.col("member").alias("name"), F.col("member").alias("order"), "n", "total").groupBy("g").applyInPandas(whole, f"g {kind}, name string, ahead long, cluster int")
        at = kept(tops.select(F.col("g").alias("g2"), F.col("name"), "ahead", "cluster"), "tops")
        found = first.select("g", "id", "member", F.lit(0).cast("long").alias("place"))
        for made in steps:
            up = made.select(F.col("g").alias("g2"), F.col("member").alias("m2"), "parent", "ahead")
            found = found.join(up, F.col("g").eqNullSafe(F.col("g2")) & (F.col("member") == F.col("m2"))).select("g", "id", F.col("parent").alias("member"), (F.col("place") + F.col("ahead")).alias("place"))
        found = found.join(F.broadcast(at) if at.count() <= 100_000 else at, F.col("g").eqNullSafe(F.col("g2")) & (F.col("member") == F.col("name")))
        out = out.unionByName(found.select("g", "id", (F.col("place") + F.col("ahead")).cast("int").alias("sort_order"), "cluster"))
    return out.select(F.col("g").alias(group), F.col("id").alias(id_col), "sort_order", "cluster")
