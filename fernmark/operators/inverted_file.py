"""Exact nearest neighbours through an inverted file: rows by cells of unit vectors, and a bound that says which cells can wait.

On unit vectors the cosine distance is half the squared length of the
difference, so the triangle inequality holds for that length: no row of a cell
is nearer to a query than the query's distance to the cell's centre less the
cell's radius. ``build`` fits centres on a bounded sample (``SAMPLE`` rows by
hash) and then assigns every row; cells are written in blocks of bounded size,
each with its own range of distances to the centre. ``nearest`` first looks into the ``first`` cells of each
query, which gives its k-th best distance so far; then it looks into exactly those
other blocks whose bound is below that. What it returns is what looking at
all pairs returns, and ``pairs`` counts how many it looked at.

Defined cases: vectors of zeros or null have no direction: as rows they are near
nothing, as queries nothing is near them; a row is no neighbour of itself (by
id); ties go to the lowest id; a hot cell is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from fernmark.operators.clustering import normalised
from fernmark.operators.topk import top_k_per_group
from fernmark.scratch import kept

#: Rows that centres are fitted on, most centres, rows of a block, queries that meet a block at once.
SAMPLE, MAX_CELLS, BLOCK, QUERIES = 20_000, 4096, 4096, 1024
_ROUNDS = 8
#: Added to bounds: distances are rounded, and sums of products are not exact.
_SLACK = 1e-5


@dataclass
class InvertedFile:
    """centres (unit vectors); blocks: cell, block, low, high (distances of its rows to the centre), ids and vectors (packed doubles)."""

    centres: np.ndarray
    blocks: DataFrame
    id_col: str
    vector: str


def fit_centres(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Unit centres of a sample by a few rounds of spherical k-means; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(_ROUNDS):
        best = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, best, x)
        centres = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, normalised(total), centres)
    return centres


def _rows(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and v of the rows that have a direction."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    return rows.where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def _schema(name: str, kind: DataType, others: str) -> StructType:
    return StructType([StructField(name, kind), *StructType.fromDDL(others)])


def _unit(batch: pa.Array) -> np.ndarray:
    x = batch.flatten().to_numpy(zero_copy_only=False)
    return normalised(x.reshape(len(batch), -1)) if len(batch) else np.zeros((0, 1))


def build(df: DataFrame, id_col: str, vector: str, cells: int | None = None) -> InvertedFile:
    """Every row of ``df`` in an inverted file of about the root of its rows' number of cells, or so many."""
    spark = df.sparkSession
    rows = _rows(df, id_col, vector)
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    draw = F.shiftrightunsigned(F.xxhash64(F.md5(F.col("id").cast("string").cast("binary"))), 11) / float(1 << 53)
    sample = rows.where(draw < share * 1.2).orderBy(draw, "id").limit(SAMPLE).toPandas() if n else None
    if not n:
        return InvertedFile(np.zeros((0, 1)), spark.createDataFrame([], f"cell int, block long, low double, high double, ids array<{dict(rows.dtypes)['id']}>, v binary"), id_col, vector)
    x = normalised(np.stack(sample["v"].to_numpy()))
    centres = fit_centres(x, min(len(x), MAX_CELLS, cells or max(1, int(np.sqrt(n)))))
    sent = spark.sparkContext.broadcast(centres)  # MAX_CELLS vectors at most

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(1))
            at = x @ sent.value.T if len(x) else np.zeros((0, len(sent.value)))
            cell = at.argmax(axis=1)
            far = np.sqrt(np.maximum(2 - 2 * at[np.arange(len(x)), cell], 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "v", "cell", "far"])

    kind = rows.schema["id"].dataType
    placed = kept(rows.mapInArrow(assigned, _schema("id", kind, "v binary, cell int, far double")), "cells")
    # Blocks of a cell are parts of its range of distances, so that far ones can be left out; a cell with more rows has more.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"))
    parts = F.ceil(F.col("n") / BLOCK)
    step = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("far") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), parts - 1)).otherwise(0)
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("ring", step.cast("long"))
    # Many rows may be alike: a ring that is too full is dealt out once more by id.
    rings = dealt.groupBy("cell", "ring").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    dealt = dealt.join(rings, ["cell", "ring"]).withColumn("block", F.col("ring") * (1 << 20) + F.pmod(F.xxhash64("id"), F.col("k")))
    blocks = dealt.groupBy("cell", "block").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.sort_array(F.collect_list(F.struct("id", "v"))).alias("r"))
    packed = blocks.select("cell", "block", "low", "high", F.col("r.id").alias("ids"), F.col("r.v").alias("v"))
    return InvertedFile(centres, kept(packed, "inverted"), id_col, vector)


def _met(k: int, digits: int):
    """Blocks beside packs of queries -> the first k of each query in each block, by rounded distance and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in range(batch.num_rows):
                ids, v, q_ids, q = (batch.column(c)[p].values for c in range(4))
                x = np.frombuffer(b"".join(v.to_pylist())).reshape(len(ids), -1)
                y = np.frombuffer(b"".join(q.to_pylist())).reshape(len(q_ids), -1)
                own, of = ids.to_numpy(zero_copy_only=False), q_ids.to_numpy(zero_copy_only=False)
                far = np.round(np.round(1 - y @ x.T, digits + 3), digits) + 0.0
                far[of[:, None] == own[None, :]] = np.inf
                found: tuple[list, list, list] = ([], [], [])
                for j, d in enumerate(far):
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                    near = near[d[near] < np.inf]
                    first = near[np.lexsort((own[near], d[near]))[:k]]
                    for c, value in zip(found, (np.full(len(first), j), first, d[first])):
                        c.append(value)
                q_at, at, d = map(np.concatenate, found)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q_at)), ids.take(pa.array(at)), pa.array(d), pa.array(np.full(len(d), len(ids) * len(q_ids) / max(1, len(d))))], ["q_id", "id", "d_cosine", "looked"])

    return run


def _look(index: InvertedFile, probes: DataFrame, k: int, digits: int) -> DataFrame:
    """q_id, id, d_cosine, looked (its share of the pairs that were looked at); ``probes``: cell, block, q_id, q."""
    sizes = probes.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERIES).alias("k"))
    dealt = probes.join(sizes, ["cell", "block"]).withColumn("pack", F.pmod(F.xxhash64("q_id"), F.col("k")))
    packs = dealt.groupBy("cell", "block", "pack").agg(F.sort_array(F.collect_list(F.struct("q_id", "q"))).alias("p"))
    pairs = index.blocks.join(packs, ["cell", "block"]).select("ids", "v", F.col("p.q_id").alias("q_ids"), F.col("p.q").alias("q"))
    kinds = [index.blocks.schema["ids"].dataType.elementType, probes.schema["q_id"].dataType]
    schema = StructType([StructField("q_id", kinds[1]), *_schema("id", kinds[0], "d_cosine double, looked double")])
    return pairs.mapInArrow(_met(k, digits), schema)


def nearest(index: InvertedFile, queries: DataFrame, k: int, *, digits: int = 6, first: int = 4) -> DataFrame:
    """q_id, id, d_cosine, rank: the ``k`` nearest rows of the index to each of ``queries``, itself left out; and looked, each row's share of the pairs looked at."""
    spark, id_col = queries.sparkSession, index.id_col
    asked = _rows(queries, id_col, index.vector)
    sent = spark.sparkContext.broadcast(index.centres)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its distances to all centres."""
        for batch in batches:
            x = _unit(batch.column(1))
            far = np.sqrt(np.maximum(2 - 2 * x @ sent.value.T, 0)) if len(x) and len(sent.value) else np.zeros((len(x), 0))
            near = np.argsort(far, axis=1, kind="stable")[:, :first].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(far), pa.list_(pa.float64())), pa.array(list(near), pa.list_(pa.int32()))], ["q_id", "q", "far", "near"])

    schema = _schema("q_id", asked.schema["id"].dataType, "q binary, far array<double>, near array<int>")
    known = kept(asked.mapInArrow(measured, schema), "queries")
    layout = index.blocks.select("cell", "block", "low", "high", F.size("ids").alias("rows"))
    opening = known.select("q_id", "q", F.explode("near").alias("cell")).join(layout.select("cell", "block"), "cell")
    one = kept(_look(index, opening, k, digits), "opened")
    # The k-th distance so far, as a length; without k rows there is no bound.
    so_far = top_k_per_group(one.drop("looked"), ["q_id"], [F.col("d_cosine"), F.col("id")], k).groupBy("q_id").agg(F.max("d_cosine").alias("d"), F.count("*").alias("n"))
    reach = F.when(F.col("n") >= k, F.sqrt(2 * F.col("d")) + _SLACK)
    spread = known.join(so_far, "q_id", "left").select("q_id", "q", "near", reach.alias("reach"), F.posexplode("far").alias("cell", "d_centre"))
    # The cell's range of distances to its centre bounds what a query can find there.
    ranges = index.blocks.groupBy("cell").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"))
    may = F.col("reach").isNull() | ((F.col("d_centre") - F.col("highest") <= F.col("reach")) & (F.col("lowest") - F.col("d_centre") <= F.col("reach")))
    cells = spread.where(~F.array_contains("near", F.col("cell"))).join(F.broadcast(ranges), "cell").where(may)  # MAX_CELLS rows at most
    left = cells.join(layout, "cell").where(F.col("reach").isNull() | ((F.col("d_centre") - F.col("high") <= F.col("reach")) & (F.col("low") - F.col("d_centre") <= F.col("reach"))))
    two = _look(index, left.select("cell", "block", "q_id", "q"), k, digits)
    both = one.unionByName(two)
    ranked = top_k_per_group(both, ["q_id"], [F.col("d_cosine"), F.col("id")], k)
    return ranked.withColumnRenamed("id", id_col)
