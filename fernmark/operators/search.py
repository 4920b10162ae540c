"""Similarity search over vector columns: filter, distances, class probabilities, top k by group, top n."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.functions import vectors
from fernmark.operators.sampling import draw
from fernmark.operators.topk import round_robin, top_k_per_group
from fernmark.scratch import small


@dataclass
class Filters:
    """What rows a search may return. An empty ``quality`` filters nothing, an empty ``places`` everything."""

    quality: Sequence[str] = ()
    places: Sequence[str] | None = None
    species: Sequence[str] | None = None
    groups: Sequence[str] | None = None
    exclude_groups: Sequence[str] = ()
    include_species: Sequence[str] = ()

    def condition(self, quality: str = "quality", place: str = "place", species: str = "species", group: str = "species_group") -> Column:
        parts = [F.lit(True)]
        if self.quality:
            parts.append(F.col(quality).isin(list(self.quality)))
        for chosen, column in ((self.places, place), (self.species, species), (self.groups, group)):
            if chosen is not None:
                parts.append(F.col(column).isin(list(chosen)) if chosen else F.lit(False))
        if self.exclude_groups:
            spared = F.col(species).isin(list(self.include_species)) if self.include_species else F.lit(False)
            parts.append(~F.col(group).isin(list(self.exclude_groups)) | spared)
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


@dataclass
class Query:
    """kind: none, random, species, group or rec."""

    kind: str
    value: object = None
    filters: Filters | None = None
    seed: str = ""
    n: int = 25
    per_group: int = 3
    extra: dict = field(default_factory=dict)


def with_distances(candidates: DataFrame, query: DataFrame, vector: str, metrics: Sequence[str] = ("cosine",), digits: int = 6, norm: str | None = None, other_than: str | None = None) -> DataFrame:
    """Adds d_<metric> to the one row of ``query``, which goes to every task with its norm.

    ``norm`` names a column that stores the candidates' norms; ``other_than`` the
    id by which the query itself is left out.
    """
    own_id = [F.col(other_than).alias("_self")] if other_than else []
    one = F.broadcast(query.select(F.col(vector).alias("_q"), vectors.norm(F.col(vector)).alias("_qn"), *own_id).limit(1))
    rows = candidates.crossJoin(one)
    if other_than:
        rows = rows.where(F.col(other_than) != F.col("_self"))
    norms = {"norm_a": F.col(norm) if norm else None, "norm_b": F.col("_qn")}
    return rows.select(*candidates.columns, *[F.round(vectors.DISTANCES[m](F.col(vector), F.col("_q"), **(norms if m == "cosine" else {})), digits).alias(f"d_{m}") for m in metrics])


def nearest(candidates: DataFrame, query: DataFrame, vector: str, id_col: str, n: int, metric: str = "cosine") -> DataFrame:
    """The ``n`` nearest rows, without the query itself."""
    return with_distances(candidates, query, vector, [metric], other_than=id_col).orderBy(f"d_{metric}", id_col).limit(n)


def nearest_per_group(candidates: DataFrame, query: DataFrame, vector: str, id_col: str, group: str, k: int, n: int, probabilities: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """``k`` nearest of each group, then ``n`` over all.

    With ``probabilities`` (group, p) groups come by surprise -ln p first; groups
    without a probability are left out by a semi-join before any window.
    """
    rows = candidates
    order: list[Column] = [F.col(f"d_{metric}"), F.col(id_col)]
    final = order
    if probabilities is not None:
        surprise = F.round(vectors.surprise(F.col("p")), 6).alias("slp")
        rows = rows.join(small(probabilities.select(group, surprise)), group)
        final = [F.col("slp"), *order]
    ranked = top_k_per_group(with_distances(rows, query, vector, [metric], other_than=id_col), [group], order, k)
    return ranked.orderBy(*final).limit(n)


def top_groups(candidates: DataFrame, query: DataFrame, vector: str, id_col: str, group: str, k: int, n: int, probabilities: DataFrame, metric: str = "cosine") -> DataFrame:
    """The likeliest ceil(n / k) groups that candidates are left of, ``k`` nearest rows of each; of a lone group ``n`` rows."""
    left = candidates.select(group).distinct().join(probabilities, group)
    # One row more than is taken says whether a group is alone.
    likely = left.orderBy(F.desc("p"), group).limit(max(2, -(-n // k)))
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("p"), group)
    likely = likely.withColumn("_place", F.row_number().over(place)).withColumn("_all", F.count("*").over(Window.partitionBy(F.lit(0)))).where(F.col("_place") <= -(-n // k))
    each = F.when(F.col("_all") == 1, n).otherwise(k)
    surprise = F.round(vectors.surprise(F.col("p")), 6).alias("slp")
    rows = candidates.join(F.broadcast(likely.select(group, surprise, each.alias("_k"))), group)  # n rows at most
    order = [F.col(f"d_{metric}"), F.col(id_col)]
    ranked = top_k_per_group(with_distances(rows, query, vector, [metric], other_than=id_col), [group], order, n).where("rank <= _k").drop("_k")
    return ranked.orderBy(F.col("slp"), *order).limit(n)


#: Pairs of rows and queries up to which ``batch_nearest`` looks at all of them.
MAX_PAIRS = 1 << 32


def _packed(rows: DataFrame, id_col: str, vector: str, size: int) -> DataFrame:
    """Blocks of about ``size`` rows: ids and vectors as two arrays."""
    parts = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("_b")).agg(F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v")))).alias("_r")).select("_r")


def batch_nearest(rows: DataFrame, queries: DataFrame, vector: str, id_col: str, k: int, *, digits: int = 6, block: int = 4096) -> DataFrame:
    """q_id, id, d_cosine, rank: the ``k`` nearest of ``rows`` to each of ``queries``, itself left out.

    Rows and queries are packed into blocks of bounded size, and each pair of
    blocks is one matrix product that returns its own first ``k`` of each query;
    these are ranked once more. A vector of zeros is near nothing. Over ``MAX_PAIRS``
    pairs of rows and queries the same rows are found through an inverted file.
    """
    kind = dict(rows.dtypes)[id_col]
    if rows.count() * queries.count() > MAX_PAIRS:
        from fernmark.operators import inverted_file

        return inverted_file.nearest(inverted_file.build(rows, id_col, vector), queries, k, digits=digits).drop("looked")
    pairs = _packed(rows, id_col, vector, block).withColumnRenamed("_r", "rows").crossJoin(_packed(queries, id_col, vector, block).withColumnRenamed("_r", "queries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(block: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
            ids, v = block.values.field(0), block.values.field(1)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            n = np.sqrt((x * x).sum(axis=1, keepdims=True))
            return ids.to_numpy(zero_copy_only=False), np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)

        for batch in batches:
            for p in range(batch.num_rows):
                (ids, x), (q_ids, q) = opened(batch.column(0)[p]), opened(batch.column(1)[p])
                far = np.round(1 - q @ x.T, digits + 3)
                far[q_ids[:, None] == ids[None, :]] = np.nan
                found_q, found, found_d = [], [], []
                for j, d in enumerate(far):
                    real = np.flatnonzero(~np.isnan(d))
                    d = np.round(d[real], digits) + 0.0
                    if len(real) > k:
                        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        real, d = real[near], d[near]
                    first = np.lexsort((ids[real], d))[:k]
                    found_q.append(np.repeat(q_ids[j : j + 1], len(first)))
                    found.append(ids[real[first]])
                    found_d.append(d[first])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (found_q, found, found_d)], ["q_id", id_col, "d_cosine"])

    near = pairs.mapInArrow(run, f"q_id {kind}, {id_col} {kind}, d_cosine double")
    return top_k_per_group(near, ["q_id"], [F.col("d_cosine"), F.col(id_col)], k)


def with_query_row(results: DataFrame, query: DataFrame, distances: Sequence[str]) -> DataFrame:
    """The query row first, at distance 0; columns it lacks are null."""
    q = query.limit(1).withColumns({d: F.lit(0.0) for d in distances}).withColumn("is_query", F.lit(True))
    return q.unionByName(results.withColumn("is_query", F.lit(False)), allowMissingColumns=True)


def labelled(df: DataFrame, column: str, order: list[Column], name: str = "label_index") -> DataFrame:
    """A dense index of a column's values in the order of first appearance. For result pages, not tables."""
    everything = Window.partitionBy(F.lit(0))
    at = df.withColumn("_at", F.row_number().over(everything.orderBy(*order)))
    at = at.withColumn("_first", F.min("_at").over(Window.partitionBy(column)))
    return at.withColumn(name, F.dense_rank().over(everything.orderBy("_first")) - 1).drop("_at", "_first")


def run(catalogue: DataFrame, query: Query, *, id_col: str = "id", vector: str = "vector", species: str = "species", group: str = "species_group", probabilities: DataFrame | None = None) -> DataFrame:
    """Any query of the search screens as one lazy plan."""
    rows = catalogue.where(query.filters.condition()) if query.filters else catalogue
    match query.kind:
        case "none":
            return rows.limit(0)
        case "random":
            return round_robin(rows, [species], [draw(id_col, query.seed), F.col(id_col)], query.n)
        case "species":
            return rows.where(F.col(species) == query.value).orderBy(F.col(id_col).desc()).limit(query.n)
        case "group":
            return rows.where(F.col(group) == query.value).orderBy(F.col(id_col).desc()).limit(query.n)
        case "rec":
            one = catalogue.where(F.col(id_col) == query.value)
            return nearest_per_group(rows, one, vector, id_col, species, query.per_group, query.n, probabilities)
    raise ValueError(f"no query of kind {query.kind}")


def compare(catalogue: DataFrame, queries: Sequence[Query], **columns) -> DataFrame:
    """Results of several queries, with the query's number."""
    frames = [run(catalogue, q, **columns).withColumn("query_i", F.lit(k)) for k, q in enumerate(queries)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
