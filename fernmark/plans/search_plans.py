"""Similarity search over ``embeddings``: vec_id is the recording, label its species."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernmark.functions import vectors
from fernmark.operators import dedup, inverted_file, models, sampling, search, topk
from fernmark.plans.registry import ORACLES, query, read

_D = "list_transform(embedding, lambda x: x::DOUBLE)"
_DIST = f"""
q AS (SELECT {_D} AS q FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id, label, {_D} AS v FROM embeddings),
d AS (SELECT vec_id, label, round(1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS d_cosine,
             round(sqrt(list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS d_l2,
             round(list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2]))), 6) AS d_l1
      FROM e, q WHERE vec_id <> 0)"""
#: Probabilities of labels for the query vector, as a classifier would give them: by rank of the label.
_P = "p AS (SELECT label, 1.0 / (2 + label) AS p FROM (SELECT DISTINCT label FROM embeddings))"


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


def _one(spark, sf_dir, vec_id=0):
    return _vectors(spark, sf_dir).where(F.col("vec_id") == vec_id)


def _probabilities(spark, sf_dir):
    return _vectors(spark, sf_dir).select("label").distinct().withColumn("p", F.lit(1.0) / (F.lit(2) + F.col("label")))


@query("knn_topk_per_label", f"""WITH {_DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d_cosine, vec_id) AS rank FROM d)
SELECT vec_id, label, d_cosine, rank::INT AS rank FROM r WHERE rank <= 3 ORDER BY d_cosine, vec_id LIMIT 25""")
def knn_topk_per_label(spark, sf_dir):
    found = search.nearest_per_group(_vectors(spark, sf_dir), _one(spark, sf_dir), "embedding", "vec_id", "label", 3, 25)
    return found.select("vec_id", "label", "d_cosine", "rank")


@query("knn_all_metrics", f"WITH {_DIST} SELECT vec_id, d_cosine, d_l1, d_l2 FROM d")
def knn_all_metrics(spark, sf_dir):
    rows = _vectors(spark, sf_dir).where("vec_id <> 0")
    return search.with_distances(rows, _one(spark, sf_dir), "embedding", ["cosine", "l1", "l2"]).select("vec_id", "d_cosine", "d_l1", "d_l2")


@query("knn_nearest", f"WITH {_DIST} SELECT vec_id, label, d_l2 FROM d ORDER BY d_l2, vec_id LIMIT 10")
def knn_nearest(spark, sf_dir):
    return search.nearest(_vectors(spark, sf_dir), _one(spark, sf_dir), "embedding", "vec_id", 10, "l2").select("vec_id", "label", "d_l2")


@query("knn_with_slp", f"""WITH {_DIST}, {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d_cosine, vec_id) AS rank FROM d)
SELECT vec_id, label, d_cosine, rank::INT AS rank, round(abs(-ln(p)), 6) AS slp FROM r JOIN p USING (label) WHERE rank <= 2 ORDER BY slp, d_cosine, vec_id LIMIT 15""")
def knn_with_slp(spark, sf_dir):
    found = search.nearest_per_group(_vectors(spark, sf_dir), _one(spark, sf_dir), "embedding", "vec_id", "label", 2, 15, _probabilities(spark, sf_dir))
    return found.select("vec_id", "label", "d_cosine", "rank", "slp")


@query("knn_union_of_limits", f"""WITH {_DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d_cosine, vec_id) AS rank FROM d WHERE label IN (1, 2, 3))
SELECT vec_id, label, d_cosine FROM r WHERE rank <= 4""")
def knn_union_of_limits(spark, sf_dir):
    """Candidate labels first, by semi-join, then the window."""
    labels = _vectors(spark, sf_dir).select("label").distinct().where(F.col("label").isin(1, 2, 3))
    rows = _vectors(spark, sf_dir).join(F.broadcast(labels), "label", "left_semi").where("vec_id <> 0")
    found = search.with_distances(rows, _one(spark, sf_dir), "embedding")
    return topk.top_k_per_group(found, ["label"], [F.col("d_cosine"), F.col("vec_id")], 4).select("vec_id", "label", "d_cosine")


@query("search_with_query_row", f"""WITH {_DIST}, n AS (SELECT vec_id, label, d_cosine FROM d ORDER BY d_cosine, vec_id LIMIT 9),
u AS (SELECT vec_id, label, 0.0::DOUBLE AS d_cosine, true AS is_query FROM embeddings WHERE vec_id = 0 UNION ALL SELECT *, false FROM n),
f AS (SELECT *, row_number() OVER (ORDER BY is_query DESC, d_cosine, vec_id) AS place FROM u), g AS (SELECT *, min(place) OVER (PARTITION BY label) AS seen FROM f)
SELECT vec_id, label, d_cosine, is_query, (dense_rank() OVER (ORDER BY seen) - 1)::INT AS label_index FROM g""")
def search_with_query_row(spark, sf_dir):
    found = search.nearest(_vectors(spark, sf_dir), _one(spark, sf_dir), "embedding", "vec_id", 9).select("vec_id", "label", "d_cosine")
    rows = search.with_query_row(found, _one(spark, sf_dir).select("vec_id", "label"), ["d_cosine"])
    return search.labelled(rows, "label", [F.desc("is_query"), F.col("d_cosine"), F.col("vec_id")])


@query("label_round_robin", """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || 's1'), vec_id) AS turn FROM embeddings)
SELECT vec_id, label, turn::INT AS turn FROM r ORDER BY turn, label LIMIT 25""")
def label_round_robin(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", "label")
    return topk.round_robin(rows, ["label"], [sampling.draw("vec_id", "s1"), F.col("vec_id")], 25)


@query("vector_norms", f"SELECT vec_id, round(sqrt(list_dot_product({_D}, {_D})), 6) AS norm, round({_D}[1], 6) AS v_0, round({_D}[2], 6) AS v_1 FROM embeddings")
def vector_norms(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return _vectors(spark, sf_dir).select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), *[F.round(F.element_at(v, k + 1), 6).alias(f"v_{k}") for k in range(2)])


@query("compare_queries", f"""WITH e AS (SELECT vec_id, label, {_D} AS v FROM embeddings), q AS (SELECT vec_id AS q_id, v AS q FROM e WHERE vec_id IN (1, 2)),
d AS (SELECT q_id, vec_id, label, round(1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS d_cosine FROM e, q WHERE vec_id <> q_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY d_cosine, vec_id) AS rank FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d_cosine, vec_id) AS n FROM r WHERE rank <= 2)
SELECT (q_id - 1)::INT AS query_i, vec_id, label, d_cosine FROM t WHERE n <= 12""")
def compare_queries(spark, sf_dir):
    queries = [search.Query("rec", k, n=12, per_group=2) for k in (1, 2)]
    found = search.compare(_vectors(spark, sf_dir), queries, id_col="vec_id", vector="embedding", species="label")
    return found.select("query_i", "vec_id", "label", "d_cosine")


@query("batch_knn", f"""WITH e AS (SELECT vec_id, {_D} AS v FROM embeddings), d AS (SELECT a.vec_id AS q_id, b.vec_id, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS d_cosine
FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d_cosine, vec_id) AS rank FROM d)
SELECT q_id, vec_id, d_cosine, rank::INT AS rank FROM r WHERE rank <= 5""")
def batch_knn(spark, sf_dir):
    """Every fiftieth vector as a query against all rows, block by block."""
    rows = _vectors(spark, sf_dir).select("vec_id", "embedding")
    return search.batch_nearest(rows, rows.where("vec_id % 50 = 0"), "embedding", "vec_id", 5)


@query("indexed_knn", ORACLES["batch_knn"])
def indexed_knn(spark, sf_dir):
    """The same rows through an inverted file over all vectors."""
    rows = _vectors(spark, sf_dir).select("vec_id", "embedding")
    found = inverted_file.nearest(inverted_file.build(rows, "vec_id", "embedding"), rows.where("vec_id % 50 = 0"), 5)
    return found.drop("looked")


@query("knn_vote", f"""WITH e AS (SELECT vec_id, label, {_D} AS v FROM embeddings), d AS (SELECT a.vec_id AS q_id, a.label AS truth, b.vec_id, b.label, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS d_cosine
FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d_cosine, vec_id) AS rank FROM d),
v AS (SELECT q_id, truth, label, count(*) AS votes FROM r WHERE rank <= 5 GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY votes DESC, label) AS n FROM v) SELECT q_id AS vec_id, truth, label AS predicted, votes FROM w WHERE n = 1""")
def knn_vote(spark, sf_dir):
    """Every fiftieth vector classified by its five nearest neighbours."""
    rows = _vectors(spark, sf_dir).select("vec_id", "label", "embedding")
    found = models.knn_classify(rows, rows.where("vec_id % 50 = 0"), "embedding", "vec_id", "label", 5)
    return found.join(rows.select("vec_id", F.col("label").alias("truth")), "vec_id").select("vec_id", "truth", "predicted", "votes")


@query("one_group_search", f"""WITH {_DIST} SELECT vec_id, label, d_cosine FROM d WHERE label = 3 ORDER BY d_cosine, vec_id LIMIT 12""")
def one_group_search(spark, sf_dir):
    """A filter that leaves one label: as many rows as asked for, not the few of a label among several."""
    rows = _vectors(spark, sf_dir).where("vec_id <> 0 and label = 3")
    found = search.top_groups(rows, _one(spark, sf_dir), "embedding", "vec_id", "label", 3, 12, _probabilities(spark, sf_dir))
    return found.select("vec_id", "label", "d_cosine")


@query("union_aligned", """SELECT label, count(*) AS n, -1::BIGINT AS n_low FROM embeddings GROUP BY label UNION ALL
SELECT label, 0 AS n, count(*) AS n_low FROM embeddings WHERE embedding[1] < 0 GROUP BY label""")
def union_aligned(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    a = rows.groupBy("label").agg(F.count("*").alias("n"))
    b = rows.where(F.col("embedding")[0] < 0).groupBy("label").agg(F.count("*").alias("n_low"))
    return dedup.concat_aligned([a, b]).select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_low", F.lit(-1)).alias("n_low"))
