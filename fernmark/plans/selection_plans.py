"""Grid searches over ``embeddings``: scores by setting, split and metric; and what fitted models are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernmark.operators import evals, models, sampling, selection
from fernmark.plans.registry import query, read

_E = "e AS (SELECT vec_id, label, (vec_id % 3)::INT AS fold, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_KNN = f"""WITH {_E}, f AS (SELECT unnest([0, 1, 2]) AS split),
d AS (SELECT split, a.vec_id AS q_id, a.label AS truth, a.fold = split AS held, b.vec_id, b.label, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS far
  FROM e a, e b, f WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND b.fold <> split),
r AS (SELECT *, row_number() OVER (PARTITION BY split, q_id ORDER BY far, vec_id) AS rank FROM d),
v AS (SELECT split, k, q_id, truth, held, label, count(*) AS votes FROM r, (SELECT unnest([1, 3, 9]) AS k) WHERE rank <= k GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY split, k, q_id ORDER BY votes DESC, label) AS n FROM v)
SELECT 'knn,k=' || k AS setting, split::INT AS split, avg((label = truth)::INT) FILTER (held) AS test_accuracy, avg((label = truth)::INT) FILTER (NOT held) AS train_accuracy FROM w WHERE n = 1 GROUP BY k, split"""


@query("grid_search_knn", _KNN)
def grid_search_knn(spark, sf_dir):
    """Nearest neighbours for three numbers of them and three folds; every fiftieth vector is asked for."""
    rows = read(spark, sf_dir, "embeddings")
    table = selection.knn_grid(rows, F.col("vec_id") % 50 == 0, [1, 3, 9], vector="embedding", label="label", id_col="vec_id", fold=F.col("vec_id") % 3, folds=3)
    return evals.unpivot_splits(table, ["setting"])


@query("grid_search_scores")
def grid_search_scores(spark, sf_dir):
    """Accuracy and coverage of four settings on two folds, long: no SQL fits models; tests repeat the fits one by one."""
    configs = ["nb", *selection.grid("gbt", {"rounds": [1, 2], "depth": [2]}), "sgd,steps=5"]
    table = selection.grid_search(read(spark, sf_dir, "embeddings"), configs, vector="embedding", label="label", id_col="vec_id", folds=2)
    return evals.unpivot_splits(table, ["setting"])


def _fitted(spark, sf_dir, config):
    rows = sampling.stratified_split(read(spark, sf_dir, "embeddings"), "label", "vec_id", 0.2, "t")
    return models.classifier(config).fit(models.with_features(rows.where("not is_test"), "embedding"))


@query("model_statistics")
def model_statistics(spark, sf_dir):
    """Trees of a forest: depth and nodes."""
    return models.statistics_table(spark, _fitted(spark, sf_dir, "rf,numTrees=5,maxDepth=4"))


@query("pca_variance")
def pca_variance(spark, sf_dir):
    """Components of the vectors with their shares of the variance."""
    _, shares = models.pca_normalised(read(spark, sf_dir, "embeddings"), "embedding", 4)
    return models.variance_frame(spark, shares)
