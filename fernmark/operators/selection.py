"""Grid search over folds: settings times folds, fitted side by side, with scores of every split as a table.

Rows are dealt to folds once. Each (setting, fold) is a distributed fit on the
other folds; several run at a time and share the executors. Scores of training and
test rows come from one pass over all rows, as aggregates. The table is wide, one
row for each setting and columns split<k>_<metric>; ``evals.unpivot_splits`` makes
it long, ``summary`` gives means and spreads over the folds.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernmark.operators import evals, models, sampling, search
from fernmark.scratch import kept

METRICS = ("accuracy", "score")


def grid(name: str, options: Mapping[str, Sequence]) -> list[str]:
    """Every combination of options as configurations of ``models.classifier``."""
    return [",".join([name, *(f"{k}={v}" for k, v in zip(options, chosen))]) for chosen in itertools.product(*options.values())]


def _fit_scores(rows: DataFrame, config: str, fold: int, vector: str, label: str) -> dict[str, float]:
    """Accuracy and minus the median coverage error of the fold's rows (test) and of the others (train)."""
    fitted = models.classifier(config, label=label).fit(rows.where(F.col("fold") != fold))
    found = models.probabilities(fitted.transform(rows)).withColumn("_at", F.col("fold") == fold)
    classes = F.transform("p", lambda _, k: k)
    error = evals.coverage_error(classes, F.col("p"), F.col(label).cast("int"))
    hit = (F.col("prediction") == F.col(label)).cast("double")
    per = found.groupBy("_at").agg(F.avg(hit).alias("accuracy"), (-F.percentile(error, 0.5)).alias("score")).collect()
    return {f"split{fold}_{'test' if r['_at'] else 'train'}_{m}": r[m] for r in per for m in METRICS}


def grid_search(df: DataFrame, configs: Sequence[str], *, vector: str, label: str, id_col: str, folds: int = 3, seed: str = "grid", side_by_side: int = 4) -> DataFrame:
    """setting and split<k>_train_accuracy, _train_score, _test_accuracy, _test_score for each fold."""
    rows = sampling.batched(df.where(F.col(label).isNotNull()), id_col, folds, seed, "fold")
    rows = models.with_features(kept(rows.select(id_col, label, vector, "fold"), "folds"), vector)
    tasks = [(c, f) for c in configs for f in range(folds)]
    run = inheritable_thread_target(df.sparkSession)(lambda task: _fit_scores(rows, *task, vector, label))
    with ThreadPoolExecutor(side_by_side) as pool:
        scores = list(pool.map(run, tasks))
    by_setting: dict[str, dict] = {c: {} for c in configs}
    for (c, _), s in zip(tasks, scores):
        by_setting[c] |= s
    names = [f"split{f}_{side}_{m}" for f in range(folds) for side in ("train", "test") for m in METRICS]
    table = [(c, *(by_setting[c].get(n) for n in names)) for c in configs]  # settings times folds: what was asked for
    return df.sparkSession.createDataFrame(table, "setting string, " + ", ".join(f"{n} double" for n in names))


def knn_grid(df: DataFrame, queries: Column, ks: Sequence[int], *, vector: str, label: str, id_col: str, fold: Column, folds: int) -> DataFrame:
    """The same table for nearest neighbours, which need no fit: setting, split<k>_train_accuracy, split<k>_test_accuracy.

    ``queries`` says which rows are asked for. Neighbours are rows outside the
    fold; they are found once a fold, for the largest k, and all settings vote
    with the first of them. Ties of votes go to the lowest label.
    """
    rows = kept(df.select(id_col, label, vector, fold.cast("int").alias("fold")), "folds")
    asked = rows.where(queries)
    truth = asked.select(F.col(id_col).alias("q_id"), F.col(label).alias("truth"), F.col("fold").alias("q_fold"))
    found = None
    for f in range(folds):
        train = rows.where(F.col("fold") != f)
        near = search.batch_nearest(train, asked, vector, id_col, max(ks)).join(train.select(id_col, label), id_col)
        near = near.withColumn("split", F.lit(f))
        found = near if found is None else found.unionByName(near)
    votes = found.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k").groupBy("q_id", "split", "k", label).agg(F.count("*").alias("votes"))
    best = votes.groupBy("q_id", "split", "k").agg(F.min(F.struct((-F.col("votes")).alias("m"), F.col(label).alias("predicted"))).alias("b"))
    side = F.when(F.col("q_fold") == F.col("split"), "test").otherwise("train")
    scored = best.join(truth, "q_id").withColumn("name", F.concat(F.lit("split"), F.col("split").cast("string"), F.lit("_"), side, F.lit("_accuracy")))
    names = [f"split{f}_{s}_accuracy" for f in range(folds) for s in ("train", "test")]
    hit = (F.col("b.predicted") == F.col("truth")).cast("double")
    return scored.groupBy(F.concat(F.lit("knn,k="), F.col("k").cast("string")).alias("setting")).pivot("name", names).agg(F.avg(hit))


def summary(table: DataFrame) -> DataFrame:
    """setting, metric, mean, spread (of the population) and the rank of the mean among settings."""
    metrics = sorted({c.split("_", 1)[1] for c in table.columns if c.startswith("split")})
    long = evals.unpivot_splits(table, ["setting"]).unpivot(["setting", "split"], metrics, "metric", "value")
    means = long.groupBy("setting", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    from pyspark.sql.window import Window

    order = Window.partitionBy("metric").orderBy(F.desc(F.round("mean", 9)), "setting")  # one row for each setting
    return means.withColumn("rank", F.row_number().over(order))
