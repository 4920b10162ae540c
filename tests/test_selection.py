"""Boosted trees, stochastic gradients and grid search against plain versions."""

import json

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fernmark.operators import boosting, evals, linear, models, sampling, selection

K = 4


@pytest.fixture(scope="module")
def blobs(spark):
    """Classes that no single feature tells apart: by the signs of two products."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) * 2 + (x[:, 2] > x[:, 3]).astype(int)
    rows = [(k, int(y[k]), [float(v) for v in x[k]]) for k in range(len(x))]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").withColumn("features", array_to_vector("v")).cache()
    df.count()
    return df, x, y


def plain_tree(bins, g, h, depth, n_bins, l2, least):
    """One tree by loops: (feature, cut) of the inner nodes, ties to the lowest feature and bin."""
    out, nodes = {}, {0: np.arange(len(bins))}
    for level in range(depth):
        for i in range(2**level - 1, 2 ** (level + 1) - 1):
            rows = nodes.get(i)
            if rows is None:
                continue
            best = None
            for f in range(bins.shape[1]):
                for b in range(n_bins):
                    left = rows[bins[rows, f] <= b]
                    right = rows[bins[rows, f] > b]
                    if min(len(left), len(right)) < least:
                        continue
                    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                    value = round((part(left) + part(right) - part(rows)) / 2, 6)
                    if best is None or value > best[0]:
                        best = (value, f, b, left, right)
            if best and best[0] > 1e-9:
                out[i] = best[:3]
                nodes[2 * i + 1], nodes[2 * i + 2] = best[3:]
    return out


def test_first_tree_against_loops(blobs):
    df, x, y = blobs
    model = boosting.HistogramBoosting(rounds=1, depth=2, bins=8, l2=1.0, least=5, rate=0.5).fit(df)
    found = json.loads(model.getOrDefault("model"))
    bins = boosting.binned(found["edges"], x)
    p = boosting.softmax(np.tile(found["base"], (len(x), 1)))
    for c in range(K):
        g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])
        want = plain_tree(bins, g, h, 2, 8, 1.0, 5)
        tree = found["rounds"][0][c]
        got = {i: (tree["feature"][i], tree["cut"][i]) for i in range(3) if tree["feature"][i] >= 0}
        assert set(got) == set(want)
        for i, (f, b) in got.items():
            rows = np.flatnonzero(bins[:, f] <= b) if i == 0 else None
            if i == 0:
                part = lambda r, g=g, h=h: g[r].sum() ** 2 / (h[r].sum() + 1.0)
                rest = np.flatnonzero(bins[:, f] > b)
                assert abs((part(rows) + part(rest) - part(slice(None))) / 2 - want[0][0]) < 1e-4
        for leaf in np.unique(boosting.leaves(tree, bins)):
            mine = boosting.leaves(tree, bins) == leaf
            assert abs(tree["value"][leaf] + 0.5 * g[mine].sum() / (h[mine].sum() + 1.0)) < 1e-4


def test_boosting_learns_what_no_bayes_does(blobs):
    df, _, _ = blobs
    rows = sampling.batched(df, "id", 3, "b", "part")
    right = {}
    for config in ("gbt,rounds=20,depth=3,rate=0.4", "nb"):
        fitted = models.classifier(config).fit(rows.where("part > 0"))
        right[config[:2]] = fitted.transform(rows.where("part = 0")).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right["gb"] > 0.8 > right["nb"] + 0.1


def test_boosting_is_the_same_however_dealt_and_after_saving(blobs, tmp_path):
    df, _, _ = blobs
    one, two = (boosting.HistogramBoosting(rounds=2, depth=2, bins=8).fit(df.repartition(n)) for n in (2, 7))
    assert json.loads(one.getOrDefault("model"))["rounds"] == json.loads(two.getOrDefault("model"))["rounds"]
    fitted = models.classifier("gbt,rounds=2,depth=2,bins=8").fit(df)
    models.save(fitted, str(tmp_path / "m"))
    before, after = ([(r.id, r.prediction) for r in m.transform(df).select("id", "prediction").orderBy("id").collect()] for m in (fitted, models.load(str(tmp_path / "m"))))
    assert before == after
    assert [s["kind"] for s in models.statistics(fitted)] == ["boosted"] * 2 * K and one.numClasses == K


def loss(w, x, y, l2):
    p = boosting.softmax(x @ w[:-1] + w[-1])
    return -np.log(p[np.arange(len(y)), y]).mean() + l2 / 2 * (w[:-1] ** 2).sum()


def test_stochastic_gradients_reach_the_optimum(blobs):
    df, x, y = blobs
    batch = LogisticRegression(regParam=0.01, elasticNetParam=0.0, standardization=False, family="multinomial", maxIter=200, tol=1e-10).fit(df)
    best = loss(np.vstack([batch.coefficientMatrix.toArray().T, batch.interceptVector.toArray()]), x, y, 0.01)
    found = linear.StochasticLogistic(l2=0.01, steps=60, share=0.3).fit(df)
    assert best * 0.999 < loss(found.matrix, x, y, 0.01) < best * 1.01


def test_stochastic_gradients_are_the_same_however_dealt(blobs):
    df, _, _ = blobs
    some = [linear.StochasticLogistic(steps=6, l1=0.02).fit(df.repartition(n)).matrix for n in (2, 7)]
    assert np.array_equal(*some)
    sparse = linear.StochasticLogistic(steps=40, l1=0.05).fit(df).matrix[:-1]
    assert 0 < (sparse == 0).mean() < 1 and (np.abs(sparse[4:]) < np.abs(sparse[2:4]).max()).all()  # features 4 and 5 say nothing


def test_grid_against_single_fits(spark, blobs):
    df, _, _ = blobs
    configs = ["nb", *selection.grid("gbt", {"rounds": [1, 3], "depth": [2]})]
    assert configs[1:] == ["gbt,rounds=1,depth=2", "gbt,rounds=3,depth=2"]
    table = selection.grid_search(df.drop("features"), configs, vector="v", label="label", id_col="id", folds=2, seed="g")
    got = {r["setting"]: r.asDict() for r in table.collect()}
    rows = models.with_features(sampling.batched(df.drop("features"), "id", 2, "g", "fold"), "v")
    for config in configs:
        for fold in range(2):
            fitted = models.classifier(config).fit(rows.where(F.col("fold") != fold))
            for side in ("train", "test"):
                mine = rows.where(F.col("fold") == fold) if side == "test" else rows.where(F.col("fold") != fold)
                found = models.probabilities(fitted.transform(mine)).select("label", "prediction", "p").collect()
                assert abs(got[config][f"split{fold}_{side}_accuracy"] - np.mean([r.label == r.prediction for r in found])) < 1e-12
                errors = [sum(v >= r.p[r.label] for v in r.p) for r in found]
                assert got[config][f"split{fold}_{side}_score"] == -np.median(errors)
    long = evals.unpivot_splits(table, ["setting"])
    assert long.count() == len(configs) * 2 and set(long.columns) == {"setting", "split", "train_accuracy", "train_score", "test_accuracy", "test_score"}
    means = {(r["setting"], r["metric"]): r for r in selection.summary(table).collect()}
    for config in configs:
        both = [got[config][f"split{f}_test_accuracy"] for f in range(2)]
        assert abs(means[config, "test_accuracy"]["mean"] - np.mean(both)) < 1e-12 and abs(means[config, "test_accuracy"]["spread"] - np.std(both)) < 1e-12
    assert sorted(r["rank"] for r in means.values() if r["metric"] == "test_score") == [1, 2, 3]
