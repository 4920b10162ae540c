"""Classifiers by name, and vector transforms, over pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.operators import search
from fernmark.operators.boosting import HistogramBoosting, HistogramBoostingModel
from fernmark.operators.linear import StochasticLogistic, StochasticLogisticModel


def classifier(config: str, features: str = "features", label: str = "label") -> Pipeline:
    """From "[std-][ovr-]name[,key=value...]": nb, logreg, sgd, svm, rf, gbt; std scales first, ovr fits one against the rest.

    ``knn_classify`` is the classifier without a fit.
    """
    name, *options = config.split(",")
    settings = {k: float(v) if "." in v else int(v) for k, v in (o.split("=") for o in options)}
    stages = []
    if name.startswith("std-"):
        name = name[4:]
        stages.append(StandardScaler(withMean=True, inputCol=features, outputCol="_scaled"))
        features = "_scaled"
    one_vs_rest = name.startswith("ovr-")
    name = name.removeprefix("ovr-")
    kinds = {"nb": lambda: NaiveBayes(modelType="gaussian"), "logreg": LogisticRegression, "sgd": StochasticLogistic, "svm": LinearSVC, "rf": lambda: RandomForestClassifier(seed=0), "gbt": HistogramBoosting}
    if name not in kinds:
        raise ValueError(f"no classifier named {name}; there are {sorted(kinds)}")
    model = kinds[name]().setFeaturesCol(features).setLabelCol(label)
    model._set(**settings)
    if one_vs_rest or name == "svm":
        model = OneVsRest(classifier=model, featuresCol=features, labelCol=label)
    return Pipeline(stages=[*stages, model])


def save(model: PipelineModel, path: str) -> None:
    """A fitted pipeline, where every executor and session can read it."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def knn_classify(train: DataFrame, rows: DataFrame, vector: str, id_col: str, label: str, k: int) -> DataFrame:
    """id, predicted, votes: the most frequent label of the ``k`` nearest rows of ``train``, ties to the lowest; a row is no neighbour of itself."""
    near = search.batch_nearest(train, rows, vector, id_col, k).join(train.select(id_col, label), id_col)
    votes = near.groupBy("q_id", label).agg(F.count("*").alias("votes"))
    best = votes.groupBy("q_id").agg(F.min(F.struct((-F.col("votes")).alias("m"), F.col(label).alias("predicted"))).alias("b"))
    return best.select(F.col("q_id").alias(id_col), "b.predicted", (-F.col("b.m")).alias("votes"))


def statistics(model: PipelineModel) -> list[dict]:
    """Of the fitted classifier: a row for each tree (depth, nodes), class (weights that aren't 0, intercept) or class model."""
    last = model.stages[-1]
    parts = last.models if hasattr(last, "models") else [last]
    out = []
    for c, part in enumerate(parts):
        if isinstance(part, HistogramBoostingModel):
            out += [{"part": t["class"], "kind": "boosted", "k": t["round"], "depth": t["depth"], "nodes": 2 * t["splits"] + 1} for t in part.trees]
        elif isinstance(part, StochasticLogisticModel):
            w = part.matrix
            out += [{"part": c, "kind": "linear", "k": k, "nonzero": int((w[:-1, k] != 0).sum()), "intercept": float(w[-1, k])} for k in range(w.shape[1])]
        elif hasattr(part, "trees"):
            out += [{"part": c, "kind": "tree", "k": k, "depth": t.depth, "nodes": t.numNodes} for k, t in enumerate(part.trees)]
        elif hasattr(part, "coefficientMatrix"):
            rows = part.coefficientMatrix.toArray()
            out += [{"part": c, "kind": "linear", "k": k, "nonzero": int((rows[k] != 0).sum()), "intercept": float(part.interceptVector[k])} for k in range(len(rows))]
        elif hasattr(part, "coefficients"):
            out.append({"part": c, "kind": "linear", "k": c, "nonzero": int((part.coefficients.toArray() != 0).sum()), "intercept": float(part.intercept)})
        else:
            out.append({"part": c, "kind": type(part).__name__, "k": c})
    return out


def statistics_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``statistics`` as a table: one row for each part, null where a kind has no such number."""
    names = "part int, kind string, k int, depth int, nodes int, nonzero int, intercept double"
    return spark.createDataFrame([tuple(s.get(c.split()[0]) for c in names.split(", ")) for s in statistics(model)], names)


def with_features(df: DataFrame, vector: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(vector).cast("array<double>")))


def probabilities(predicted: DataFrame) -> DataFrame:
    """The probability column as an array ``p``."""
    return predicted.withColumn("p", vector_to_array("probability"))


def variance_table(shares: list[float]) -> list[dict]:
    """Components with their share of the variance, and the shares up to each."""
    return [{"component": k, "share": s, "upto": sum(shares[: k + 1])} for k, s in enumerate(shares)]


def variance_frame(spark: SparkSession, shares: list[float]) -> DataFrame:
    """``variance_table`` as a table."""
    return spark.createDataFrame([(v["component"], v["share"], v["upto"]) for v in variance_table(shares)], "component int, share double, upto double")


def pca_normalised(df: DataFrame, vector: str, k: int, out: str = "projected") -> tuple[DataFrame, list[float]]:
    """Scaled, projected to ``k`` components, unit length; and the components' shares of the variance."""
    stages = [StandardScaler(withMean=True, inputCol="features", outputCol="_s"), PCA(k=k, inputCol="_s", outputCol="_p"), Normalizer(inputCol="_p", outputCol="_n")]
    rows = with_features(df, vector)
    model = Pipeline(stages=stages).fit(rows)
    return model.transform(rows).withColumn(out, vector_to_array("_n")).drop("features", "_s", "_p", "_n"), model.stages[1].explainedVariance.toArray().tolist()
