"""Gradient-boosted trees over histograms, for several classes, as a pyspark.ml estimator.

Features are cut into bins by their quantiles over all rows, once, and kept as a
byte each. Each round grows one tree a class, a level at a time: tasks add up
gradients and their curvatures by class, node, feature and bin, one shuffle that
combines before it adds the tasks' sums, and running sums over the bins give
every split's gain. Only the best split of each node comes to the driver, so
what it gets depends on the trees' size, not on the rows. Gradients are added as
whole numbers, so the trees are the same however rows are dealt out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.scratch import kept

#: Gradients are added as multiples of 1 / _UNIT.
_UNIT = 1 << 20
_QUANTILE_COLUMNS = 64


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    def setFeaturesCol(self, name: str):  # noqa: N802  as pyspark.ml names it
        return self._set(featuresCol=name)

    def setLabelCol(self, name: str):  # noqa: N802
        return self._set(labelCol=name)

    def _predicted(self, rows: DataFrame, scores: Column) -> DataFrame:
        """Adds probability and prediction; of equal ones the lowest class."""
        rows = rows.withColumn("_p", scores)
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return rows.withColumn(self.getPredictionCol(), best).withColumn(self.getProbabilityCol(), array_to_vector("_p")).drop("_p")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gain(g: Column, h: Column, all_g: Column, all_h: Column, l2: float) -> Column:
    """How much a split lowers the loss: half of the sides' squared gradients over their curvatures less the whole's."""
    part = lambda a, b: a * a / (b + l2)
    return (part(g, h) + part(all_g - g, all_h - h) - part(all_g, all_h)) / 2


def leaves(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node of each row: 2 i + 1 and 2 i + 2 are below i, a feature of -1 ends there."""
    feature, cut = np.array(tree["feature"]), np.array(tree["cut"])
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(tree["levels"]):
        inner = node < len(feature)
        at = np.where(inner, node, 0)
        goes = inner & (feature[at] >= 0)
        node = np.where(goes, 2 * node + 1 + (bins[rows, np.maximum(feature[at], 0)] > cut[at]), node)
    return node


def raw_scores(model: dict, bins: np.ndarray) -> np.ndarray:
    """The sum of the trees' leaf values by class, on what the classes' shares give."""
    out = np.tile(np.array(model["base"]), (len(bins), 1))
    for trees in model["rounds"]:
        for c, tree in enumerate(trees):
            out[:, c] += np.array(tree["value"])[leaves(tree, bins)]
    return out


def binned(edges: list[list[float]], x: np.ndarray) -> np.ndarray:
    """The bin of each value: how many edges are below it."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width).astype(float)


class HistogramBoosting(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Labels are 0 to classes - 1. ``rounds`` trees a class of ``depth`` levels over ``bins`` bins (256 at most), each worth ``rate`` of its step."""

    rounds = Param(Params._dummy(), "rounds", "trees of each class", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of each feature, 256 at most", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of each step", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "added to curvatures", TypeConverters.toFloat)
    least = Param(Params._dummy(), "least", "rows of either side of a split, at least", TypeConverters.toInt)

    @keyword_only
    def __init__(self, **settings):
        super().__init__()
        self._setDefault(rounds=10, depth=3, bins=32, rate=0.3, l2=1.0, least=2)
        self._set(**settings)

    def _fit(self, dataset: DataFrame) -> HistogramBoostingModel:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y")).where("y IS NOT NULL")
        counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        if not counts:
            raise ValueError("no labelled rows")
        n = sum(counts.values())
        classes = max(counts) + 1
        edges = self._edges(rows)
        model = {"edges": edges, "base": [float(np.log((counts.get(c, 0) + 1) / (n + classes))) for c in range(classes)], "rounds": []}
        data = kept(_binned_rows(rows, edges), "binned")
        for _ in range(self.getOrDefault("rounds")):
            model["rounds"].append(self._grown(data, model, classes))
        return self._copyValues(HistogramBoostingModel(model=json.dumps(model)))

    def _edges(self, rows: DataFrame) -> list[list[float]]:
        """Inner quantiles of each feature, each once."""
        width = rows.select(F.size("x")).first()[0]
        shares = [k / self.getOrDefault("bins") for k in range(1, self.getOrDefault("bins"))]
        found = []
        for at in range(0, width, _QUANTILE_COLUMNS):
            some = range(at, min(width, at + _QUANTILE_COLUMNS))
            found += list(rows.agg(*[F.percentile_approx(F.get("x", F.lit(f)), shares, 10_000).alias(f"q{f}") for f in some]).first())
        return [sorted({float(v) for v in q}) for q in found]

    def _grown(self, data: DataFrame, model: dict, classes: int) -> list[dict]:
        """One tree for each class."""
        depth, l2, rate = self.getOrDefault("depth"), self.getOrDefault("l2"), self.getOrDefault("rate")
        trees = [{"feature": [-1] * (2**depth - 1), "cut": [0] * (2**depth - 1), "value": [0.0] * (2 ** (depth + 1) - 1), "levels": depth} for _ in range(classes)]
        for level in range(depth):
            for r in self._best_splits(data, model, trees, 2**level - 1).collect():
                tree, i = trees[r["c"]], r["node"]
                step = lambda g, h: -rate * g / (h + l2)
                tree["value"][i] = step(r["all_g"], r["all_h"])
                if r["best"] is not None and r["best"]["gain"] > 1e-9:
                    b = r["best"]
                    tree["feature"][i], tree["cut"][i] = b["f"], b["b"]
                    tree["value"][2 * i + 1], tree["value"][2 * i + 2] = step(b["g"], b["h"]), step(r["all_g"] - b["g"], r["all_h"] - b["h"])
        return trees

    def _best_splits(self, data: DataFrame, model: dict, trees: list[dict], first: int) -> DataFrame:
        """c, node, all_g, all_h and the best split (gain, f, b, g, h) of the nodes of one level."""
        hist = data.mapInArrow(_histogram(model, trees, first), "c int, node int, f int, b int, g long, h long, n long").groupBy("c", "node", "f", "b").agg(*[F.sum(v).alias(v) for v in "ghn"])
        upto = Window.partitionBy("c", "node", "f").orderBy("b")
        whole = Window.partitionBy("c", "node", "f")
        run = hist.select("c", "node", "f", "b", *[F.sum(v).over(upto).alias(v) for v in "ghn"], *[F.sum(v).over(whole).alias(f"all_{v}") for v in "ghn"])
        real = {v: F.col(v) / _UNIT for v in ("g", "h", "all_g", "all_h")}
        run = run.withColumns(real)
        least = self.getOrDefault("least")
        allowed = (F.col("n") >= least) & (F.col("all_n") - F.col("n") >= least)
        split = F.struct(F.round(gain(F.col("g"), F.col("h"), F.col("all_g"), F.col("all_h"), self.getOrDefault("l2")), 9).alias("gain"), (-F.col("f")).alias("m"), (-F.col("b")).alias("k"), "f", "b", "g", "h")
        return run.groupBy("c", "node").agg(F.first("all_g").alias("all_g"), F.first("all_h").alias("all_h"), F.max(F.when(allowed, split)).alias("best"))


def _binned_rows(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = binned(edges, _matrix(batch.column(0), len(edges)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], ["bins", "y"])

    return rows.mapInArrow(run, "bins binary, y int")


def _histogram(model: dict, trees: list[dict], first: int):
    """Sums of a task by class, node of the level, feature and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, width = len(trees), len(model["edges"])
        n_bins = max(map(len, model["edges"])) + 1
        nodes = first + 1
        sums = np.zeros((3, classes, nodes * width * n_bins))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
            p = softmax(raw_scores(model, x))
            y = np.zeros_like(p)
            y[np.arange(len(x)), batch.column(1).to_numpy()] = 1
            for c in range(classes):
                node = leaves(trees[c], x) - first
                here = node >= 0  # others ended above
                if not here.any():
                    continue
                at = ((node[here, None] * width + np.arange(width)) * n_bins + x[here]).ravel()
                g, h = np.rint((p - y)[here, c] * _UNIT), np.rint((p * (1 - p))[here, c] * _UNIT)
                for k, w in enumerate((g, h, np.ones(len(g)))):
                    sums[k, c] += np.bincount(at, np.repeat(w, width), nodes * width * n_bins)
        c, at = np.nonzero(sums[2])
        node, rest = np.divmod(at, width * n_bins)
        cols = [pa.array(v.astype(np.int32)) for v in (c, node + first, rest // n_bins, rest % n_bins)] + [pa.array(sums[k][c, at].astype(np.int64)) for k in range(3)]
        yield pa.RecordBatch.from_arrays(cols, ["c", "node", "f", "b", "g", "h", "n"])

    return run


class HistogramBoostingModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees, kept as JSON in a parameter, which is what saving writes."""

    model = Param(Params._dummy(), "model", "edges, base scores and trees", TypeConverters.toString)

    @keyword_only
    def __init__(self, **settings):
        super().__init__()
        self._setDefault(model="{}")
        self._set(**settings)

    @property
    def trees(self) -> list[dict]:
        """class, round, splits, depth and largest leaf value of every tree."""
        out = []
        for k, trees in enumerate(json.loads(self.getOrDefault("model"))["rounds"]):
            for c, t in enumerate(trees):
                used = [i for i, f in enumerate(t["feature"]) if f >= 0]
                out.append({"class": c, "round": k, "splits": len(used), "depth": max(((i + 1).bit_length() for i in used), default=0), "largest": max(map(abs, t["value"]))})
        return out

    @property
    def numClasses(self) -> int:  # noqa: N802
        return len(json.loads(self.getOrDefault("model"))["base"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = self.getOrDefault("model")

        @F.arrow_udf("array<double>")
        def probabilities(x: pa.Array) -> pa.Array:
            model = json.loads(text)
            p = softmax(raw_scores(model, binned(model["edges"], _matrix(x, len(model["edges"]))))) if len(x) else np.zeros((0, 1))
            return pa.array(list(p), pa.list_(pa.float64()))

        return self._predicted(dataset, probabilities(vector_to_array(self.getFeaturesCol())))
