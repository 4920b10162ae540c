"""A linear classifier by stochastic gradients, as a pyspark.ml estimator.

A step draws a part of the rows by a hash of their values, the seed and the
step, so the same rows are drawn however they are dealt out. Tasks add up
gradients of their rows as whole numbers (values and residuals are rounded to
fixed fractions), one shuffle adds the tasks' sums, and the driver gets as many
numbers as the model has. The rate falls with the steps, an L1 penalty is taken
off after each step (what it brings past zero is zero), and the result is the
mean of the weights of the second half.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernmark.operators.boosting import _Columns, _matrix, softmax
from fernmark.scratch import kept

#: Values are rounded to 1 / _UNIT of their feature's largest, residuals to 1 / _UNIT.
_UNIT = 1 << 16
_MAX_BATCH = 1 << 14


def _draw(h: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in [0, 1) for each row's hash."""
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03 + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


class StochasticLogistic(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Multinomial logistic regression. Labels are 0 to classes - 1."""

    steps = Param(Params._dummy(), "steps", "steps", TypeConverters.toInt)
    share = Param(Params._dummy(), "share", "share of the rows in a step", TypeConverters.toFloat)
    rate = Param(Params._dummy(), "rate", "rate of the first step", TypeConverters.toFloat)
    fall = Param(Params._dummy(), "fall", "step k has rate / (1 + fall * k)", TypeConverters.toFloat)
    l1 = Param(Params._dummy(), "l1", "penalty on absolute weights", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "half the penalty on squared weights", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, **settings):
        super().__init__()
        self._setDefault(steps=100, share=0.25, rate=2.0, fall=0.02, l1=0.0, l2=0.001, seed=0)
        self._set(**settings)

    def _fit(self, dataset: DataFrame) -> StochasticLogisticModel:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y")).where("y IS NOT NULL")
        data = kept(rows.select("x", "y", F.xxhash64("x", "y").alias("h")), "rows")
        top = data.agg(F.max("y"), F.max(F.size("x"))).first()
        if top[0] is None:
            raise ValueError("no labelled rows")
        classes, width = top[0] + 1, top[1]
        large = {r["f"]: r["v"] for r in data.select(F.posexplode(F.transform("x", F.abs)).alias("f", "v")).groupBy("f").agg(F.max("v").alias("v")).collect()}
        scale = np.array([large.get(f) or 1.0 for f in range(width)] + [1.0])  # and the constant
        w, mean = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))
        get, late = self.getOrDefault, 0
        for k in range(get("steps")):
            grad, n = self._gradient(data, w, scale, k)
            if n:
                rate = get("rate") / (1 + get("fall") * k)
                pull = np.vstack([w[:-1], np.zeros((1, classes))]) * get("l2")
                w = w - rate * (grad / n + pull)
                w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * get("l1"), 0)
            if 2 * k >= get("steps") - 1:
                mean, late = mean + w, late + 1
        if get("l1") == 0:
            w = mean / max(1, late)  # of sparse weights the mean is not sparse: these are the last step's
        return self._copyValues(StochasticLogisticModel(weights=json.dumps(w.tolist())))

    def _gradient(self, data: DataFrame, w: np.ndarray, scale: np.ndarray, step: int) -> tuple[np.ndarray, int]:
        """The sum over the step's rows, and how many there are."""
        share, seed = self.getOrDefault("share"), self.getOrDefault("seed")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(w.shape, np.int64), 0
            for batch in batches:
                for at in range(0, batch.num_rows, _MAX_BATCH):  # sums of so many products are exact
                    some = batch.slice(at, _MAX_BATCH)
                    mine = np.flatnonzero(_draw(some.column(2).to_numpy().view(np.uint64), seed, step) < share)
                    if not len(mine):
                        continue
                    x = np.concatenate([_matrix(some.column(0), len(scale) - 1)[mine], np.ones((len(mine), 1))], axis=1)
                    r = softmax(x @ w)
                    r[np.arange(len(mine)), some.column(1).to_numpy()[mine]] -= 1
                    total += (np.rint(x / scale * _UNIT).T @ np.rint(r * _UNIT)).astype(np.int64)
                    n += len(mine)
            yield pa.RecordBatch.from_arrays([pa.array([np.append(total.ravel(), n)], pa.list_(pa.int64()))], ["sums"])

        sums = data.select("x", "y", "h").mapInArrow(run, "sums array<long>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(w.size + 1)
        for r in sums:
            flat[r["at"]] = r["v"]
        return flat[:-1].reshape(w.shape) * scale[:, None] / _UNIT**2, int(flat[-1])


class StochasticLogisticModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Weights by feature, the constant last, and class."""

    weights = Param(Params._dummy(), "weights", "JSON of the weights", TypeConverters.toString)

    @keyword_only
    def __init__(self, **settings):
        super().__init__()
        self._setDefault(weights="[]")
        self._set(**settings)

    @property
    def matrix(self) -> np.ndarray:
        return np.array(json.loads(self.getOrDefault("weights")))

    @property
    def numClasses(self) -> int:  # noqa: N802
        return self.matrix.shape[1]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = self.matrix

        @F.arrow_udf("array<double>")
        def probabilities(x: pa.Array) -> pa.Array:
            return pa.array(list(softmax(_matrix(x, len(w) - 1) @ w[:-1] + w[-1])) if len(x) else [], pa.list_(pa.float64()))

        return self._predicted(dataset, probabilities(vector_to_array(self.getFeaturesCol())))
