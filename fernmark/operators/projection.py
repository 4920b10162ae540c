"""Whitening and dictionaries of unit vectors: fit by sums, transform by matrix products of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.operators.clustering import spherical_kmeans


@dataclass
class Whitening:
    """x -> (x - mean) times components, a column each, divided by the roots of their variances."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix


def fit_whitening(df: DataFrame, vector: str, *, retain: float = 1.0, least: float = 1e-12) -> Whitening:
    """Principal axes that together retain a share of the variance. Tasks return sums of x and of x times x; the
    axes of the d x d covariance are found on the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first, second = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "first": [first.tolist()], "second": [second.ravel().tolist()]})

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    made = rows.mapInPandas(sums, "n long, first array<double>, second array<double>").toPandas()
    if made.empty:
        raise ValueError("no vectors")
    n, mean = made["n"].sum(), np.sum(np.stack(made["first"]), axis=0) / made["n"].sum()
    covariance = np.sum(np.stack(made["second"]), axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)
    variances, axes = np.linalg.eigh(covariance)
    variances, axes = variances[::-1], axes[:, ::-1]
    kept = max(1, int(np.searchsorted(np.cumsum(variances) / variances.sum(), retain - 1e-9)) + 1)
    kept = max(1, min(kept, int((variances > least * variances[0]).sum())))
    # An axis has no direction by itself: its largest entry is positive.
    axes = axes[:, :kept] * np.sign(axes[np.abs(axes[:, :kept]).argmax(axis=0), np.arange(kept)])
    return Whitening(mean, axes, variances[:kept])


@dataclass
class Dictionary:
    """Whitening, then products with unit centres (rows)."""

    whitening: Whitening | None
    centres: np.ndarray

    def __call__(self, x: np.ndarray, rectify: bool = False, n_hot: int = 0) -> np.ndarray:
        out = (self.whitening(x) if self.whitening else x) @ self.centres.T
        if rectify:
            out = np.maximum(out, 0)
        if n_hot:
            last = np.argsort(out, axis=1, kind="stable")[:, -n_hot:]
            out = np.zeros_like(out)
            np.put_along_axis(out, last, 1, axis=1)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        w = self.whitening
        row = (w.mean.tolist(), w.components.tolist(), w.variances.tolist(), self.centres.tolist()) if w else (None, None, None, self.centres.tolist())
        spark.createDataFrame([row], "mean array<double>, components array<array<double>>, variances array<double>, centres array<array<double>>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dictionary:
        r = spark.read.parquet(path).first()
        return Dictionary(Whitening(*map(np.array, (r["mean"], r["components"], r["variances"]))) if r["mean"] is not None else None, np.array(r["centres"]))


def transformed(df: DataFrame, vector: str, how, out: str) -> DataFrame:
    """Adds ``out``: ``how`` (a function of matrices, sent to every task) of the vectors."""
    sent = df.sparkSession.sparkContext.broadcast(how)

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value(np.stack(v.to_numpy()).astype(float)))) if len(v) else v

    return df.withColumn(out, run(F.col(vector).cast("array<double>")))


def fit_dictionary(df: DataFrame, id_col: str, vector: str, k: int, *, whiten: bool = True, retain: float = 0.99, rounds: int = 100) -> Dictionary:
    """Spherical k-means of whitened vectors."""
    rows, whitening = df.select(id_col, vector), None
    if whiten:
        whitening = fit_whitening(df, vector, retain=retain)
        rows = transformed(rows, vector, whitening, "_w").select(id_col, F.col("_w").alias(vector))
    return Dictionary(whitening, spherical_kmeans(rows, id_col, vector, k, rounds)[0])
