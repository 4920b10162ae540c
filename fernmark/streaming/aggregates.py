"""Streaming aggregates and sinks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """Counts by day and key; days close when the watermark passes them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), key, "n")


def running_range(values: DataFrame, key: str, value: str) -> DataFrame:
    """Smallest and largest value of each key so far (update or complete mode)."""
    return values.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))


def upsert_latest(path: str, key: str, version: str, buckets: int = 64, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps the newest row of each key. ``upserted`` reads the table.

    Keys are dealt to buckets by hash. A batch reads and rewrites only the buckets that
    it has keys of, and then writes which version of each bucket counts: that makes the
    batch take effect, so one that fails midway changes nothing, and one that runs again
    starts from the versions before it, whatever numbers are missing. Versions that the last ``keep``
    batches don't name are removed.
    """
    from fernmark.operators.dedup import latest

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        before = _versions(spark, path, number)
        touched = sorted(r["_bucket"] for r in rows.select("_bucket").distinct().collect())  # ``buckets`` numbers at most
        old = [f"{path}/data/{before[b]}/_b={b}" for b in touched if b in before]
        if old:
            held = spark.read.schema(batch.schema).parquet(*old).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            rows = held.unionByName(rows)
        newest = latest(rows, [key], version).withColumn("_b", F.col("_bucket")).drop("_bucket")
        newest.repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{path}/data/{number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{number}")
        _forget_versions(spark, path, number, keep)

    return merge


def _children(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders below a path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(root) if f.getPath().getName().isdigit())


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose versions were written whole."""
    from fernmark.sources.sinks import exists

    return [n for n in _children(spark, f"{path}/versions") if exists(spark, f"{path}/versions/{n}/_SUCCESS")]


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket after the newest batch, or the newest before a number."""
    done = [n for n in _complete(spark, path) if before is None or n < before]
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/versions/{done[-1]}").collect()} if done else {}


def _forget_versions(spark: SparkSession, path: str, number: int, keep: int) -> None:
    done = [n for n in _complete(spark, path) if n <= number]
    named = {v for n in done[-keep:] for v in _versions(spark, path, n + 1).values()}
    gone = [f"{path}/versions/{n}" for n in done[:-keep]] + [f"{path}/data/{n}" for n in _children(spark, f"{path}/data") if n <= number and n not in named]
    for folder in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_latest`` keeps."""
    found = _versions(spark, path)
    if not found:
        raise ValueError(f"no rows were written below {path}")
    return spark.read.parquet(*[f"{path}/data/{v}/_b={b}" for b, v in found.items()])


class OnlineSphericalKMeans:
    """For ``foreachBatch``: unit centres that move to each batch's vectors, weighted by how often they were hit.

    With ``path`` the centres are written after each batch, and a new object goes
    on where the last one stopped; a batch that was counted is not counted again.
    """

    def __init__(self, centres: np.ndarray, path: str | None = None):
        self.centres, self.hits = np.asarray(centres, float), np.ones(len(centres))
        self.path, self.last = path, -1

    def _move(self, total: np.ndarray, n: np.ndarray) -> None:
        moved = (self.centres * self.hits[:, None] + total) / (self.hits + n)[:, None]
        self.hits = self.hits + n
        norm = np.linalg.norm(moved, axis=1, keepdims=True)
        self.centres = moved / np.where(norm > 0, norm, 1)

    def update(self, x: np.ndarray) -> None:
        """One batch at hand."""
        best = (x @ self.centres.T).argmax(axis=1)
        total = np.zeros_like(self.centres)
        np.add.at(total, best, x)
        self._move(total, np.bincount(best, minlength=len(self.centres)))

    def restore(self, spark: SparkSession) -> None:
        """The state of the last batch that was written to ``path``."""
        rows = spark.read.parquet(self.path).orderBy(F.desc("batch")).limit(1).collect()
        if rows and rows[0]["batch"] > self.last:
            self.last, self.hits = rows[0]["batch"], np.array(rows[0]["hits"])
            self.centres = np.array(rows[0]["centres"]).reshape(len(self.hits), -1)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """One pass of the batch's tasks: sums and counts by centre come back, not rows."""
        from fernmark.sources.sinks import exists

        spark = batch.sparkSession
        if self.path and self.last < 0 and exists(spark, self.path):
            self.restore(spark)
        if number <= self.last:
            return
        centres = self.centres

        def sums(frames):
            total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for f in frames:
                if len(f):
                    x = np.stack(f["v"].to_numpy())
                    best = (x @ centres.T).argmax(axis=1)
                    np.add.at(total, best, x)
                    n += np.bincount(best, minlength=len(centres))
            yield pd.DataFrame({"total": [total.ravel().tolist()], "n": [n.tolist()]})

        made = batch.select(F.col("v").cast("array<double>").alias("v")).mapInPandas(sums, "total array<double>, n array<long>").toPandas()
        if len(made):
            self._move(np.sum(np.stack(made["total"]), axis=0).reshape(centres.shape), np.sum(np.stack(made["n"]), axis=0))
        self.last = number
        if self.path:
            row = [(number, self.hits.tolist(), self.centres.ravel().tolist())]
            spark.createDataFrame(row, "batch long, hits array<double>, centres array<double>").coalesce(1).write.mode("append").parquet(self.path)


def keep_result(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream in complete mode: the result so far, as a Parquet table of numbered snapshots."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")

    return write


def last_result(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot below ``path``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    return spark.read.parquet(f"{path}/{max(int(f.getPath().getName()) for f in found)}")
