"""Sizes that decide about broadcasts, and a folder for what a query writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast.
MAX_ROWS = 200_000
_OWN: dict[str, str] = {}


def under(df: DataFrame, max_rows: int = MAX_ROWS) -> bool:
    """Whether ``df`` has at most so many rows; runs it, up to the first row too many."""
    return df.limit(max_rows + 1).count() <= max_rows


def small(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``df`` marked for broadcast when a count proves it small, else as it is."""
    return F.broadcast(df) if under(df, max_rows) else df


def path(spark: SparkSession, label: str) -> str:
    """A fresh path that all executors share: below ``spark.checkpoint.dir``, or, on one machine without it, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        if context.applicationId not in _OWN:
            own = tempfile.mkdtemp(prefix="fernmark-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN[context.applicationId] = "file://" + own
        root = _OWN[context.applicationId]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows doesn't run it again; no executor's disk holds it."""
    where = path(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
