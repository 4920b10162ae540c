"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders, by application, of sessions on one machine that have no spark.checkpoint.dir; removed at exit.
_OWN: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can see: ``spark.checkpoint.dir``.

    Only where it is unset and all of Spark runs in this process (a local
    master, as in tests) is there a folder of our own. A cluster without the
    setting is an error, as a folder of one machine would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    if context.applicationId not in _OWN:
        own = tempfile.mkdtemp(prefix="fernmark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[context.applicationId] = "file://" + own
    return _OWN[context.applicationId]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage; a lost executor costs nothing, because the files are not
    on its disk.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many intermediate tables there are; ``release`` takes it."""
    return len(_MADE)


def release(spark: SparkSession, since: int) -> None:
    """Delete the intermediate tables made after ``since``: for callers that have written what came of them."""
    for path in _MADE[since:]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _MADE[since:]


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows apart by id and text, null or repeated ids included."""
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(name, F.lit("\0"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")))


def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is among ``keys`` (one column). No column name can clash."""
    gone = materialize(keys.toDF("fernmark row key").distinct(), "gone")
    return docs.join(broadcast_if_small(gone, max_rows), row_key(id_col, text_col) == gone["fernmark row key"], "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def pieces(batch: pa.RecordBatch, most_bytes: int, most_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` of text (the second column), or one row, and at most ``most_rows`` rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most_bytes + np.arange(len(sizes)) // most_rows
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
    yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def under(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows: the check before a broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast when a count proves it small, else as it is."""
    return F.broadcast(df) if under(df, max_rows) else df
