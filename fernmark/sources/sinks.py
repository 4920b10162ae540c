"""Writers, and tables that are built once."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(spark: SparkSession, root: str, name: str, version: str, build: Callable[[], DataFrame], *, refresh: bool = False, only_read: bool = False) -> DataFrame:
    """The Parquet table of a name and version: built if its _SUCCESS marker is missing, or if asked."""
    path = f"{root}/{name}/{version}"
    if refresh or not exists(spark, f"{path}/_SUCCESS"):
        if only_read:
            raise FileNotFoundError(path)
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fixed_width(df: DataFrame, path: str, widths: dict[str, int]) -> None:
    """Text columns of stated widths, divided by two spaces, with a header in each file."""
    line = F.rtrim(F.concat_ws("  ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths.items()]))
    head = "  ".join(c.ljust(w) for c, w in widths.items()).rstrip()
    df.select(line.alias(head)).write.mode("overwrite").option("header", True).option("quote", "\u0000").option("sep", "\u0001").option("ignoreTrailingWhiteSpace", False).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_search(df: DataFrame, path: str, *, vector: str, n: int, id_col: str, sort: Sequence[str], drop: Sequence[str] = ()) -> None:
    """A table for clients without arrays: a column for each component, the norm, nested columns as JSON, sorted
    within files by what queries filter on, so that file statistics can skip."""
    from fernmark.functions import vectors

    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct")) and c != vector]
    rows = df.withColumn(f"norm_{vector}", vectors.norm(F.col(vector))).withColumns({c: F.to_json(c) for c in nested})
    rows = rows.select(*[c for c in rows.columns if c not in (vector, *drop)], *vectors.unpack(F.col(vector), n, vector))
    rows.repartitionByRange(*sort, id_col).sortWithinPartitions(*sort, id_col).write.mode("overwrite").parquet(path)


def by_species(df: DataFrame, path: str, species: str) -> None:
    """One folder for each species, dealt by species first so that a folder has few files."""
    df.repartition(species).write.mode("overwrite").partitionBy(species).parquet(path)


def key_map(df: DataFrame, key: str, value: str, path: str) -> None:
    """key -> value as JSON lines, one object each."""
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value).cast("string"))).alias("value")).write.mode("overwrite").text(path)


def trimmed(dim: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows of a dimension that a table uses."""
    return dim.join(used.select(key).distinct(), key, "left_semi")


_SQLITE = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def _plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON."""
    return df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))})


def _fill(db: sqlite3.Connection, table: str, columns: list[tuple[str, str]], rows: Iterable[tuple]) -> None:
    db.execute(f"DROP TABLE IF EXISTS {table}")
    db.execute(f"CREATE TABLE {table} ({', '.join(f'{c} {_SQLITE.get(t, 'TEXT')}' for c, t in columns)})")
    db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns))})", rows)
    db.commit()


def sqlite_files(df: DataFrame, path: str, table: str, *, rows_a_file: int = 1_000_000) -> None:
    """SQLite databases made by the tasks, each of at most ``rows_a_file`` rows: a Parquet table (part, n, database).

    Nothing passes through the driver; ``open_sqlite`` reads one of them.
    """
    rows = _plain(df)
    columns = rows.dtypes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        made = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            with sqlite3.connect(":memory:") as db:
                _fill(db, table, columns, held)
                out = pa.RecordBatch.from_pydict({"part": [f"{TaskContext.get().partitionId()}-{made}"], "n": [len(held)], "database": [db.serialize()]})
            held.clear()
            made += 1
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == rows_a_file:
                    yield flush()
        if held:
            yield flush()

    rows.mapInArrow(run, "part string, n long, database binary").write.mode("overwrite").parquet(path)


def open_sqlite(database: bytes) -> sqlite3.Connection:
    """A database of ``sqlite_files`` in memory."""
    db = sqlite3.connect(":memory:")
    db.deserialize(database)
    return db


def sampled(spark: SparkSession, path: str, key: str, per_cent: int, root: str, seed: str = "") -> DataFrame:
    """A hash sample of a Parquet table, written once below ``root`` and read from there."""
    from fernmark.operators.sampling import sample_share

    name = f"sample-{per_cent}-{seed}-" + sha1(path.encode()).hexdigest()[:12]
    return materialize(spark, root, name, key, lambda: sample_share(spark.read.parquet(path), key, per_cent, seed))
