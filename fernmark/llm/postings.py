"""Inverted postings over blocks of documents, and sums by document of what keys are worth.

``write_blocks`` reads texts in blocks of bounded bytes and rows. A block gives
one row with its documents (``heads``) and, for each key that its texts have, one
row with the documents that have it and how often: the postings (key, document,
count) of that block, packed. ``weigh`` shuffles postings by key to where the
key's values are, multiplies, adds up by document what is in one place, and
reduces these contributions by block.

A key that many documents have has a row in every block, so such keys are salted
by blocks: those with over 1 / ``HOT_KEYS`` of all rows, which are at most that
many and so may be broadcast. What is grouped by block is bounded by the
block's bytes. The blocks are a table in the shared folder, so a lost executor
can't renumber them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from fernmark.llm._common import materialize, pieces

BLOCK_BYTES, _ROW_BITS = 4 << 20, 12
HOT_KEYS = 10_000
#: From texts: a key (under 2 ** 51) and a text's number for each occurrence, and columns with a value for each text.
Inverted = tuple[np.ndarray, np.ndarray, dict[str, list]]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values of each row as bytes; ``ends`` are places in ``values``."""
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _posting_rows(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Keys, their occurrences, the texts that have them and how often."""
    both = np.sort((keys.astype(np.int64) << _ROW_BITS) | texts)
    first = np.flatnonzero(np.diff(both, prepend=-1))
    counts, both = np.diff(first, append=len(both)), both[first]
    key = both >> _ROW_BITS
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(begin[1:], len(key))
    total = np.add.reduceat(counts, begin) if len(begin) else counts
    return key[begin], total, _binary((both & ((1 << _ROW_BITS) - 1)).astype("<u2"), ends), _binary(counts.astype("<u4"), ends)


def write_blocks(docs: DataFrame, inverter: Callable[[], Callable[[list], Inverted]], fields: str, label: str, *, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """block, key, n, docs, counts and heads, as a table; ``fields`` are the columns that the inverter adds to the carried ones.

    ``inverter`` is called once in each task. A head is the struct ``row`` of the
    carried columns, its place in the block and the fields.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    head_type = StructType([StructField("row", rows.schema["row"].dataType), StructField("place", IntegerType()), *StructType.fromDDL(fields)])
    schema = StructType.fromDDL("block long, key long, n long, docs binary, counts binary").add("heads", ArrayType(head_type))
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    head = kinds[-1].value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, invert = TaskContext.get().partitionId() << 32, inverter()
        for batch in batches:
            for some in pieces(batch, BLOCK_BYTES, 1 << _ROW_BITS):
                keys, texts, more = invert(some.column(1).to_pylist())
                key, total, of, counts = _posting_rows(keys, texts)
                n = some.num_rows
                columns = [some.column(0).cast(head.field("row").type), pa.array(np.arange(n), pa.int32()), *[pa.array(v, head.field(k).type) for k, v in more.items()]]
                heads = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.StructArray.from_arrays(columns, fields=[head.field(k) for k in ("row", "place", *more)]))
                lone = [pa.array([block], pa.int64()), *[pa.nulls(1, k) for k in kinds[1:-1]], heads.cast(kinds[-1])]
                yield pa.RecordBatch.from_arrays(lone, names)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(key), pa.array(total.astype(np.int64)), of, counts, pa.nulls(len(key), kinds[-1])], names)
                block += 1

    return materialize(rows.mapInArrow(run, schema), label)


def key_counts(blocks: DataFrame) -> DataFrame:
    """key, n (occurrences) and rows (blocks that have it)."""
    return blocks.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))


def _contribute(values: list[str]):
    """Rows (block, docs, counts, values) in the order of blocks -> (block, docs, sums): each document once a batch."""
    names = ["block", "docs", *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy() // 2
            if not len(size):
                continue
            block, code = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            docs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").astype(np.int64)
            counts = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").astype(np.int64)
            where = np.repeat(code.astype(np.int64) << _ROW_BITS, size) | docs
            order = np.argsort(where, kind="stable")
            where = where[order]
            first = np.flatnonzero(np.diff(where, prepend=-1))
            sums = [np.add.reduceat((counts * np.repeat(batch.column(3 + k).to_numpy(), size))[order], first) for k in range(len(values))]
            ends = np.searchsorted(where[first], (np.arange(len(block)) + 1) << _ROW_BITS)
            packed = _binary((where[first] & ((1 << _ROW_BITS) - 1)).astype("<u2"), ends)
            yield pa.RecordBatch.from_arrays([pa.array(block), packed, *[_binary(s.astype("<i8"), ends) for s in sums]], names)

    return run


def _reduce(values: list[str]):
    """The contributions to one block -> sums by place."""

    def run(part: pa.Table) -> pa.Table:
        docs = np.frombuffer(b"".join(part["docs"].to_pylist()), "<u2")
        row = {"block": part["block"][:1]}
        for v in values:
            total = np.zeros(int(docs.max()) + 1, np.int64)
            np.add.at(total, docs, np.frombuffer(b"".join(part[v].to_pylist()), "<i8"))
            row[v] = pa.array([total], pa.list_(pa.int64()))
        return pa.table(row)

    return run


def weigh(blocks: DataFrame, stats: DataFrame, values: list[str]) -> DataFrame:
    """The documents of ``blocks``: block, place, row, the fields, and for each of ``values`` (whole numbers) its sum over a document's keys, by their counts.

    ``stats``: key, rows (as in ``key_counts``) and the values of each key.
    """
    total = stats.agg(F.sum("rows")).first()[0] or 0
    most = max(1, total // HOT_KEYS)  # at most HOT_KEYS keys have more rows than that
    hot = F.broadcast(stats.where(F.col("rows") > most).select("key", F.ceil(F.col("rows") / most).cast("int").alias("salts")))
    posts = blocks.where("key IS NOT NULL").join(hot, "key", "left").select("key", "block", "docs", "counts", F.pmod(F.xxhash64("block"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    salts = F.when(F.col("rows") > most, F.ceil(F.col("rows") / most).cast("int")).otherwise(1)
    spread = stats.select("key", *values, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    met = posts.join(spread.hint("merge"), ["key", "salt"]).select("block", "docs", "counts", *values)
    given = met.sortWithinPartitions("block").mapInArrow(_contribute(values), "block long, docs binary, " + ", ".join(f"{v} binary" for v in values))
    sums = given.groupBy("block").applyInArrow(_reduce(values), "block long, " + ", ".join(f"{v} array<long>" for v in values))
    heads = blocks.where("heads IS NOT NULL").select("block", "heads").join(sums, "block", "left")
    fields = [f.name for f in blocks.schema["heads"].dataType.elementType.fields]

    def weighed(h, place):
        return F.struct(*[h[f].alias(f) for f in fields], *[F.coalesce(F.get(v, place), F.lit(0).cast("long")).alias(v) for v in values])

    return heads.select("block", F.inline(F.transform("heads", weighed)))
