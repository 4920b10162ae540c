"""Token-id files with Elias-Fano document boundaries.

``write_token_files`` range-partitions documents by id, encodes each partition
in order and writes blocks of about ``block_ids`` ids; a document is never cut.
A block holds its ids as one little-endian array (two bytes each for
vocabularies up to 65,536) and the ends of its documents as an Elias-Fano code
(``elias_fano``), whose select structure finds one document without a table of
64-bit offsets. Blocks are rows of Parquet files, so any store that Spark
writes to will do. ``read_token_files`` gives documents back from the files.

Defined cases: a null text is the empty text (only the end id); a null id sorts
first; repeated ids stay separate documents, next to each other and in the order
of their texts; a very long text is a block of its own, which has to fit a row;
an empty table gives no blocks; ids are integers; columns other than id and text
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.llm import elias_fano
from fernmark.llm._common import pieces, shared_path, table

BLOCK_SCHEMA = "shard int, block int, n_docs int, n_ids long, width int, doc_ids array<long>, ends binary, ids binary"
#: Text that is encoded before a block's size is looked at again; characters that order rows with one id.
_BYTES_AT_ONCE, _TIE = 4 << 20, 64
_ENCODERS: dict = {}


def _encoder(path: str):
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        from fernmark.llm.piece_encoder import PieceEncoder

        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _encode(tokenizer_path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, block = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        lens: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, ids, lens, held, block
            row = {
                "shard": [shard], "block": [block], "n_docs": [len(docs)], "n_ids": [held], "width": [ids[0].dtype.itemsize],
                "doc_ids": [docs], "ends": [elias_fano.encode(np.cumsum(lens))], "ids": [np.concatenate(ids).tobytes()],
            }
            docs, ids, lens, held, block = [], [], [], 0, block + 1
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))

        for batch in batches:
            for some in pieces(batch, _BYTES_AT_ONCE, 1000):
                flat, counts = encoder.encode(some.column(1).to_pylist())
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id)
                docs += some.column(0).to_pylist()
                lens += (counts + 1).tolist()
                ids.append(flat)
                held += len(flat)
                if held >= block_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = 1 << 20
) -> None:
    """Encode ``docs`` in ascending order of ``id_col`` into token files below ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Rows that share an id are in the order of their texts, of which the beginning helps to deal them out.
    ordered = rows.repartitionByRange(F.col("id"), F.substring("text", 1, _TIE)).sortWithinPartitions("id", "text")
    ordered.mapInArrow(_encode(tokenizer_path, end_id, block_ids), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def with_base(blocks: DataFrame) -> DataFrame:
    """Adds ``base``: ids in all blocks before. Sums by shard first, so no window holds all blocks."""
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_base"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    places = blocks.select("shard", "block", "n_ids").withColumn("inside", inside)
    places = places.join(before, "shard").select("shard", "block", (F.col("shard_base") + F.col("inside")).alias("base"))
    return blocks.join(places, ["shard", "block"])


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = elias_fano.EliasFano(row["ends"]).select_many(np.arange(len(row["doc_ids"])))
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                starts = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([starts, ends[-1:]]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids_crc32 and, if asked, the ids."""
    blocks = with_base(spark.read.schema(BLOCK_SCHEMA).parquet(path)).select("base", "width", "doc_ids", "ends", "ids")
    return blocks.mapInArrow(_documents(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fetch(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """doc_id and ids of some documents: only blocks that have them are opened, and ``select`` finds their ends there."""
    chosen = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = elias_fano.EliasFano(row["ends"])
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                for k in (k for k, d in enumerate(row["doc_ids"]) if d in chosen):
                    start, stop = np.append(0, ends.select_many([k - 1, k] if k else [0]))[-2:]
                    found = ids[start:stop]
                    yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k]], pa.int64()), pa.array([found.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).where(F.arrays_overlap("doc_ids", F.lit(list(wanted)).cast("array<long>")))
    return blocks.select("width", "doc_ids", "ends", "ids").mapInArrow(run, "doc_id long, ids array<int>")


def token_output(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write token files to the shared folder and read the documents back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, **options)
    return read_token_files(docs.sparkSession, path)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
