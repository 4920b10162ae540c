"""Media columns stored as content-defined chunks.

A payload (here: the UTF-8 bytes of a text, padded with 255 to a positive
multiple of ``unit`` bytes) is read as 8-bit samples. A rolling gear hash over
the last 32 bytes cuts it: a chunk ends where the hash's top bits are zero,
after ``MIN`` and at the latest after ``MAX`` bytes.

The store has two Parquet tables. ``documents`` has one row for each document
with its manifest (the ordered list of digests and lengths) and the chunks that
no other document has. ``chunks`` has the others, each once: digests are counted,
those that occur again go into a Bloom filter that all tasks get, and the chunks
it lets pass move out of their documents; a join with the first place of each
digest picks the one copy that is stored. A chunk that passes by mistake is
stored outside its document, which changes nothing. So texts are never shuffled,
only chunks that several documents have. Beyond ``MAX_FILTER_BYTES`` of filter
documents are joined with their shared digests instead, by one shuffle of texts.

Reading fetches the moved chunks by digest, once for each distinct manifest,
checks the digest of every chunk, and rebuilds the payload. Hot digests and hot
manifests meet in joins whose large side has no bytes of payload, which adaptive
execution splits.

``media_bytes`` and ``media_sha256`` describe the stored form of one document:
its manifest followed by its chunks in order, which depends on the text alone.

Defined cases: null is the empty payload, so one unit of padding; repeated rows
and repeated or null ids are stored each; very long texts are cut whole, and a
document's payload has to fit a row; an empty table gives an empty result; ids may be
of any type; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.llm._common import materialize, pieces, row_key, shared_path, table
from fernmark.llm.repeats import BLOOM_BITS, opened, send_filters, shard_filters

MIN, MAX, AVERAGE_BITS = 256, 8192, 11
#: Size of the filter of shared digests up to which all tasks get it.
MAX_FILTER_BYTES = 64 << 20
_KEYS_A_SHARD = 1 << 17
_REMEMBERED = 1 << 18
_BYTES_AT_ONCE = 8 << 20
_GEAR = np.random.default_rng(7919).integers(0, 1 << 32, 256, np.uint32)
#: Magic, bytes, padded bytes, chunks; and digest and length of each chunk.
_HEAD, _ENTRY = "<4sQQI", "<32sI"


def cuts(payload: np.ndarray) -> list[int]:
    """Ends of the chunks of one payload."""
    h = _GEAR[payload]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            more = h.copy()
            more[s:] += h[:-s] << np.uint32(s)
            h = more
    marks = np.flatnonzero(h >> np.uint32(32 - AVERAGE_BITS) == 0) + 1
    ends, at, n = [], 0, len(payload)
    for m in marks.tolist():
        if m - at < MIN:
            continue
        while m - at > MAX:
            at += MAX
            ends.append(at)
        if m - at >= MIN and m < n:
            ends.append(m)
            at = m
    while n - at > MAX:
        at += MAX
        ends.append(at)
    return [*ends, n] if at < n else ends


def payload_of(text: str | None, unit: int) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\xff" * (-len(data) % unit or (0 if data else unit))


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    at, out = 0, []
    for end in cuts(np.frombuffer(payload, np.uint8)):
        piece = payload[at:end]
        out.append((hashlib.sha256(piece).digest(), piece))
        at = end
    return out


def _digests(unit: int):
    """The distinct digests of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests: list[bytes] = []
            for text in batch.column(0):
                digests += {d for d, _ in chunks_of(payload_of(text.as_py(), unit)[1])}
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary())], ["digest"])

    return run


def _hashes(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, what the shard is drawn from) of digests."""
    both = np.frombuffer(b"".join(d[:12] for d in digests), np.dtype([("h", "<u8"), ("s", ">u4")]))
    return both["h"].astype(np.uint64), both["s"].astype(np.int64)


def _keyed(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, s = _hashes(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array((s % shards).astype(np.int32)), pa.array(h.view(np.int64))], ["shard", "h"])

    return run


def _pack(unit: int, shards: int, sent):
    """Rows (kind 0: id, manifest, own chunks, digests of moved ones) and, as kind 1, the moved chunks (digest, place, bytes).

    With a filter (``sent``) it says what moves, otherwise the third column, the
    shared digests of the document, does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filters: dict = {}
        given: set[bytes] = set()  # chunks this task has handed out
        place = TaskContext.get().partitionId() << 40
        binary, many = pa.binary(), pa.list_(pa.binary())
        for whole in batches:
            for batch in pieces(whole, _BYTES_AT_ONCE):
                docs = []
                for text in batch.column(1):
                    n, payload = payload_of(text.as_py(), unit)
                    docs.append((n, len(payload), chunks_of(payload)))
                every = list({d for _, _, chunks in docs for d, _ in chunks})
                if sent is not None:
                    h, s = _hashes(every)
                    moves = {d for d, hit in zip(every, opened(filters, sent.value, s % shards, h)) if hit}
                manifests, own, moved, loose = [], [], [], {}
                for k, (n, size, chunks) in enumerate(docs):
                    manifests.append(struct.pack(_HEAD, b"CDC1", n, size, len(chunks)) + b"".join(struct.pack(_ENTRY, d, len(c)) for d, c in chunks))
                    once = dict(chunks)
                    if sent is None:
                        moves = set(batch.column(2)[k].as_py() or ())
                    own.append([c for d, c in once.items() if d not in moves])
                    moved.append([d for d in once if d in moves])
                    loose |= {d: once[d] for d in moved[-1] if d not in given}
                if len(given) > _REMEMBERED:
                    given.clear()
                given |= loose.keys()
                n, m = len(docs), len(loose)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0), pa.array(manifests, binary), pa.array(own, many), pa.array(moved, many), pa.nulls(n, binary), pa.nulls(n, pa.int64()), pa.nulls(n, binary)], _PACKED)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, batch.column(0).type), pa.nulls(m, binary), pa.nulls(m, many), pa.nulls(m, many), pa.array(list(loose), binary), pa.array(place + np.arange(m)), pa.array(list(loose.values()), binary)], _PACKED)
                place += m

    return run


_PACKED = ["kind", "id", "manifest", "own", "moved", "digest", "place", "bytes"]


def write_media(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 576) -> None:
    """Store the payloads of ``docs`` below ``path``."""
    spark = docs.sparkSession
    digests = docs.select(F.col(text_col).alias("text")).mapInArrow(_digests(unit), "digest binary")
    shared = materialize(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digests")
    n = shared.count()
    shards = max(1, -(-n // _KEYS_A_SHARD))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("array<binary>").alias("known"))
    sent = None
    if n * BLOOM_BITS // 8 <= MAX_FILTER_BYTES:
        sent = send_filters(shard_filters(shared.mapInArrow(_keyed(shards), "shard int, h long")))
    else:
        with_keys = docs.select(F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key")).mapInArrow(_digests_by_key(unit), "key binary, digest binary")
        known = with_keys.join(shared, "digest").groupBy("key").agg(F.collect_set("digest").alias("known"))
        keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
        rows = keyed.join(known, "key", "left").select("id", "text", "known")
    schema = f"kind int, id {dict(rows.dtypes)['id']}, manifest binary, own array<binary>, moved array<binary>, digest binary, place long, bytes binary"
    packed = rows.mapInArrow(_pack(unit, shards, sent), schema)
    packed.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/packed")
    loose = spark.read.schema(schema).parquet(f"{path}/packed").where("kind = 1")
    first = loose.groupBy("digest").agg(F.min("place").alias("place"))
    loose.join(first, ["digest", "place"]).select("digest", "bytes").write.option("compression", "zstd").parquet(f"{path}/chunks")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    made = spark._jvm.org.apache.hadoop.fs.Path
    if files.exists(made(f"{path}/packed/kind=0")):
        files.rename(made(f"{path}/packed/kind=0"), made(f"{path}/documents"))
    else:  # there are no documents
        packed.limit(0).select(*_STORED).write.parquet(f"{path}/documents")
    files.delete(made(f"{path}/packed"), True)


_STORED = ["id", "manifest", "own", "moved"]


def _digests_by_key(unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests = [], []
            for text, key in zip(batch.column(0), batch.column(1).to_pylist()):
                own = {d for d, _ in chunks_of(payload_of(text.as_py(), unit)[1])}
                keys += [key] * len(own)
                digests += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.binary())], ["key", "digest"])

    return run


_FACTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_chunks long, feature string"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id or key, manifest, own, fetched): what is known of each payload."""
    names = ["id", *(f.split()[0] for f in _FACTS.split(", "))]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    for whole in batches:
        for batch in (whole.slice(k, 200) for k in range(0, whole.num_rows, 200)):
            rows = []
            for manifest, own, fetched in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                magic, n, size, count = struct.unpack_from(_HEAD, manifest)
                have = {hashlib.sha256(c).digest(): c for c in (*own, *(fetched or ()))}
                entries = [struct.unpack_from(_ENTRY, manifest, struct.calcsize(_HEAD) + k * struct.calcsize(_ENTRY)) for k in range(count)]
                if lacking := {d for d, _ in entries} - have.keys():
                    raise ValueError(f"of the chunks of a payload {len(lacking)} are missing or differ from their digests")
                payload = b"".join(have[d] for d, _ in entries)
                if magic != b"CDC1" or len(payload) != size or any(len(have[d]) != s for d, s in entries):
                    raise ValueError("chunks don't make up their payload")
                samples = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                share = samples / size
                mean = float(share @ np.arange(256))
                deviation = float(share @ (np.arange(256) - mean) ** 2) ** 0.5
                share = share[share > 0]
                feature = f"mean={mean:.3f};std={deviation:.3f};entropy={-float(share @ np.log2(share)):.3f};peak={int(samples.argmax())}"
                media = hashlib.sha256(manifest)
                media.update(payload)
                rows.append((n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(manifest) + size, media.hexdigest(), count, feature))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild and verify every payload of a store; sizes, digests and a feature of each."""
    store = spark.read.parquet(f"{path}/documents")
    chunks = spark.read.schema("digest binary, bytes binary").parquet(f"{path}/chunks")
    kind = dict(store.dtypes)["id"]
    whole = store.where(F.size("moved") == 0).select("id", "manifest", "own", F.lit(None).cast("array<binary>").alias("fetched"))
    parts = store.where(F.size("moved") > 0).withColumn("key", F.sha2("manifest", 256))
    # Copies have one manifest, so they are rebuilt once.
    distinct = parts.dropDuplicates(["key"]).select("key", "manifest", "own", "moved")
    wanted = parts.select("key", "moved").dropDuplicates(["key"]).select("key", F.explode("moved").alias("digest"))
    fetched = wanted.join(chunks, "digest").groupBy("key").agg(F.collect_list("bytes").alias("fetched"))
    rebuilt = distinct.join(fetched, "key", "left").select("key", "manifest", "own", "fetched").mapInArrow(_rebuild, "id string, " + _FACTS)
    by_id = parts.select("id", "key").join(rebuilt.withColumnRenamed("id", "key"), "key").drop("key")
    return whole.mapInArrow(_rebuild, f"id {kind}, " + _FACTS).unionByName(by_id)


def media_column(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Store to the shared folder, read back, verify."""
    path = shared_path(docs.sparkSession, "media")
    write_media(docs, path, id_col=id_col, **options)
    return read_media(docs.sparkSession, path).withColumnRenamed("id", id_col)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents"))
