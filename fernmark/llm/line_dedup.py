"""Removal of lines that many documents share.

Two Bloom filters find the suspects. Line hashes are dealt to shards (a map
task sends a hash once a batch, with the mark "twice" if it saw it again), and
each shard puts them in a *once-seen* filter, or, if they are there already, in
a *twice-seen* filter. The twice-seen filters, a few bits for each repeated
line, go to all tasks if their size, known by then, is under a bound; beyond it
line hashes go to the filters, shard by shard. Only lines that pass are shuffled,
as digests of 128 bits that each task has counted already, and counted exactly;
no text is. The repeated keys' digests go to all tasks as far as a bound allows,
the most frequent ones first, and the rest, if there is any, is joined by a
shuffle.

A line's key is the line without the white space [ \\t\\n\\v\\f\\r] at both ends
and with A-Z lower-cased. Empty keys are never repeats.

Defined cases: a null or empty text is one empty line; each row counts as a
document, repeated rows included; ids may be null and of any orderable type;
very long texts and lines are read whole; an empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.llm._common import materialize, row_key, table
from fernmark.llm.repeats import probed_by_shard, repeated_hashes, send_filters, suspects, shard_of

#: Most repeated keys (24 bytes each) that all tasks get; the others are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000
WHITE = b" \t\n\x0b\x0c\r"
_FLUSH = 1 << 17


def _keys(text: str | None) -> list[bytes]:
    return [line.strip(WHITE).lower() for line in (text or "").encode().split(b"\n")]  # bytes.lower() changes A-Z only


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """For each document the hashes of its distinct keys."""
    for batch in batches:
        for text in batch.column(0):
            keys = {k for k in _keys(text.as_py()) if k}
            yield np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)).view(np.int64)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _count_lines(shards: int, sent):
    """(shard, h, digest, n, first_id, first_pos) of keys: how many documents of this task have one, and its first place there.

    With the filters (``sent``) only keys that pass them.
    """
    names = ["shard", "h", "digest", "n", "first_id", "first_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        held: dict[bytes, list] = {}  # digest -> h, n, (whether the id is there, id, position)
        kind = pa.null()

        def flush() -> pa.RecordBatch:
            h = np.array([r[0] for r in held.values()], np.uint64)
            cols = [pa.array(shard_of(h, shards).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(list(held), pa.binary())]
            cols += [pa.array([r[1] for r in held.values()], pa.int64()), pa.array([r[2][1] for r in held.values()], kind), pa.array([r[2][2] for r in held.values()], pa.int32())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            kind = batch.column(0).type
            ids, pos, keys = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                first: dict[bytes, int] = {}
                for k, key in enumerate(_keys(text.as_py())):
                    if key:
                        first.setdefault(key, k)
                ids += [doc] * len(first)
                pos += first.values()
                keys += first
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            chosen = np.flatnonzero(suspects(cache, sent.value, shards, h)) if sent is not None else np.arange(len(keys))
            for k, x in zip(chosen.tolist(), h[chosen].tolist()):
                place = (ids[k] is not None, ids[k], pos[k])  # a null id comes first
                own = held.setdefault(_digest(keys[k]), [x, 0, place])
                own[1] += 1
                if place[0] < own[2][0] or (place[0] == own[2][0] and (place[1:] < own[2][1:] if place[0] else place[2] < own[2][2])):
                    own[2] = place
                if len(held) >= _FLUSH:
                    yield flush()
        if held:
            yield flush()

    return run


def repeated_lines(docs: DataFrame, *, min_docs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, h, n_docs, first_id, first_pos) of keys in at least ``min_docs`` documents, with exact counts.

    ``first_id`` and ``first_pos`` are the first occurrence in the order of ids.
    """
    found = repeated_hashes(docs.select(F.col(text_col).alias("text")), _line_hashes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = send_filters(found.filters) if found.small() else None
    schema = f"shard int, h long, digest binary, n long, first_id {dict(rows.dtypes)['id']}, first_pos int"
    lines = rows.mapInArrow(_count_lines(found.shards, sent), schema)
    if sent is None:
        lines = probed_by_shard(lines, found)
    counted = lines.groupBy("digest", "h").agg(F.sum("n").alias("n_docs"), F.min(F.struct("first_id", "first_pos")).alias("first"))
    repeated = counted.where(F.col("n_docs") >= min_docs).select("digest", "h", "n_docs", F.col("first.first_id").alias("first_id"), F.col("first.first_pos").alias("first_pos"))
    return materialize(repeated, "repeated")


def _own_digests(sent):
    """(key, id, digest) of the distinct keys of each document that not all tasks know of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            for k, text in enumerate(batch.column(2)):
                own = {_digest(key) for key in set(_keys(text.as_py())) if key and xxhash.xxh3_64_intdigest(key) not in sent.value}
                rows += [k] * len(own)
                digests += own
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(digests, pa.binary())], ["key", "id", "digest"])

    return run


def _rewrite(sent, keep_first: bool, with_text: bool):
    names = ["id", "n_lines", "n_dropped", "kept_sha256", "kept_text"][: 4 + with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[int, dict[bytes, object]] = sent.value
        for batch in batches:
            rows = []
            for doc, text, drop in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py() or ""
                lines, more = text.split("\n"), set(drop or ())

                def goes(key: bytes) -> bool:
                    known = often.get(xxhash.xxh3_64_intdigest(key))
                    if known is None and not more:
                        return False
                    digest = _digest(key)
                    if known is not None and digest in known:
                        return not (keep_first and known[digest] == doc)
                    return digest in more

                kept = [line for line, key in zip(lines, _keys(text)) if not (key and goes(key))]
                joined = text if len(kept) == len(lines) else "\n".join(kept)
                rows.append((len(lines), len(lines) - len(kept), hashlib.sha256(joined.encode()).hexdigest(), joined))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols][: 4 + with_text], names)

    return run


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, keep_first: bool = False, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key is in at least ``min_docs`` documents.

    ``keep_first`` spares the first document (lowest id) that has the key.
    Returns id, n_lines, n_dropped, kept_sha256 and, unless ``with_text`` is off, kept_text.
    """
    spark = docs.sparkSession
    repeated = repeated_lines(docs, min_docs=min_docs, id_col=id_col, text_col=text_col)
    steps = [0, *(4**k for k in range(1, 30))]
    many = repeated.agg(*[F.count(F.when(F.col("n_docs") >= s, 1)) for s in steps]).first()
    least = next((s for s, n in zip(steps, many) if n <= MAX_BROADCAST_ROWS), 1 << 62)
    often: dict[int, dict[bytes, object]] = {}
    for r in repeated.where(F.col("n_docs") >= least).toLocalIterator():
        often.setdefault(r["h"] & (1 << 64) - 1, {})[bytes(r["digest"])] = r["first_id"]
    sent = spark.sparkContext.broadcast(often)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    if least:  # the less frequent ones: by digests, then by document
        keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        rest = repeated.where(F.col("n_docs") < least).select("digest", "first_id")
        hits = keyed.mapInArrow(_own_digests(sent), f"key binary, id {kind}, digest binary").join(rest, "digest")
        if keep_first:
            hits = hits.where(~F.col("id").eqNullSafe(F.col("first_id")))
        drops = hits.groupBy("key").agg(F.collect_set("digest").alias("drop"))
        rows = keyed.join(drops, "key", "left").select("id", "text", "drop")
    else:
        rows = rows.withColumn("drop", F.lit(None).cast("array<binary>"))
    schema = f"id {kind}, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.mapInArrow(_rewrite(sent, keep_first, with_text), schema).withColumnRenamed("id", id_col)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, with_text=False)


#: Spark's and DuckDB's upper() and lower() go beyond A-Z, hence translate.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), often AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often o USING (key) GROUP BY doc_id
"""
