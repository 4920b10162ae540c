"""Importance resampling towards a target corpus by bucket-partitioned inverted postings.

Features are runs of 1 to ``max_n`` words, hashed into buckets. Postings
(bucket, document, count) are shuffled by bucket (``postings``), where both
corpora's counts of the bucket meet and give its gain: how much likelier the
target is to have it. Every bucket sends its gain times the count to its
documents, and a document's weight is the sum of what it gets. With Gumbel noise
from a hash of the id added, the documents with the highest scores are a sample
without replacement in proportion to the importance weights.

Ranks come from a range partition of all documents by score and running counts of
its parts, so nothing is sorted in one place.

Words are runs of digits, letters a-z (A-Z lower-cased) and all characters over
U+007F.

Defined cases: null and empty texts have no features and weight 0; an empty
target or table gives gains from what there is and an empty result; repeated rows
and rows that share an id are weighed and ranked each, in an order of their own
that reruns keep while the files' partitions stay; a null id has the noise of
the empty text and comes first among ties; very long texts are cut into words piece
by piece; other columns are ignored but for those carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.llm._common import materialize, table
from fernmark.llm.postings import key_counts, weigh, write_blocks

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 10, 20, 2024
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
_PIECE, _MAX_CACHED = 1 << 20, 500_000


class _Buckets(dict):
    """The bucket of each feature, computed once while it is kept."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) > _MAX_CACHED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.n
        return found


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, a piece at a time."""
    raw, at = (text or "").encode().lower(), 0  # of bytes, only A-Z are lowered
    while at < len(raw):
        gap = _GAP.search(raw, at + _PIECE)
        stop = gap.start() if gap else len(raw)
        yield _WORD.findall(raw, at, stop)
        at = stop


def _inverter(max_n: int, n_buckets: int):
    def start():
        buckets = _Buckets(n_buckets)

        def invert(texts):
            keys, counts, n_words = [np.zeros(0, np.int64)], [], []
            for text in texts:
                total = words = 0
                before: list[bytes] = []
                for some in words_of(text):
                    words += len(some)
                    some = before + some
                    for n in range(1, max_n + 1):
                        fresh = some[max(0, len(before) - n + 1) :]  # runs that end in this piece
                        runs = fresh if n == 1 else list(map(b" ".join, zip(*(fresh[k:] for k in range(n)))))
                        keys.append(np.fromiter(map(buckets.__getitem__, runs), np.int64, len(runs)))
                        total += len(runs)
                    before = some[len(some) - max_n + 1 :] if max_n > 1 else []
                counts.append(total)
                n_words.append(words)
            return np.concatenate(keys), np.repeat(np.arange(len(texts)), counts), {"n_features": counts, "n_words": n_words}

        return invert

    return start


def weights(docs: DataFrame, target: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", target_text_col: str = "text", max_n: int = 1, n_buckets: int = BUCKETS) -> DataFrame:
    """block, place, row (the carried columns), n_features, n_words and weight of each document."""
    inverter = _inverter(max_n, n_buckets)
    raw = write_blocks(docs, inverter, "n_features:long,n_words:long", "raw", carry=carry, text_col=text_col)
    plain = target.select(F.col(target_text_col).alias("text"), F.lit(0).alias("none"))
    wanted = write_blocks(plain, inverter, "n_features:long,n_words:long", "wanted", carry=("none",))
    both = key_counts(raw).select("key", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"), "rows")
    both = both.unionByName(key_counts(wanted).select("key", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"), F.lit(0).cast("long").alias("rows")))
    # At most n_buckets rows.
    met = materialize(both.groupBy("key").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("rows").alias("rows")), "buckets")
    all_s, all_t = met.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    above = (F.col("t") + 1).cast("double") * F.lit(float(all_s + n_buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(all_t + n_buckets))
    gains = met.where("rows > 0").select("key", "rows", F.floor(1000 * F.log(above / below)).cast("long").alias("weight"))
    return weigh(raw, gains, ["weight"])


def resample(
    docs: DataFrame, target: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, **options
) -> DataFrame:
    """row (the carried columns), n_features, weight, score and rank of every document; rank is null for those that are not drawn."""
    rows = weights(docs, target, carry=tuple(dict.fromkeys((id_col, *carry))), **options)
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row")[id_col].cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0))).cast("long")
    able = F.col("n_words") >= min_words
    scored = materialize(rows.select("block", "place", "row", "n_features", "weight", (F.col("weight") + noise).alias("score"), able.alias("able")), "scored")
    drawn = percent * scored.where("able").count() // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("row")[id_col].asc(), F.col("block").asc(), F.col("place").asc()]
    parts = materialize(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "parts")
    sizes = parts.groupBy("part").count()  # a row for each partition of the range
    before = sizes.select("part", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long") + F.col("before")
    ranked = parts.join(F.broadcast(before), "part").withColumn("at", place)
    return ranked.select("row", "n_features", "weight", "score", F.when(F.col("able") & (F.col("at") <= drawn), F.col("at")).alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH RECURSIVE crc_bits AS (
  SELECT b, b AS r, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, k + 1 FROM crc_bits WHERE k < 8
), crc AS (SELECT list(r ORDER BY b) AS tab FROM crc_bits WHERE k = 8
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), counted AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM doc_words) GROUP BY ALL
), vocabulary AS (
  SELECT DISTINCT word FROM (SELECT word FROM counted UNION ALL SELECT word FROM item_words)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h[i:i + 1])::BIGINT FOR i IN range(1, len(h), 2)]), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM vocabulary), crc
), s AS (SELECT bucket, sum(n)::BIGINT AS s FROM counted JOIN hashed USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM item_words JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id::VARCHAR), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM doc_words LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
