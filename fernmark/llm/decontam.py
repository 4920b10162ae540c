"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

An item is hit where a document holds one of its windows: ten consecutive words
(all its words if it has fewer). As sets of words, a window must be contained
whole, so the prefix that has to be joined is one word: the rarest, by how often
the documents have the benchmark's words. A prefix word in a document says where
a window would start (its place less its place in the window, positional bound)
and how long it would be (length bound: it must lie within the document). The
words that stand there are then compared, all of them, with the windows by a
join, once for each place of a document however many items are possible there.

Words are runs of digits, letters a-z (A-Z lower-cased) and all characters over
U+007F.

Defined cases: null and empty texts have no words, as items none can occur and
as documents none is hit; repeated items count by their ids; repeated rows and
null ids of documents are judged each, rows that share an id by their own text
(rows are told apart by 128 bits of id and text); an empty benchmark hits
nothing; very long texts are tested at each place once; ids may be of any type
that casts to a string; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.llm._common import broadcast_if_small, materialize, row_key, table, under, without

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows (a word and its place, a window, an item of a window, a hit document) that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _windows(benchmark: DataFrame, n: int, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """Each distinct window (no, an array of words), and which items have it (no, item): rows, as any number of items may share one."""
    words = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - n, F.lit(0))
    rows = words.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("first"))
    pairs = rows.select("item", F.slice("words", F.col("first") + 1, F.lit(n)).alias("window"))
    windows = materialize(pairs.select("window").distinct().withColumn("no", F.monotonically_increasing_id()), "windows")
    return windows, materialize(pairs.join(broadcast_if_small(windows, MAX_BROADCAST_ROWS), "window").select("no", "item").distinct(), "items")


def _rarest(words: DataFrame, windows: DataFrame) -> DataFrame:
    """The prefixes: (word, offset in its window, length of the window), the rarest word of each window by the documents' counts."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    counts = words.select(F.explode("words").alias("word")).join(broadcast_if_small(vocabulary, MAX_BROADCAST_ROWS), "word").groupBy("word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "counts")
    placed = windows.select("window", F.posexplode("window").alias("offset", "word")).join(broadcast_if_small(counts, MAX_BROADCAST_ROWS), "word", "left")
    # A window with a word that no document has can't occur.
    first = placed.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("f")).where("f.n > 0")
    return first.select("f.word", "f.offset", F.size("window").alias("length")).distinct()


def hits(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """key (``row_key``), n_hit (words inside a window that occurs) and items (sorted) of the documents that are hit."""
    windows, items = _windows(benchmark, n, item_col, item_text_col)
    rows = docs.select(row_key(id_col, text_col).alias("key"), words_of(F.col(text_col)).alias("words"))
    prefix = materialize(_rarest(rows, windows), "prefixes")
    spot = F.col("at") - F.col("offset")
    fits = (spot >= 0) & (spot + F.col("length") <= F.size("words"))
    if under(prefix, MAX_BROADCAST_ROWS):
        # The document's words are at hand in the row that found the prefix: nothing of a text is shuffled.
        placed = rows.select("key", "words", F.posexplode("words").alias("at", "word")).join(F.broadcast(prefix), "word").where(fits)
        tested = placed.select("key", spot.alias("start"), F.slice("words", F.greatest(spot + 1, F.lit(1)), F.col("length")).alias("window"))
    else:
        placed = rows.select("key", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "word")).join(prefix, "word")
        starts = placed.where((spot >= 0) & (spot + F.col("length") <= F.col("n_words"))).groupBy("key").agg(F.collect_set(F.struct(spot.alias("start"), "length")).alias("tests"))
        tested = rows.join(starts, "key").select("key", "words", F.explode("tests").alias("t")).select("key", "t.start", F.slice("words", F.col("t.start") + 1, F.col("t.length")).alias("window"))
    found = tested.join(F.broadcast(windows) if under(windows, MAX_BROADCAST_ROWS) else windows, "window")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.size("window")).alias("end"))))
    by_row = materialize(found.groupBy("key").agg(spans.alias("spans"), F.collect_set("no").alias("nos")), "hits")
    which = by_row.select("key", F.explode("nos").alias("no")).join(broadcast_if_small(items, MAX_BROADCAST_ROWS), "no").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("upto"))
    union = F.aggregate("spans", zero, lambda a, s: F.struct((a["covered"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("covered"), F.greatest(a["upto"], s["end"]).alias("upto")))
    return by_row.select("key", union["covered"].cast("long").alias("n_hit")).join(which, "key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_words, n_hit (words inside a window that occurs), items (sorted ids of the items hit)."""
    found = hits(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    rows = rows.join(broadcast_if_small(found, MAX_BROADCAST_ROWS), "key", "left")
    return rows.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that no item hits."""
    return without(docs, hits(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("key"), id_col, text_col, MAX_BROADCAST_ROWS)


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT item, least(len(w), 10) AS n, unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS window FROM item_words WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), doc_windows AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS start, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS window FROM doc_words, sizes WHERE len(w) >= n
), hits AS (
  SELECT d.doc_id, d.start, d.n, x.item FROM doc_windows d JOIN windows x ON d.window = x.window AND d.n = x.n
), hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + n)) AS place FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""
