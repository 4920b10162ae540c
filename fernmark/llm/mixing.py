"""Mixing sources to target weights by weighted fair queueing.

Each source's documents queue in an order drawn by md5 of their ids and texts, up to
``max_repeats`` times one after another. A document's virtual finish time is the
number of its source's words up to and with it, divided by the source's target.
All documents, sorted by finish time, are taken while their words fit the total
budget. DataFrame functions only.

No window holds a source: running sums go by buckets of the order (a sum for
each bucket, then sums inside buckets). The last document to be taken is found
the same way, in a histogram of finish times, and is then one row that all
others are compared with.

Defined cases: a null text has size 0; a null source is the last source; a
source without words has target 0 and takes nothing; ids may be null or repeated
and of any orderable type that casts to a string, and rows that share an id are
queued each; rows alike in every column get alike results as far as the budget's
end allows; a very long text is one document, taken whole or not at all; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.llm._common import broadcast_if_small, materialize, row_key, table

WORD = r"[^\x20\x09-\x0D]+"
_ROWS_A_BUCKET = 256
_KEY_BITS = 60


def source_targets(sizes: DataFrame, max_repeats: int, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """From (source, source_size): s (order), weight and target.

    Targets are the sources' shares of all words by weight, but at most
    ``max_repeats`` times their size, with the excess shared by the others. With
    sources in order of limit / weight those at their limit come first.
    """
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("s", F.row_number().over(order) - 1).withColumn("budget", F.sum("source_size").over(everything))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("top", F.col("source_size") * max_repeats)
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("top") / F.col("weight"), "s")
    rows = rows.withColumn("before", F.sum("top").over(filling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("top"))
    rows = rows.withColumn("rest", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("budget") - F.col("before")) / F.col("rest")
    rows = rows.withColumn("level", F.when(level <= F.col("top") / F.col("weight"), level))
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(whole))
    target = F.least(F.col("top").cast("double"), F.col("level") * F.col("weight"))
    return rows.select("s", "source", "source_size", "weight", "budget", target.alias("target"))


def _finish(copy: Column) -> Column:
    return (copy * F.col("source_size") + F.col("upto")) / F.col("target")


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)
) -> DataFrame:
    """id, source, size, source_size, target, copies, taken (= copies x size)."""
    queued = _queue(docs.withColumn("fernmark row key", F.lit(None).cast("binary")), id_col, text_col, source_col, max_repeats, weights)
    return queued.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as it is taken.

    Rows alike in id, text and source share what they are given: the least of them
    by its columns written as JSON, which may be of any type, stands for all.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).cast("binary")
    key = F.concat(row_key(id_col, text_col), F.unhex(F.md5(source)))
    queued = _queue(docs.withColumn("fernmark row key", key), id_col, text_col, source_col, max_repeats, weights)
    mixed = materialize(queued.groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("alike")).where("copies > 0"), "copies")
    # Only names made here stand beside the struct of the row, so none can clash.
    rows = docs.select(key.alias("key"), F.struct(*columns).alias("row")).join(broadcast_if_small(mixed, 1_000_000), "key")
    single = rows.where("alike = 1").select("row", "copies")
    shared = rows.where("alike > 1").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"), F.first("copies").alias("copies")).select("row", "copies")
    return single.unionByName(shared).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def _queue(docs: DataFrame, id_col: str, text_col: str, source_col: str, max_repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """key (the column "fernmark row key" of ``docs``), id, source, size, source_size, target and copies of each row."""
    sized = docs.select(
        F.col("`fernmark row key`").alias("key"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        # Id and text, so that rows that share an id, or have none, are dealt to buckets like others.
        F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")), 1, _KEY_BITS // 4), 16, 10).cast("long").alias("k"),
    )
    sized = materialize(sized, "sized")
    bits = max(4, min(22, (sized.count() // _ROWS_A_BUCKET).bit_length()))
    sources = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats, weights), "sources")

    rows = sized.join(broadcast_if_small(sources.withColumnRenamed("source", "its"), 1_000_000), F.col("source").eqNullSafe(F.col("its"))).drop("its", "budget", "weight")
    rows = rows.withColumn("bucket", F.shiftright("k", _KEY_BITS - bits))
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select("s", "bucket", (F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("s", "bucket").orderBy("k", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside)).join(before, ["s", "bucket"])
    queued = materialize(rows.select("key", "id", "source", "size", "source_size", "target", "s", "k", (F.col("before") + F.col("inside")).alias("upto")), "queued")

    slots, last = 1 << bits, 4 << bits
    entries = queued.where("target > 0").withColumn("copy", F.explode(F.array(*map(F.lit, range(max_repeats))))).withColumn("finish", _finish(F.col("copy")))
    entries = entries.withColumn("slot", F.least(F.floor(F.col("finish") * slots), F.lit(last)).cast("int"))
    # Two levels of running sums: at most 8,193 coarse slots in one window, then the slots of each.
    slot_sums = entries.groupBy("slot").agg(F.sum("size").alias("n")).withColumn("coarse", F.shiftright("slot", max(0, bits - 11)))
    coarse = slot_sums.groupBy("coarse").agg(F.sum("n").alias("m"))
    coarse = coarse.select("coarse", (F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("coarse")) - F.col("m")).alias("earlier"))
    within = F.sum("n").over(Window.partitionBy("coarse").orderBy("slot"))
    running = slot_sums.withColumn("within", within).join(F.broadcast(coarse), "coarse").withColumn("upto_slot", F.col("earlier") + F.col("within"))
    running = running.crossJoin(F.broadcast(sources.agg(F.max("budget").alias("budget"))))
    cut = running.where("upto_slot > budget").agg(F.min(F.struct("slot", (F.col("budget") - F.col("upto_slot") + F.col("n")).alias("left"))).alias("c")).select("c.slot", F.col("c.left").alias("left"))
    place = F.struct("finish", "s", "k", "id", "size", "copy")
    near = entries.join(F.broadcast(cut), "slot")
    near = near.withColumn("filled", F.sum("size").over(Window.partitionBy("slot").orderBy("finish", "s", "k", "id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)))
    end = near.where(F.col("filled") > F.col("left")).agg(F.min(place).alias("end"))

    def taken(copy: int) -> Column:
        mine = F.struct(_finish(F.lit(copy)).alias("finish"), "s", "k", "id", "size", F.lit(copy).alias("copy"))
        return F.when((F.col("target") > 0) & (F.col("end").isNull() | (mine < F.col("end"))), 1).otherwise(0)

    copies = sum((taken(c) for c in range(1, max_repeats)), taken(0))
    return queued.crossJoin(F.broadcast(end)).withColumn("copies", copies.cast("int"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 15) AS k FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s, (sum(source_size) OVER ())::BIGINT AS budget FROM sizes
), weighed AS (
  SELECT *, s % 3 + 1 AS weight, 3 * source_size AS top FROM ordered
), filling AS (
  SELECT *, (sum(top) OVER (ORDER BY top::DOUBLE / weight, s ROWS UNBOUNDED PRECEDING) - top)::BIGINT AS before,
         (sum(weight) OVER (ORDER BY top::DOUBLE / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM weighed
), levels AS (
  SELECT min((budget - before)::DOUBLE / rest) FILTER (WHERE (budget - before)::DOUBLE / rest <= top::DOUBLE / weight
             AND before = (SELECT min(before) FROM filling WHERE (budget - before)::DOUBLE / rest <= top::DOUBLE / weight)) AS level FROM filling
), targets AS (
  SELECT source, s, source_size, budget, least(top::DOUBLE, level * weight) AS target FROM weighed, levels
), queued AS (
  SELECT z.doc_id, z.size, z.k, t.s, t.source_size, t.target, t.budget, (sum(z.size) OVER (PARTITION BY t.s ORDER BY z.k, z.doc_id, z.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source
), entries AS (
  SELECT *, (copy * source_size + upto)::DOUBLE / target AS finish FROM queued, (SELECT unnest([0, 1, 2]) AS copy) WHERE target > 0
), filled AS (
  SELECT *, sum(size) OVER (ORDER BY finish, s, k, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS filled FROM entries
)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(f.copies, 0))::BIGINT AS taken
FROM queued q LEFT JOIN (SELECT doc_id, count(*) AS copies FROM filled WHERE filled <= budget GROUP BY doc_id) f USING (doc_id)
"""
