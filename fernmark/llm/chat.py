"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that
participant as ``assistant`` and everybody else as a named user; system turns
stay system turns and take no part. The loss mask covers what the participant
says, with its closing mark. DataFrame functions only.

The result has one row for each perspective and turn, with the segment's place
in the rendered dialogue, so a dialogue may be longer than a row may be;
``render`` joins the segments where a whole string is wanted. Places are running
sums by blocks of 256 turn numbers: no window holds a long conversation. They are
made of lengths alone; texts are shuffled once, before they are multiplied. A block
of more than ``MOST_IN_BLOCK`` turns (null or repeated numbers) is sorted by range
and cut where its partitions end, so that no task gets it whole; only the turns of
such blocks are written and shuffled once more.

Defined cases: a null or empty text is an empty turn, a very long one a segment
of a row; a null role speaks as "unknown"; null turns come first, turns with one
number in the order of role and text; repeated rows are repeated turns, however many; a null conversation is one of its own; an empty table gives an
empty result; conversation ids may be of any type that casts to a string; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.llm._common import broadcast_if_small, materialize, table

TURNS_A_BLOCK = 256
#: Turns from which on a block is cut by range.
MOST_IN_BLOCK = 16 * TURNS_A_BLOCK
#: Blocks up to which their keys are broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000

HEAD, END = "<|{}|>\n", "<|end|>\n"


def _others_head(who: Column) -> Column:
    """How others see a turn's head."""
    return F.when(who == "system", F.lit(HEAD.format("system"))).otherwise(F.concat(F.lit("<|user name="), who, F.lit("|>\n")))


def _sizes(turns: DataFrame) -> DataFrame:
    """Of each part of a block and each speaker in it: turns and characters."""
    return turns.groupBy("c", "block", "part", "who").agg(F.first("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _in_parts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with the part of their block, and the sizes of the parts."""
    turns = turns.withColumn("part", F.lit(0))
    sizes = materialize(_sizes(turns), "sizes")
    large = materialize(sizes.groupBy("c", "block").agg(F.sum("n").alias("n")).where(F.col("n") > MOST_IN_BLOCK).select("c", "block"), "large")
    if large.isEmpty():
        return turns, sizes
    large = broadcast_if_small(large, MAX_BROADCAST_ROWS)
    # Numbered and written first: rows alike in everything are told apart by a number that a task run again gives again.
    hot = materialize(turns.join(large, ["c", "block"]).withColumn("number", F.monotonically_increasing_id()), "hot")
    cut = hot.repartitionByRange("c", "block", "turn", "who", "text", "number").withColumn("part", F.spark_partition_id()).drop("number")
    cut = materialize(cut, "cut")
    turns = turns.join(large, ["c", "block"], "left_anti").unionByName(cut)
    return turns, sizes.join(large, ["c", "block"], "left_anti").unionByName(_sizes(cut))


def rotate(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, speaker, seq, turn, role, name, segment, trained, char_start, char_end, mask_start, mask_end.

    Characters [mask_start, mask_end) of the rendered dialogue are trained on; in
    segments of others the span is empty. Without a name, ``name`` is empty.
    """
    who, text = F.coalesce(F.col(role_col), F.lit("unknown")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.concat(F.lit("i"), F.col(conv_col).cast("string")), F.lit("n")).alias("c"),
        F.coalesce(F.floor(F.col(turn_col).cast("long") / TURNS_A_BLOCK), F.lit(-(1 << 62))).alias("block"),
        F.col(turn_col).cast("long").alias("turn"), who.alias("who"), text.alias("text"),
    )
    turns, per = _in_parts(turns)
    # Numbers only: turns and characters before each part of a block, and each speaker's turns before it.
    at = ["c", "block", "part"]
    as_others = F.col("n") * (F.length(_others_head(F.col("who"))) + len(END)) + F.col("chars")
    blocks = per.groupBy(*at).agg(F.first("conv_id").alias("conv_id"), F.sum("n").alias("turns"), F.sum(as_others).alias("chars"))
    earlier = Window.partitionBy("c").orderBy("block", "part")
    blocks = blocks.select("conv_id", *at, (F.sum("turns").over(earlier) - F.col("turns")).alias("turns_before"), (F.sum("chars").over(earlier) - F.col("chars")).alias("chars_before"))
    own = per.where("who <> 'system'").select(*at, F.col("who").alias("speaker"), F.col("n").alias("own"))
    grid = blocks.join(own.select("c", "speaker").distinct(), "c").join(own, [*at, "speaker"], "left")
    earlier = Window.partitionBy("c", "speaker").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("conv_id", *at, "speaker", "turns_before", "chars_before", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("own_before"))
    # One shuffle deals turns to parts; places and texts both come from it, and meet again within a part.
    inside = Window.partitionBy(*at).orderBy("turn", "who", "text")
    placed = turns.select(*at, "turn", "who", "text").withColumn("i", F.row_number().over(inside))
    n = F.length(_others_head(F.col("who"))) + F.length("text") + len(END)
    places = placed.select(*at, "i", "who", n.alias("n"), F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    mine = F.col("who") == F.col("speaker")
    places = places.join(grid, at)
    so_far = Window.partitionBy(*at, "speaker").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    places = places.withColumn("own_upto", F.col("own_before") + F.sum(mine.cast("int")).over(so_far))
    less = F.length(_others_head(F.col("speaker"))) - len(HEAD.format("assistant"))  # what a head of one's own is shorter by
    end: Column = F.col("chars_before") + F.col("upto") - F.col("own_upto") * less
    start = end - F.col("n") + F.when(mine, less).otherwise(0)
    seen = places.select("conv_id", *at, "i", "speaker", (F.col("turns_before") + F.col("i") - 1).alias("seq"), start.alias("char_start"), end.alias("char_end"))
    rows = placed.join(seen, [*at, "i"])
    system = F.col("who") == "system"
    head = F.when(mine, F.lit(HEAD.format("assistant"))).otherwise(_others_head(F.col("who")))
    return rows.select(
        "conv_id", "speaker", "seq", "turn", F.when(mine, "assistant").when(system, "system").otherwise("user").alias("role"), F.when(~mine & ~system, F.col("who")).otherwise("").alias("name"),
        F.concat(head, "text", F.lit(END)).alias("segment"), mine.alias("trained"), "char_start", "char_end",
        F.when(mine, F.col("char_start") + F.length(head)).otherwise(F.col("char_start")).alias("mask_start"), F.when(mine, F.col("char_end") - 1).otherwise(F.col("char_start")).alias("mask_end"),
    )


def render(rotated: DataFrame) -> DataFrame:
    """One row for each perspective: the whole dialogue and its mask spans. For dialogues that fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "segment", "mask_start", "mask_end")))
    spans = F.transform(F.filter("parts", lambda p: p["mask_start"] < p["mask_end"]), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    grouped = rotated.groupBy("conv_id", "speaker").agg(parts.alias("parts"))
    return grouped.select("conv_id", "speaker", F.concat_ws("", F.transform("parts", lambda p: p["segment"])).alias("dialogue"), spans.alias("spans"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text FROM conversations
), rows AS (
  SELECT t.conv_id, s.speaker, t.turn, t.who, t.text, t.who = s.speaker AS trained,
         CASE WHEN t.who = s.speaker THEN 'assistant' WHEN t.who = 'system' THEN 'system' ELSE 'user' END AS role,
         CASE WHEN t.who <> s.speaker AND t.who <> 'system' THEN t.who ELSE '' END AS name
  FROM turns t JOIN (SELECT DISTINCT conv_id, who AS speaker FROM turns WHERE who <> 'system') s USING (conv_id)
), heads AS (
  SELECT *, '<|' || role || CASE WHEN name <> '' THEN ' name=' || name ELSE '' END || '|>' || chr(10) AS head FROM rows
), segments AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM heads
), placed AS (
  SELECT *, (sum(length(segment)) OVER w)::BIGINT AS char_end, row_number() OVER w - 1 AS seq FROM segments
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, speaker, seq, turn, role, name, segment, trained, char_end - length(segment) AS char_start, char_end,
       char_end - length(segment) + CASE WHEN trained THEN length(head) ELSE 0 END AS mask_start, CASE WHEN trained THEN char_end - 1 ELSE char_end - length(segment) END AS mask_end
FROM placed
"""
