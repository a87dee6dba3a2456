"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

Every participant of a conversation gets a rendering of the whole dialogue in
which that participant is the assistant: its turns carry the loss mask, all
other participants are users under their own names, and system turns stay what
they are. Roles that differ are participants that differ, under names that
differ (see ``speaker``); the system is none.

A rendering is a row for each message, in order: the segment to append, whether
the loss counts there, and where the segment's content begins and ends in the
whole rendering. So a conversation of any length is never one value or one
task's: positions come from two-level sums over ranges of turns, and only a sum
for each range of each conversation meets in one place.

Format: ``<|im_start|>ROLE`` + `` name=NAME`` for users + newline + text +
``<|im_end|>`` + newline, where the text's own ``<|im_`` becomes ``<| im_``, so
that content cannot open or close a message.

Defined results: null and empty texts are messages with empty content; a role
of letters, digits, ``_`` and ``-`` is its participant's name; in any other role
other characters become ``_`` and a dot and the start of the role's MD5 follow; a
null role is a participant named ``unknown.``; messages are ordered by turn (null
first), then role, then text, and repeated rows are messages of their own; a
conversation of system turns alone has no participant and no rows; a null
``conv_id`` is one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.llm.common import materialise

START, END, GUARD = "<|im_start|>", "<|im_end|>", "<|im_"


def speaker(role: Column) -> Column:
    """A participant's name, which no other role has: plain names hold no dot."""
    shown = F.regexp_replace(role, r"[^A-Za-z0-9_-]", "_")
    plain = (shown == role) & (role != "")
    return F.when(role.isNull(), "unknown.").when(plain, role).otherwise(F.concat(shown, F.lit("."), F.left(F.md5(role), F.lit(16))))


def _segment(role: Column, speaker: Column, view: Column, content: Column) -> tuple[Column, Column]:
    """The text before a message's content, and its role in this view."""
    shown = F.when(speaker == "system", "system").when(speaker == view, "assistant").otherwise("user")
    name = F.when(shown == "user", F.concat(F.lit(" name="), speaker)).otherwise(F.lit(""))
    return F.concat(F.lit(START), shown, name, F.lit("\n")), shown


def rotate(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, seq, turn, role, name, segment, loss, content_start, content_end).

    ``seq`` counts the messages of a conversation from 0; concatenating
    ``segment`` by ``seq`` gives the rendering; ``content_start`` and
    ``content_end`` are character positions in it, and the loss counts on
    exactly these where ``loss`` is true.
    """
    spark = conversations.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|im_", "<| im_")
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), speaker(F.col(role)).alias("speaker"), content.alias("content"))
    # ranges of (conversation, turn): a long conversation spans several; ties end in one range or carry equal rows
    order = ["conv_id", "turn", "speaker", "content"]
    ranged = rows.repartitionByRange(n, *order, F.xxhash64("content")).withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "chat-ranges")
    within = Window.partitionBy("range", "conv_id").orderBy(*order[1:])
    counted = ranged.withColumn("at", F.row_number().over(within) - 1)
    views = materialise(ranged.where("speaker != 'system'").select("conv_id", F.col("speaker").alias("view")).distinct(), "chat-views")
    # both sides keep null conversations together: a null key equals a null key
    same = counted["conv_id"].eqNullSafe(views["conv_id"])
    each = counted.join(views, same).select(counted["conv_id"], "range", "at", "turn", "speaker", "view", "content")
    before, shown = _segment(F.col("speaker"), F.col("speaker"), F.col("view"), F.col("content"))
    each = each.select("*", before.alias("before"), shown.alias("role")).withColumn("size", F.length("before") + F.length("content") + len(END) + 1)
    sums = each.groupBy("conv_id", "view", "range").agg(F.sum("size").alias("chars"), F.count("*").alias("messages"))
    up_to = Window.partitionBy("conv_id", "view").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("conv_id").alias("o_conv"), F.col("view").alias("o_view"), F.col("range").alias("o_range"),
        F.coalesce(F.sum("chars").over(up_to), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("messages").over(up_to), F.lit(0)).alias("messages_before"),
    )
    offsets = materialise(offsets, "chat-offsets")
    running = F.sum("size").over(Window.partitionBy("range", "conv_id", "view").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("ends", running).join(offsets, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("view") == F.col("o_view")) & (F.col("range") == F.col("o_range")))
    stop = F.col("chars_before") + F.col("ends") - len(END) - 1
    return placed.select(
        "conv_id", F.col("view").alias("perspective"), (F.col("messages_before") + F.col("at")).alias("seq"), "turn", "role",
        F.when(F.col("role") == "user", F.col("speaker")).alias("name"), F.concat("before", "content", F.lit(END + "\n")).alias("segment"),
        (F.col("role") == "assistant").alias("loss"), (stop - F.length("content")).alias("content_start"), stop.alias("content_end"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH rows AS (
  SELECT conv_id, turn,
         CASE WHEN role IS NULL THEN 'unknown.' WHEN regexp_full_match(role, '[A-Za-z0-9_-]+') THEN role
              ELSE regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') || '.' || left(md5(role), 16) END AS speaker,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS content
  FROM conversations),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, content) - 1 AS seq FROM rows),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker <> 'system'),
each AS (
  SELECT n.*, v.perspective,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM numbered n JOIN views v ON n.conv_id IS NOT DISTINCT FROM v.conv_id),
headed AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM each),
ended AS (
  SELECT *, sum(length(head) + length(content) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY seq) - 11 AS stop FROM headed)
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, role, CASE WHEN role = 'user' THEN speaker END AS name,
       head || content || '<|im_end|>' || chr(10) AS segment, role = 'assistant' AS loss,
       CAST(stop - length(content) AS BIGINT) AS content_start, CAST(stop AS BIGINT) AS content_end
FROM ended
"""
