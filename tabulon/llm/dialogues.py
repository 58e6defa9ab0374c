"""Multi-party dialogues seen by every participant in turn.

For every participant of a conversation the dialogue is rendered once: that
speaker's messages become the assistant's, all others are users who keep their
name, and the loss mask covers the assistant's words only.  System messages
stay system messages and are no participant.

The rendering stays relational: one row per (conversation, perspective,
message) with its text and its place in the rendered dialogue.  The dialogue is
the concatenation of ``segment`` by ``position``; ``mask_begin`` and
``mask_end`` are character offsets in it.  So a conversation that holds a third
of all rows is spread over tasks like any other: positions come from turns in
buckets of ``bucket`` turns, ordered inside a bucket and shifted by the totals
of the buckets before.

Defined results: a null role is the participant ``unknown``; a null text is an
empty message; messages without a conversation id form the null conversation;
equal turns are ordered by role and text; a null turn comes first; repeated rows
are repeated messages; a conversation of system messages alone has no
perspective and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def header(role: Column, name: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n"))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 system: str = "system", bucket: int = 64) -> DataFrame:
    """conv_id, perspective, turn, position, role, name, segment, char_begin,
    mask_begin and mask_end (null where nothing is learnt)."""
    m = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
                     F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("unknown")).alias("speaker"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    m = m.withColumn("_b", F.floor(F.col("turn") / F.lit(bucket)))
    who = m.where(F.col("speaker") != system).select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    d = m.join(who, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    own = F.col("speaker") == F.col("perspective")
    shown = F.when(F.col("speaker") == system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    d = d.withColumn("role", shown).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    d = d.withColumn("_head", header(F.col("role"), F.col("name")))
    d = d.withColumn("segment", F.concat("_head", "text", F.lit(CLOSE + "\n")))
    size = F.length("segment").cast("long")
    inside = Window.partitionBy("conv_id", "perspective", "_b").orderBy("turn", "speaker", "text")
    local = d.select("*", (F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("_at"),
                     (F.row_number().over(inside) - 1).cast("long").alias("_i"))
    # one row per bucket of turns
    totals = d.groupBy("conv_id", "perspective", "_b").agg(F.sum(size).alias("_len"), F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(F.col("conv_id").alias("c_"), F.col("perspective").alias("p_"), F.col("_b").alias("b_"),
                          F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_shift"),
                          F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_first"))
    out = local.join(shift, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("perspective") == F.col("p_"))
                     & F.col("_b").eqNullSafe(F.col("b_")))
    begin = F.col("_shift") + F.col("_at")
    learnt = F.when(F.col("role") == "assistant", begin + F.length("_head"))
    return out.select("conv_id", "perspective", "turn", (F.col("_first") + F.col("_i")).alias("position"), "role", "name", "segment",
                      begin.alias("char_begin"), learnt.alias("mask_begin"), (learnt + F.length("text")).alias("mask_end"))
