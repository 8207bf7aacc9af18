"""Conversation history per turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Turns per block. Conversations within one block need a single window.
BLOCK_TURNS = 1_024


def chat_history(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``(conv_id, turn, history)``: all earlier turns as ``role: text`` lines, empty at the first.

    Turns are split into blocks of ``block_turns`` turn numbers, so that no task holds a whole long
    conversation: a window gives the lines of the same block, and each earlier block's text is sent to the
    blocks that need it. All work on turns goes by (conversation, block); by conversation alone only
    block numbers meet. The second part is empty for conversations of one block. Rows of one turn
    number are ordered by their line. The output grows with the square of a conversation's length by
    its nature.
    """
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    turns = conversations.select(
        "conv_id", "turn", line.alias("line"), F.expr(f"turn div {block_turns}").alias("block")
    )
    earlier = (
        Window.partitionBy("conv_id", "block")
        .orderBy("turn", "line")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = turns.withColumn("near", F.collect_list("line").over(earlier)).drop("line")

    # Which block needs which: numbers only, none for conversations of one block.
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    existing = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    needed = existing.select("conv_id", F.col("block").alias("needed_by"), F.collect_list("block").over(before).alias("all"))
    needed = needed.select("conv_id", "needed_by", F.explode("all").alias("block"))
    blocks = (
        turns.join(needed.select("conv_id", "block").distinct(), ["conv_id", "block"], "left_semi")
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
        .select("conv_id", "block", F.concat_ws("\n", F.transform("lines", lambda t: t["line"])).alias("text"))
    )
    far = (
        needed.join(blocks, ["conv_id", "block"])
        .groupBy("conv_id", F.col("needed_by").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("of"), "text"))).alias("parts"))
        .select("conv_id", "block", F.transform("parts", lambda p: p["text"]).alias("far"))
    )
    return within.join(far, ["conv_id", "block"], "left").select(
        "conv_id",
        "turn",
        F.concat_ws("\n", F.coalesce("far", F.array().cast("array<string>")), "near").alias("history"),
    )
