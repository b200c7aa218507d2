"""Chat logs to training text: keep the longest snapshot of each conversation, then render it.

A logged conversation that is the beginning of a longer one is a snapshot of
it. Rolling hashes over each conversation's turns stand for its beginnings;
an anti-join drops conversations whose whole hash is a proper beginning of
another, and of equal ones the smallest id stays.

Only built-in functions are used; what is compared are 128-bit hashes of
position, role and text. A conversation is rendered to one text, so it has to
fit one row; many equal conversations or beginnings are reduced before each
shuffle.

Repeated rows count once. Turns with the same number follow in order of role
and text; a null turn comes last. A null role is rendered as ``unknown``, a
null text as empty, but neither equals a role or text spelled that way. All
turns without an id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.tables import col


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of conversations ``(conv_id, turn, role, text)`` that begin no other."""
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    in_order = Window.partitionBy("conv_id").orderBy(*order)
    placed = turns.withColumn("k", F.row_number().over(in_order))
    what = ["k", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    # texts stay behind here: the rolling hashes need a position and two numbers a turn
    hashed = placed.select("conv_id", "k", F.xxhash64(F.lit(1), *what).alias("h1"), F.xxhash64(F.lit(2), *what).alias("h2"))
    so_far = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select(
        "conv_id", "k", F.bit_xor("h1").over(so_far).alias("p1"), F.bit_xor("h2").over(so_far).alias("p2"),
        F.count("*").over(Window.partitionBy("conv_id")).alias("n"),
    )
    beginnings = rolled.where("k < n").select("k", "p1", "p2").distinct()
    whole = rolled.where("k = n").groupBy("k", "p1", "p2").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id")).alias("id"))
    return whole.join(beginnings, ["k", "p1", "p2"], "left_anti").select(
        F.col("id.conv_id").alias("conv_id"), F.col("k").cast("bigint").alias("n_turns")
    )


def render_conversations(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``(conv_id, n_turns, text)`` of every maximal conversation."""
    turns = conversations.select(
        col(conv_id).alias("conv_id"), col(turn).alias("turn"), col(role).alias("role"), col(text).alias("text")
    ).distinct()
    kept = maximal_conversations(turns).withColumnRenamed("conv_id", "_id")
    rows = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_id")))
    piece = F.struct(F.col("turn").isNull(), "turn", "role", "text")
    whole = rows.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(
        F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n")
    ))
    return whole.select("conv_id", "n_turns", F.array_join(shown, "").alias("text"))
