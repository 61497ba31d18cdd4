"""Chat transcripts from logged conversations, without earlier snapshots of longer ones.

A logger that stores the whole history at every turn writes each conversation many times,
each time a few turns longer.  A conversation is dropped if its turns are the first turns of
a longer one; of equal conversations the one with the smallest ``conv_id`` stays.

Every prefix of a conversation has a rolling hash: the exclusive or of 128-bit hashes of the
turns so far, each taken over turn number, role and text.  Being commutative it is summed
per segment of ``SEGMENT`` turns first and rolled over the segments afterwards, so that one
endless conversation does not end up in one task.  An anti-join of whole conversations
against the proper prefixes of others keeps the maximal ones; both sides hold each hash once,
so a first turn that many conversations share is one row.

Rows repeated within a conversation count once.  Null roles and texts are empty ones; a role
that is empty is rendered as ``unknown``.  A null turn comes before all others, rows of the
same turn stand in the order of role and text.  A null ``conv_id`` is a conversation of its
own and counts as the largest id.  A conversation of more than ``SEGMENT`` turns is rendered
in several rows, numbered by ``segment``.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.llm.common import stored

SEGMENT = 1024
KEY = ("last_turn", "n_turns", "h1", "h2")


def turns_of(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Distinct turns with their segment and hash."""
    turns = conversations.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).distinct()
    return turns.select("*", F.floor(F.col("turn") / segment).alias("segment"),
                        F.xxhash64("turn", "role", "text").alias("h1"),
                        F.xxhash64(F.lit("2"), "text", "role", "turn").alias("h2"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, last_turn, n_turns, h1, h2``: the rolling hash after every turn."""
    def summed(*by: str) -> DataFrame:
        return turns.groupBy("conv_id", "segment", *by).agg(
            F.count("*").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))

    def rolled(window) -> list[Column]:
        return [F.sum("n").over(window), F.bit_xor("h1").over(window),
                F.bit_xor("h2").over(window)]

    whole = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(
        Window.unboundedPreceding, -1)
    before = summed().select(F.col("conv_id").alias("conv"), F.col("segment").alias("part"), *[
        F.coalesce(c, F.lit(0)).alias(n)
        for c, n in zip(rolled(whole), ("n_before", "h1_before", "h2_before"))])
    inner = Window.partitionBy("conv_id", "segment").orderBy("turn").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    within = summed("turn").select("conv_id", "segment", "turn", *[
        c.alias(n) for c, n in zip(rolled(inner), ("n", "h1", "h2"))])
    return within.join(before, F.col("conv_id").eqNullSafe(F.col("conv"))
                       & (F.col("segment") == F.col("part"))).select(
        "conv_id", F.col("turn").alias("last_turn"), (F.col("n") + F.col("n_before")).alias("n_turns"),
        F.col("h1").bitwiseXOR(F.col("h1_before")).alias("h1"),
        F.col("h2").bitwiseXOR(F.col("h2_before")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_equal``: conversations that are no prefix of a longer one."""
    rolling = prefixes(turns)
    ends = turns.groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.count("*").alias("n_turns"),
        F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    contents = ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"),
                                      F.count("*").alias("n_equal"))
    last = ends.select(F.col("conv_id").alias("conv"), F.col("last_turn").alias("end"))
    shorter = (rolling.join(last, F.col("conv_id").eqNullSafe(F.col("conv"))
                            & (F.col("last_turn") < F.col("end"))).select(*KEY).distinct())
    return contents.join(shorter, list(KEY), "left_anti").select("conv_id", "n_turns", "n_equal")


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """``conv_id, segment, chat``: the turns in order, each between the two marks."""
    block = F.concat(F.lit(start), F.when(F.col("role") == "", "unknown").otherwise(F.col("role")),
                     F.lit("\n"), F.col("text"), F.lit(end + "\n"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", block.alias("block"))))
    return turns.groupBy("conv_id", "segment").agg(
        F.concat_ws("", F.transform(ordered, lambda t: t["block"])).alias("chat"))


def format_chats(conversations: DataFrame, segment: int = SEGMENT, **marks: str) -> DataFrame:
    """``conv_id, segment, n_turns, n_equal, chat`` of every maximal conversation."""
    turns = stored(turns_of(conversations, segment), "turns")
    kept = maximal(turns.drop("role", "text")).withColumnRenamed("conv_id", "kept_id")
    chats = render(turns.select("conv_id", "segment", "turn", "role", "text").join(
        kept.select("kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi"), **marks)
    return chats.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select(
        "conv_id", "segment", "n_turns", "n_equal", "chat")
