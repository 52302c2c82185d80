"""Cumulative-snapshot collapse and rendering of conversations (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm._common import settle

#: Turn numbers of one block; a block's turns are ordered in one task.
BLOCK = 1024


def _sums(at: Column, digest: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), at, digest).cast("decimal(20,0)") for seed in (1, 2)]


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, block, pos, n, digest) of the turns of the conversations that no other one extends.

    `turns` is what `read_turns` gives. A prefix's hash is the sum of the
    hashes of (place, role and text), so it rolls on by one addition a turn and
    blocks of a long conversation are added up apart: a conversation of any
    length is never gathered in one task. A conversation goes if its whole hash
    is a prefix's of a longer one; of equal conversations the one with the
    smallest id stays.
    """
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "block", "turn", "digest", F.row_number().over(inside).alias("at"))
    numbered = settle(numbered, "turns")
    over_blocks = Window.partitionBy("conv_id").orderBy("block")
    before = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    counts = numbered.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    offsets = counts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(whole).alias("n"))
    same = lambda x: x["conv_id"].eqNullSafe(F.col("c")) & x["block"].eqNullSafe(F.col("b"))
    placed = numbered.join(offsets, same(numbered)).select("conv_id", "block", "at", "n", (F.col("offset") + F.col("at")).alias("pos"), "turn", "digest")
    placed = placed.withColumns(dict(zip(("h1", "h2"), _sums(F.col("pos"), F.col("digest")), strict=True)))
    placed = settle(placed, "places")
    block_sums = placed.groupBy("conv_id", "block").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    starts = block_sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    inner = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select("conv_id", "block", "pos", "n", *[F.sum(f"h{i}").over(inner).alias(f"r{i}") for i in (1, 2)])
    prefixes = settle(rolled.join(starts, same(rolled)).select("conv_id", "pos", "n", *[(F.col(f"o{i}") + F.col(f"r{i}")).cast("decimal(38,0)").alias(f"p{i}") for i in (1, 2)]), "prefixes")
    key = ["pos", "p1", "p2"]
    finals = prefixes.where("pos = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    longer = prefixes.where("pos < n").select(*key).distinct()
    return finals.join(longer, key, "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def read_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, block, turn, role, text, digest): rows that repeat all four count once; null roles and texts are empty."""
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    block = F.floor(F.col("turn") / BLOCK)
    return rows.distinct().select("conv_id", block.alias("block"), "turn", "role", "text", F.md5(F.concat_ws("\u0000", "role", "text")).alias("digest"))


def render_turn(role: Column, text: Column) -> Column:
    """One turn in chat markup; marks within the text are broken up by a space."""
    clean = F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.concat(F.lit("<|im_start|>"), F.when(role == "", F.lit("unknown")).otherwise(role), F.lit("\n"), clean, F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, chat): the maximal conversations, rendered.

    Logs often hold a conversation again after each turn; those that are the
    first turns of a longer one are dropped, and one of equal ones stays (see
    `maximal_conversations`). Turns are in order of turn number, null first,
    then role and text. A part holds the turns of one block of BLOCK turn
    numbers, so that a row stays of bounded turns: part 0 is the first, and a
    chat is its parts put together. Rows that repeat all four columns count
    once; a null conversation id is a conversation of its own; null roles are
    "unknown", null texts empty. An empty table gives an empty one.
    """
    turns = settle(read_turns(conversations, conv_col, turn_col, role_col, text_col), "chats")
    stay = maximal_conversations(turns).select(F.col("conv_id").alias("stay"), "n_turns")
    kept = turns.join(stay, turns["conv_id"].eqNullSafe(F.col("stay")))
    line = F.struct("turn", "role", "text", render_turn(F.col("role"), F.col("text")).alias("line"))
    parts = kept.groupBy("conv_id", "block", "n_turns").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    part = F.row_number().over(Window.partitionBy("conv_id").orderBy("block")) - 1
    return parts.select("conv_id", part.alias("part"), "n_turns", F.array_join(F.col("lines.line"), "").alias("chat"))
