"""Chat formatting: collapse cumulative snapshots, then render.

Chat logs hold a conversation again after each turn. Turns are numbered within their conversation, and a
rolling hash of every prefix of turns is kept: two running sums (60-bit lanes, exact in DECIMAL) of hashes of
(number, role, text). A conversation whose last prefix hash is a proper prefix of another's is a snapshot of
a longer one; anti-joins on (length, hash) drop it, and of equal conversations the smallest id stays. What
is left is maximal, and is rendered.

A conversation may hold any number of turns: they are numbered, summed and rendered in blocks of
`block_turns`, and a rendered conversation is a row per block, in order. Prefix hashes are made distinct
before they meet, so that a very common first turn is one row for each task.

Defined cases: a null text or role is rendered as empty but differs from an empty one; repeated rows (all of
conv_id, turn, role and text equal) are one turn; turns with the same number are ordered by role and text;
null turn numbers come first; rows without a conv_id are left out, as they belong to no conversation; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shared_table

HASH = "decimal(38,0)"


def _lane(name: str) -> Column:
    """60 bits of a hash of the turn, as an exact number that sums without overflow."""
    h = F.xxhash64(F.lit(name), F.col("pos"), F.isnull("role"), F.col("role"), F.isnull("text"), F.col("text"))
    return F.shiftrightunsigned(h, 4).cast(HASH)


def numbered_turns(df: DataFrame, block_turns: int = 1024) -> DataFrame:
    """(conv_id, block, pos, role, text): distinct turns numbered from 0 within each conversation.

    Turns are ranked within blocks of their turn number; the blocks' counts give each its first number."""
    turns = df.select("conv_id", "turn", "role", "text").filter("conv_id is not null").distinct()
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).cast("long"))
    turns = shared_table(turns, "chat-turns")
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = shared_table(sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "chat-blocks")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    ranked = turns.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["conv_id", "block"])
    return shared_table(ranked.select("conv_id", "block", (F.col("first") + F.col("rank")).alias("pos"), "role", "text"), "chat-numbered")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, length, h1, h2): the hash of every prefix of every conversation, two-level running sums."""
    lanes = turns.select("conv_id", "block", "pos", _lane("one").alias("x1"), _lane("two").alias("x2"))
    sums = lanes.groupBy("conv_id", "block").agg(F.sum("x1").cast(HASH).alias("s1"), F.sum("x2").cast(HASH).alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(HASH)
    carry = sums.select("conv_id", "block", F.coalesce(F.sum("s1").over(before).cast(HASH), zero).alias("c1"), F.coalesce(F.sum("s2").over(before).cast(HASH), zero).alias("c2"))
    carry = shared_table(carry, "chat-carries")
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = lanes.withColumn("r1", F.sum("x1").over(upto).cast(HASH)).withColumn("r2", F.sum("x2").over(upto).cast(HASH)).join(carry, ["conv_id", "block"])
    return run.select("conv_id", (F.col("pos") + 1).alias("length"), (F.col("c1") + F.col("r1")).cast(HASH).alias("h1"), (F.col("c2") + F.col("r2")).cast(HASH).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, length, copies): the conversations that no longer one begins with, one of each class of equal ones."""
    prefixes = shared_table(prefix_hashes(turns), "chat-prefixes")
    lengths = prefixes.groupBy("conv_id").agg(F.max("length").alias("whole"))
    lengths = shared_table(lengths, "chat-lengths")
    marked = prefixes.join(lengths, "conv_id")
    key = ["length", "h1", "h2"]
    whole = marked.filter(F.col("length") == F.col("whole")).groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = marked.filter(F.col("length") < F.col("whole")).select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", "length", "copies")


def render_chat(df: DataFrame, block_turns: int = 1024, opening: str = "<|im_start|>", closing: str = "<|im_end|>\n") -> DataFrame:
    """(conv_id, n_turns, copies, piece, first_turn, rendered): the maximal conversations of
    `df` (conv_id, turn, role, text), in pieces of at most `block_turns` turns."""
    turns = numbered_turns(df, block_turns)
    keep = shared_table(maximal(turns), "chat-maximal")
    part = F.concat(F.lit(opening), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(closing))
    kept = turns.join(keep, "conv_id").withColumn("piece", F.floor(F.col("pos") / block_turns))
    parts = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    pieces = kept.groupBy("conv_id", "length", "copies", "piece").agg(F.min("pos").alias("first_turn"), parts.alias("parts"))
    rendered = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    return pieces.select("conv_id", F.col("length").alias("n_turns"), "copies", "piece", "first_turn", rendered.alias("rendered"))
