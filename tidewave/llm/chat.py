"""Collapse of cumulative snapshots of chats, and rendering of what remains.

Every conversation gets a chain of hashes, one per turn, each over the hash before it and the
turn's role and text. A conversation whose last hash is a proper-prefix hash of another is a
snapshot of it and goes, by an anti-join; of equal conversations the smallest conv_id stays. The
maximal conversations are rendered.

Defined results: a null conv_id makes every row a conversation of its own; rows repeated
within a conversation count once; turns are ordered by (turn, role, text), nulls first, and
their numbers don't matter beyond that; a null role is ``unknown``, a null text empty when
rendered, and both differ from other values when compared; markers inside a text get a blank
after ``<`` so that they can't end a turn; an empty table gives an empty one; further columns
are ignored. A conversation is one text in the end and has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.sizing import cut_lineage

BLOCK = 128
START, END = "<|im_start|>", "<|im_end|>"


def tagged(c: Column) -> Column:
    """A form that can be concatenated without ambiguity."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def chain_of(turns: Column) -> Column:
    """One hash per turn, each over the one before. Blocks of turns are put together at the end of each, as arrays grow by copying."""
    none = F.array().cast("array<string>")

    def step(state: Column, turn: Column) -> Column:
        last = F.md5(F.concat(state["last"], tagged(turn["role"]), tagged(turn["text"])).cast("binary"))
        return F.struct(last.alias("last"), F.concat(state["chain"], F.array(last)).alias("chain"))

    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["last"].alias("last"), none.alias("chain")), step)
        return F.struct(inner["last"].alias("last"), F.concat(state["chain"], inner["chain"]).alias("chain"))

    blocks = F.transform(F.sequence(F.lit(0), F.size(turns) - 1, F.lit(BLOCK)), lambda a: F.slice(turns, a + 1, F.lit(BLOCK)))
    return F.aggregate(blocks, F.struct(F.lit("").alias("last"), none.alias("chain")), block, lambda s: s["chain"])


def conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns, chain), one row per conversation."""
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    named = (
        df.where(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("conv_id"))
        .agg(F.sort_array(F.collect_set(one)).alias("turns"))
    )
    alone = df.where(F.col(conv_id).isNull()).select(F.col(conv_id).alias("conv_id"), F.array(one).alias("turns"))
    return named.unionByName(alone).withColumn("chain", chain_of(F.col("turns")))


def maximal(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, n_copies): one conversation of each that no other continues."""
    chats = cut_lineage(chats)
    prefixes = chats.select(F.explode(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("full")).distinct()
    whole = chats.select(F.element_at("chain", -1).alias("full"), "conv_id", "turns")
    return (
        whole.groupBy("full")
        .agg(F.min(F.struct(F.col("conv_id").isNull().alias("unnamed"), "conv_id", "turns")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
        .join(prefixes, "full", "left_anti")
        .select("first.conv_id", "first.turns", "n_copies")
    )


def rendered(turns: Column) -> Column:
    def one(turn: Column) -> Column:
        body = F.regexp_replace(F.coalesce(turn["text"], F.lit("")), "<(\\|im_(start|end)\\|>)", "< $1")
        return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("unknown")), F.lit("\n"), body, F.lit(END + "\n"))

    return F.array_join(F.transform(turns, one), "")


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies, chat) of the maximal conversations."""
    kept = maximal(conversations(df, conv_id, turn, role, text))
    return kept.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", rendered(F.col("turns")).alias("chat"))
