"""Chat formatting with a collapse of cumulative snapshots, in DataFrame operations.

Logs often hold a conversation again and again while it grows. A turn's key is a hash of
its role and text; a conversation's key up to a turn is the sum of hashes of (position,
key) of the turns so far, so the keys of all its prefixes come from one running sum, and
the key of the whole from an aggregate that folds before the shuffle. A conversation
whose whole key is some longer one's prefix key of the same length is dropped by an
anti-join; of equal conversations the one with the smallest id stays. Two sums of
different hashes are kept, which makes keys of 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Text before a turn, by role, and after it.
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (position from 1), role, text; equal rows once, in the order of turns."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return rows.withColumn("at", F.row_number().over(order))


def _sum(value, window=None):
    # Sums of 38-digit decimals cannot overflow for fewer than 10^19 turns.
    s = F.sum(value.cast("decimal(20,0)"))
    return s.over(window) if window is not None else s


def prefix_keys(turns: DataFrame) -> DataFrame:
    """conv_id, at, and the key (k1, k2) of the conversation up to and with that turn."""
    h1 = F.xxhash64("at", "role", "text")
    h2 = F.conv(F.substring(F.md5(F.concat_ws("\x1f", "at", "role", "text")), 1, 15), 16, 10)
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        turns.select("conv_id", "at", h1.alias("h1"), h2.alias("h2"))
        .withColumn("k1", _sum(F.col("h1"), so_far))
        .withColumn("k2", _sum(F.col("h2"), so_far))
        .select("conv_id", "at", "k1", "k2")
    )


def maximal(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns, and the ids of conversations that no other one begins with."""
    turns = materialize(_turns(conversations), "turns")
    keys = materialize(prefix_keys(turns), "turn-prefixes")
    length = keys.groupBy("conv_id").agg(F.max("at").alias("n"))
    whole = keys.join(length, "conv_id").filter("at = n")
    # Equal conversations first: one id for each key, with a null id only if there is no other.
    one = whole.groupBy("n", "k1", "k2").agg(F.min("conv_id").alias("conv_id"))
    inside = (
        keys.join(length, "conv_id").filter("at < n").select(F.col("at").alias("n"), "k1", "k2").distinct()
    )
    return turns, one.join(inside, ["n", "k1", "k2"], "left_anti").select("conv_id")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, chat.

    Turns are taken in the order of ``turn`` (null last), ties by role and text; equal
    rows count once; null role and text count as empty. Rows with a null conv_id form no
    conversation. Empty tables give no rows; other columns are ignored.
    """
    turns, kept = maximal(conversations.filter("conv_id IS NOT NULL"))
    rendered = F.concat(F.lit(OPEN.split("{}")[0]), "role", F.lit(OPEN.split("{}")[1]), "text", F.lit("\n" + CLOSE))
    return (
        turns.join(kept, "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", rendered.alias("t")))).alias("ts"))
        .select("conv_id", "n_turns", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("chat"))
    )
