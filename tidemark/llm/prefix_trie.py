"""A trie of conversation prefixes, built in parts that a task can hold.

A node stands for all conversations that begin with the same turns. Conversations are
dealt by a hash of their first turn's digest, so that one task builds whole subtries:
dictionaries of pointers from (node, turn digest) to node, filled turn by turn and then
summed from the leaves up. A first turn with more rows than a task should hold is not
dealt so: the turns that all its conversations share form a chain, which aggregates
describe without gathering a row, and what follows them is split by the next turn, again
and again until every subtrie is small. Sums of the split subtries then go up the chains.

Turns are compared by SHA-256 digests; texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Sliced, positions, running_sum
from .shared import SALTS, materialize, ship, with_group

#: Rows of a subtrie beyond which it is split by its next turn, and rows that a task builds tries of at a time.
LIMIT = 1 << 12
PART = 1 << 14
#: Consecutive conversation ids whose list is one value.
BLOCK = 1 << 16

NODES = (
    "g binary, top boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends array<long>"
)
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), digest, size (bytes of the text): turns in order, null first, ties by digest.

    Null role and text are empty; rows without a conv_id belong to no conversation; equal
    rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size")
    )
    return positions(rows, ["conv_id"], ["turn", "digest"], "at").select("conv_id", F.col("at").cast("long").alias("at"), "digest", "size")


def rebuilt(of: DataFrame, block: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their block's first one: their turns, and conv_id with n_turns.

    Conversation c begins with the first h turns of c - c mod ``block`` (all if it has
    fewer, none if it isn't there) and goes on with its own turns after its first h;
    h is the CRC-32 of its decimal id modulo ``most``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = of.filter((F.pmod("conv_id", F.lit(block)) == 0) & (F.col("at") < most - 1))
    lent = first.withColumn("conv_id", F.explode(F.sequence("conv_id", F.col("conv_id") + block - 1))).filter(F.col("at") < h)
    every = lent.withColumn("own", F.lit(False)).unionByName(of.withColumn("own", F.lit(True)))
    every = materialize(every.withColumns({"n_lent": F.when(~F.col("own"), -F.col("at") - 1), "there": F.when(F.col("own"), 0), "h": h}), "trie-turns")
    stays = ~F.col("own") | (F.col("at") >= F.col("h"))
    convs = every.groupBy("conv_id").agg(F.max("own").alias("own"), F.count_if(stays).alias("n_turns")).filter("own").drop("own")
    known = with_group(every.select("conv_id", "at", "digest", "size", "own", "h", "n_lent", "there"), ["conv_id"], F.xxhash64("at", "own"), least_lent="n_lent", is_there="there")
    known = known.filter("is_there IS NOT NULL").filter(stays)
    at = F.when(F.col("own"), F.col("at") - F.col("h") - F.coalesce("least_lent", F.lit(0))).otherwise(F.col("at"))
    return known.select("conv_id", at.alias("at"), "digest", "size"), convs


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the subtries whose turns these are."""
    rows = rows.sort_values(["g", "conv_id", "at"], kind="stable")
    tops: dict[bytes, int] = {}
    child: dict[tuple[int, bytes], int] = {}
    group, parent, depth, least, n, size, up, ends = [], [], [], [], [], [], [], []
    last, node = None, -1
    for g, conv, at, digest, bytes_, end, above in zip(*[rows[c].tolist() for c in ("g", "conv_id", "at", "digest", "size", "end", "up")], strict=True):
        fresh, last = last != (g, conv), (g, conv)
        known = tops.get(g) if fresh else child.get((node, digest))
        if known is None:
            known = len(parent)
            if fresh:
                tops[g] = known
            else:
                child[node, digest] = known
            for to, value in ((group, g), (parent, -1 if fresh else node), (depth, at + 1), (least, conv), (n, 0), (size, bytes_), (up, above), (ends, [])):
                to.append(value)
        node = known
        n[node] += 1
        least[node] = min(least[node], conv)
        if end:
            ends[node].append(conv)
    children, leaves, saved = [0] * len(n), [0] * len(n), [0] * len(n)
    # Children are made after their parents, so backwards they come before them.
    for i in reversed(range(len(n))):
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * size[i]
        if (p := parent[i]) >= 0:
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            up[i] = least[p]
    return pd.DataFrame(
        {
            "g": group, "top": [p < 0 for p in parent], "depth": depth, "conv_id": least, "parent_conv_id": up, "n_convs": n,
            "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends": ends,
        }
    )


def _ends_sha(rows: DataFrame) -> DataFrame:
    """g and the hash of its ids (conv_id) in a comma-joined list: lists in blocks, hashed as they come."""
    block = F.floor(F.col("conv_id") / BLOCK)
    lists = rows.groupBy("g", block.alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            done = []
            for g, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if g != now:
                    if sha:
                        done.append((now, sha.hexdigest()))
                    now, sha = g, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.as_buffer())
            yield pa.record_batch([pa.array([g for g, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["g", "ends_sha256"])
        if sha:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], names=["g", "ends_sha256"])

    placed = lists.repartition("g").sortWithinPartitions("g", "block").select("g", "ids")
    return placed.mapInArrow(hashed, "g binary, ends_sha256 string")


def _beside(rows: DataFrame, few: DataFrame, key: str = "g") -> DataFrame:
    """Rows with the one row of their key in ``few``; large keys are split."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("conv_id", "at"), F.lit(SALTS)).cast("short"))
    salts = F.explode(F.array(*[F.lit(i).cast("short") for i in range(SALTS)]))
    return salted.join(few.withColumn("_salt", salts), [key, "_salt"]).drop("_salt")


def prefix_trie(rows: DataFrame, convs: DataFrame, limit: int = LIMIT, part: int = PART) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` has the turns (conv_id, at, digest, size), ``convs`` every conversation and its
    n_turns, turnless ones too. ``limit`` and ``part`` say how the trie is built, never
    what it is. Without conversations there is no node, not even a root.
    """
    spark = rows.sparkSession
    ship(spark)
    convs = materialize(convs, "trie-convs")
    n, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    empty = hashlib.sha256(b"").hexdigest()
    with_end = with_group(materialize(rows, "trie-rows").withColumn("first", F.when(F.col("at") == 0, F.col("digest"))).withColumn("before", -F.col("at")), ["conv_id"], F.col("at"), g="first", last="before")
    live = with_end.select("g", F.lit(0).cast("long").alias("d"), F.lit(least).cast("long").alias("up"), "conv_id", "at", "digest", "size", (F.col("at") == -F.col("last")).alias("end"))
    live = live.withColumn("parent", F.lit(b""))
    small, chains = [], []
    while True:
        sized = materialize(with_group(live.withColumn("one", F.lit(1)), ["g"], F.xxhash64("conv_id", "at"), counted="n_rows", _one="one").drop("one", "_one"), "trie-round")
        small.append(sized.filter(F.col("n_rows") <= limit).drop("n_rows"))
        large = sized.filter(F.col("n_rows") > limit).drop("n_rows")
        levels = large.groupBy("g", "at").agg(
            F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.min("size").alias("size"), F.min("conv_id").alias("conv_id"),
            F.min("d").alias("d"), F.min("up").alias("up"), F.min("parent").alias("parent"),
        )
        levels = materialize(levels, "trie-levels")
        if levels.isEmpty():
            break
        tops = levels.filter("at = d").select("g", F.col("n").alias("n_convs"), F.col("conv_id").alias("least"), "d", "up", "parent")
        split = F.min(F.when((F.col("lo") != F.col("hi")) | (F.col("n") < F.col("n_convs")), F.col("at")))
        found = levels.select("g", "at", "n", "lo", "hi").join(tops, "g").groupBy("g").agg(F.coalesce(split, F.max("at") + 1).alias("to"))
        chain = materialize(tops.join(found, "g"), "trie-chains")
        sizes = levels.select("g", "at", "size").join(chain, "g").filter("at < to")
        last = _beside(large.drop("d", "up", "parent"), chain.select("g", "to", "least")).withColumn("next", F.when(F.col("at") == F.col("to"), F.col("digest")))
        ended = last.filter("end AND at = to - 1").select("g", "conv_id")
        chains.append((chain, sizes, _ends_sha(ended)))
        # What follows a chain, by its next turn.
        on = with_group(materialize(last.filter("at >= to"), "trie-next"), ["g", "conv_id"], F.col("at"), turn="next")
        live = on.select(
            F.unhex(F.sha2(F.concat("g", "turn"), 256)).alias("g"), F.col("to").alias("d"), F.col("least").alias("up"), "conv_id", "at", "digest", "size", "end", F.col("g").alias("parent")
        )
    every = small[0]
    for s in small[1:]:
        every = every.unionByName(s)
    parts = max(1, -(-every.count() // part))
    dealt = every.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts))).select("part", "g", "conv_id", "at", "digest", "size", "end", "up")
    nodes = materialize(dealt.groupBy("part").applyInPandas(_forest, NODES), "trie-nodes")
    sha = F.sha2(F.array_join(F.sort_array("ends").cast("array<string>"), ","), 256)
    out = [nodes.withColumn("ends_sha256", sha).select(*OUT)]
    # From the last split up: what stands below each chain, then the chain itself.
    sums = [F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")]
    names = [s.select("g", "parent").distinct() for s in small]
    above = None
    for k in reversed(range(len(small))):
        tops = nodes.filter("top").join(names[k], "g").select("parent", "n_leaves", "saved_tokens")
        tops = tops if above is None else tops.unionByName(above)
        below = tops.groupBy("parent").agg(*sums)
        if not k:
            break
        chain, sizes, ended = chains[k - 1]
        rows = sizes.join(below.withColumnRenamed("parent", "g"), "g", "left").withColumns({"cost": (F.col("n_convs") - 1) * F.col("size"), "back": -F.col("at")})
        s = Sliced(rows, ["g"], ["back"])
        rows = s.done(running_sum(s, s.rows, "cost", "upto", own=True)).join(ended, "g", "left")
        end = F.col("at") == F.col("to") - 1
        kept = materialize(
            rows.select(
                "g", "parent", (F.col("at") == F.col("d")).alias("top"), F.col("least").alias("conv_id"), (F.col("at") + 1).alias("depth"),
                F.when(F.col("at") == F.col("d"), F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"), "n_convs",
                F.when(end, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
                (F.col("upto") + F.coalesce("below", F.lit(0))).cast("long").alias("saved_tokens"), F.when(end, F.coalesce("ends_sha256", F.lit(empty))).otherwise(empty).alias("ends_sha256"),
            ),
            "trie-chain-nodes",
        )
        out.append(kept.select(*OUT))
        above = kept.filter("top").select("parent", "n_leaves", "saved_tokens")
    if n:
        turnless = _ends_sha(convs.filter("n_turns = 0").select(F.lit(b"").alias("g"), "conv_id")).withColumnRenamed("g", "parent")
        root = spark.range(1).select(F.lit(b"").alias("parent")).join(below, "parent", "left").join(turnless, "parent", "left")
        out.append(
            root.select(
                F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"),
                F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
                F.coalesce("below", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
            )
        )
    all_nodes = out[0]
    for o in out[1:]:
        all_nodes = all_nodes.unionByName(o)
    return all_nodes


def conversation_trie(conversations: DataFrame, limit: int = LIMIT, part: int = PART) -> DataFrame:
    """prefix_trie() of the rebuilt conversations of a table of turns.

    The table's columns are conv_id, turn, role, text; others are ignored. Null turns come
    first, ties go by the digest of role and text, null role and text are empty, and a
    null conv_id is no conversation. An empty table gives no node.
    """
    return prefix_trie(*rebuilt(materialize(turns(conversations), "trie-order")), limit, part)
