"""Exact deduplication by a content sort, in DataFrame operations only.

Normalised texts are dealt to range partitions by sampled splitters over their first
bytes, a hash of the rest and a salt, sorted there by all their bytes, on disk if need
be, and equal neighbours, compared in full, fold into one summary row each. Splitters
have a fixed width, so what the sample sends to the driver does not grow with the texts.
The salt, a hash of the id, lets a splitter fall inside a large group of copies, so that
such a group is spread over partitions; its partial summaries (at most SALTS) meet again
by the SHA-256 of the text. Each part then gets its group's verdict, and rows find it by
text and salt, so that no task holds all copies of a text. Only summaries and fixed-width
rows are shuffled after the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SALTS, materialize, squeezed

#: Characters of a text that splitters see; texts that agree in them are told apart by their hash.
HEAD = 32


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """Smallest for the row that stays: most code points, then smallest id, null ids last."""
    return F.struct((-n_chars).alias("neg_chars"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"))


def _salt() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("short").alias("salt")


def content_runs(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text and salt: text_sha256, salt, best (rank struct), n."""
    rows = docs.select(
        squeezed(F.col("text")).alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "doc_id", _salt()
    )
    rows = rows.withColumns({"head": F.substring("norm", 1, HEAD), "rest": F.xxhash64("norm")})
    runs = (
        rows.repartitionByRange("head", "rest", "salt")
        .sortWithinPartitions("head", "norm", "rest", "salt")
        .groupBy("head", "norm", "rest", "salt")
        .agg(F.min(_rank(F.col("n_chars"), F.col("doc_id"))).alias("best"), F.count("*").alias("n"))
    )
    return runs.select(F.sha2("norm", 256).alias("text_sha256"), "salt", "best", "n")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and texts of white space only are equal to it. Of equal
    texts the row with the most code points stays, then the smallest doc_id; a null
    doc_id loses to any other. Of repeated rows (same id, same text) exactly one is
    marked as kept. Empty tables give no rows; other columns are ignored.
    """
    runs = materialize(content_runs(docs), "exact-runs")
    whole = runs.groupBy("text_sha256").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    groups = runs.select("text_sha256", "salt").join(whole, "text_sha256")
    members = (
        docs.select(
            "doc_id",
            F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
            F.sha2(squeezed(F.col("text")), 256).alias("text_sha256"),
            _salt(),
        )
        .groupBy("doc_id", "n_chars", "text_sha256", "salt")
        .agg(F.count("*").alias("times"))
    )
    mine = _rank(F.col("n_chars"), F.col("doc_id"))
    return (
        members.join(groups, ["text_sha256", "salt"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            "group_size",
            (mine.eqNullSafe(F.col("best")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns, each once.

    The verdicts are decided on ids and hashes; the texts are then moved once, by id.
    """
    kept = materialize(
        exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha")), "exact-kept"
    )
    cols = docs.columns
    out = docs.join(
        kept,
        docs["doc_id"].eqNullSafe(kept["k_id"]) & (F.sha2(squeezed(docs["text"]), 256) == kept["k_sha"]),
        "left_semi",
    )
    if not repeats_ids(docs):
        return out
    # Repeated ids: rows of one id and one normalised text fold into the one that stays.
    key = F.sha2(squeezed(F.col("text")), 256)
    whole = F.struct(F.struct((-F.char_length(F.coalesce("text", F.lit("")))).alias("n")), F.struct(*[F.col(c) for c in cols]))
    held = out.groupBy(F.col("doc_id"), key).agg(F.min(whole).alias("row"))
    return held.select(F.col("row.col2.*"))


def repeats_ids(docs: DataFrame) -> bool:
    """Whether any doc_id stands on two rows."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
