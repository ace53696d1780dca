"""Quality rules with host verdicts, in DataFrame operations only.

Each text is measured by array functions inside its own row. Rule failures are then
counted by host (``source``), failure rates are shrunk with a beta prior fitted to all
hosts by the method of moments, and hosts whose shrunk rate passes HOST_LIMIT reject
their documents. The host table has a row per host and is joined back as Spark's own
size check decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, let, materialize, words

MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
#: A host is rejected above this shrunk failure rate.
HOST_LIMIT = 0.5


def _window_hashes(hashes: Column) -> Column:
    n = F.size(hashes)
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
    )
    return F.when(n >= WINDOW, grams).otherwise(F.array().cast("array<bigint>"))


def _covered(ws: Column) -> Column:
    """Words in windows found twice or more; windows are compared as strings."""
    n = F.size(ws)
    placed = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.struct(F.array_join(F.slice(ws, i + 1, WINDOW), " ").alias("g"), i.alias("at")),
        )
    )
    again = let(
        placed,
        lambda s: F.transform(
            F.filter(
                s,
                lambda e, k: e["g"].eqNullSafe(F.get(s, k - 1)["g"]) | e["g"].eqNullSafe(F.get(s, k + 1)["g"]),
            ),
            lambda e: e["at"],
        ),
    )
    # Each window adds the words that the next one does not cover as well.
    return let(
        F.sort_array(again),
        lambda p: F.aggregate(
            F.transform(
                p,
                lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x), F.lit(WINDOW)).cast("long"),
            ),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Null text has no words and no lines; every count is over the whole text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "source", text.alias("t"), words(F.col("text")).alias("ws"))
    base = base.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    base = base.withColumn("gs", _window_hashes(F.col("hs")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("lines", lines)
    # Windows without an equal hash are without an equal: only the rest are compared in full.
    repeated = F.size(F.array_distinct("gs")) < F.size("gs")
    return base.select(
        "doc_id",
        "source",
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", WS + "+", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _covered(F.col("ws"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def host_rates(marked: DataFrame) -> DataFrame:
    """One row per host: host_docs, host_failures, host_rate (shrunk), host_failed.

    The prior's mean is the pooled rate; its strength comes from the spread of the hosts'
    rates beyond what chance gives, held to 1 to 1,000,000 documents.
    """
    hosts = marked.groupBy("source").agg(
        F.count("*").alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failures")
    )
    pooled = hosts.agg(
        F.sum("host_docs").alias("n"),
        F.sum("host_failures").alias("k"),
        F.count("*").alias("hosts"),
        F.sum(F.col("host_failures") * F.col("host_failures") / F.col("host_docs")).alias("squares"),
    )
    m = F.col("k") / F.col("n")
    chance = m * (1 - m) * F.col("hosts") / F.col("n")
    spread = F.col("squares") / F.col("n") - m * m - chance
    strength = F.when(spread > 0, m * (1 - m) / F.when(spread > 0, spread) - 1).otherwise(F.lit(1e6))
    prior = pooled.filter("n > 0").select(m.alias("rate"), F.least(F.greatest(strength, F.lit(1.0)), F.lit(1e6)).alias("docs")).first()
    mean, weight = (prior["rate"], prior["docs"]) if prior else (0.0, 1.0)  # two numbers
    rate = (F.col("host_failures") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
    return hosts.select("source", "host_docs", "host_failures", rate.alias("host_rate")).withColumn(
        "host_failed", F.col("host_rate") > HOST_LIMIT
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its measures, base_failed, the host's rate and kept.

    A null source is a host of its own. Repeated rows are measured and returned as often
    as they stand in the input; empty tables give no rows; other columns are ignored.
    """
    m = measure(docs)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rule_failed = (
        F.col("base_failed")
        | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"))
    )
    marked = materialize(
        m.withColumn("base_failed", base_failed).withColumn("rule_failed", rule_failed), "quality"
    )
    hosts = host_rates(marked).select(F.col("source").alias("host"), "host_rate", "host_failed")
    return marked.join(hosts, marked["source"].eqNullSafe(hosts["host"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "rule_failed", "host_rate",
    )
