"""What a corpus of records can show: exact heavy hitters, counts of a lexicon, lists of both.

The most frequent of very many terms are found without shuffling them all. Each task keeps
at most a fixed number of terms; what it drops lowers all its counts by the same amount,
which it reports. Summed over tasks, a term's count is too low by at most the sum of
these amounts, so that few terms can be among the best. Only those are counted again,
in full. Where no task dropped anything the first counts are exact already.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .dedupe import _ensure_checkpoint_dir

#: Terms that a task keeps.
KEPT = 1 << 18
#: Candidates that every task gets; where there are more, the join is left to Spark.
SENT = 1 << 16


def _counts(df: DataFrame, terms: Column, kept: int) -> DataFrame:
    """term, n, and one row a task with a null term and the amount by which its counts may be too low."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        short = 0
        for b in batches:
            flat = b.column(0).flatten().drop_null().value_counts()
            found.update(dict(zip(flat.field("values").to_pylist(), flat.field("counts").to_pylist(), strict=True)))
            if len(found) > 2 * kept:
                # All counts go down by that of the first term that is not kept.
                least = sorted(found.values(), reverse=True)[kept]
                found = Counter({t: n - least for t, n in found.items() if n > least})
                short += least
        if short or found:
            yield pa.record_batch([pa.array([*found, None], pa.string()), pa.array([*found.values(), short], pa.int64())], names=["term", "n"])

    return df.select(F.array_distinct(terms).alias("terms")).mapInArrow(work, "term string, n long")


def frequent_terms(df: DataFrame, terms: Column, most: int, kept: int = KEPT) -> DataFrame:
    """term, df: in how many rows each of the ``most`` most frequent terms is, ties by term; exact.

    ``terms`` is an array of texts; null counts as empty, null elements don't count, and a
    term counts once a row. ``kept`` bounds a task's memory, never what comes out: where
    the best can't be told apart by what was kept, twice as much is.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    while True:
        part = _counts(df, terms, kept).checkpoint()  # at most ``kept`` rows a task, read several times
        totals = part.groupBy("term").agg(F.sum("n").alias("df"))
        # One row: what all tasks together may have missed, and the least that the last of the best has for sure.
        best = totals.filter("term IS NOT NULL").orderBy(F.desc("df"), "term").limit(most)
        missed = part.filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m")).first()["m"]
        if not missed:
            return best
        floor, n = best.agg(F.min("df"), F.count("*")).first()
        if n == most and floor > missed:
            may = totals.filter(F.col("term").isNotNull() & (F.col("df") + missed >= floor)).select("term").checkpoint()
            # Beside the few candidates no task has to shuffle, or hold, what its records' terms are.
            may = F.broadcast(may) if may.count() <= SENT else may
            rows = df.select(F.explode(F.array_distinct(terms)).alias("term"))
            again = rows.join(may, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
            return again.orderBy(F.desc("df"), "term").limit(most)
        kept *= 2


def lexicon_counts(df: DataFrame, text: Column, lexicon: list[str]) -> DataFrame:
    """term, place (in the lexicon, from 0), n: how many rows' texts hold each term; zeros too.

    One aggregate over one pass: a task sends one row, however many records it reads.
    """
    words = list(dict.fromkeys(lexicon))
    if not words:
        return df.sparkSession.createDataFrame([], "term string, place int, n long")
    t = F.coalesce(text, F.lit(""))
    one = df.agg(*[F.count_if(F.contains(t, F.lit(w))).alias(f"c{i}") for i, w in enumerate(words)])
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.lit(i).alias("place"), F.col(f"c{i}").alias("n")) for i, w in enumerate(words)]))
    return one.select(rows.alias("r")).select("r.*")


def capabilities(
    records: DataFrame, text: Column, points: Column, kind: Column, lexicon: list[str] = list(K.SIGNAL_WORDS), problems: tuple = K.PROBLEM_WORDS, openings: tuple = K.OPENING_WORDS,
    strong: int = K.STRONG_COUNT, evidence: int = K.EVIDENCE_COUNT,
) -> DataFrame:
    """What records can show, as rows (list, place from 1, term, n).

    ``available``, ``strong`` and ``evidence`` are lexicon terms that any, ``strong`` or
    ``evidence`` records' texts hold, most frequent first; ``missing`` those that none
    holds, in the lexicon's order. ``weak_problem`` are problem words that are not strong,
    ``safe_opening`` opening words that are, both in their own order. ``points`` (an array)
    and ``kinds`` (one value) are those observed, trimmed, blank ones left out.
    """
    words = list(dict.fromkeys([*lexicon]))
    found = lexicon_counts(records, text, words)
    out = []

    def listed(rows: DataFrame, name: str, order: list[Column], most: int) -> None:
        best = rows.orderBy(*order).limit(most).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "term", "n"))).alias("x"))
        out.append(best.select(F.lit(name).alias("list"), F.posexplode("x").alias("p", "r")).select("list", (F.col("p") + 1).alias("place"), "r.term", "r.n"))

    by_count, by_place = [-F.col("n"), F.col("term")], [F.col("place")]
    listed(found.filter("n > 0"), "available", by_count, K.MOST_TERMS)
    listed(found.filter("n = 0"), "missing", by_place, K.MOST_TERMS)
    listed(found.filter(F.col("n") >= strong), "strong", by_count, K.MOST_TERMS)
    listed(found.filter(F.col("n") >= evidence), "evidence", by_count, K.MOST_TERMS)
    for name, ws, keep in (("weak_problem", problems, F.col("n") < strong), ("safe_opening", openings, F.col("n") >= strong)):
        own = F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.lit(i).alias("place")) for i, w in enumerate(ws)]))
        of = records.sparkSession.range(1).select(own.alias("w")).select("w.*").join(found.select("term", "n"), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        listed(of.filter(keep), name, by_place, len(ws))
    blank = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    for name, terms, most in (("points", blank(points), K.MOST_POINTS), ("kinds", blank(F.array(kind)), K.MOST_TYPES)):
        listed(_observed(records, terms, most), name, by_count, most)
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def _observed(records: DataFrame, terms: Column, most: int) -> DataFrame:
    """The most frequent values, repeated ones of a record counted as often as they stand."""
    return records.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(most)


def examples(records: DataFrame, order: str, texts: dict[str, int], lists: dict[str, int], most: int = K.MOST_EXAMPLES) -> DataFrame:
    """The first records by ``order``, with texts cut to a length and lists to a number of elements."""
    first = records.orderBy(order).limit(most)
    return first.select(order, *[F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c) for c, n in texts.items()], *[F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n).alias(c) for c, n in lists.items()])
