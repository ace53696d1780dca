"""Aggregates over records, all with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SEVERITY


def mean_vectors(df: DataFrame, keys: list[str], vector: str = "embedding", size: int | None = None) -> DataFrame:
    """Element-wise mean per key: keys, n_vectors, mean. With ``size`` other lengths don't count."""
    if size is not None:
        df = df.filter(F.size(vector) == size)
    per = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(
        F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n")
    )
    out = per.groupBy(*keys).agg(F.max("_n").alias("n_vectors"), F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return out.select(*keys, "n_vectors", F.transform("_v", lambda x: x["_m"]).alias("mean"))


def count_map(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts by value as a map, with distinct and repeated values: keys, counts, n_distinct, repeated."""
    per = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).alias("k"), F.col("_n").alias("v"))))
    return per.groupBy(*keys).agg(pairs.alias("_p"), F.count("*").alias("n_distinct")).select(
        *keys, F.map_from_entries("_p").alias("counts"), "n_distinct",
        F.transform(F.filter("_p", lambda x: x["v"] > 1), lambda x: x["k"]).alias("repeated"),
    )


def document_frequency(df: DataFrame, terms: Column, most: int | None = 30) -> DataFrame:
    """In how many rows each term is, most frequent first, ties by term; ``most`` of them without shuffling all."""
    if most:
        from .terms import frequent_terms

        return frequent_terms(df, terms, most)
    out = df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return out


def tally(df: DataFrame, keys: list[str], status: str, classes: list[str], default: str) -> DataFrame:
    """A count for each status class; what is in none goes to the default."""
    s = F.when(F.col(status).isin(*classes), F.col(status)).otherwise(F.lit(default))
    counts = [F.count_if(s == c).alias(f"n_{c}") for c in dict.fromkeys([*classes, default])]
    return df.groupBy(*keys).agg(*counts, F.count("*").alias("n_total"))


def message_frequency(df: DataFrame, message: str, order: str) -> DataFrame:
    """Messages by count, most frequent first, ties by first seen."""
    return df.groupBy(message).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def severity(status: Column) -> Column:
    """The rank of a status; an unknown one is a warning."""
    m = F.create_map(*[x for i, s in enumerate(SEVERITY) for x in (F.lit(s), F.lit(i))])
    return F.coalesce(F.try_element_at(m, status), F.lit(SEVERITY.index("warning")))


def worst(status: Column) -> Column:
    """Aggregate: the severest status; a group without any is a warning."""
    return F.coalesce(F.max_by(status, severity(status)), F.lit("warning"))


def final_status(status: Column, failed=("failed",), review=("review", "manual_review", "warning"), open_=("queued", "running", "pending")) -> Column:
    """Aggregate: failed before review before open before done."""
    has = lambda xs: F.coalesce(F.bool_or(status.isin(*xs)), F.lit(False))
    return F.when(has(failed), "failed").when(has(review), "review").when(has(open_), "running").otherwise("done")


def completeness(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows, and rows with a value, for each column."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in columns])


def channel_success(df: DataFrame, channels: str, status: str = "status") -> DataFrame:
    """Totals over a map of channel structs: channel, n_ok, n_failed."""
    return df.select(F.explode(channels).alias("channel", "_s")).groupBy("channel").agg(
        F.count_if(F.col(f"_s.{status}") == "ok").alias("n_ok"), F.count_if(F.col(f"_s.{status}") != "ok").alias("n_failed")
    )


def ordered_text(df: DataFrame, keys: list[str], text: str, order: list[str], separator: str = " ") -> DataFrame:
    """Non-empty texts of a group joined in order."""
    rows = F.array_sort(F.collect_list(F.when(F.col(text) != "", F.struct(*order, F.col(text).alias("_t")))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["_t"]), separator).alias(text))


def sorted_set(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Distinct elements of lists, sorted; folded before they are gathered."""
    each = df.select(*keys, F.explode(values).alias("_v")).distinct()
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias(values))


def first_seen_groups(df: DataFrame, label: str, item: str, order: str, default: str) -> DataFrame:
    """Items by label in order of first sight: label, items, first_seen."""
    lab = F.coalesce(F.when(F.col(label) != "", F.col(label)), F.lit(default))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"))))
    return df.groupBy(lab.alias(label)).agg(rows.alias("_r"), F.min(order).alias("first_seen")).select(
        label, F.array_distinct(F.transform("_r", lambda x: x["i"])).alias("items"), "first_seen"
    )


def bucket_counts(df: DataFrame, bucket: str, buckets: list[str]) -> DataFrame:
    """One row with a count for each bucket."""
    return df.agg(*[F.count_if(F.col(bucket) == b).alias(f"n_{b}") for b in buckets])
