"""Joins of records: lookups, nesting, fallbacks, missing and known keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.themes import contract_verdict


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: what a lookup keeps of repeated keys."""
    cols = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*cols), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, where first-wins unions are wanted."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def lookup(df: DataFrame, dim: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left join with the last row of each key; misses give nulls. Spark picks the strategy by size."""
    return df.join(last_by_key(dim, keys, order).drop(order), keys, "left")


def nest_children(children: DataFrame, parent: str, order: list[str], name: str = "children") -> DataFrame:
    """One row per parent with its children as a sorted array of structs."""
    rest = [c for c in children.columns if c != parent and c not in order]
    return children.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def with_children(df: DataFrame, children: DataFrame, key: str, child_key: str, ids: str, child_id: str, order: list[str]) -> DataFrame:
    """Children by an explicit list of ids if any of them resolves (in the list's order), else by parent key."""
    cols = children.columns
    # A null key meets none: its children, all of them perhaps, are not gathered.
    by_key = nest_children(children.filter(F.col(child_key).isNotNull()), child_key, order, "_by_key").withColumnRenamed(child_key, "_key")
    listed = (
        df.select(key, F.posexplode(ids).alias("_pos", "_cid"))
        .join(children, F.col("_cid") == children[child_id])
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.struct(*order, *[c for c in cols if c not in order and c != child_key]).alias("c")))).alias("_l"))
        .select(key, F.transform("_l", lambda x: x["c"]).alias("_by_id"))
    )
    return (
        df.join(listed, key, "left")
        .join(by_key, df[key] == F.col("_key"), "left")
        .withColumn("children", F.coalesce("_by_id", "_by_key"))
        .drop("_by_id", "_by_key", "_key")
    )


def known_lists(df: DataFrame, key: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """Lists of ids that resolve as a whole: key, all_known."""
    return (
        df.select(key, F.explode_outer(ids).alias("_id"))
        .join(known.select(F.col(known_id).alias("_k")).distinct(), F.col("_id") == F.col("_k"), "left")
        .groupBy(key)
        .agg(F.coalesce(F.bool_and(F.col("_k").isNotNull()), F.lit(False)).alias("all_known"))
    )


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(present, keys, "left_anti")


def unacknowledged(df: DataFrame, key: str, aliases: str, acks: DataFrame, ack: str) -> DataFrame:
    """Rows none of whose alias keys is acknowledged."""
    hit = df.select(key, F.explode(aliases).alias("_a")).join(acks.select(F.col(ack).alias("_a")).distinct(), "_a", "left_semi").select(key).distinct()
    return df.join(hit, key, "left_anti")


def required_lookup(df: DataFrame, dim: DataFrame, key: str, message: str) -> DataFrame:
    """A join that raises for a key without a match."""
    out = df.join(dim.withColumn("_found", F.lit(True)), key, "left")
    check = F.assert_true(F.coalesce("_found", F.lit(False)), F.concat(F.lit(f"{message}: "), F.col(key).cast("string")))
    return out.withColumn("_ok", check).filter(F.col("_ok").isNull()).drop("_found", "_ok")


def any_key_match(left: DataFrame, right: DataFrame, left_id: str, name: str, prefix: str, right_name: str, right_order: str) -> DataFrame:
    """The first right row whose name equals the left's or holds its prefix: a fuzzy file join.

    Equal names are an equi-join. The rest is found through the runs of letters and digits
    in the names, which makes it an equi-join too; prefixes are such runs.
    """
    r = right.select(F.col(right_order).alias("_ord"), F.col(right_name).alias("_name"))
    exact = left.select(left_id, name).join(r, F.col(name) == F.col("_name")).select(left_id, "_ord")
    tokens = r.select("_ord", F.explode(F.array_distinct(F.split("_name", r"[^0-9A-Za-z]+"))).alias("_t")).filter("_t <> ''")
    held = left.select(left_id, F.col(prefix).alias("_p")).join(tokens, F.col("_p") == F.substring("_t", 1, 10)).select(left_id, "_ord")
    return exact.unionByName(held).groupBy(left_id).agg(F.min("_ord").alias(right_order))


def full_status(left: DataFrame, right: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Full outer join with a rolled-up status: both sides may have one; precedence decides."""
    l = left.select(key, F.col(status).alias("_l"))  # noqa: E741
    r = right.select(F.col(key).alias("_k"), F.col(status).alias("_r"))
    out = l.join(r, F.col(key) == F.col("_k"), "full")
    return out.select(F.coalesce(key, "_k").alias(key), F.coalesce("_l", "_r").alias(status), F.col("_l").isNotNull().alias("in_left"), F.col("_r").isNotNull().alias("in_right"))


def merge_rows(df: DataFrame, key: str, order: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """Rows of one key as one: lists joined in order, the first value of each scalar."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *lists)))
    agg = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    out = df.groupBy(key).agg(rows.alias("_rows"), *agg)
    for c in lists:
        each = lambda x: F.coalesce(x[c], F.array().cast(df.schema[c].dataType))  # noqa: B023, E731  used at once
        out = out.withColumn(c, F.flatten(F.transform("_rows", each)))
    return out.drop("_rows")


def verdicts(pairs: DataFrame, contracts: DataFrame, key: str, text: str, contract: str) -> DataFrame:
    """Each pair with ``verdict``, its text's against its section's contract; see contract_verdict().

    A section's contract follows from a few rules, and candidates are shown to many
    sections: each text is judged once for each different contract, not for each pair.
    """
    named = contracts.select(key, F.md5(F.coalesce(F.to_json(contract), F.lit(""))).alias("_k"), contract)
    rows = pairs.withColumn("_t", F.coalesce(text, F.lit(""))).join(named.select(key, "_k"), key)
    different = named.groupBy("_k").agg(F.any_value(contract).alias("_c"))
    judged = rows.select("_k", "_t").distinct().join(different, "_k").select("_k", "_t", contract_verdict(F.col("_t"), F.col("_c")).alias("verdict"))
    return rows.join(judged, ["_k", "_t"]).drop("_k", "_t")
