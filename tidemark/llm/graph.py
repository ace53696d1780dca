"""Connected components of a large graph, without a driver that sees its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, with_group


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node that has an edge: node, root (the smallest node it can reach).

    Alternates large-star and small-star steps, which flatten every component to a star
    in a number of rounds logarithmic in its size. Neighbours are never gathered: a
    node's smallest neighbour is an aggregate that goes back to its edges part by part, so
    that a hub with a third of all edges is in no task as a whole. Each round is written
    to the shared folder; the driver sees counts and sums only.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "cc"
    )

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]

    seen = state(now)
    while seen[0]:
        # Large star: larger neighbours move to the smallest one around.
        both = now.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(
            now.select(F.col("v").alias("n"), F.col("u").alias("w"))
        )
        around = with_group(both, ["n"], F.col("w"), m="w")
        large = around.filter("w > n").select(F.col("w").alias("u"), F.least("n", "m").alias("v"))
        large = materialize(large.filter("u > v").distinct(), "cc")
        # Small star: smaller neighbours, and the node itself, move to the smallest one.
        small = with_group(large, ["u"], F.col("v"), m="v").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.filter("u > v").distinct(), "cc")
        discard(spark, now, large)
        now, before, seen = after, seen, state(after)
        if before == seen:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
