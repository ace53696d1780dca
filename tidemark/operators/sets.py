"""Unions with lineage, first-wins merges, differences of terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_runs(runs: list[tuple[str, DataFrame]], key: str, keep_all: bool = False) -> DataFrame:
    """Rows of several runs with run and run_key; the first run that has a key wins unless all are kept."""
    parts = [df.withColumn("run", F.lit(name)).withColumn("_r", F.lit(i)) for i, (name, df) in enumerate(runs)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = out.withColumn("run_key", F.concat_ws(":", "run", F.col(key).cast("string")))
    if keep_all:
        return out.drop("_r")
    w = Window.partitionBy(key).orderBy("_r")
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_r")


def first_key_wins(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union in which the first frame's row of a key stays; blank keys are left out."""
    parts = [df.withColumn("_r", F.lit(i)) for i, df in enumerate(frames)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).filter(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    w = Window.partitionBy(key).orderBy("_r", order)
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_r")


def intersects(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def lacking(terms: Column, hits: Column, aliases: Column | None = None) -> Column:
    """Terms that are no hit, nor is one of their aliases."""
    if aliases is None:
        return F.array_except(terms, hits)
    none = F.array().cast("array<string>")
    return F.filter(
        terms, lambda t: ~F.array_contains(hits, t) & ~intersects(F.coalesce(F.try_element_at(aliases, t), none), hits)
    )


def hide_jobs_with_runs(rows: DataFrame) -> DataFrame:
    """Job rows go where a real run has the same job id or folder; rows have is_job, job_id, job_dir."""
    real = rows.filter(~F.col("is_job"))
    jobs = rows.filter("is_job")
    for c in ("job_id", "job_dir"):
        jobs = jobs.join(real.filter(F.col(c) != "").select(c).distinct(), c, "left_anti")
    return real.unionByName(jobs)
