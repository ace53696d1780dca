"""Views of running work: latest runs, stages, tallies, what needs attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import tally

STAGES = ("copy", "tts", "retrieve", "subtitle", "render", "qa")
RUNNING = ("running", "queued", "pending")
ATTENTION = ("failed", "stalled", "review")


def latest(rows: DataFrame, keys: list[str], at: str, tie: str, n: int = 1) -> DataFrame:
    """The n latest rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def stage_list(stages: Column, order: tuple[str, ...] = STAGES) -> Column:
    """A map of stage statuses as an array in the fixed order, pending where missing."""
    return F.transform(F.array(*[F.lit(s) for s in order]), lambda s: F.struct(s.alias("stage"), F.coalesce(F.try_element_at(stages, s), F.lit("pending")).alias("status")))


def current_stage(stages: Column, order: tuple[str, ...] = STAGES) -> Column:
    """The running stage, else the first that is pending or stale."""
    listed = stage_list(stages, order)
    pick = lambda *st: F.get(F.filter(listed, lambda x: x["status"].isin(*st)), 0)["stage"]
    return F.coalesce(pick("running"), pick("pending", "stale"))


def failed_stage(stages: Column, order: tuple[str, ...] = STAGES) -> Column:
    return F.get(F.filter(stage_list(stages, order), lambda x: x["status"] == "failed"), 0)["stage"]


def occurrence_key(*columns: str) -> Column:
    """A text that names one occurrence of a task's state."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def task_center(tasks: DataFrame, intakes: DataFrame, acks: DataFrame, most: int = 8) -> DataFrame:
    """Work of both kinds as one list: kind, id, status, updated_at, place (running, attention or recent).

    Acknowledged occurrences go; the newest ``most`` finished ones stay.
    """
    rows = tasks.select(F.lit("task").alias("kind"), "id", "status", "updated_at").unionByName(
        intakes.select(F.lit("intake").alias("kind"), "id", "status", "updated_at")
    )
    rows = rows.withColumn("key", occurrence_key("kind", "id", "status", "updated_at")).join(acks.select("key").distinct(), "key", "left_anti")
    place = F.when(F.col("status").isin(*RUNNING), "running").when(F.col("status").isin(*ATTENTION), "attention").otherwise("recent")
    rows = rows.withColumn("place", place)
    open_, done = rows.filter("place <> 'recent'"), rows.filter("place = 'recent'")
    return open_.unionByName(done.orderBy(F.desc("updated_at"), "id").limit(most)).drop("key")


def center_summary(center: DataFrame) -> DataFrame:
    return tally(center, ["kind"], "place", ["running", "attention", "recent"], "recent")


def batches(batch: DataFrame, tasks: DataFrame, key: str = "batch_id") -> DataFrame:
    """Batches with a count for each status of their tasks."""
    counts = tally(tasks, [key], "status", ["queued", "running", "done", "failed", "review"], "queued")
    return batch.join(counts, key, "left")


def products(dirs: DataFrame, runs: DataFrame) -> DataFrame:
    """Products from folders and from runs, by slug, with the latest ready run (a merged one first)."""
    best = runs.filter("ready").groupBy(F.col("slug").alias("_s")).agg(F.max_by("run", F.struct("merged", "updated_at", "run")).alias("latest_run"))
    busy = runs.groupBy(F.col("slug").alias("_t")).agg(F.bool_or(F.col("status") == "running").alias("_busy"), F.bool_or(F.col("status") == "failed").alias("_bad"))
    out = dirs.join(busy, F.col("slug") == F.col("_t"), "full").withColumn("slug", F.coalesce("slug", "_t")).join(best, F.col("slug") == F.col("_s"), "left")
    status = F.when(F.col("latest_run").isNotNull(), "ready").when(F.col("_busy"), "running").when(F.col("_bad"), "failed").otherwise("empty")
    return out.withColumn("status", status).select("slug", F.coalesce("name", "slug").alias("name"), "latest_run", "status")


def upsert_one(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return rows.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
