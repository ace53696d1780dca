"""Incremental selection and upserts, as batch steps that streams call for each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(sources: DataFrame, registry: DataFrame, key: str = "source_fingerprint", force: bool = False, retry_failed: bool = True) -> DataFrame:
    """Sources with reason and selected: ready ones are skipped, failed ones retried or deferred."""
    known = registry.groupBy(F.col(key).alias("_k")).agg(F.max_by("status", F.struct("status")).alias("_s"), F.bool_or(F.col("status") == "ready").alias("_ready"))
    out = sources.join(known, F.col(key) == F.col("_k"), "left")
    ready = F.coalesce("_ready", F.lit(False))
    reason = (
        F.when(ready & F.lit(not force), "already_ready")
        .when(F.col("_s") == "failed", "retry_failed" if force or retry_failed else "existing_failed_deferred")
        .when(F.col("_k").isNull(), "new_source")
        .otherwise(F.concat(F.lit("registry_status_"), F.coalesce("_s", F.lit("unknown"))))
    )
    return out.withColumn("reason", reason).withColumn("selected", ~F.col("reason").isin("already_ready", "existing_failed_deferred")).drop("_k", "_s", "_ready")


def upsert(registry: DataFrame, changed: DataFrame, now: Column, key: str = "source_fingerprint") -> DataFrame:
    """The registry after a run over ``changed`` (key, filename, bytes, source_path, status, run, error_code, error_message).

    Paths are added to the history once, a success clears an error, other rows stay.
    """
    c = changed.groupBy(F.col(key).alias("_k")).agg(
        *[F.max_by(x, "source_path").alias(f"_{x}") for x in ("filename", "bytes", "status", "run", "error_code", "error_message")],
        F.array_sort(F.collect_set("source_path")).alias("_paths"),
    )
    j = registry.join(c, F.col(key) == F.col("_k"), "full")
    hit = F.col("_k").isNotNull()
    new = lambda n: F.when(hit, F.col(f"_{n}")).otherwise(F.col(n)).alias(n)
    none = F.array().cast("array<string>")
    return j.select(
        F.coalesce(key, "_k").alias(key), new("filename"), new("bytes"), new("status"),
        F.array_union(F.coalesce("source_path_history", none), F.coalesce("_paths", none)).alias("source_path_history"),
        F.when(hit, F.coalesce("_run", "latest_run")).otherwise(F.col("latest_run")).alias("latest_run"), F.coalesce("first_run", "_run").alias("first_run"),
        F.coalesce("created_at", now).alias("created_at"), F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        new("error_code"), new("error_message"),
    )


def retry_merge(rows: DataFrame, retried: DataFrame, key: str) -> DataFrame:
    """Rows with those that were done again in place of the old ones."""
    return rows.join(retried.select(key).distinct(), key, "left_anti").unionByName(retried, allowMissingColumns=True)


def changed_stages(old: DataFrame, new: DataFrame, order: dict[str, int], task: str = "task_id") -> DataFrame:
    """Stages to run again: all from the earliest whose input hash changed (or is new) on."""
    rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    o = old.select(task, "stage", F.col("input_hash").alias("_o"))
    j = new.join(o, [task, "stage"], "left").withColumn("_rank", F.element_at(rank, F.col("stage")))
    first = j.filter(F.col("_o").isNull() | (F.col("_o") != F.col("input_hash"))).groupBy(task).agg(F.min("_rank").alias("_first"))
    return j.join(first, task).filter(F.col("_rank") >= F.col("_first")).select(task, "stage", F.when(F.col("_rank") == F.col("_first"), "changed").otherwise("stale").alias("state"))


def expired(resources: DataFrame, now: Column) -> DataFrame:
    return resources.withColumn("state", F.when(F.col("expires_at") <= now, "expired").otherwise(F.col("state")))


def heartbeat(updates: DataFrame, key: str, at: str, now: Column, after_s: float = 120) -> DataFrame:
    """Each run's last update and whether it is stalled."""
    last = updates.groupBy(key).agg(F.max(at).alias("last_update"), F.count("*").alias("n_updates"))
    return last.withColumn("stalled", now.cast("double") - F.col("last_update").cast("double") > after_s)
