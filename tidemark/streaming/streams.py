"""Structured Streaming: file streams, windows with late data, stall alarms, sinks per batch."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(path)


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str, value: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; later rows than ``late`` are left out."""
    more = [F.sum(value).alias("total")] if value else []
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), *more).select(
        F.col("window.start").alias("window_start"), *keys, "n", *([F.col("total")] if value else [])
    )


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work through all that is there, a batch at a time, and stop; a rerun goes on from there."""
    q: StreamingQuery = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the latest row of each key in a versioned table.

    Version n is written whole from version n - 1, so a batch that runs again gives the
    same version.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c not in keys]
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}").unionByName(batch)
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
        latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{number}")

    return sink


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own; a batch that runs again replaces it."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def sessions(events: DataFrame, at: str, keys: list[str], gap: str, late: str, value: str | None = None) -> DataFrame:
    """Counts and sums of runs of events with less than ``gap`` between neighbours; later rows than ``late`` are left out."""
    more = [F.sum(value).alias("total")] if value else []
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"), *more).select(
        F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n", *([F.col("total")] if value else [])
    )


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, before: str, late: str) -> DataFrame:
    """Rows of two streams with equal keys where the right one lies at most ``before`` before the left one.

    Both sides have watermarks and the join a bound on time, so that state is dropped once
    no row can meet it any more. Other columns must have different names.
    """
    l, r = left.withWatermark(left_at, late), right.withWatermark(right_at, late)  # noqa: E741
    same = None
    for k in keys:
        one = l[k] == r[k]
        same = one if same is None else same & one
    near = (r[right_at] <= l[left_at]) & (r[right_at] >= l[left_at] - F.expr(f"INTERVAL {before}"))
    out = l.join(r, near if same is None else same & near)
    for k in keys:
        out = out.drop(r[k])
    return out


def stall_alarms(updates: DataFrame, key: str, after: str = "120 seconds") -> DataFrame:
    """A row whenever a run's state changes: key, state, n_updates.

    A run is ``running`` from its first update, ``stalled`` once it has had none for a while
    and ``resumed`` with the next one. Processing-time timers per key; state is a count and
    a flag.
    """
    ms = pd.Timedelta(after).value // 1_000_000
    kind = dict(updates.dtypes)[key]

    def watch(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, stalled = state.get if state.exists else (0, False)
        row = lambda what: pd.DataFrame({key: [k[0]], "state": [what], "n_updates": [n]})
        if state.hasTimedOut:
            state.update((n, True))
            yield row("stalled")
            return
        first = n == 0
        n += sum(len(b) for b in batches)
        state.update((n, False))
        state.setTimeoutDuration(int(ms))
        if first or stalled:
            yield row("running" if first else "resumed")

    return updates.groupBy(key).applyInPandasWithState(
        watch, f"{key} {kind}, state string, n_updates long", "n long, stalled boolean", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


class Monitor:
    """A live query over runs' updates: state changes go to a table as they happen.

    ``every`` is how often it looks; timers of silent runs fire between updates too. The
    table is a folder a batch, so a batch that runs again replaces its own rows. After a
    restart with the same ``checkpoint`` it goes on with the states that it had.
    """

    def __init__(self, updates: DataFrame, key: str, table: str, checkpoint: str, after: str = "120 seconds", every: str = "2 seconds"):
        self.spark, self.table = updates.sparkSession, table
        changes = stall_alarms(updates, key, after).withColumn("at", F.current_timestamp())
        self.schema = changes.schema

        def sink(batch: DataFrame, number: int) -> None:
            batch.coalesce(1).write.mode("overwrite").parquet(f"{table}/batch={number}")

        self.query = changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def changes(self) -> DataFrame:
        """All state changes so far, with the batch that saw them."""
        schema = StructType([*self.schema.fields, StructField("batch", IntegerType())])
        return self.spark.read.schema(schema).option("basePath", self.table).parquet(f"{self.table}/batch=*")

    def now(self, key: str) -> DataFrame:
        """The last state of each run."""
        return self.changes().groupBy(key).agg(F.max_by(F.struct("state", "n_updates", "at"), "batch").alias("_s")).select(key, "_s.*")

    def stop(self) -> None:
        self.query.stop()


class ProgressLog(StreamingQueryListener):
    """Keeps the last lines of queries' progress: name, batch, rows, milliseconds; and how they ended."""

    def __init__(self, most: int = 1000):
        self.lines: deque = deque(maxlen=most)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.lines.append((p.name or str(p.id), p.batchId, p.numInputRows, p.batchDuration))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def poll(refresh: Callable[[], bool], until: Callable[[], bool], busy_s: float = 2.0, idle_s: float = 6.0, wait: Callable[[float], None] = time.sleep) -> list[float]:
    """Call ``refresh`` again and again until ``until`` holds: soon while it says that work is under way, else later.

    Returns the waits. ``refresh`` is a step like run_available(), which goes on where the
    last one ended; an error in it ends the loop.
    """
    waits = []
    while not until():
        waits.append(busy_s if refresh() else idle_s)
        wait(waits[-1])
    return waits
