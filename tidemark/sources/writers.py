"""Sinks. Spark's committers make a write whole or absent; versions replace each other by name."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redacted_map


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a Markdown table, with the head on top."""
    spark = df.sparkSession
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\|")
    head = spark.createDataFrame([(0, f"| {' | '.join(columns)} |"), (1, "|" + " --- |" * len(columns))], "n long, value string")
    body = df.select((F.monotonically_increasing_id() + 2).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("value"))
    return head.unionByName(body).orderBy("n").select("value")


def append_events(df: DataFrame, path: str) -> None:
    """Log events as JSON lines, with secrets redacted."""
    df.withColumn("data", redacted_map("data")).write.mode("append").json(path)


@contextmanager
def locked(spark: SparkSession, path: str, stale_s: float = 3600):
    """Hold the lock of a place: a file that only one writer can create. One older than ``stale_s`` is broken."""
    jvm = spark._jvm.org.apache.hadoop.fs
    lock = jvm.Path(f"{path.rstrip('/')}.lock")
    fs = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(lock) and time.time() * 1000 - fs.getFileStatus(lock).getModificationTime() > stale_s * 1000:
        fs.delete(lock, False)
    try:
        fs.create(lock, False).close()
    except Py4JJavaError as e:
        raise RuntimeError(f"{path} is locked by another run") from e
    try:
        yield
    finally:
        fs.delete(lock, False)


def _pointer(spark: SparkSession, path: str) -> str | None:
    """The version that a place shows, and the run that wrote it, as "run version"."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/CURRENT")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def promote(df: DataFrame, path: str, run: int = 0) -> bool:
    """Publish a frame as a new version of a place, unless a later run has; whether it was published.

    The version is written whole first. Under the place's lock the pointer to it then
    replaces the old one by one rename, so that readers see the old or the new version at
    any time. A run with a smaller number than the one that is shown is superseded: its
    version is dropped. The version before the last stays for readers that still use it.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = lambda name: jvm.Path(f"{path.rstrip('/')}/{name}")
    fs = at(version).getFileSystem(conf)
    with locked(spark, path):
        shown = _pointer(spark, path)
        if shown and int(shown.split()[0]) > run:
            fs.delete(at(version), True)
            return False
        new = at(f"CURRENT-{version}")
        stream = fs.create(new, False)
        stream.writeUTF(f"{run} {version}")
        stream.close()
        over = spark._sc._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
        over[0] = getattr(jvm, "Options$Rename").OVERWRITE
        jvm.FileContext.getFileContext(at(version).toUri(), conf).rename(new, at("CURRENT"), over)
        keep = {version, shown.split()[1] if shown else version}
        for status in fs.listStatus(at("")):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in keep:
                fs.delete(status.getPath(), True)
    return True


def promoted(spark: SparkSession, path: str) -> DataFrame:
    """What a place shows now."""
    shown = _pointer(spark, path)
    if shown is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path.rstrip('/')}/{shown.split()[1]}")


def write_back(df: DataFrame, path: str, run: int = 0) -> DataFrame:
    """Replace a table that the frame itself reads: a new version first, then the pointer to it."""
    promote(df, path, run)
    return promoted(df.sparkSession, path)


def result_lists(tasks: DataFrame, status: str, passed: tuple[str, ...] = ("pass", "passed", "done"), review: tuple[str, ...] = ("review", "warning", "manual_review")) -> tuple[DataFrame, DataFrame]:
    return tasks.filter(F.col(status).isin(*passed)), tasks.filter(F.col(status).isin(*review))
