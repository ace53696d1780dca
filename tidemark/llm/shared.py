"""What the operators of this subpackage have in common.

Scratch data goes to the folder that the session names in ``spark.checkpoint.dir``:
on a cluster that is the one place which the driver and every executor see. Only a
session without that setting (tests on one machine) gets a temporary folder here.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts here, as a character class: space and \t \n \v \f \r.
WS = r"[\x20\x09-\x0D]"

#: Parts that a group of any size is split into.
SALTS = 64

#: Bytes of an Arrow batch in a session that goes through many steps. Spark's own limit lets 10,000 whole
#: texts into one, which both an executor's JVM and its Python worker hold for each core.
BATCH_BYTES = 4 << 20

_shipped: set[str] = set()
_kept: set[str] = set()
_steps = {"every": 0, "n": 0}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine set to a temporary one if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    """The store that a path is on, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; what is there goes when the application ends."""
    app = spark.sparkContext.applicationId
    mine = f"{shared_dir(spark)}/tidemark/{app}"
    if mine not in _kept:
        _kept.add(mine)
        fs, where = _at(spark, mine)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return f"{mine}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: written as Parquet to the shared folder and read back.

    Lost executors cost nothing that was written; the committer makes retries safe.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    _steps["n"] += 1
    if _steps["every"] and _steps["n"] % _steps["every"] == 0:
        release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(spark: SparkSession, *of: DataFrame | str) -> None:
    """Delete scratch data that no later step reads."""
    for x in of:
        path = x if isinstance(x, str) else getattr(x, "_scratch", None)
        if path:
            fs, where = _at(spark, path)
            fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps hold.

    Spark deletes their shuffle files and broadcasts only once the driver's JVM has
    collected the owners, which it may put off until its heap has grown to the limit. What
    its C library keeps of freed memory (compilers and codecs take and free some with each
    plan) goes back to the system as well, where the JVM can do that.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Let the driver's C library give freed memory back, through the JVM's management beans (JDK 17.0.9 and later, on Linux)."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    args = gateway.new_array(jvm.Object, 4)  # the bean, its operation, no values, no types
    args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    args[1] = "systemTrimNativeHeap"
    # Called through the interface: the class of the server itself is closed to other modules.
    methods = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
    invoke = next(m for m in methods if m.getName() == "invoke")
    with contextlib.suppress(Py4JJavaError):  # a JVM without that operation
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def ease(spark: SparkSession, every: int = 1) -> None:
    """release() now and after each ``every``-th step that is written from here on; 0 for no more.

    For a session that goes through many steps: between two releases its driver's heap grows
    by what the steps' plans left, up to its limit, whatever of it is still in use. Its
    executors keep the largest buffers that a step took, so Arrow batches have at most
    BATCH_BYTES (and a row) from here on.
    """
    release(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    _steps["every"], _steps["n"] = every, 0


def worker_release() -> None:
    """In a task: give back what this Python worker keeps of earlier tasks, which may have been other stages'."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def with_group(df: DataFrame, by: list[str], unit: Column, counted: str | None = None, **least: str) -> DataFrame:
    """Each row with its group's values: the minimum of a column by name, and how many rows.

    No task holds a group: rows are split by a hash of ``unit`` into SALTS parts, parts
    fold before they are shuffled, and every part gets the whole group's values back. The
    rows should be cheap to read twice. Keys in ``by`` must not be null.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(unit), F.lit(SALTS)).cast("short"))
    n = [F.count("*").alias("_n")] if counted else []
    parts = salted.groupBy(*by, "_salt").agg(*n, *[F.min(c).alias(f"_{k}") for k, c in least.items()])
    sums = [F.sum("_n").alias(counted)] if counted else []
    whole = parts.groupBy(*by).agg(*sums, *[F.min(f"_{k}").alias(k) for k in least])
    back = parts.select(*by, "_salt").join(whole, by)
    return salted.join(back, [*by, "_salt"]).drop("_salt")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for those without it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-ship-"), f"{root.name}_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of other characters than WS; null text has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(spaced, " "), "")


def squeezed(text: Column) -> Column:
    """The text without any character of WS; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, the same in every run."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))
