"""Stages and queues of the driver: fixed order, resume, isolation of failures, one writer."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def run_stages(stages: list[tuple[str, Callable[[], None]]], resume_from: str | None = None, done: set[str] | None = None) -> dict[str, str]:
    """Run stages in order, from ``resume_from`` on or what is not done; stops at a failure."""
    names = [n for n, _ in stages]
    start = names.index(resume_from) if resume_from else 0
    states = dict.fromkeys(names, "pending")
    for i, (name, work) in enumerate(stages):
        if i < start or not resume_from and name in (done or set()):
            states[name] = "skipped"
            continue
        try:
            work()
            states[name] = "done"
        except Exception as e:  # the state is the report; the caller decides
            states[name] = f"failed: {e}"
            break
    return states


#: The code of what went beyond its limit.
TIMED_OUT = 124


def _limited(spark: SparkSession, name: str, work: Callable[[], object], limit_s: float | None) -> tuple[str, object]:
    """Run under a job tag of its own; beyond the limit all its Spark jobs are cancelled."""
    sc, late = spark.sparkContext, threading.Event()
    tag = f"task-{uuid.uuid4().hex}"

    def end() -> None:
        late.set()
        while not over.wait(0.2):  # jobs that it starts after the first cancellation as well
            sc.cancelJobsWithTag(tag)

    over = threading.Event()
    timer = threading.Timer(limit_s, end) if limit_s else None
    sc.setLocalProperty("spark.scheduler.pool", name)
    sc.addJobTag(tag)
    try:
        if timer:
            timer.daemon = True
            timer.start()
        result = ("done", work())
    except Exception as e:
        result = ("failed", str(e))
    finally:
        over.set()
        if timer:
            timer.cancel()
        sc.removeJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", None)
    return ("timed out", TIMED_OUT) if late.is_set() and result[0] == "failed" else result


def run_queue(
    spark: SparkSession, tasks: dict[str, Callable[[], object]], workers: int = 2, paused: Callable[[], bool] = lambda: False, limits: dict[str, float] | None = None,
) -> dict[str, tuple[str, object]]:
    """Run tasks side by side, each in a scheduler pool of its own; failures stay with their task.

    A task with a limit (seconds) ends as ("timed out", 124) when its Spark jobs take
    longer: they are cancelled, others go on. What a task does outside of Spark is not
    broken off; one that is done all the same counts as done.
    """
    out, lock = {}, threading.Lock()

    def one(name: str) -> None:
        result = ("queued", None) if paused() else _limited(spark, name, tasks[name], (limits or {}).get(name))
        with lock:
            out[name] = result

    with ThreadPoolExecutor(max_workers=workers) as pool:
        for f in as_completed([pool.submit(inheritable_thread_target(spark)(one), n) for n in tasks]):
            f.result()
    return out
