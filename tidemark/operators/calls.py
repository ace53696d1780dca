"""Calls to models, stores and probes: a client per task, retries, failures kept as rows.

The client is a parameter, a function that makes one; tests pass a stub. Rows go through
in batches per partition, so ``repartition(n)`` sets how many calls run side by side.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redacted


def with_retry(call: Callable, arg, tries: int = 3, wait_s: float = 0.0):
    """The result, or the last error; waits grow linearly."""
    for n in range(1, tries + 1):
        try:
            return call(arg), None
        except Exception as e:  # what a remote end throws is data here
            error = f"{type(e).__name__}: {e}"
            if n < tries and wait_s:
                time.sleep(wait_s * n)
    return None, error


def call_rows(
    df: DataFrame, value: str, result: str, make_client: Callable[[], Callable], tries: int = 3, wait_s: float = 0.0, valid: Callable[[object], bool] = lambda x: x is not None
) -> DataFrame:
    """Each row with result, status (ok, failed or skipped) and error.

    Blank values are skipped. A result that is not valid is a failure, such as a vector
    of the wrong length.
    """
    extra = f"result {result}, status string, error string"
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + extra

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            out = []
            for v in b[value]:
                if v is None or v == "" or v is not v:
                    out.append((None, "skipped", None))
                    continue
                got, error = with_retry(client, v, tries, wait_s)
                ok = error is None and valid(got)
                out.append((got if ok else None, "ok" if ok else "failed", error if error else None if ok else "invalid result"))
            r = pd.DataFrame(out, columns=["result", "status", "error"], index=b.index)
            yield pd.concat([b, r], axis=1)

    called = df.mapInPandas(work, schema)
    return called.withColumn("error", redacted("error"))


def embed_channels(inputs: DataFrame, make_client: Callable[[], Callable], dim: int, tries: int = 3) -> DataFrame:
    """Vectors of enabled channel inputs: shot_id, channel, mode, status, embedding, error."""
    todo = inputs.filter("enabled").select("shot_id", "channel", "mode", "value")
    out = call_rows(todo, "value", "array<float>", make_client, tries, valid=lambda v: v is not None and len(v) == dim)
    return out.select("shot_id", "channel", "mode", "status", F.col("result").alias("embedding"), "error")


def refine(rows: DataFrame, key: str, prompt: Column, make_client: Callable[[], Callable], flag: str = "needs_refine", most: int | None = None, workers: int = 3) -> DataFrame:
    """Flagged rows with a model's answer; all others as they are, without one."""
    todo = rows.filter(flag).withColumn("_prompt", prompt)
    if most is not None:
        todo = todo.orderBy(key).limit(most)
    done = call_rows(todo.select(key, "_prompt").repartition(workers), "_prompt", "string", make_client).select(key, F.col("result").alias("answer"), F.col("status").alias("answer_status"))
    return rows.join(done, key, "left")


def probe(paths: DataFrame, path: str, fields: str, make_client: Callable[[], Callable]) -> DataFrame:
    """What a prober says of each path, as a struct of ``fields``; null where it fails."""
    return call_rows(paths, path, f"struct<{fields}>", make_client).withColumnRenamed("result", "media")


def stored_url(output: Column, scheme: str = "oss") -> Column:
    """The address in a tool's output: a JSON field, a marked line, or the first that looks like one."""
    form = rf"({scheme}://[^\s\"']+)"
    found = [F.get_json_object(output, f"$.{k}") for k in ("url", "oss_url", "data.url", "output.url")]
    found.append(F.regexp_extract(output, rf"(?im)^\s*(?:url|result)\s*[:=]\s*{form}", 1))
    found.append(F.regexp_extract(output, form, 1))
    return F.coalesce(*[F.when(c.startswith(f"{scheme}://"), c) for c in found])
