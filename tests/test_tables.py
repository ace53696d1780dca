"""The bucketed table of latest rows: what is written, reruns, versions; windows with late rows."""

import os
import random

from pyspark.sql import functions as F

from tidemark.streaming import streams
from tidemark.streaming.tables import KeyedTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_upserts_touch_few_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    t = KeyedTable(spark, path, ["k"], ["o"], buckets=32)
    whole = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("o"), F.lit("x" * 50).alias("v"))
    assert t.upsert(whole, 0)
    first = size(path)
    few = spark.createDataFrame([(7, 2, "new"), (9, 0, "old"), (-1, 1, "more"), (7, 1, "older")], "k long, o int, v string")
    assert t.upsert(few, 1) and not t.upsert(few, 1)
    assert size(path) - first < first / 4  # three buckets of 32
    got = {r.k: (r.o, r.v) for r in t.read().filter("k IN (7, 9, -1)").collect()}
    assert got == {7: (2, "new"), 9: (1, "x" * 50), -1: (1, "more")} and t.read().count() == 5001
    assert t.read(0).count() == 5000 and KeyedTable(spark, path, ["k"], ["o"], buckets=5).buckets == 32
    assert t.upsert(few.filter("false"), 2) and rows(t.read()) == rows(t.read(1))
    assert t.vacuum(1) == 3 and t.versions() == [2] and t.read().count() == 5001


def test_equals_a_plain_upsert(spark, tmp_path):
    rng, latest = random.Random(4), {}
    t = KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], ["o", "v"], buckets=7)
    for n in range(4):
        batch = [(rng.choice([None, "x", "y"]), rng.randrange(9), rng.randrange(5), rng.randrange(100)) for _ in range(40)]
        for a, b, o, v in batch:
            latest[a, b] = max(latest.get((a, b), (-1, -1)), (o, v))
        t.upsert(spark.createDataFrame(batch, "a string, b int, o int, v int"), n)
    assert {(r.a, r.b): (r.o, r.v) for r in t.read().collect()} == latest


def test_as_a_stream_sink(spark, tmp_path):
    schema, src = "k string, o int, v int", str(tmp_path / "in")
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["o"], buckets=4)
    for batch in ([("a", 1, 10), ("b", 1, 20)], [("a", 2, 11)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        streams.run_available(streams.file_stream(spark, src, schema), t.sink(), str(tmp_path / "ck"))
    assert rows(t.read()) == [("a", 2, 11), ("b", 1, 20)] and len(t.versions()) == 2


def test_late_rows_are_left_out(spark, tmp_path):
    schema = "k string, at timestamp, v int"
    for n, day in enumerate((1, 5, 9, 1)):
        data = spark.createDataFrame([("a", f"2024-01-0{day} 10:00:00", n)], "k string, at string, v int").withColumn("at", F.col("at").cast("timestamp"))
        data.coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    src = streams.file_stream(spark, str(tmp_path / "in" / "*"), schema, files_per_batch=1)
    streams.run_available(streams.windowed_counts(src, "at", ["k"], "1 day", "1 hour", "v"), streams.append_to(str(tmp_path / "out")), str(tmp_path / "ck"))
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).select(F.dayofmonth("window_start"), "n", "total")
    assert rows(got) == [(1, 1, 0), (5, 1, 1)]  # the last window is still open
