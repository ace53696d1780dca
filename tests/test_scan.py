"""Running values of keys that are cut into slices equal plain windows; slices are even."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import intervals, scan


@pytest.fixture
def cut(monkeypatch):
    monkeypatch.setattr(scan, "LEAST_ROWS", 20)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(8)
    data = []
    for i in range(900):
        key = None if i % 9 == 0 else "hot" if i % 3 else f"k{i % 50}"
        at = rng.choice([round(rng.uniform(0, 300), 2), float(rng.randrange(300))]) if i % 40 else None
        data.append((key, i, at, None if at is None else at + round(rng.uniform(-0.2, 3), 2), rng.randrange(9)))
    return spark.createDataFrame(data, "key string, id int, start_s double, end_s double, v int").repartition(5)


def test_slices_are_even(spark, cut):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("x"))
    s = scan.Sliced(df, ["k"], ["x"], slices=64)
    sizes = [r["count"] for r in s.rows.groupBy("k", "_slice").count().collect()]
    assert max(sizes) <= 2 * 30_000 / 64 and len(sizes) >= 500 + 16
    tasks = s.rows.repartition(16, "k", "_slice").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert tasks.max() <= 2 * tasks.median()
    edges = s.rows.filter("k = -1").groupBy("_slice").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("_slice").collect()
    assert all(x.b < y.a for x, y in zip(edges, edges[1:]))


def test_positions(spark, spans, cut):
    w = Window.partitionBy("key").orderBy("start_s", "id")
    got = scan.positions(spans, ["key"], ["start_s", "id"], "n", first=1)
    assert got.columns == [*spans.columns, "n"]
    assert rows(got) == rows(spans.withColumn("n", F.row_number().over(w)))
    text = spans.withColumn("t", F.format_string("%05d", "id"))  # no axis to cut
    assert rows(scan.positions(text, ["key"], ["t"], "n").select("id", "n")) == rows(text.select("id", F.row_number().over(Window.partitionBy("key").orderBy("t")) - 1))
    assert rows(scan.positions(spans, [], ["id"], "n").select("id", "n")) == [(i, i) for i in range(900)]
    assert scan.positions(spans.filter("false"), ["key"], ["id"], "n").count() == 0


def test_running_operators_equal_plain_windows(spans, cut):
    w = Window.partitionBy("key").orderBy("start_s", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    known = spans.filter("start_s IS NOT NULL")
    axis = intervals.running_axis(spans, ["key"], ["id"], "v").select("id", "start_s", "end_s")
    by_id = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("v").over(by_id)
    assert rows(axis) == rows(spans.select("id", upto - F.col("v"), upto))
    reach = F.max("end_s").over(before)
    got = intervals.overlaps_before(known, ["key"], ["start_s", "id"])
    assert rows(got.select("id", "overlap")) == rows(known.select("id", F.coalesce(F.col("start_s") < reach - 0.04, F.lit(False))))
    got = intervals.overlaps_before(known, ["key"], ["start_s", "id"], last_only=True)
    assert rows(got.select("id", "overlap")) == rows(known.select("id", F.coalesce(F.col("start_s") < F.lag("end_s").over(w) - 0.04, F.lit(False))))
    got = intervals.gap_islands(known, ["key"], ["start_s", "id"], 0.2).select("id", "island")
    new = known.withColumn("new", F.coalesce((F.col("start_s") - reach > 0.2).cast("int"), F.lit(1)))
    assert rows(got) == rows(new.select("id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    got = intervals.points_to_intervals(known, ["key"], "start_s", shortest=-1)
    plain = known.select("key", "start_s", F.lead("start_s").over(Window.partitionBy("key").orderBy("start_s")).alias("end_s")).filter("end_s IS NOT NULL")
    assert rows(got) == rows(plain)


def test_monotonic_equals_sequential(spans, cut):
    got = {r.id: (r.start_s, r.end_s) for r in intervals.monotonic(spans.filter("start_s IS NOT NULL"), ["key"], ["id"]).collect()}
    groups = {}
    for r in spans.filter("start_s IS NOT NULL").collect():
        groups.setdefault(r.key, []).append((r.start_s, r.id, r.end_s))
    for g in groups.values():
        last = None
        for s, i, e in sorted(g):
            start = max(s, 0.0 if last is None else last)
            last = max(e, max(s, 0.0) + 0.05, -1e9 if last is None else last + 0.05)
            assert got[i] == (pytest.approx(start, abs=2e-3), pytest.approx(last, abs=2e-3))


def test_nearest_start_equals_all_pairs(spans, cut):
    left = spans.filter("start_s IS NOT NULL AND key IS NOT NULL")
    right = left.filter("v < 3").select("key", F.col("id").alias("r"), F.col("start_s").alias("at"))
    got = intervals.nearest_start(left.select("key", "id", "start_s"), right, "id", "r", "start_s", "at", ["key"])
    pairs = left.join(right, "key").select("id", F.struct(F.abs(F.col("at") - F.col("start_s")).alias("d"), "r").alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    assert rows(got.filter("r IS NOT NULL").select("id", "r")) == rows(pairs.select("id", "x.r"))


def test_capped_islands_do_not_depend_on_slices(spans, monkeypatch):
    known = spans.filter("start_s IS NOT NULL")
    whole = rows(intervals.capped_islands(known, ["key"], 0.5, 6.0))
    monkeypatch.setattr(scan, "LEAST_ROWS", 20)
    assert rows(intervals.capped_islands(known, ["key"], 0.5, 6.0)) == whole


def test_merge_of_many_cuts(spark):
    df = spark.range(8).select("id", F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: F.round(i * 0.9 + F.pmod(F.xxhash64(i, "id"), F.lit(80)) / 100, 2)).alias("cuts"))
    df = df.select("id", F.lit(0.0).alias("start_s"), F.lit(9100.0).alias("end_s"), "cuts")
    out = intervals.split_by_cuts(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") + plan.count("arraysort(") <= 1
    r = out.groupBy("id").agg(F.count("*").alias("n"), F.min(F.col("piece_end_s") - F.col("piece_start_s")).alias("least"), F.sum(F.col("piece_end_s") - F.col("piece_start_s")).alias("all")).collect()
    assert all(x.n > 4000 and x.least >= 1.2 - 1e-9 and abs(x["all"] - 9100) < 1e-3 for x in r)


def test_cuts_are_found_once(spark, spans, cut):
    s = scan.Sliced(spans, ["key"], ["start_s", "id"])
    plan = s.rows._jdf.queryExecution().optimizedPlan().toString()
    assert s.rows.filter("_split").count() and "percentile_approx" not in plan  # approximate cuts may differ from one look to the next
    whole = scan.Sliced(spans, ["key"], ["start_s", "id"], least_rows=1000).rows
    assert whole.filter("_split OR _slice <> 0").isEmpty() and "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_long_sums_keep_their_cents(spark):
    big = spark.createDataFrame([(0, 4e14)], "id int, v double").unionByName(spark.range(1, 4_001).selectExpr("cast(id as int) AS id", "0.01D AS v"))
    got = intervals.running_axis(big, [], ["id"], "v").select("id", F.round("end_s", 2).alias("e")).filter("id = 4000").first()
    assert got.e == 4e14 + 40


def test_thousandths_round_by_their_thousandfold(spark):
    df = spark.createDataFrame([(0, 4.0005), (1, 600 - 4.0005)], "id int, u double").withColumn("total", F.lit(600.0))
    got = intervals.proportional_axis(df, [], ["id"], "u", "total").filter("id = 0").first()
    assert got.end_s == 4.0  # 4.0005 * 1000 is below the half


def test_nearest_is_by_whole_microseconds(spark):
    at = "timestamp_micros(1700000000000000 + {})"
    left = spark.sql(f"SELECT 1 AS k, id, {at.format('id * 7')} AS at FROM range(200)")
    right = spark.sql(f"SELECT 1 AS k, id + 1000 AS r, {at.format('id * 7 - 3 + (id % 2) * 6')} AS r_at FROM range(200)")
    near = intervals.nearest_start(left, right, "id", "r", "at", "r_at", ["k"])
    assert "unboundedfollowing" not in near._jdf.queryExecution().optimizedPlan().toString()  # such a frame is summed anew for each row
    got = {r.id: r.r for r in near.collect()}
    places = {1000 + i: i * 7 - 3 + (i % 2) * 6 for i in range(200)}
    assert got == {i: min((abs(p - i * 7), r) for r, p in places.items())[1] for i in range(200)}
