"""Daily summaries, merged, against exact values."""

from pyspark.sql import functions as F

from tidemark.operators import sketches


def test_merged_summaries_are_close(spark):
    df = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 2).alias("k"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("user"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)).cast("double").alias("v"))
    days = sketches.summaries(df, ["day", "k"], {"user": "user"}, {"v": "v"})
    assert days.count() == 30
    month = sketches.merged(sketches.merged(days, ["day"], ["user"], ["v"]), [], ["user"], ["v"])
    got = month.select("n", "min_v", "max_v", sketches.distinct_estimate("d_user").alias("d"), *[sketches.quantile_estimate("q_v", q).alias(f"q{int(q * 100)}") for q in (0.01, 0.5, 0.99)]).first()
    exact = df.agg(F.count_distinct("user").alias("d"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    assert (got.n, got.min_v, got.max_v) == (60_000, exact.a, exact.b)
    assert abs(got.d - exact.d) < 0.05 * exact.d
    for q in (0.01, 0.5, 0.99):
        at = df.filter(F.col("v") <= getattr(got, f"q{int(q * 100)}")).count() / 60_000
        assert abs(at - q) < 0.04


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (1, "a", 2.0), (2, None, None)], "day int, u string, v double")
    days = sketches.summaries(df, ["day"], {"u": "u"}, {"v": "v"})
    rows = {r.day: (r.n, r.d, r.q) for r in days.select("day", "n", sketches.distinct_estimate("d_u").alias("d"), sketches.quantile_estimate("q_v", 0.5).alias("q")).collect()}
    assert rows == {1: (2, 1, 2.0), 2: (1, 0, None)}
    assert sketches.summaries(df.filter("false"), ["day"], {"u": "u"}, {"v": "v"}).count() == 0
