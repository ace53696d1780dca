"""Heavy hitters and lists of terms against plain counts, however little a task keeps."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import terms


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    rows = [[f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(40))] for _ in range(800)]
    return [*rows, None, [], [None, "w1", "w1"]]


@pytest.mark.parametrize("kept", [5, 60, 1 << 16])
def test_frequent_terms_are_exact(spark, data, kept):
    df = spark.createDataFrame([(x,) for x in data], "t array<string>").repartition(5)
    want = Counter(t for x in data if x for t in set(x) if t is not None)
    got = [tuple(r) for r in terms.frequent_terms(df, F.col("t"), 12, kept).collect()]
    assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:12]


def test_fewer_terms_than_asked_for(spark):
    df = spark.createDataFrame([(["b", "a"],), (["b"],)], "t array<string>")
    assert [tuple(r) for r in terms.frequent_terms(df, F.col("t"), 9, 1).collect()] == [("b", 2), ("a", 1)]
    assert terms.frequent_terms(df.filter("false"), F.col("t"), 9).collect() == []


def test_ties_at_the_end(spark):
    df = spark.createDataFrame([([f"t{i:03d}"],) for i in range(300)], "t array<string>").repartition(4)
    assert [r.term for r in terms.frequent_terms(df, F.col("t"), 7, 3).collect()] == [f"t{i:03d}" for i in range(7)]


def test_capabilities(spark):
    rows = [(1, "aa bb", ["x ", " "], "k"), (2, "aa", None, ""), (3, None, ["x", "x"], None), (4, "aa cc bb", [], "k")]
    df = spark.createDataFrame(rows, "id int, text string, points array<string>, kind string")
    got = {}
    for r in terms.capabilities(df, F.col("text"), F.col("points"), F.col("kind"), ["zz", "bb", "aa", "cc", "bb"], ("cc", "bb", "no"), ("bb", "aa", "cc")).orderBy("list", "place").collect():
        got.setdefault(r.list, []).append((r.term, r.n))
    assert got == {
        "available": [("aa", 3), ("bb", 2), ("cc", 1)], "missing": [("zz", 0)], "strong": [("aa", 3), ("bb", 2)], "evidence": [("aa", 3)],
        "weak_problem": [("cc", 1), ("no", 0)], "safe_opening": [("bb", 2), ("aa", 3)], "points": [("x", 3)], "kinds": [("k", 2)],
    }
    first = terms.examples(df, "id", {"text": 3}, {"points": 1}, most=2).collect()
    assert [tuple(r) for r in first] == [(1, "aa ", ["x "]), (2, "aa", [])]
    assert terms.lexicon_counts(df, F.col("text"), []).count() == 0


def test_candidates_are_counted_without_shuffling_all_terms(spark):
    """the second count sends the few candidates to the rows, not the rows' terms to the candidates."""
    rng = random.Random(4)
    rows = [[f"h{i}" for i in range(8)] + [f"r{rng.randrange(10**9)}" for _ in range(10)] for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in rows], "t array<string>").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = terms.frequent_terms(df, F.col("t"), 8, 200)
        assert [tuple(r) for r in got.collect()] == [(f"h{i}", 600) for i in range(8)]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
