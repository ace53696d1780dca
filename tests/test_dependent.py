"""The dependent top-k against an exhaustive search, with rows that cluster and rows that lack channels."""

import numpy as np
import pytest

from tidemark.operators import dependent

KIND = "map<string,array<double>>"


def brute(queries, index, k, channels):
    out = []
    for name, q, weights in queries:
        rows = []
        for i, vectors in index:
            top = low = 0.0
            for c in channels:
                v, w = (vectors or {}).get(c), (weights or {}).get(c) or 0.0
                if v is None or w <= 0:
                    continue
                q_, v_ = np.array(q or []), np.array(v)
                size = np.linalg.norm(q_) * np.linalg.norm(v_)
                top, low = top + w * (q_ @ v_ / size if len(q_) == len(v_) and len(v_) and size > 0 else -1.0), low + w
            rows.append((-round(top / low if low else -1.0, 6), i))
        out += [(name, i, -s, r) for r, (s, i) in enumerate(sorted(rows)[:k], start=1)]
    return sorted(out)


def same(got, want):
    got = sorted(tuple(r) for r in got.collect())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-6)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 2, 8))
    index = []
    for i in range(600):
        a, b = centres[i % 12] + rng.normal(size=(2, 8)) * 0.15
        chans = {"a": a.tolist(), "b": b.tolist(), "other": [9.0]}
        if i % 7 == 0:
            del chans["b"]
        if i % 50 == 1:
            chans = {"a": [0.0] * 8} if i % 100 == 1 else {"b": [1.0, 2.0]}
        index.append((i, None if i == 599 else chans))
    queries = [(f"q{j}", (centres[j % 12, j % 2] + rng.normal(size=8) * 0.1).tolist(), {"a": 1.0, "b": 0.4 * (j % 3)}) for j in range(20)]
    queries += [("none", None, {"a": 1.0}), ("zero", [0.0] * 8, {"a": 1.0}), ("unweighted", [1.0] * 8, {"b": 0.0}), ("short", [1.0, 1.0], {"b": 1.0})]
    return queries, index


@pytest.mark.parametrize(("lists", "probe", "list_rows"), [(1, 1, 1000), (24, 2, 10), (200, 1, 1000)])
def test_equals_exhaustive(spark, data, lists, probe, list_rows):
    queries, index = data
    q = spark.createDataFrame(queries, "name string, q array<double>, weights map<string,double>")
    ix = spark.createDataFrame(index, f"id long, channels {KIND}").repartition(3)
    got = dependent.dependent_top_k(q, ix, 9, "name", "id", ["a", "b"], lists=lists, probe=probe, list_rows=list_rows)
    same(got, brute(queries, index, 9, ["a", "b"]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_scores_few_pairs_where_rows_cluster(spark, data):
    queries = [(n, q, {"a": 1.0}) for n, q, _ in data[0][:20:2]]
    index = [(i, c) for i, c in data[1] if c and "a" in c and any(c["a"])]
    q = spark.createDataFrame(queries, "name string, q array<double>, weights map<string,double>")
    ix = spark.createDataFrame(index, f"id long, channels {KIND}")
    assert dependent.scored_lists(q, ix, 9, "name", "id", ["a"], lists=40) < 0.4


def test_empty_sides(spark):
    q = spark.createDataFrame([("x", [1.0], {"a": 1.0})], "name string, q array<double>, weights map<string,double>")
    ix = spark.createDataFrame([(1, {"a": [1.0]})], f"id long, channels {KIND}")
    assert dependent.dependent_top_k(q, ix.filter("false"), 3, "name", "id", ["a"]).count() == 0
    assert dependent.dependent_top_k(q.filter("false"), ix, 3, "name", "id", ["a"]).count() == 0


def test_memory_of_dealing_does_not_follow_the_batch(spark):
    """rows of a large batch are dealt some at a time."""
    import tracemalloc

    import pandas as pd

    class Taken:
        dtypes = [("id", "bigint")]

        def select(self, *_):
            return self

        def mapInPandas(self, work, _):
            return work

    rng = np.random.default_rng(5)
    of = dependent.Lists.__new__(dependent.Lists)
    of.row, of.channels, of.vectors = "id", ["a", "b"], "v"
    of.pivots = [{"a": dependent._unit(x), "b": dependent._unit(-x)} for x in rng.normal(size=(256, 4))]
    batch = pd.DataFrame({"_row": range(10_000), "v0": list(rng.normal(size=(10_000, 4))), "v1": list(rng.normal(size=(10_000, 4)))})
    tracemalloc.start()
    n = sum(len(x) for x in of.deal(Taken())(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and peak < 20e6
