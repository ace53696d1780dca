"""The best rows for each of many queries, exactly, without pairing every query with every row.

Rows are dealt to lists around chosen rows (pivots). By channel a list knows how far its
rows are from its pivot at most; the angle between a query and the pivot less that says how
well any of its rows can do at best, by the triangle inequality of angles. A query first
scores the few lists that promise most. Its k-th best score so far is a threshold, and
only lists that can still reach it are scored as well. Lists that promise less hold no
better row, so the answer is that of an exhaustive search; how much is saved depends on
how much rows cluster.

What is broadcast, and what passes the driver, are the pivots and one line for each list
and channel: their number is a parameter. Queries and rows meet in joins by list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, mean_weighted
from .topk import top_k_per_key

LISTS, PROBE = 256, 2
#: Rows of a list that meet a query's row in one task; larger lists are split.
LIST_ROWS = 1 << 14
_SLACK = 1e-9
#: Rows whose angles a task has at a time, and rows of promises in a batch: memory doesn't follow the batches that come in.
AT_ONCE = 1 << 9
PROMISES = 1 << 14


def _unit(values) -> np.ndarray | None:
    if values is None or not len(values):
        return None
    v = np.asarray(values, dtype=np.float64)
    n = np.sqrt((v * v).sum())
    return v / n if n > 0 and np.isfinite(n) else None


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


class Lists:
    """Pivots by channel and, once rows are dealt, the bounds of each list."""

    def __init__(self, index: DataFrame, row: str, channels: list[str], vectors: str, n_lists: int):
        self.row, self.channels, self.vectors = row, channels, vectors
        picked = index.select(row, vectors).orderBy(F.xxhash64(F.col(row)), row).limit(n_lists).collect()  # bounded by n_lists
        found = [{c: _unit((r[vectors] or {}).get(c)) for c in channels} for r in picked]
        self.pivots = found or [dict.fromkeys(channels)]
        self.bounds: dict = {}

    def deal(self, index: DataFrame) -> DataFrame:
        """The index with its list, and the largest angle to the pivot by channel (null where either lacks it)."""
        pivots, channels, row = self.pivots, self.channels, self.row

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in (x.iloc[at : at + AT_ONCE] for x in batches for at in range(0, len(x), AT_ONCE)):
                out: dict[str, list] = {"_row": [], "list": [], **{f"a{i}": [] for i in range(len(channels))}, **{f"has{i}": [] for i in range(len(channels))}}
                every = np.full((len(channels), len(b), len(pivots)), np.nan)
                has = np.zeros((len(channels), len(b)), bool)
                for i in range(len(channels)):
                    sizes = {len(p[channels[i]]) for p in pivots if p[channels[i]] is not None}
                    units = [_unit(v) for v in b[f"v{i}"]]
                    has[i] = [u is not None for u in units]
                    for size in sizes:
                        r = [k for k, u in enumerate(units) if u is not None and len(u) == size]
                        p = [k for k, x in enumerate(pivots) if x[channels[i]] is not None and len(x[channels[i]]) == size]
                        if r:
                            every[i][np.ix_(r, p)] = _angles(np.stack([units[k] for k in r]), np.stack([pivots[k][channels[i]] for k in p]))
                # The nearest pivot over all channels; a channel that either lacks counts as far.
                best = np.nan_to_num(every, nan=math.pi).sum(axis=0).argmin(axis=1)
                own = every[:, np.arange(len(b)), best]
                out["_row"], out["list"] = b["_row"].tolist(), best.tolist()
                for i in range(len(channels)):
                    out[f"a{i}"] = [None if np.isnan(x) else float(x) for x in own[i]]
                    out[f"has{i}"] = has[i].tolist()
                yield pd.DataFrame(out)

        kind = dict(index.dtypes)[row]
        parts = index.select(F.col(row).alias("_row"), *[F.col(self.vectors)[c].cast("array<double>").alias(f"v{i}") for i, c in enumerate(channels)])
        angles = ", ".join(f"a{i} double" for i in range(len(channels))) + ", " + ", ".join(f"has{i} boolean" for i in range(len(channels)))
        return parts.mapInPandas(work, f"_row {kind}, list int, {angles}")

    def measure(self, dealt: DataFrame) -> None:
        """Bounds and sizes of the lists: one row each."""
        cols = []
        for i in range(len(self.channels)):
            # A row that has the channel but no angle can do anything; one without it does nothing there.
            cols += [F.max(F.when(F.col(f"has{i}"), F.coalesce(f"a{i}", F.lit(math.pi)))).alias(f"far{i}"), F.bool_and(f"has{i}").alias(f"all{i}"), F.bool_or(f"has{i}").alias(f"any{i}")]
        self.bounds = {r["list"]: r.asDict() for r in dealt.groupBy("list").agg(F.count("*").alias("n"), *cols).collect()}  # bounded by n_lists

    def promise(self, q, weights) -> list[tuple[int, float]]:
        """For each list that has rows, the best score that any of them can have for a query."""
        unit, out = _unit(q), []
        weights = dict(weights or {})
        for k, b in sorted(self.bounds.items()):
            always, maybe = [], []
            for i, c in enumerate(self.channels):
                w = weights.get(c) or 0.0
                if w <= 0 or not b[f"any{i}"]:
                    continue
                p, best = self.pivots[k][c], -1.0
                if unit is not None:
                    near = float(_angles(unit[None], p[None])[0, 0]) if p is not None and len(p) == len(unit) else 0.0
                    best = math.cos(max(0.0, near - b[f"far{i}"])) if p is not None and len(p) == len(unit) else 1.0
                (always if b[f"all{i}"] else maybe).append((best, w))
            top, low = sum(s * w for s, w in always), sum(w for _, w in always)
            for s, w in sorted(maybe, reverse=True):
                if low == 0 or s > top / low:
                    top, low = top + s * w, low + w
            # A row without any weighted channel scores -1.
            out.append((k, top / low + _SLACK if low else -1.0))
        return out


def dependent_top_k(
    queries: DataFrame, index: DataFrame, k: int, query: str, row: str, channels: list[str], vector: str = "q", weights: str = "weights",
    vectors: str = "channels", lists: int = LISTS, probe: int = PROBE, decimals: int = 6, list_rows: int = LIST_ROWS,
) -> DataFrame:
    """The ``k`` best index rows of each query: query, row, score, rank; ties go to the smaller row.

    ``queries`` has a vector and a map of channel weights, ``index`` a map of vectors by
    channel (those named by ``channels`` count). The score is mean_weighted() of the
    cosines, rounded; rows without a weighted channel score -1. Empty sides give no rows.
    """
    of = Lists(index, row, channels, vectors, lists)
    dealt = of.deal(index)
    of.measure(dealt)
    parts = {i: max(1, -(-b["n"] // list_rows)) for i, b in of.bounds.items()}
    kind = dict(queries.dtypes)[query]

    def promised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, q, w in zip(b["_query"], b["_q"], b["_w"], strict=True):
                out += [(key, i, best, parts[i]) for i, best in of.promise(q, w)]
                if len(out) >= PROMISES:
                    yield pd.DataFrame(out, columns=["_query", "list", "best", "parts"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["_query", "list", "best", "parts"])

    asked = queries.select(F.col(query).alias("_query"), F.col(vector).cast("array<double>").alias("_q"), F.col(weights).cast("map<string,double>").alias("_w"))
    bounds = asked.mapInPandas(promised, f"_query {kind}, list int, best double, parts int")
    order = Window.partitionBy("_query").orderBy(F.desc("best"), "list")
    bounds = bounds.withColumn("place", F.row_number().over(order))
    n_parts = F.element_at(F.create_map(*[x for i, n in parts.items() for x in (F.lit(i), F.lit(n))]), F.col("list")) if parts else F.lit(1)
    rows = dealt.select("_row", "list", F.pmod(F.xxhash64("_row"), n_parts).cast("int").alias("part")).join(
        index.select(F.col(row).alias("_row"), F.col(vectors).alias("_v")), "_row"
    )

    def scored(some: DataFrame) -> DataFrame:
        with_part = some.select("_query", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        pairs = with_part.join(rows, ["list", "part"]).join(asked, "_query")
        known = F.map_filter("_v", lambda c, v: c.isin(*channels) & v.isNotNull())
        sims = F.transform_values(known, lambda _, v: cosine(F.col("_q"), v))
        return pairs.select("_query", "_row", F.round(mean_weighted(sims, F.col("_w")), decimals).alias("score"))

    first = top_k_per_key(scored(bounds.filter(F.col("place") <= probe)), ["_query"], "score", k, "_row")
    floor = first.filter(F.col("rank") == k).select("_query", F.col("score").alias("floor"))
    rest = bounds.filter(F.col("place") > probe).join(floor, "_query", "left").filter(F.col("floor").isNull() | (F.col("best") >= F.col("floor") - 10.0**-decimals))
    every = first.select("_query", "_row", "score").unionByName(scored(rest))
    return top_k_per_key(every, ["_query"], "score", k, "_row").select(F.col("_query").alias(query), F.col("_row").alias(row), "score", "rank")


def scored_lists(queries: DataFrame, index: DataFrame, k: int, query: str, row: str, channels: list[str], **how) -> float:
    """The share of all (query, row) pairs that dependent_top_k() has to score; for tuning ``lists`` and ``probe``."""
    lists, probe = how.get("lists", LISTS), how.get("probe", PROBE)
    vector, weights, vectors = how.get("vector", "q"), how.get("weights", "weights"), how.get("vectors", "channels")
    of = Lists(index, row, channels, vectors, lists)
    of.measure(of.deal(index))
    best = dependent_top_k(queries, index, k, query, row, channels, **how)
    floors = {r[query]: r["score"] for r in best.filter(F.col("rank") == k).collect()}
    total, seen = 0, 0
    for r in queries.select(query, vector, weights).toLocalIterator():
        promise = sorted(of.promise(r[vector], r[weights]), key=lambda x: (-x[1], x[0]))
        total += sum(b["n"] for b in of.bounds.values())
        seen += sum(of.bounds[i]["n"] for place, (i, s) in enumerate(promise) if place < probe or s >= floors.get(r[query], -2.0) - 1e-6)
    return seen / max(1, total)
