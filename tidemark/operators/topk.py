"""Ranking: exact top-k, caps per parent and asset, slots with shared state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """The k best rows with their rank; a heap per task, no full sort."""
    best = df.orderBy(F.desc(score), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))  # of k rows


def top_k_per_key(df: DataFrame, keys: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The k best rows of each key; Spark prunes groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def capped_top_k(df: DataFrame, score: str, k: int, tie: str, parent: str, per_parent: int = 1) -> DataFrame:
    """Top k with a cap per parent, relaxed if too few are left: rank is selection order.

    A row's pass is 1 within its parent's cap, else 2. Passes keep score order, so the
    selection is the order by (pass, score).
    """
    per_parent = max(1, per_parent)
    within = F.row_number().over(Window.partitionBy(parent).orderBy(F.desc(score), tie))
    best = df.withColumn("pass", F.when(within <= per_parent, 1).otherwise(2)).orderBy("pass", F.desc(score), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("pass", F.desc(score), tie)))


def select_capped(rows: list[tuple], k: int, per_parent: int, per_asset: int) -> list[tuple[int, int]]:
    """Joint greedy over (position, parent, asset) in score order: (position, pass).

    Pass 1 keeps both caps (0: none), pass 2 gives up the assets' and pass 3 the parents'.
    """
    taken: dict[int, int] = {}
    parents: dict = {}
    assets: dict = {}
    passes = [(1, True, True)]
    if per_asset > 0:
        passes.append((2, True, False))
    if per_parent > 0:
        passes.append((3, False, False))
    for number, by_parent, by_asset in passes:
        for at, parent, asset in rows:
            if len(taken) >= k:
                break
            full = by_parent and per_parent > 0 and parents.get(parent, 0) >= per_parent
            full |= by_asset and per_asset > 0 and asset not in (None, "") and assets.get(asset, 0) >= per_asset
            if at in taken or full:
                continue
            taken[at] = number
            parents[parent] = parents.get(parent, 0) + 1
            assets[asset] = assets.get(asset, 0) + 1
    return list(taken.items())


def double_capped_top_k(
    df: DataFrame, keys: list[str], score: str, tie: str, parent: str, asset: str, k: int, pool: int, per_parent: int = 1, per_asset: int = 2
) -> DataFrame:
    """Top k of each key with caps per parent and per asset: keys, tie, rank, pass.

    Each pick depends on those before, so a key's pool, its ``pool`` best rows, is folded
    in one task; pools are cut in the JVM first, which bounds a group.
    """
    ranked = top_k_per_key(df, keys, score, pool, tie).select(*keys, tie, parent, asset, "rank")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        chosen = select_capped(list(zip(range(len(group)), group[parent], group[asset], strict=True)), k, per_parent, per_asset)
        out = group.iloc[[i for i, _ in chosen]][[*keys, tie]].copy()
        out["rank"] = range(1, len(out) + 1)
        out["pass"] = [p for _, p in chosen]
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, tie]) + ", rank int, pass int"
    return ranked.groupBy(*keys).applyInPandas(pick, schema)


def slot_plan(df: DataFrame, plan: str, slot_order: str, score: str, tie: str, parent: str, asset: str, count: str, pool: int = 36, per_asset: int = 0, alternates: int = 3, relax: bool = True) -> DataFrame:
    """Slots of a plan filled in order; used parents and assets carry over to later slots.

    Rows are (plan, slot, candidate). Returns plan, slot, tie, timeline_order (null for an
    alternate). A plan's pools are bounded by slots times ``pool``.
    """
    ranked = top_k_per_key(df, [plan, slot_order], score, pool, tie).select(plan, slot_order, tie, parent, asset, count, "rank")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        parents: set = set()
        assets: dict = {}
        out, at = [], 1
        for slot, rows in group.sort_values([slot_order, "rank"]).groupby(slot_order, sort=True):
            want, chosen = int(rows[count].iloc[0]), []
            for by_parent, by_asset in ((True, True), (True, False), (False, False)):
                if by_asset is False and by_parent and per_asset <= 0 or not by_parent and not relax:
                    continue
                for r in rows.itertuples(index=False):
                    row = r._asdict()
                    if len(chosen) >= want:
                        break
                    full = by_parent and row[parent] in parents
                    full |= by_asset and per_asset > 0 and bool(row[asset]) and assets.get(row[asset], 0) >= per_asset
                    if row[tie] in chosen or full:
                        continue
                    chosen.append(row[tie])
                    parents.add(row[parent])
                    assets[row[asset]] = assets.get(row[asset], 0) + 1
            for c in chosen:
                out.append((group[plan].iloc[0], slot, c, at))
                at += 1
            rest = [x for x in rows[tie] if x not in chosen][:alternates]
            out += [(group[plan].iloc[0], slot, c, None) for c in rest]
        result = pd.DataFrame(out, columns=[plan, slot_order, tie, "timeline_order"])
        result["timeline_order"] = result["timeline_order"].astype("Int32")
        return result

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (plan, slot_order, tie)) + ", timeline_order int"
    return ranked.groupBy(plan).applyInPandas(fill, schema)


def best_then_pool(df: DataFrame, keys: list[str], evidence: list, pool_order: list, first: int = 3, most: int = 8) -> DataFrame:
    """The ``first`` rows by evidence, then pool order, up to ``most``: place."""
    part = Window.partitionBy(*keys)
    df = df.withColumn("_e", F.row_number().over(part.orderBy(*evidence))).withColumn("_p", F.row_number().over(part.orderBy(*pool_order)))
    place = F.row_number().over(part.orderBy(F.when(F.col("_e") <= first, F.col("_e")).otherwise(F.lit(first + 1)), "_p"))
    return df.withColumn("place", place).filter(F.col("place") <= most).drop("_e", "_p")


def expand_pool(pool: DataFrame, extra: DataFrame, keys: list[str], row_id: str, order: list, most: int = 18) -> DataFrame:
    """Rows that the pool lacks, the first ``most`` of each key, added to it."""
    new = extra.join(pool.select(*keys, row_id), [*keys, row_id], "left_anti")
    w = Window.partitionBy(*keys).orderBy(*order)
    new = new.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")
    return pool.unionByName(new, allowMissingColumns=True)


def pool_with_fallback(df: DataFrame, keys: list[str], hit: str) -> DataFrame:
    """Rows with a hit; all rows, flagged, of keys without any."""
    any_hit = F.max(F.col(hit).cast("int")).over(Window.partitionBy(*keys)) > 0
    return df.withColumn("fallback", ~any_hit).filter(F.col(hit) | F.col("fallback"))


def nearest_n(it: Iterator, n: int) -> list:
    """The first n of an iterator, for drivers that show a head."""
    return [x for x, _ in zip(it, range(n), strict=False)]
