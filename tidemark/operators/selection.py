"""Stateful selection under budgets, and the counters that keep a batch diverse.

Picks for a section depend on those of the sections before, so one task's sections, with
pools that are cut to a few dozen rows beforehand, are worked through in one group. The
counters between tasks are facts (batch, task, kind, key, n): totals are a sum, and a task
leaves itself out by a filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import reuse_scale
from .clips import MOST, MOST_STEPS, STEP_ROLES
from .topk import top_k_per_key

#: Rows that a task sorts or folds at a time where the number of tasks follows the rows.
ROWS_A_TASK = 1_000_000

#: A budget is filled when at most this much is left; a pick should have at least MIN_CLIP_S.
DONE_S, MIN_CLIP_S, SHORT_S = 0.03, 2.5, 0.08
#: Rows of sections that are filled in one call.
AT_ONCE = 1 << 14
#: The price of reuse in the same task, by shot, unit and asset.
REUSE = (0.46, 0.58, 0.055)


@dataclass
class Usage:
    """What a task has used so far."""

    shots: dict
    units: dict
    assets: dict

    @classmethod
    def empty(cls) -> "Usage":
        return cls({}, {}, {})

    def price(self, shot, unit, asset) -> float:
        n = (self.shots.get(shot, 0), self.units.get(unit, 0), self.assets.get(asset, 0))
        return sum(a * b for a, b in zip(n, REUSE, strict=True))

    def add(self, shot, unit, asset) -> None:
        for d, k in ((self.shots, shot), (self.units, unit), (self.assets, asset)):
            d[k] = d.get(k, 0) + 1


def allocate_runs(runs: list[tuple[int, list[float]]], budget: float, least: float = MIN_CLIP_S) -> tuple[list[tuple[int, int, float, bool]], float]:
    """Fill a budget with clips of candidates in order: (candidate, clip, seconds taken, short), and what is left.

    A candidate is (most clips that it gives, seconds of each). Clips below the least length
    wait while more than that is to be filled, inside a candidate and between candidates
    alike; the first that waited is used, as short, only if nothing else is. No further
    candidate is begun for less than the least length.
    """
    least = min(least, budget) if budget > 0 else least
    left, taken, waiting = budget, [], None
    for i, (most, parts) in enumerate(runs):
        if left <= DONE_S or taken and left + SHORT_S < least:
            break
        n = 0
        for j, d in enumerate(parts):
            if left <= DONE_S or n >= most:
                break
            part = min(d, left)
            if part <= 0:
                continue
            if part + SHORT_S < least and left > least + SHORT_S:
                waiting = waiting or (i, j, part, True)
                continue
            taken.append((i, j, part, False))
            n += 1
            left = max(0.0, left - part)
    if not taken and waiting:
        taken = [waiting]
        left = max(0.0, left - waiting[2])
    return [(i, j, round(p, 3), short) for i, j, p, short in taken], round(left, 3)


def allocate(durations: list[float], budget: float, least: float = MIN_CLIP_S) -> tuple[list[tuple[int, float]], float]:
    """allocate_runs() of candidates with one clip each: (clip, seconds taken), and what is left."""
    taken, left = allocate_runs([(1, [d]) for d in durations], budget, least)
    return [(i, p) for i, _, p, _ in taken], left


def clips_of(r) -> tuple[int, list[tuple[str, float, float]]]:
    """What a candidate can give: the most clips, and (clip, where in it, seconds from there) in order.

    A candidate with a file of its own gives that, from where its chosen child begins (an
    offer's packaging from the start); one with children gives a run of them from the chosen
    one on, more of them where steps are shown; any other gives itself.
    """
    whole = r.packaging and r.duration_s >= WHOLE_S
    base = 0.0 if whole else r.parent_offset_s
    if r.own_file and r.duration_s > 0 and base < r.duration_s - DONE_S:
        at = min(base + r.inner_offset_s, r.duration_s)
        return 1, [(r.shot_id, round(at, 3), max(0.0, r.duration_s - at))]
    children = [] if r.children is None else list(r.children)
    if not children:
        at = max(0.0, min(0.0 if whole else r.inner_offset_s, r.duration_s))
        return 1, [(r.shot_id, round(at, 3), r.duration_s - at)]
    ids = [c["shot_id"] for c in children]
    first = ids.index(r.chosen_child) if not whole and r.chosen_child in ids else 0
    most = MOST_STEPS if r.packaging or r.role in STEP_ROLES else MOST
    return most, [(c["shot_id"], 0.0, c["duration_s"] or 0.0) for c in children[first:]]


def planned_clips(chosen: list, budget: float, least: float = MIN_CLIP_S) -> tuple[list[tuple], float]:
    """(candidate, clip, where in it, seconds, short) of candidates in order, and what of the budget is left."""
    runs = [clips_of(r) for r in chosen]
    plan, gap = allocate_runs([(most, [d for *_, d in parts]) for most, parts in runs], budget, least)
    return [(chosen[i], *runs[i][1][j][:2], part, short) for i, j, part, short in plan], gap


#: What counts as strong, how much of a gap is topped up, and clips of a section.
STRONG_MEANING, STRONG_VISUAL, TOP_UP_S, CLIPS = 1.6, 2.5, 0.08, 6
#: A packaging candidate of this length is shown from its start.
WHOLE_S = 0.3
#: Columns that candidates may have, with what stands for them.
OPTIONAL = {
    "override_order": ("double", None), "planner_order": ("double", None), "batch_price": ("double", 0.0), "role": ("string", ""),
    "renderable": ("boolean", True), "allowed": ("boolean", True), "allowed_top_up": ("boolean", True), "needs_child_hit": ("boolean", False),
    "hard_hits": ("int", 0), "visual_score": ("double", 0.0), "semantic_score": ("double", 0.0), "hits": ("array<string>", []),
    "visual_hits": ("int", 0), "theme_hit": ("boolean", False), "packaging": ("boolean", False), "packaging_hit": ("boolean", False),
    "opening_pressure": ("int", 0), "query_terms": ("array<string>", []), "own_file": ("boolean", False), "parent_offset_s": ("double", 0.0),
    "inner_offset_s": ("double", 0.0), "chosen_child": ("string", ""), "children": ("array<struct<shot_id:string,duration_s:double>>", []),
}


def _pool(rows: list) -> tuple[list, bool]:
    """Rows with a child's hard hit where the section needs one and any has it, else all; whether it had to fall back."""
    if not rows or not rows[0].needs_child_hit:
        return rows, False
    hard = [r for r in rows if r.renderable and r.hard_hits > 0]
    return (hard, False) if hard else (rows, True)


def _compatible(seed, r) -> bool:
    """Whether a clip goes with a section's first one."""
    if r.packaging:
        return bool(r.packaging_hit)
    return seed is None or bool(set(seed.hits) & set(r.hits)) or r.visual_hits > 0 or r.theme_hit or seed.asset_id == r.asset_id


def _choose(rows: list, budget: float, most: int) -> tuple[list, str]:
    """Clips by rule: one that is long enough and means the right thing, else several that belong together."""
    usable, _ = _pool([r for r in rows if r.renderable and r.allowed])
    strong = [r for r in usable if r.semantic_score >= STRONG_MEANING]
    long_ = sorted((r for r in usable if r.duration_s >= budget - DONE_S), key=lambda r: (-r.hard_hits, -r.visual_score, -r.semantic_score, -r.now))
    if long_ and (long_[0].visual_score >= STRONG_VISUAL or long_[0].semantic_score >= STRONG_MEANING or not strong):
        return long_[:1], "single"
    chosen: list = []
    hits: set = set()
    for r in strong or usable:
        if len(chosen) >= most or sum(c.duration_s for c in chosen) >= budget - DONE_S:
            break
        # Later ones share a hit with the first, hit the section's own words or come from a known file.
        own = set(r.hits)
        if chosen and not (own & hits or own & set(r.query_terms) or r.asset_id in {c.asset_id for c in chosen}):
            continue
        chosen.append(r)
        hits = hits or set(r.hits)
    return chosen, "several"


def _fresh_opening(chosen: list, rows: list) -> list:
    """An opening that other tasks have used gives way to the least used alternative, if any is less used."""
    if not chosen or chosen[0].role != "opening" or chosen[0].opening_pressure <= 0:
        return chosen
    taken = {r.shot_id for r in chosen}
    others = [r for r in rows if r.shot_id not in taken and r.renderable and r.allowed and r.opening_pressure < chosen[0].opening_pressure]
    if not others:
        return chosen
    return [min(others, key=lambda r: (r.opening_pressure, -r.hard_hits, -r.visual_score, -r.semantic_score, -r.now)), *chosen[1:]]


def _topped_up(chosen: list, rows: list, budget: float, least: float, most: int) -> list:
    """Clips added while a gap is left: such as go with the first one, else any that may fill up."""
    pool, fallback = _pool(rows)
    rows = rows if fallback else pool
    chosen, seed = list(chosen), chosen[0] if chosen else None
    limit = len(chosen) + most
    while planned_clips(chosen, budget, least)[1] > TOP_UP_S and len(chosen) < limit:
        taken = {r.shot_id for r in chosen}
        free = [r for r in rows if r.shot_id not in taken and r.renderable and r.allowed_top_up]
        fits = [r for r in free if _compatible(seed, r)]
        if not fits and (not free or free[0].packaging):
            break
        chosen.append((fits or free)[0])
    return chosen


def _with_optional(candidates: DataFrame) -> DataFrame:
    for c, (kind, value) in OPTIONAL.items():
        fill = F.array().cast(kind) if value == [] else F.lit(value).cast(kind)
        candidates = candidates.withColumn(c, F.coalesce(F.col(c).cast(kind), fill) if c in candidates.columns else fill)
    return candidates


def fill_sections(chosen: DataFrame, section: str, order: str, least: float = MIN_CLIP_S) -> DataFrame:
    """Clips of candidates that are chosen already: section, shot_id, clip_order, clip_id, offset_s, planned_s, short, gap_s.

    A row is a candidate of a section, taken in ``order`` (unique in it), with shot_id,
    duration_s, budget_s and what it has of OPTIONAL. Candidates, and clips inside of them,
    share one budget; see allocate_runs(). A section without any usable clip has no row.
    """
    rows = _with_optional(chosen).select(
        section, order, F.col("shot_id").cast("string"), F.coalesce(F.col("duration_s").cast("double"), F.lit(0.0)).alias("duration_s"), F.col("budget_s").cast("double"), *OPTIONAL
    )

    # Many sections go in one call; their number follows the input, so that a call's rows don't.
    parts = max(1, -(-rows.count() // AT_ONCE))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(section), F.lit(parts)))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values([section, order]), []
        for key, listed in groupby(group.itertuples(), key=lambda r: getattr(r, section)):
            chosen = list(listed)
            plan, gap = planned_clips(chosen, float(chosen[0].budget_s), least)
            out += [(key, r.shot_id, k, str(clip), at, part, short, gap) for k, (r, clip, at, part, short) in enumerate(plan, start=1)]
        return pd.DataFrame(out, columns=[section, "shot_id", "clip_order", "clip_id", "offset_s", "planned_s", "short", "gap_s"])

    kind = dict(chosen.dtypes)[section]
    return rows.groupBy("_part").applyInPandas(work, f"{section} {kind}, shot_id string, clip_order int, clip_id string, offset_s double, planned_s double, short boolean, gap_s double")


def select_sections(
    candidates: DataFrame, task: str = "task_id", section: str = "section_order", pool: int = 54, least: float = MIN_CLIP_S, most: int = CLIPS
) -> DataFrame:
    """Clips for every section of every task: task, section, shot_id, clip_order, planned_s, adjusted_score, strategy, gap_s, clip_id, offset_s, short.

    Rows are (task, section, shot_id, unit_id, asset_id, score, duration_s, budget_s) and
    what they have of OPTIONAL. ``score`` is scoring.adjusted_score() without the task's
    own reuse, which is paid here, less where a hit is strong. An editor's order is kept as
    given; a planner's is kept but for a used opening and topped up; else rules choose.
    """
    candidates = _with_optional(candidates)
    cols = [task, section, "shot_id", "unit_id", "asset_id", "score", "duration_s", "budget_s", *OPTIONAL]
    ranked = top_k_per_key(candidates.select(*cols, reuse_scale(F.col("visual_score")).alias("reuse_scale")), [task, section], "score", pool, "shot_id")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        use, out = Usage.empty(), []
        for number, rows in group.groupby(section, sort=True):
            rows = rows.copy()
            rows["now"] = [r.score - use.price(r.shot_id, r.unit_id, r.asset_id) * r.reuse_scale - (0 if pd.isna(r.batch_price) else r.batch_price) for r in rows.itertuples()]
            listed = list(rows.sort_values(["now", "shot_id"], ascending=[False, True]).itertuples())
            budget = float(listed[0].budget_s)
            wanted = lambda c: sorted((r for r in listed if not pd.isna(getattr(r, c))), key=lambda r: getattr(r, c))  # noqa: B023, E731  used at once
            chosen, strategy = wanted("override_order"), "override"
            if not chosen:
                chosen, strategy = wanted("planner_order"), "planner"
                if not chosen:
                    chosen, strategy = _choose(listed, budget, most)
                chosen = _topped_up(_fresh_opening(chosen, listed), listed, budget, least, most)
            plan, gap = planned_clips(chosen, budget, least)
            for order, (r, clip, at, part, short) in enumerate(plan, start=1):
                use.add(r.shot_id, r.unit_id, r.asset_id)
                out.append((group[task].iloc[0], number, r.shot_id, order, part, round(r.now, 6), strategy, gap, str(clip), at, short))
        return pd.DataFrame(out, columns=[task, section, "shot_id", "clip_order", "planned_s", "adjusted_score", "strategy", "gap_s", "clip_id", "offset_s", "short"])

    kinds = dict(candidates.dtypes)
    schema = f"{task} {kinds[task]}, {section} {kinds[section]}, shot_id {kinds['shot_id']}, clip_order int, planned_s double, adjusted_score double, strategy string, gap_s double, clip_id string, offset_s double, short boolean"
    return ranked.groupBy(task).applyInPandas(work, schema)


def usage_facts(picks: DataFrame, batch: str, task: str, **kinds: str) -> DataFrame:
    """(batch, task, kind, key, n) of picks; kinds name a column each."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in kinds.items()])
    return (
        picks.select(batch, task, F.explode(rows).alias("_k"))
        .select(batch, task, "_k.kind", "_k.key").filter("key IS NOT NULL AND key <> ''")
        .groupBy(batch, task, "kind", "key").agg(F.count("*").alias("n"))
    )


def replace_tasks(facts: DataFrame, new: DataFrame, batch: str, task: str) -> DataFrame:
    """Facts with the new tasks' rows in place of their old ones; doing it again changes nothing."""
    return facts.join(new.select(batch, task).distinct(), [batch, task], "left_anti").unionByName(new)


def parts_of(rows: DataFrame, rows_a_task: int = ROWS_A_TASK) -> int:
    """Tasks for rows of a table, so that what a task holds does not grow with the table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, -(-rows.count() // rows_a_task))


def totals(facts: DataFrame, batch: str) -> DataFrame:
    return facts.groupBy(batch, "kind", "key").agg(F.sum("n").alias("n"))


def others(facts: DataFrame, batch: str, task: str, parts: int | None = None) -> DataFrame:
    """For every task the counts of all other tasks of its batch, for the keys that it uses.

    With ``parts`` facts are dealt to as many tasks, for the totals and the join at once.
    """
    if parts:
        facts = facts.repartition(parts, batch, "kind", "key")
    whole = totals(facts, batch).withColumnRenamed("n", "_all")
    return facts.join(whole, [batch, "kind", "key"]).select(batch, task, "kind", "key", (F.col("_all") - F.col("n")).alias("n_others"))


def valid_plans(plans: DataFrame, pool: DataFrame, task: str, section: str, row_id: str = "shot_id") -> DataFrame:
    """Planned ids of sections whose ids are all in the pool; a section with one unknown id has none."""
    known = pool.select(task, section, row_id).distinct().withColumn("_k", F.lit(True))
    joined = plans.join(known, [task, section, row_id], "left")
    ok = F.min(F.coalesce("_k", F.lit(False)).cast("int")).over(Window.partitionBy(task, section)) == 1
    return joined.withColumn("_ok", ok).filter("_ok").drop("_ok", "_k")


def confidence(picks: DataFrame, keys: list[str]) -> DataFrame:
    """A section's confidence from 0 to 0.98: keys, confidence, n_clips.

    Rows have score, hit, gap_s, strategy, override and hard_subtitle_risk. It rises with
    the mean score and the share of clips with a hit, an editor's choice has a floor, and
    burnt-in texts and a gap lower it.
    """
    base = 0.52 + F.least(F.lit(0.24), F.greatest(F.lit(0.0), F.avg("score")) * 0.18) + F.avg(F.col("hit").cast("int")) * 0.12
    base = base + F.when(F.bool_or(F.col("strategy") == "single"), 0.08).otherwise(0.0)
    base = F.when(F.bool_or("override"), F.greatest(base, F.lit(0.78))).otherwise(base)
    risk = lambda r, cost: F.when(F.bool_or(F.coalesce(F.col("hard_subtitle_risk") == r, F.lit(False))), cost).otherwise(0.0)
    gap = F.max("gap_s")
    raw = base - risk("medium", 0.08) - risk("high", 0.2) - F.when(gap > 0, F.least(F.lit(0.35), gap * 0.06 + 0.12)).otherwise(0.0)
    return picks.groupBy(*keys).agg(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(0.98), raw)), 3).alias("confidence"), F.count("*").alias("n_clips"))


def selection_summary(picks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and sums of a selection."""
    return picks.groupBy(*keys).agg(
        F.count("*").alias("n_clips"), F.countDistinct("shot_id").alias("n_shots"), F.round(F.sum("planned_s"), 3).alias("planned_s"),
        (F.count("*") - F.countDistinct("shot_id")).alias("n_repeats"), F.round(F.max("gap_s"), 3).alias("max_gap_s"),
    )


def role_order_ok(timeline: DataFrame, plan: str, order: str, role: str, first: str = "product", then: str = "cta") -> DataFrame:
    """Whether the first ``then`` comes after the first ``first``; true without a ``then``."""
    at = lambda r: F.min(F.when(F.col(role) == r, F.col(order)))
    return timeline.groupBy(plan).agg((at(then).isNull() | F.coalesce(at(then) > at(first), F.lit(False))).alias("in_order"))
