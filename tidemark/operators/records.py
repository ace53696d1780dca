"""Smaller operators on the record tables: assets, children, terms, scenes, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as X
from ..functions.scoring import child_score
from .clips import late_lean, order_hint, proof_order
from .intervals import overlap_join


def assets(documents: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """One row per video document; a probe's values stand in for those that it lacks."""
    out = documents.select(
        F.concat_ws("_", F.lit("asset"), F.coalesce("id", "asset_id")).alias("asset_id"), C.product("product", "product").alias("product"), "duration_s"
    )
    if media is None:
        return out
    m = media.select("asset_id", F.col("media.duration_s").alias("_d"), F.col("media.fps").alias("fps"))
    return out.join(m, "asset_id", "left").withColumn("duration_s", C.first_positive("duration_s", "_d")).drop("_d")


def child_records(rows: DataFrame) -> DataFrame:
    """Children with defaults for what they lack, and ranges as two columns."""
    pair = C.time_range("time_range", "start_s", "end_s")
    usable = C.time_range("usable_range", F.get(pair, 0), F.get(pair, 1))
    text = lambda n: F.coalesce(F.col(n), F.lit("")).alias(n)
    return rows.select(
        "shot_id", "parent_shot_id", F.get(pair, 0).alias("start_s"), F.get(pair, 1).alias("end_s"), F.get(usable, 0).alias("usable_start"), F.get(usable, 1).alias("usable_end"),
        F.coalesce(C.first_positive("clip_actual_duration_s", "duration_s"), F.get(pair, 1) - F.get(pair, 0)).alias("duration_s"),
        text("visual_summary"), text("source_meaning"), F.coalesce("visual_actions", F.array().cast("array<string>")).alias("visual_actions"),
        C.first_nonblank("duplicate_status", default=F.lit("unique")).alias("duplicate_status"),
    )


def section_terms(sections: DataFrame, key: str, lexicon: list[str], fields: dict[str, float], keywords: str = "keywords", keyword_weight: float = 1.05, token_most: float = 0.55) -> DataFrame:
    """Weighted terms of sections, the heaviest weight of each: key, term, weight.

    Lexicon terms count with their field's weight, other pieces of a field with at most
    ``token_most``, key words with their own.
    """
    lex = F.array(*[F.lit(t) for t in lexicon]).cast("array<string>")
    pairs = lambda terms, w: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("weight")))
    lists = [pairs(F.col(keywords), keyword_weight)]
    for c, w in fields.items():
        lists += [pairs(X.term_hits(F.coalesce(c, F.lit("")), lex), w), pairs(X.query_terms(F.coalesce(c, F.lit(""))), min(w, token_most))]
    none = F.array().cast("array<struct<term:string,weight:double>>")
    every = F.concat(*[F.coalesce(x.cast("array<struct<term:string,weight:double>>"), none) for x in lists])
    rows = sections.select(key, F.explode(every).alias("_t")).select(key, F.trim("_t.term").alias("term"), "_t.weight")
    return rows.filter(F.length("term") >= 2).groupBy(key, "term").agg(F.max("weight").alias("weight"))


def admitted(hits: Column, forbidden: Column, strict: bool = True) -> Column:
    """Whether a section takes a candidate: none forbidden and, strictly, some hit."""
    ok = F.size(forbidden) == 0
    return ok & (F.size(hits) > 0) if strict else ok


def rank_children(children: DataFrame, keys: list[str], hard_required: str = "hard_required") -> DataFrame:
    """Children of candidates by child_score, best first, ties in their own order: adds child_score and rank.

    Rows have shot_id, idx and child_score()'s parts by name, except the places, which are
    found here from ``idx``, ``anchor`` and ``proof_anchor`` (0 to 1 or null). Where a hard
    hit is required and some child of the group has one, only such children are ranked.
    ``n_soft_hits``, the hits without the hard ones, decides whether a proof leans late; without
    it all hits do.
    """
    w = Window.partitionBy(*keys)
    rows = children.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("idx")) - 1})
    soft = F.col("n_soft_hits" if "n_soft_hits" in children.columns else "n_hits")
    late = F.when(
        (F.col("role") == "proof") & (soft == 0) & (F.col("n_parent_hits") > 0) & ~F.col("verified"), late_lean(F.col("_i"), F.col("_n"))
    ).otherwise(0.0)
    rows = rows.withColumn(
        "child_score",
        child_score(
            F.col("semantic"), F.col("n_hard_hits"), F.col("n_hits"), F.col("n_parent_hits"), F.col("verified"),
            order_hint(F.col("_i"), F.col("_n"), F.col("anchor")), proof_order(F.col("_i"), F.col("_n"), F.when(F.col("role") == "proof", F.col("proof_anchor"))), late,
            F.col("duration_s"), F.col("target_s"), F.col("role"), F.col("opening_reuse"), F.col("duplicate_status"), F.col("hard_subtitle_risk"),
        ),
    )
    only_hard = F.col(hard_required) & (F.max("n_hard_hits").over(w) > 0)
    rows = rows.withColumn("_only", only_hard).filter(~F.col("_only") | (F.col("n_hard_hits") > 0))
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("child_score"), "idx"))).drop("_n", "_i", "_only")


def choose_child(children: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """The child that a candidate begins with: keys, shot_id, by ("planner" or "score").

    A planner's child (the first with ``preferred``) is taken, unless the best by score is
    another one and: hard hits are required, some child has one and it has none; a proof's
    words stand in its parent's text alone; other openings have it; it is a strong duplicate.
    """
    best = ranked.filter("rank = 1").select(*keys, F.col("shot_id").alias("_best"))
    row = F.struct(
        "shot_id",
        (
            (F.col("hard_required") & F.col("has_terms") & (F.col("n_hard_hits") == 0) & F.col("_any_hard"))
            | ((F.col("role") == "proof") & F.col("has_terms") & (F.col("n_parent_hits") > 0) & (F.col("n_hits") == 0))
            | ((F.col("role") == "opening") & (F.col("opening_reuse") > 0))
            | F.coalesce(F.col("duplicate_status") == "strong_duplicate", F.lit(False))
        ).alias("veto"),
    )
    any_hard = F.max("n_hard_hits").over(Window.partitionBy(*keys)) > 0
    wish = children.withColumn("_any_hard", any_hard).filter("preferred").groupBy(*keys).agg(F.min_by(row, "idx").alias("_w"))
    vetoed = F.col("_w.veto") & F.col("_best").isNotNull() & (F.col("_best") != F.col("_w.shot_id"))
    kept = F.col("_w").isNotNull() & ~F.coalesce(vetoed, F.lit(False))
    return best.join(wish, keys, "full").select(
        *keys, F.when(kept, F.col("_w.shot_id")).otherwise(F.col("_best")).alias("shot_id"), F.when(kept, "planner").otherwise("score").alias("by")
    )


def scene_cuts(times: Column, least: float = 0.25) -> Column:
    """Distinct cut times after the very start, in order."""
    return F.array_sort(F.array_distinct(F.filter(times, lambda t: t > least)))


def scene_bounds(units: DataFrame, scenes: DataFrame, key: str = "asset_id") -> DataFrame:
    """Units moved to the bounds of the scenes that they cover, where those make a full range.

    Scenes have idx, start_s and end_s; units keep their own bounds otherwise.
    """
    left = units.select(key, "unit_id", F.col("start_s").alias("l_start"), F.col("end_s").alias("l_end"))
    right = scenes.select(key, "idx", F.col("start_s").alias("r_start"), F.col("end_s").alias("r_end"))
    hit = overlap_join(left, right, key).groupBy("unit_id").agg(
        F.min("r_start").alias("_s"), F.max("r_end").alias("_e"), (F.max("idx") - F.min("idx") + 1 == F.countDistinct("idx")).alias("contiguous")
    )
    out = units.join(hit, "unit_id", "left")
    ok = F.coalesce("contiguous", F.lit(False))
    return out.withColumns({"start_s": F.when(ok, F.col("_s")).otherwise(F.col("start_s")), "end_s": F.when(ok, F.col("_e")).otherwise(F.col("end_s"))}).drop("_s", "_e")


def previous(df: DataFrame, keys: list[str], order: str, value: str, n: int = 8) -> DataFrame:
    """before: the values of the n rows before, in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("before", F.collect_list(value).over(w))


def all_done(shots: DataFrame, results: DataFrame, key: str = "shot_id") -> DataFrame:
    """One row: whether every shot has an ok result with an address."""
    good = results.filter("status = 'ok' AND url <> ''").select(key).distinct().withColumn("_ok", F.lit(True))
    return shots.join(good, key, "left").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.coalesce("_ok", F.lit(False))), F.lit(False)).alias("complete"))


def dedupe_summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("status").agg(F.count("*").alias("n_groups"), F.sum("n_members").alias("n_members"))


def run_rollup(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """A run's counts and warnings, from rows with uploaded, trimmed, channels_failed and needs_refine."""
    out = rows.groupBy(run).agg(
        F.count("*").alias("n_rows"), F.count_if("uploaded").alias("n_uploaded"), F.count_if("trimmed").alias("n_trimmed"),
        F.sum("channels_failed").alias("n_channels_failed"), F.count_if("needs_refine").alias("n_to_refine"),
    )
    tests = {"uploads are missing": F.col("n_uploaded") < F.col("n_rows"), "channels failed": F.col("n_channels_failed") > 0, "rows wait for refinement": F.col("n_to_refine") > 0}
    return out.withColumn("warnings", F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull()))
