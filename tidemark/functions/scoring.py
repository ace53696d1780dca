"""Scores of candidates: bonuses, penalties and the reasons for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import term_hits


def role_hits(text: Column, query: Column, role: Column) -> Column:
    """Key words of a role that the record's text or the query holds."""
    lists = F.create_map(*[x for r, ws in K.ROLE_KEYWORDS.items() for x in (F.lit(r), F.array(*[F.lit(w) for w in ws]))])
    words = F.coalesce(F.try_element_at(lists, role), F.array().cast("array<string>"))
    return term_hits(F.concat_ws(" ", text, query), words)


def role_bonus(hits: Column) -> Column:
    return F.least(F.lit(0.12), F.lit(0.035) * F.size(hits))


def keyword_hits(text: Column, query: Column) -> Column:
    terms = F.filter(F.split(F.regexp_replace(query, "[，,]", " "), r"\s+"), lambda t: F.length(t) >= 2)
    return term_hits(text, terms)


def keyword_bonus(hits: Column) -> Column:
    return F.least(F.lit(0.08), F.lit(0.025) * F.size(hits))


def _lookup(table: dict[str, float], c: Column) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.coalesce(c, F.lit("unknown"))), F.lit(0.0))


def risk_adjustment(subtitle: Column, voice: Column) -> Column:
    return _lookup(K.SUBTITLE_RISK, subtitle) + _lookup(K.VOICE_FIT, voice)


def standalone_bonus(can: Column, role: Column) -> Column:
    return F.when(F.coalesce(can, F.lit(False)) & role.isin(*K.STANDALONE_ROLES), 0.04).otherwise(0.0)


def duration_adjustment(duration: Column, target: Column) -> Column:
    """Near the target is better; far above it and missing are worse."""
    d = F.coalesce(duration, F.lit(0.0))
    return (
        F.when(target <= 0, 0.0).when(d <= 0, -0.08).when(F.abs(d - target) <= 0.8, 0.06)
        .when(d > target * 2.2, -0.04).otherwise(0.0)
    )


def duration_score(duration: Column, target: Column) -> Column:
    """Long enough is good, far longer a little less so; short costs by what is missing."""
    d, t = F.coalesce(duration, F.lit(0.0)), F.coalesce(target, F.lit(0.0))
    long_ = 0.18 - F.least(F.lit(0.08), (d - t) * 0.01)
    return F.when((d <= 0) | (t <= 0), -0.2).when(d >= t, long_).otherwise(-0.22 * (1 - d / F.when(t > 0, t)))


def semantic_bonus(weights: Column) -> Column:
    """From the weights of the terms that hit."""
    return F.least(F.lit(0.34), F.lit(0.045) * F.aggregate(weights, F.lit(0.0), lambda s, w: s + w))


def visual_score(hits: Column, lexicon: Column) -> Column:
    """1.25 for a term of the lexicon, 0.8 for another."""
    return F.aggregate(hits, F.lit(0.0), lambda s, t: s + F.when(F.array_contains(lexicon, t), 1.25).otherwise(0.8))


def reuse_scale(score: Column) -> Column:
    """A strong visual hit makes reuse cheaper."""
    return F.when(score >= 3.0, 0.35).when(score >= 1.25, 0.65).otherwise(1.0)


def reuse_penalty(shot: Column, unit: Column, asset: Column, scale: Column) -> Column:
    """For earlier uses in the same task."""
    return (shot * 0.46 + unit * 0.58 + asset * 0.055) * scale


def batch_penalty(unit: Column, asset: Column, opening_unit: Column, opening_asset: Column, role: Column, scale: Column) -> Column:
    """For uses in the batch's other tasks; openings count more."""
    opening = F.when(role == "opening", opening_unit * 0.92 + opening_asset * 0.18).otherwise(0.0)
    return (unit * 0.05 + asset * 0.018 + opening) * scale


def opening_pressure(unit: Column, asset: Column) -> Column:
    return unit * 4 + asset


def duplicate_penalty(strong: Column, near: Column) -> Column:
    return F.least(F.lit(0.18), strong * 0.035 + near * 0.012)


def adjusted_score(
    score: Column, duration_part: Column, visual: Column, visual_hits: Column, child_terms: Column, needs_child: Column,
    semantic: Column, role: Column, reuse: Column, batch: Column, subtitle: Column, semantic_hits: Column,
    forbidden: Column, theme_ok: Column, has_themes: Column, duplicates: Column,
) -> Column:
    """A candidate's score for a section, from its parts; counts are numbers of hits."""
    child = F.when(child_terms > 0, F.least(F.lit(0.72), 0.28 + child_terms * 0.12)).when(needs_child, -0.22).otherwise(0.0)
    meaning = F.when(semantic > 0, semantic).when(role.isin("proof", "product", "cta"), -0.08).otherwise(0.0)
    burnt = (
        F.when(subtitle == "medium", F.when(semantic_hits >= 2, -0.035).otherwise(-0.06)).when(subtitle == "high", -0.14)
        .otherwise(0.0)
    )
    return F.bround(
        score + duration_part
        + F.when(visual_hits > 0, F.least(F.lit(0.42), visual * 0.075)).otherwise(0.0)
        + child + meaning - reuse - batch + burnt
        - F.when(forbidden > 0, 1.4).otherwise(0.0)
        + F.when(~theme_ok, -1.6).when(has_themes, 0.18).otherwise(0.0)
        - duplicates,
        6,
    )


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold, in the given order."""
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def first_reason(**tests: Column) -> Column:
    return F.get(reasons(**tests), 0)


def product_matches(name: Column, slug: Column, wanted: str) -> Column:
    """Either holds the other; a record without a name is of every product."""
    if not wanted:
        return F.lit(True)
    n, s, w = F.coalesce(name, F.lit("")), F.coalesce(slug, F.lit("")), F.lit(wanted)
    return F.contains(n, w) | F.contains(s, w) | F.contains(w, n)


def passes_slot(score: Column, text: Column, least: Column, any_of: Column, none_of: Column) -> Column:
    """A slot's filters; null least and empty lists don't filter."""
    return (
        (least.isNull() | (score >= least))
        & ((F.size(any_of) == 0) | F.exists(any_of, lambda t: F.contains(text, t)))
        & ~F.exists(none_of, lambda t: F.contains(text, t))
    )


def theme_verdict(text: Column, required: Column, forbidden: Column) -> Column:
    """A theme contract: allowed, the themes that the text lacks and the forbidden terms that it has.

    required is a map of theme to its terms.
    """
    missing = F.map_keys(F.map_filter(required, lambda k, ts: ~F.exists(ts, lambda t: F.contains(text, t))))
    bad = term_hits(text, forbidden)
    return F.struct(((F.size(missing) == 0) & (F.size(bad) == 0)).alias("allowed"), missing.alias("missing"), bad.alias("forbidden"))


def is_renderable(path: Column, duration: Column) -> Column:
    return (F.coalesce(path, F.lit("")) != "") & (F.coalesce(duration, F.lit(0.0)) > 0)


def is_verified(precision: Column, policy: Column, needs_refine: Column) -> Column:
    """Whether a child's own text may be trusted: it is neither its parent's nor still to be refined."""
    precision = F.trim(F.coalesce(precision, F.lit("")))
    inherited = precision.isin(*K.INHERITED_TEXT) | (F.trim(F.coalesce(policy, F.lit(""))) == K.UNREFINED_POLICY)
    return ~inherited & (~F.coalesce(needs_refine, F.lit(False)) | precision.isin(*K.EXACT_TEXT))


def loop_enabled(flag: Column, policy: Column, render_policy: Column | None = None) -> Column:
    """Whether a clip may loop: by its flag, or by a policy that names loops and does not forbid them."""
    named = F.when(F.coalesce(policy, F.lit("")) != "", policy)
    p = F.lower(F.coalesce(named, *([render_policy] if render_policy is not None else []), F.lit("")))
    off = F.lit(False)
    for marker in K.NO_LOOP:
        off = off | F.contains(p, F.lit(marker))
    return F.coalesce(flag, F.lit(False)) | (F.contains(p, F.lit("loop")) & ~off)


def valid_url(c: Column) -> Column:
    """An address of a stored video: K.STORE at its start, long enough, of one word, a video by its end."""
    u = F.trim(c)
    ends = F.lit(False)
    for suffix in K.VIDEO_SUFFIXES:
        ends = ends | F.endswith(F.lower(u), F.lit(suffix))
    return F.coalesce((F.length(u) >= K.STORE_LEAST) & u.rlike(rf"\A{K.STORE}\S+\z") & ends, F.lit(False))


def child_score(
    semantic: Column, hard_hits: Column, hits: Column, parent_hits: Column, verified: Column, order: Column, proof_order: Column, late: Column,
    duration: Column, target: Column, role: Column, opening_reuse: Column, duplicate: Column, subtitle: Column,
) -> Column:
    """A child's score inside its candidate, from counts of hits, places, lengths, reuse and risks.

    ``order``, ``proof_order`` and ``late`` are order_hint(), proof_order() and late_lean()
    of clips; ``duplicate`` is a status, ``opening_reuse`` how often openings have it.
    """
    hard, d = hard_hits, F.coalesce(duration, F.lit(0.0))
    dup = lambda with_hit, without: F.when(hard > 0, with_hit).otherwise(without)
    return F.bround(
        semantic
        + F.when(hard > 0, 1.8 + F.least(F.lit(1.6), hard * 0.42)).otherwise(0.0)
        + order + proof_order + late
        - F.when((parent_hits > 0) & (hits == 0), 0.28).otherwise(0.0)
        - F.when(verified, 0.0).otherwise(0.08)
        + F.when(target > 0, duration_score(d, F.least(target, F.greatest(d, F.lit(0.1)))) * 0.35).otherwise(0.0)
        - F.when((role == "opening") & (opening_reuse > 0), F.least(F.lit(1.4), opening_reuse * 0.72)).otherwise(0.0)
        - F.when(duplicate == "strong_duplicate", dup(0.22, 0.86)).when(duplicate == "near_duplicate_candidate", dup(0.08, 0.24)).otherwise(0.0)
        - F.when(subtitle == "high", 0.35).when(subtitle == "medium", 0.12).otherwise(0.0),
        6,
    )


def valid_slug(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-z0-9](?:[a-z0-9_-]{0,62}[a-z0-9])?$"), F.lit(False))
