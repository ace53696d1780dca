"""Queries of scoring, clip, selection and time rules; each stands beside its SQL.

Events and order lines stand in for clips: their numbers become counts of hits, lengths
and places, so that every branch of a rule is met.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as G
from ..operators import clips as C
from ..operators import intervals as I
from ..operators import records as R
from ..operators import selection as S
from ..operators import topk as K
from .queries import long, query, t


def _mod(c: str, n: int, less: int = 0):
    return (F.col(c) % n - less).cast("int")


# Scores

_E = "event_id, user_id, value, event_type"


@query("""
    SELECT event_id, round(CASE WHEN d <= 0 OR t <= 0 THEN -0.2 WHEN d >= t THEN 0.18 - least(0.08, (d - t) * 0.01) ELSE -0.22 * (1 - d / t) END::DOUBLE, 9) AS score
    FROM (SELECT event_id, value / 40 AS d, (event_id % 9)::DOUBLE AS t FROM events)""")
def score_duration(spark, d):
    return t(spark, d, "events").select("event_id", F.round(G.duration_score(F.col("value") / 40, _mod("event_id", 9).cast("double")), 9).alias("score"))


@query("""
    SELECT event_id, round(least(0.34, 0.045 * (w1 + w2))::DOUBLE, 9) AS semantic, round(least(0.12, 0.035 * n)::DOUBLE, 9) AS role_bonus,
           round(least(0.08, 0.025 * n)::DOUBLE, 9) AS keyword, round((1.25 * least(n, 2) + 0.8 * greatest(n - 2, 0))::DOUBLE, 9) AS visual,
           (4 * n + event_id % 3)::BIGINT AS pressure, round(least(0.18, 0.035 * n + 0.012 * (event_id % 3))::DOUBLE, 9) AS duplicates
    FROM (SELECT event_id, event_id % 5 AS n, value / 100 AS w1, (event_id % 4)::DOUBLE AS w2 FROM events)""")
def score_parts(spark, d):
    e = t(spark, d, "events")
    n = _mod("event_id", 5)
    hits = F.slice(F.array(*[F.lit(x) for x in "abcde"]), 1, n)
    return e.select(
        "event_id", F.round(G.semantic_bonus(F.array(F.col("value") / 100, _mod("event_id", 4).cast("double"))), 9).alias("semantic"),
        F.round(G.role_bonus(hits), 9).alias("role_bonus"), F.round(G.keyword_bonus(hits), 9).alias("keyword"),
        F.round(G.visual_score(hits, F.array(F.lit("a"), F.lit("b"))), 9).alias("visual"), long(G.opening_pressure(n, _mod("event_id", 3))).alias("pressure"),
        F.round(G.duplicate_penalty(n, _mod("event_id", 3)), 9).alias("duplicates"),
    )


@query("""
    SELECT event_id, round(CASE WHEN v >= 3 THEN 0.35 WHEN v >= 1.25 THEN 0.65 ELSE 1 END * (a * 0.46 + b * 0.58 + c * 0.055)::DOUBLE, 6) AS reuse,
           round(CASE WHEN v >= 3 THEN 0.35 WHEN v >= 1.25 THEN 0.65 ELSE 1 END * (a * 0.05 + b * 0.018 + CASE WHEN event_type = 'click' THEN a * 0.92 + b * 0.18 ELSE 0 END)::DOUBLE, 6) AS batch
    FROM (SELECT event_id, event_type, value / 100 AS v, event_id % 3 AS a, event_id % 4 AS b, event_id % 5 AS c FROM events)""")
def score_reuse(spark, d):
    scale = G.reuse_scale(F.col("value") / 100)
    a, b, c = (_mod("event_id", n) for n in (3, 4, 5))
    role = F.when(F.col("event_type") == "click", "opening").otherwise("proof")
    return t(spark, d, "events").select("event_id", F.round(G.reuse_penalty(a, b, c, scale), 6).alias("reuse"), F.round(G.batch_penalty(a, b, a, b, role, scale), 6).alias("batch"))


@query("""
    WITH e AS (
      SELECT event_id, value / 200 AS score, (event_id % 3) * 0.02 AS dur, (event_id % 7) * 0.9 AS visual, event_id % 7 AS vh, event_id % 4 AS ct, event_id % 5 = 0 AS needs,
             (event_id % 6) * 0.05 AS sem, ['opening', 'proof', 'product', 'cta', 'transition'][(event_id % 5) + 1] AS role, (event_id % 8) * 0.1 AS reuse, (event_id % 9) * 0.03 AS batch,
             ['none', 'medium', 'high'][(event_id % 3) + 1] AS subtitle, event_id % 4 AS sh, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS forbidden, event_id % 13 <> 0 AS theme_ok,
             event_id % 2 = 0 AS themes, (event_id % 10) * 0.01 AS dup FROM events)
    SELECT event_id, round((score + dur + CASE WHEN vh > 0 THEN least(0.42, visual * 0.075) ELSE 0 END
        + CASE WHEN ct > 0 THEN least(0.72, 0.28 + ct * 0.12) WHEN needs THEN -0.22 ELSE 0 END
        + CASE WHEN sem > 0 THEN sem WHEN role IN ('proof', 'product', 'cta') THEN -0.08 ELSE 0 END - reuse - batch
        + CASE subtitle WHEN 'medium' THEN CASE WHEN sh >= 2 THEN -0.035 ELSE -0.06 END WHEN 'high' THEN -0.14 ELSE 0 END
        - CASE WHEN forbidden > 0 THEN 1.4 ELSE 0 END + CASE WHEN NOT theme_ok THEN -1.6 WHEN themes THEN 0.18 ELSE 0 END - dup)::DOUBLE, 6) AS score FROM e""")
def score_adjusted(spark, d):
    i = lambda n, by=1.0: F.col("event_id") % n * by
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % len(xs) + 1).cast("int"))
    score = G.adjusted_score(
        F.col("value") / 200, i(3, 0.02), i(7, 0.9), i(7), i(4), i(5) == 0, i(6, 0.05), pick(["opening", "proof", "product", "cta", "transition"]), i(8, 0.1), i(9, 0.03),
        pick(["none", "medium", "high"]), i(4), F.when(i(11) == 0, 2).otherwise(0), i(13) != 0, i(2) == 0, i(10, 0.01),
    )
    return t(spark, d, "events").select("event_id", score.alias("score"))


def _children(spark, d):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % len(xs) + 1).cast("int"))
    n = F.col("event_id")
    return t(spark, d, "events").select(
        F.col("user_id").alias("candidate"), n.alias("shot_id"), n.alias("idx"), F.when(F.col("user_id") % 3 == 0, "proof").when(F.col("user_id") % 3 == 1, "opening").otherwise("product").alias("role"),
        (F.col("user_id") % 5).cast("double").alias("target_s"), (n % 4 * 0.5).alias("semantic"), F.when(n % 6 == 0, n % 5).otherwise(0).alias("n_hard_hits"), (n % 3).alias("n_hits"), (n % 2).alias("n_parent_hits"),
        (n % 7 != 0).alias("verified"), F.when(n % 4 != 0, n % 11 / 10).alias("anchor"), F.when(n % 5 != 0, n % 9 / 8).alias("proof_anchor"), F.round(F.col("value") / 50, 1).alias("duration_s"),
        (n % 4).alias("opening_reuse"), pick(["unique", "strong_duplicate", "near_duplicate_candidate", "unique", "unique"]).alias("duplicate_status"), pick(["low", "medium", "high"]).alias("hard_subtitle_risk"),
        (F.col("user_id") % 2 == 0).alias("hard_required"), F.lit(True).alias("has_terms"), (n % 8 == 0).alias("preferred"),
    )


_KIDS = """
    k AS (
      SELECT user_id AS candidate, event_id AS shot_id, ['proof', 'opening', 'product'][(user_id % 3) + 1] AS role, (user_id % 5)::DOUBLE AS tgt, (event_id % 4) * 0.5 AS semantic,
             CASE WHEN event_id % 6 = 0 THEN event_id % 5 ELSE 0 END AS hard, event_id % 3 AS hits, event_id % 2 AS parent_hits, event_id % 7 <> 0 AS verified,
             CASE WHEN event_id % 4 <> 0 THEN (event_id % 11) / 10.0::DOUBLE END AS anchor, CASE WHEN event_id % 5 <> 0 THEN (event_id % 9) / 8.0::DOUBLE END AS panchor, round(value / 50, 1) AS dur,
             event_id % 4 AS reuse, ['unique', 'strong', 'near', 'unique', 'unique'][(event_id % 5) + 1] AS dup, ['low', 'medium', 'high'][(event_id % 3) + 1] AS sub,
             user_id % 2 = 0 AS required, event_id % 8 = 0 AS preferred, count(*) OVER w AS n, row_number() OVER (w ORDER BY event_id) - 1 AS i, max(CASE WHEN event_id % 6 = 0 THEN event_id % 5 ELSE 0 END) OVER w > 0 AS any_hard
      FROM events WINDOW w AS (PARTITION BY user_id)),
    m AS (SELECT *, least(tgt, greatest(dur, 0.1)) AS lim FROM k),
    s AS (
      SELECT *, round_even((semantic + CASE WHEN hard > 0 THEN 1.8 + least(1.6, hard * 0.42) ELSE 0 END
        + CASE WHEN n > 1 AND anchor IS NOT NULL THEN greatest(0, 0.42 - abs((i + 0.5) / n - anchor)) * 0.45 ELSE 0 END
        + CASE WHEN n > 1 AND role = 'proof' AND panchor IS NOT NULL THEN greatest(0, 0.62 - abs((i + 0.5) / n - panchor)) * 0.9 ELSE 0 END
        + CASE WHEN role = 'proof' AND hits = 0 AND parent_hits > 0 AND NOT verified AND n > 1 THEN i / greatest(1, n - 1) * 0.9 - (1 - i / greatest(1, n - 1)) * 0.4 ELSE 0 END
        - CASE WHEN parent_hits > 0 AND hits = 0 THEN 0.28 ELSE 0 END - CASE WHEN verified THEN 0 ELSE 0.08 END
        + CASE WHEN tgt > 0 THEN 0.35 * CASE WHEN dur <= 0 THEN -0.2 WHEN dur >= lim THEN 0.18 - least(0.08, (dur - lim) * 0.01) ELSE -0.22 * (1 - dur / lim) END ELSE 0 END
        - CASE WHEN role = 'opening' AND reuse > 0 THEN least(1.4, reuse * 0.72) ELSE 0 END
        - CASE dup WHEN 'strong' THEN CASE WHEN hard > 0 THEN 0.22 ELSE 0.86 END WHEN 'near' THEN CASE WHEN hard > 0 THEN 0.08 ELSE 0.24 END ELSE 0 END
        - CASE sub WHEN 'high' THEN 0.35 WHEN 'medium' THEN 0.12 ELSE 0 END)::DOUBLE, 6) AS score FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, shot_id) AS rank FROM s WHERE NOT (required AND any_hard) OR hard > 0)"""


@query(f"WITH {_KIDS} SELECT candidate, shot_id, score FROM r")
def score_children(spark, d):
    return R.rank_children(_children(spark, d), ["candidate"]).select("candidate", "shot_id", F.col("child_score").alias("score"))


@query(f"""
    WITH {_KIDS},
    b AS (SELECT candidate, shot_id AS best FROM r WHERE rank = 1),
    w AS (
      SELECT candidate, arg_min(shot_id, shot_id) AS wish,
             arg_min((required AND hard = 0 AND any_hard) OR (role = 'proof' AND parent_hits > 0 AND hits = 0) OR (role = 'opening' AND reuse > 0) OR dup = 'strong', shot_id) AS veto
      FROM s WHERE preferred GROUP BY candidate)
    SELECT candidate, CASE WHEN wish IS NOT NULL AND NOT (veto AND best <> wish) THEN wish ELSE best END AS shot_id,
           CASE WHEN wish IS NOT NULL AND NOT (veto AND best <> wish) THEN 'planner' ELSE 'score' END AS by FROM b FULL JOIN w USING (candidate)""")
def choose_child(spark, d):
    kids = _children(spark, d)
    return R.choose_child(kids, R.rank_children(kids, ["candidate"]), ["candidate"])


@query("""
    WITH p AS (
      SELECT user_id, event_id % 3 = 0 AS hit, value / 100 - 1 AS score, CASE WHEN user_id % 4 = 0 THEN (user_id % 7)::DOUBLE ELSE 0 END AS gap, user_id % 3 = 0 AS single, user_id % 5 = 0 AS override,
             ['low', 'medium', 'high'][(event_id % 3) + 1] AS sub FROM events),
    g AS (
      SELECT user_id, count(*) AS n_clips, max(gap) AS gap, bool_or(override) AS override, bool_or(sub = 'medium') AS medium, bool_or(sub = 'high') AS high,
             0.52 + least(0.24, greatest(0, avg(score)) * 0.18) + avg(hit::INT) * 0.12 + CASE WHEN bool_or(single) THEN 0.08 ELSE 0 END AS base FROM p GROUP BY user_id)
    SELECT user_id, n_clips, round_even(greatest(0, least(0.98, CASE WHEN override THEN greatest(base, 0.78) ELSE base END - CASE WHEN medium THEN 0.08 ELSE 0 END - CASE WHEN high THEN 0.2 ELSE 0 END
           - CASE WHEN gap > 0 THEN least(0.35, gap * 0.06 + 0.12) ELSE 0 END))::DOUBLE, 3) AS confidence FROM g""")
def score_confidence(spark, d):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % len(xs) + 1).cast("int"))
    p = t(spark, d, "events").select(
        "user_id", (F.col("value") / 100 - 1).alias("score"), (F.col("event_id") % 3 == 0).alias("hit"), F.when(F.col("user_id") % 4 == 0, (F.col("user_id") % 7).cast("double")).otherwise(0.0).alias("gap_s"),
        F.when(F.col("user_id") % 3 == 0, "single").otherwise("several").alias("strategy"), (F.col("user_id") % 5 == 0).alias("override"), pick(["low", "medium", "high"]).alias("hard_subtitle_risk"),
    )
    return S.confidence(p, ["user_id"])


# Predicates


@query(r"""
    SELECT event_id, NOT (p IN ('parent_context_only', 'parent_story_unit_inherited') OR policy = 'video_only_until_child_vlm_refine')
             AND (event_id % 2 = 0 OR p IN ('child_vlm_refined', 'child_verified', 'highlight_overlap', 'story_unit_exact')) AS verified,
           event_id % 17 = 0 OR (contains(lower(loop), 'loop') AND NOT regexp_matches(lower(loop), 'disabled|no_loop|without_loop|loop disabled')) AS loops,
           length(url) >= 80 AND regexp_matches(url, '^oss://\S+$') AND regexp_matches(lower(url), '\.(mp4|mov|m4v|avi|webm)$') AS url_ok, regexp_matches(slug, '^[a-z0-9]([a-z0-9_-]{0,62}[a-z0-9])?$') AS slug_ok,
           path <> '' AND value > 30 AS renderable
    FROM (SELECT event_id, value, ['', 'parent_context_only', 'child_verified', 'highlight_overlap', 'parent_story_unit_inherited', 'x'][(event_id % 6) + 1] AS p,
                 ['', 'video_only_until_child_vlm_refine', 'own'][(event_id % 3) + 1] AS policy, ['', 'loop', 'no_loop', 'Loop_short', 'loop disabled', 'no-loop', 'trim'][(event_id % 7) + 1] AS loop,
                 ['oss://b/', 'https://b/', 'oss://b /'][(event_id % 3) + 1] || repeat('k', 60 + event_id % 40) || ['.mp4', '.MOV', '.gif'][(event_id % 4) % 3 + 1] AS url,
                 ['ab-' , '-ab', 'Ab', 'a'][(event_id % 4) + 1] || event_id AS slug, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'f' END AS path FROM events)""")
def rule_predicates(spark, d):
    n = F.col("event_id")
    pick = lambda xs, i=None: F.element_at(F.array(*[F.lit(x) for x in xs]), ((n % len(xs) if i is None else i) + 1).cast("int"))
    url = F.concat(pick(["oss://b/", "https://b/", "oss://b /"]), F.repeat(F.lit("k"), (60 + n % 40).cast("int")), pick([".mp4", ".MOV", ".gif"], n % 4 % 3))
    return t(spark, d, "events").select(
        "event_id",
        G.is_verified(pick(["", "parent_context_only", "child_verified", "highlight_overlap", "parent_story_unit_inherited", "x"]), pick(["", "video_only_until_child_vlm_refine", "own"]), n % 2 != 0).alias("verified"),
        G.loop_enabled(n % 17 == 0, pick(["", "loop", "no_loop", "Loop_short", "loop disabled", "no-loop", "trim"])).alias("loops"), G.valid_url(url).alias("url_ok"),
        G.valid_slug(F.concat(pick(["ab-", "-ab", "Ab", "a"]), n.cast("string"))).alias("slug_ok"), G.is_renderable(F.when(n % 5 == 0, "").otherwise("f"), F.greatest(F.col("value") - 30, F.lit(0.0))).alias("renderable"),
    )


@query("""
    SELECT doc_id, (lang = 'en' OR n_chars >= 500) AND (contains(text, 'the') OR contains(text, 'der')) AND NOT contains(text, 'idiot') AS slot_ok,
           (contains(text, 'tion') OR contains(text, 'sion')) AND contains(text, 'ung') AND NOT (contains(text, 'que') OR contains(text, 'les')) AS theme_ok,
           array_to_string(list_filter(['que', 'les'], lambda w: contains(text, w)), ',') AS forbidden,
           array_to_string(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN contains(text, 'idiot') THEN 'rude' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM documents""")
def rule_filters(spark, d):
    terms = lambda *xs: F.array(*[F.lit(x) for x in xs])
    themes = F.create_map(F.lit("noun"), terms("tion", "sion"), F.lit("ending"), terms("ung"))
    v = G.theme_verdict(F.col("text"), themes, terms("que", "les"))
    least = F.when(F.col("lang") != "en", 500)
    why = G.reasons(short=F.col("n_chars") < 100, rude=F.contains(F.col("text"), F.lit("idiot")), foreign=F.col("lang") != "en")
    return t(spark, d, "documents").select(
        "doc_id", G.passes_slot(F.col("n_chars"), F.col("text"), least, terms("the", "der"), terms("idiot")).alias("slot_ok"), v["allowed"].alias("theme_ok"),
        F.array_join(v["forbidden"], ",").alias("forbidden"), F.array_join(why, ",").alias("reasons"),
    )


# Clips


@query("""
    WITH e AS (SELECT event_id, round(value / 20, 1) AS d, (event_id % 7)::DOUBLE AS p, CASE WHEN event_id % 3 <> 0 THEN (event_id % 11) / 10.0::DOUBLE END AS a, event_id % 2 = 0 AS proof, event_id % 5 <> 0 AS acts FROM events),
    f AS (SELECT *, least(p, d) AS take, greatest(0, d - least(p, d)) AS room FROM e)
    SELECT event_id, round(CASE WHEN room <= 0.45 OR NOT acts THEN 0 WHEN a IS NOT NULL THEN greatest(0, least(room, a * d - 0.28 * take)) WHEN proof THEN 0.65 * room ELSE 0 END::DOUBLE, 3) AS start_s FROM f""")
def clip_offsets(spark, d):
    n = F.col("event_id")
    role = F.when(n % 2 == 0, "proof").otherwise("product")
    return t(spark, d, "events").select(
        "event_id", C.start_offset(F.round(F.col("value") / 20, 1), (n % 7).cast("double"), F.when(n % 3 != 0, n % 11 / 10), role, n % 5 != 0).alias("start_s")
    )


@query("""
    WITH e AS (SELECT event_id, value AS s, value + event_id % 9 AS e, value + (event_id % 4) - 1 AS us, value + (event_id % 12) - 1 AS ue, (event_id % 6)::DOUBLE AS p FROM events),
    f AS (SELECT *, greatest(s, us) AS a, least(e, ue) AS b FROM e),
    g AS (SELECT *, least(greatest(b - a, 0), p) AS take FROM f)
    SELECT event_id, round(a, 3) AS start_s, round(a + take, 3) AS end_s, round(take, 3) AS planned_s FROM g""")
def clip_parent(spark, d):
    n, v = F.col("event_id"), F.col("value")
    c = C.parent_clip(v, v + n % 9, v + n % 4 - 1, v + n % 12 - 1, (n % 6).cast("double"))
    return t(spark, d, "events").select("event_id", c["source_start_s"].alias("start_s"), c["source_end_s"].alias("end_s"), c["planned_s"].alias("planned_s"))


@query("""
    WITH RECURSIVE k AS (
      SELECT user_id, list(d ORDER BY event_id) AS ds, list(event_id ORDER BY event_id) AS ids FROM (SELECT user_id, event_id, round(value / 60, 2) AS d FROM events) GROUP BY user_id),
    f AS (
      SELECT user_id, ds, ids, 1 AS i, 8.0::DOUBLE AS rest, []::BIGINT[] AS out, []::DOUBLE[] AS took, NULL::BIGINT AS short_id, NULL::DOUBLE AS short_s FROM k
      UNION ALL
      SELECT user_id, ds, ids, i + 1,
        CASE WHEN o OR b THEN rest ELSE greatest(0, rest - take) END, CASE WHEN o OR b THEN out ELSE list_append(out, ids[i]) END, CASE WHEN o OR b THEN took ELSE list_append(took, take) END,
        CASE WHEN NOT o AND b THEN coalesce(short_id, ids[i]) ELSE short_id END, CASE WHEN NOT o AND b THEN coalesce(short_s, take) ELSE short_s END
      FROM (SELECT *, (rest <= 0.03 OR len(out) >= CASE WHEN user_id % 2 = 0 THEN 4 ELSE 2 END OR take <= 0) AS o, (take + 0.08 < 2.5 AND rest > 2.58) AS b
            FROM (SELECT *, least(ds[i], rest) AS take FROM f WHERE i <= len(ds)))),
    z AS (SELECT * FROM f WHERE i > len(ds))
    SELECT user_id, array_to_string(CASE WHEN len(out) > 0 THEN out WHEN short_id IS NULL THEN [] ELSE [short_id] END, ',') AS shots,
           round(CASE WHEN len(out) > 0 THEN list_sum(list_transform(took, lambda x: round(x, 3))) WHEN short_id IS NULL THEN 0 ELSE round(short_s, 3) END::DOUBLE, 2) AS planned_s, len(out) = 0 AND short_id IS NOT NULL AS short FROM z""")
def clip_children(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") / 60, 2).alias("d"))
    kids = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "d"))), lambda x: F.struct(x["event_id"].cast("string").alias("shot_id"), x["d"].alias("duration_s")))
    g = e.groupBy("user_id").agg(kids.alias("kids"))
    role = F.when(F.col("user_id") % 2 == 0, "proof").otherwise("product")
    g = g.select("user_id", C.child_run(F.col("kids"), F.lit(None).cast("string"), F.lit(8.0), role, F.lit(2.5)).alias("run"))
    return g.select(
        "user_id", F.array_join(F.transform("run", lambda x: x["shot_id"]), ",").alias("shots"),
        F.round(F.aggregate("run", F.lit(0.0), lambda a, x: a + x["planned_s"]), 2).alias("planned_s"), F.exists("run", lambda x: x["short"]).alias("short"),
    )


# Time


@query("""
    SELECT event_id, CASE WHEN fps > 0 AND d > 1 / fps + 0.05 THEN round(value + d - 1 / fps, 6) ELSE round(value + d, 6) END AS end_s,
           round(CASE WHEN dur > 0 AND value > 3 * dur THEN value / 1000 ELSE value END, 3) AS at_s, ts < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 120 SECOND AS stalled
    FROM (SELECT event_id, ts, value, ((event_id % 3) * 15)::DOUBLE AS fps, (event_id % 5) * 0.03 AS d, ((event_id % 4) * 20)::DOUBLE AS dur FROM events)""")
def time_scalars(spark, d):
    n, v = F.col("event_id"), F.col("value")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    end = I.trim_end(v, v + n % 5 * 0.03, (n % 3 * 15).cast("double"))
    return t(spark, d, "events").select(
        "event_id", F.round(end, 6).alias("end_s"), I.milliseconds_guess(v, (n % 4 * 20).cast("double")).alias("at_s"), I.is_stalled(F.col("ts").cast("timestamp"), now).alias("stalled")
    )


_IV = "iv AS (SELECT user_id, event_id, value AS start_s, value + event_id % 5 AS end_s FROM events)"


def _iv(spark, d):
    return t(spark, d, "events").select("user_id", "event_id", F.col("value").alias("start_s"), (F.col("value") + F.col("event_id") % 5).alias("end_s"))


@query(f"""
    WITH {_IV}
    SELECT event_id, coalesce(start_s < max(end_s) OVER (PARTITION BY user_id ORDER BY start_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.04, false) AS overlap,
           coalesce(start_s < lag(end_s) OVER (PARTITION BY user_id ORDER BY start_s, event_id) - 0.04, false) AS overlap_last FROM iv""")
def time_overlaps(spark, d):
    by = (["user_id"], ["start_s", "event_id"])
    a = I.overlaps_before(_iv(spark, d), *by).withColumnRenamed("overlap", "any")
    return I.overlaps_before(a, *by, last_only=True).select("event_id", F.col("any").alias("overlap"), F.col("overlap").alias("overlap_last"))


@query("""
    WITH p AS (SELECT user_id, value AS start_s, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS end_s FROM events)
    SELECT * FROM p WHERE end_s - start_s > 0.05""")
def time_between_points(spark, d):
    return I.points_to_intervals(t(spark, d, "events"), ["user_id"], "value")


@query("""
    WITH c AS (SELECT user_id, event_id % 60 AS i FROM events)
    SELECT user_id, max(i) - min(i) + 1 = count(DISTINCT i) AS contiguous, min(i) AS first, max(i) AS last FROM c GROUP BY user_id""")
def time_contiguous(spark, d):
    return I.contiguous(t(spark, d, "events").select("user_id", (F.col("event_id") % 60).alias("i")), ["user_id"], "i")


_CUTS = [i * 7.0 for i in range(80)]


@query(f"""
    WITH p AS (SELECT user_id, value AS s, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS e FROM events),
    q AS (SELECT *, row_number() OVER w AS i, lag(s) OVER w IS NULL AS first, lead(s) OVER w IS NULL AS last FROM p WHERE e - s > 0.05 WINDOW w AS (PARTITION BY user_id ORDER BY s)),
    c AS (
      SELECT *, CASE WHEN NOT first THEN list_filter({_CUTS}::DOUBLE[], lambda x: abs(x - s) <= 0.95)[1] END AS cs, CASE WHEN NOT last THEN list_filter({_CUTS}::DOUBLE[], lambda x: abs(x - e) <= 0.95)[1] END AS ce FROM q),
    n AS (
      SELECT *, coalesce(cs, s) AS s1, coalesce(ce, e) AS e1, lead(coalesce(cs, s)) OVER w AS ns, lag(coalesce(ce, e)) OVER w AS pe, lag(ce) OVER w AS pce FROM c WINDOW w AS (PARTITION BY user_id ORDER BY s)),
    f AS (
      SELECT *, CASE WHEN abs(pe - s1) <= 0.95 AND pce IS NOT NULL THEN pe ELSE s1 END AS fs, CASE WHEN abs(e1 - ns) <= 0.95 AND ce IS NULL THEN ns ELSE e1 END AS fe FROM n)
    SELECT user_id, s AS start_s, round(CASE WHEN fe - fs >= 1.2 THEN fs ELSE s END, 3) AS snapped_start_s, round(CASE WHEN fe - fs >= 1.2 THEN fe ELSE e END, 3) AS snapped_end_s, fe - fs >= 1.2 AS snapped FROM f""")
def time_snap_row(spark, d):
    p = I.points_to_intervals(t(spark, d, "events"), ["user_id"], "value").withColumn("cuts", F.array(*[F.lit(c) for c in _CUTS]))
    return I.snap_to_cuts(p, ["user_id"], ["start_s"], "cuts").select("user_id", "start_s", "snapped_start_s", "snapped_end_s", "snapped")


@query(f"""
    WITH RECURSIVE {_IV},
    c AS (SELECT event_id, start_s, end_s, list_concat([start_s], list_concat(list_filter({[i * 0.9 for i in range(600)]}::DOUBLE[], lambda x: x > start_s + 0.25 AND x < end_s - 0.25), [end_s])) AS b FROM iv),
    r AS (
      SELECT event_id, b, false AS done FROM c
      UNION ALL
      SELECT event_id, CASE WHEN short IS NULL THEN b ELSE list_filter(b, lambda x, i: i <> short + CASE WHEN short > 1 AND (short = len(b) - 1 OR b[short] - b[short - 1] <= b[short + 2] - b[short + 1]) THEN 0 ELSE 1 END) END, short IS NULL
      FROM (SELECT *, CASE WHEN len(b) > 2 THEN list_filter(range(1, len(b)), lambda i: b[i + 1] - b[i] < 1.2)[1] END AS short FROM r WHERE NOT done)),
    z AS (SELECT event_id, b, unnest(range(1, len(b))) AS i FROM r WHERE done),
    k AS (SELECT event_id, b[i] AS s, b[i + 1] AS e, i FROM z WHERE b[i + 1] - b[i] > 0.05)
    SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY i) AS piece, count(*) OVER (PARTITION BY event_id) AS n_pieces, round(s, 3) AS piece_start_s, round(e, 3) AS piece_end_s FROM k""")
def time_split_pieces(spark, d):
    iv = _iv(spark, d).withColumn("cuts", F.array(*[F.lit(i * 0.9) for i in range(600)]))
    return I.split_by_cuts(iv).select("event_id", long("piece").alias("piece"), long("n_pieces").alias("n_pieces"), "piece_start_s", "piece_end_s")


@query("""
    WITH u AS (SELECT user_id, event_id, value AS s, value + 6 AS e FROM events WHERE event_id % 2 = 0),
    sc AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS idx, value AS s, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS e FROM events WHERE event_id % 2 = 1),
    h AS (
      SELECT event_id, min(sc.s) AS s, max(sc.e) AS e, max(idx) - min(idx) + 1 = count(DISTINCT idx) AS ok
      FROM u JOIN sc USING (user_id) WHERE sc.e - sc.s > 0.5 AND least(u.e, sc.e) - greatest(u.s, sc.s) > 0.05 GROUP BY event_id)
    SELECT u.event_id, CASE WHEN ok THEN h.s ELSE u.s END AS start_s, CASE WHEN ok THEN h.e ELSE u.e END AS end_s FROM u LEFT JOIN h ON u.event_id = h.event_id""")
def time_scene_bounds(spark, d):
    from pyspark.sql import Window

    e = t(spark, d, "events")
    units = e.filter("event_id % 2 = 0").select("user_id", F.col("event_id").alias("unit_id"), F.col("value").alias("start_s"), (F.col("value") + 6).alias("end_s"))
    w = Window.partitionBy("user_id").orderBy("value")
    scenes = e.filter("event_id % 2 = 1").select("user_id", (F.row_number().over(w) - 1).alias("idx"), F.col("value").alias("start_s"), F.lead("value").over(w).alias("end_s")).filter("end_s - start_s > 0.5")
    return R.scene_bounds(units, scenes, "user_id").select(F.col("unit_id").alias("event_id"), "start_s", "end_s")


# Pools and selections


@query("""
    WITH h AS (SELECT event_id, event_id % 7 = 0 AS hit, max((event_id % 7 = 0)::INT) OVER (PARTITION BY event_id // 5) = 0 AS fallback FROM events)
    SELECT event_id, fallback FROM h WHERE hit OR fallback""")
def pool_fallback(spark, d):
    e = t(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 5).alias("section"), (F.col("event_id") % 7 == 0).alias("hit"))
    return K.pool_with_fallback(e, ["section"], "hit").select("event_id", "fallback")


@query("""
    WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
    o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN e <= 3 THEN e ELSE 4 END, p) AS place FROM r)
    SELECT user_id, event_id, place FROM o WHERE place <= 8""")
def pool_best_first(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "value")
    return K.best_then_pool(e, ["user_id"], [F.desc("value"), F.col("event_id")], [F.col("event_id")]).select("user_id", "event_id", long("place").alias("place"))


@query("""
    WITH p AS (SELECT user_id, event_id FROM events WHERE event_id % 5 = 0),
    x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE event_id % 5 <> 0)
    SELECT * FROM p UNION ALL SELECT user_id, event_id FROM x WHERE n <= 18""")
def pool_expanded(spark, d):
    e = t(spark, d, "events")
    pool = e.filter("event_id % 5 = 0").select("user_id", "event_id")
    return K.expand_pool(pool, e, ["user_id"], "event_id", [F.desc("value"), F.col("event_id")]).select("user_id", "event_id")


@query("""
    WITH p AS (SELECT event_id // 12 AS task, event_id // 4 % 3 AS section, event_id AS shot_id FROM events)
    SELECT task, section, shot_id FROM p QUALIFY min((shot_id % 7 <> 0)::INT) OVER (PARTITION BY task, section) = 1""")
def plans_valid(spark, d):
    n = F.col("event_id")
    e = t(spark, d, "events").select(F.floor(n / 12).alias("task"), (F.floor(n / 4) % 3).alias("section"), n.alias("shot_id"))
    return S.valid_plans(e, e.filter("shot_id % 7 <> 0"), "task", "section")


@query("""
    SELECT l_orderkey AS task, count(*) AS n_clips, count(DISTINCT l_partkey) AS n_shots, round(sum(l_quantity), 3) AS planned_s, count(*) - count(DISTINCT l_partkey) AS n_repeats, round(max(l_tax), 3) AS max_gap_s
    FROM lineitem GROUP BY l_orderkey""")
def select_summary(spark, d):
    p = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("shot_id"), F.col("l_quantity").alias("planned_s"), F.col("l_tax").alias("gap_s"))
    return S.selection_summary(p, ["task"])


@query("""
    WITH f AS (SELECT user_id % 5 AS batch, user_id AS task, event_type AS key, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
    g AS (SELECT user_id % 5 AS batch, user_id AS task, event_type AS key, count(*) AS n FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 GROUP BY ALL),
    r AS (SELECT * FROM f WHERE (batch, task) NOT IN (SELECT batch, task FROM g) UNION ALL SELECT * FROM g)
    SELECT batch, key, sum(n)::BIGINT AS n FROM r GROUP BY batch, key""")
def state_replaced(spark, d):
    e = t(spark, d, "events").withColumn("batch", F.col("user_id") % 5).withColumnRenamed("user_id", "task")
    facts = lambda x: S.usage_facts(x, "batch", "task", type="event_type")
    out = S.replace_tasks(facts(e.filter("event_id % 2 = 0")), facts(e.filter("event_id % 2 = 1 AND task % 3 = 0")), "batch", "task")
    return S.totals(out, "batch").select("batch", "key", "n")


@query("""
    SELECT user_id, min(event_id) FILTER (event_type = 'purchase') IS NULL OR coalesce(min(event_id) FILTER (event_type = 'purchase') > min(event_id) FILTER (event_type = 'click'), false) AS in_order
    FROM events GROUP BY user_id""")
def select_role_order(spark, d):
    return S.role_order_ok(t(spark, d, "events"), "user_id", "event_id", "event_type", "click", "purchase")
