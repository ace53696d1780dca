"""Queries of operators that large keys, long rows and many rules ask for; each stands beside its SQL.

A third of all rows gets one key here, so that the key is cut into slices.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import themes as T
from ..functions.constants import DEFAULT_WEIGHTS, ROLE_WEIGHTS
from ..functions.vectors import weight_map
from ..operators import aggregates as A
from ..operators import intervals as I
from ..operators import joins as J
from ..operators import selection as S
from ..operators import sketches as Z
from ..operators import terms as Y
from ..operators.dedupe import _ensure_checkpoint_dir
from ..operators.dependent import dependent_top_k
from ..session import ship
from ..streaming import streams as W
from ..streaming.tables import KeyedTable
from .queries import _EV, _event_times, long, query, t

_KEY = "CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END"


@query(f"""
    WITH o AS (SELECT {_KEY} AS key, o_orderkey, o_totalprice AS d FROM orders)
    SELECT o_orderkey, key, round(coalesce(sum(d) OVER (PARTITION BY key ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS start_s,
           round(sum(d) OVER (PARTITION BY key ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS end_s FROM o""")
def scan_hot_axis(spark, d):
    o = t(spark, d, "orders").select(F.expr(_KEY).alias("key"), "o_orderkey", "o_totalprice")
    r = I.running_axis(o, ["key"], ["o_orderkey"], "o_totalprice")
    return r.select("o_orderkey", "key", F.round("start_s", 2).alias("start_s"), F.round("end_s", 2).alias("end_s"))


@query(f"""
    WITH u AS (SELECT {_KEY} AS key, o_orderkey, (1 + o_orderkey % 7)::DOUBLE AS u FROM orders),
    s AS (SELECT *, sum(u) OVER (PARTITION BY key) AS whole, sum(u) OVER (PARTITION BY key ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS upto,
                 lead(o_orderkey) OVER (PARTITION BY key ORDER BY o_orderkey) IS NULL AS last FROM u)
    SELECT o_orderkey, round(600.0::DOUBLE * (upto - u) / whole, 3) AS start_s, CASE WHEN last THEN 600.0::DOUBLE ELSE round(600.0::DOUBLE * upto / whole, 3) END AS end_s FROM s""")
def scan_hot_shares(spark, d):
    o = t(spark, d, "orders").select(F.expr(_KEY).alias("key"), "o_orderkey", (1 + F.col("o_orderkey") % 7).cast("double").alias("units"), F.lit(600.0).alias("total"))
    return I.proportional_axis(o, ["key"], ["o_orderkey"], "units", "total").select("o_orderkey", "start_s", "end_s")


_HOT = "CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END"


def _hot_events(spark, d):
    return _event_times(spark, d).withColumn("user_id", F.expr(_HOT))


_HV = f"{_EV}, hv AS (SELECT event_id, {_HOT} AS user_id, event_type, s, e FROM v)"


@query(f"""
    WITH {_HV},
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) * 0.05::DOUBLE AS i FROM hv),
    b AS (SELECT *, greatest(e, greatest(s, 0) + 0.05::DOUBLE) - i AS b FROM i),
    f AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) + i AS fe FROM b)
    SELECT event_id, round(greatest(s, coalesce(lag(fe) OVER (PARTITION BY user_id ORDER BY s, event_id), 0)), 2) AS start_s, round(fe, 2) AS end_s FROM f""")
def scan_hot_monotonic(spark, d):
    r = I.monotonic(_hot_events(spark, d), ["user_id"], ["event_id"])
    return r.select("event_id", F.round("start_s", 2).alias("start_s"), F.round("end_s", 2).alias("end_s"))


@query(f"""
    WITH {_HV},
    r AS (SELECT *, max(e) OVER w AS reach FROM hv WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT event_id, island::BIGINT AS island, coalesce(s < reach - 0.04::DOUBLE, false) AS overlap FROM g""")
def scan_hot_islands(spark, d):
    e = I.overlaps_before(_hot_events(spark, d), ["user_id"], ["start_s", "event_id"])
    return I.gap_islands(e, ["user_id"], ["start_s", "event_id"], 600.0).select("event_id", long("island").alias("island"), "overlap")


@query(f"""
    WITH e AS (SELECT event_id, {_HOT} AS user_id, event_type, ts FROM events),
    p AS (SELECT user_id, event_id AS p_id, ts AS p_ts FROM e WHERE event_type = 'purchase'),
    i AS (SELECT DISTINCT user_id, p_ts FROM p),
    a AS (SELECT e.event_id, e.user_id, e.ts, b.p_ts FROM e ASOF JOIN i b ON e.user_id = b.user_id AND e.ts >= b.p_ts
          UNION ALL SELECT e.event_id, e.user_id, e.ts, b.p_ts FROM e ASOF JOIN i b ON e.user_id = b.user_id AND e.ts <= b.p_ts),
    j AS (SELECT a.event_id, p.p_id, abs(epoch_us(a.p_ts) - epoch_us(a.ts)) AS dist FROM a JOIN p ON a.user_id = p.user_id AND a.p_ts = p.p_ts)
    SELECT event_id, p_id, dist::BIGINT AS distance_us FROM j
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY dist, p_id) = 1""")
def scan_hot_nearest(spark, d):
    e = t(spark, d, "events").select("event_id", F.expr(_HOT).alias("user_id"), "event_type", "ts")
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("p_id"), F.col("ts").alias("p_ts"))
    r = I.nearest_start(e.select("user_id", "event_id", "ts"), p, "event_id", "p_id", "ts", "p_ts", ["user_id"]).filter("p_id IS NOT NULL")
    return r.select("event_id", "p_id", long(F.round(F.col("distance_s") * 1e6)).alias("distance_us"))


# Sections and what they may show


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: Words that sections and candidates of these queries are made of.
_POOL = [*K.FACE_WORDS[:6], *K.DETAIL_WORDS[:6], *K.PACKAGING_WORDS[:4], *K.PROOF_WORDS[:4], "国风", "款式", "手臂", "精华", "活动价", "plain", "words", "only"]
_ROLES = ["opening", "product", "proof", "cta", "transition", ""]


def _has(ws, q: str = "q") -> str:
    return f"len(list_filter({_list(ws)}, lambda w: contains({q}, w))) > 0"


def _place(ws, q: str) -> str:
    return f"coalesce(list_min(list_filter(list_transform({_list(ws)}, lambda w: instr({q}, w)), lambda p: p > 0)), 9999)"


_NO_OFFER = [w for w in K.PACKAGING_WORDS if w not in K.PACKAGING_OFFER_WORDS]
_N = len(_POOL)
_SECTIONS_SQL = f"""
    parts AS (
      SELECT p_partkey AS section_id, {_list(_ROLES)}[p_partkey % 6 + 1] AS role, {_list(_POOL)}[p_partkey * 7 % {_N} + 1] AS a, {_list(_POOL)}[p_partkey * 11 // 6 % {_N} + 1] AS b,
             CASE WHEN p_partkey % 4 = 0 THEN '' ELSE {_list(_POOL)}[p_partkey * 5 // 3 % {_N} + 1] || {_list(_POOL)}[p_partkey // 4 % {_N} + 1] END AS voice FROM part),
    q AS (SELECT *, trim(a || ' ' || b || ' ' || voice) AS q FROM parts),
    fl AS (
      SELECT *, role = 'cta' OR {_has(K.PACKAGING_WORDS)} AS pk, role = 'proof' OR {_has(K.PROOF_WORDS)} AS pr, {_has(K.DETAIL_WORDS)} AS dt, {_has(K.FACE_WORDS)} AS fc,
             CASE WHEN voice = '' THEN q ELSE voice END AS main FROM q),
    pl AS (
      SELECT *, pk OR pr OR dt AND role = 'product' OR fc AND role IN ('opening', 'product') AS strict, role IN ('opening', 'product') AND fc AND dt AS both_,
             {_place(K.FACE_WORDS, 'main')} AS f1, {_place(K.DETAIL_WORDS, 'main')} AS d1, {_place(K.FACE_WORDS, 'q')} AS f2, {_place(K.DETAIL_WORDS, 'q')} AS d2 FROM fl),
    kp AS (SELECT *, CASE WHEN f1 = 9999 AND d1 = 9999 THEN f2 <= d2 ELSE f1 <= d1 END AS keep_face FROM pl),
    s AS (
      SELECT section_id, role, q, strict, pk AND NOT both_ AS pk, pr AND NOT both_ AS pr, CASE WHEN both_ THEN NOT keep_face ELSE dt END AS dt, CASE WHEN both_ THEN keep_face ELSE fc END AS fc FROM kp),
    r AS (
      SELECT *, CASE WHEN pk AND role = 'cta' THEN 1 WHEN pk AND dt THEN 2 WHEN pk AND fc THEN 3 WHEN pk THEN 4 WHEN pr THEN 5 WHEN fc THEN 6 WHEN dt THEN 7 ELSE 8 END AS rule,
             CASE WHEN role = 'opening' AND NOT ({_has(K.OPENING_ALLOWED_WORDS)}) THEN 'opening' WHEN role = 'product' AND NOT ({_has(K.OPENING_ALLOWED_WORDS)}) AND {_has(K.TEXTURE_WORDS)} THEN 'texture'
                  WHEN role = 'cta' AND {_has(K.CTA_PACKAGING_WORDS)} THEN 'packaging' END AS kind FROM s),
    contracts AS (
      SELECT section_id, role, strict, kind, rule,
             CASE WHEN rule IN (1, 4) THEN ['packaging'] WHEN rule IN (2, 7) THEN ['product_detail'] WHEN rule = 3 THEN ['face_apply'] WHEN rule = 5 THEN ['proof_test']
                  WHEN rule = 6 THEN CASE WHEN dt THEN ['product_detail', 'face_apply'] ELSE ['face_apply'] END ELSE []::VARCHAR[] END AS themes,
             CASE WHEN rule IN (1, 4) THEN {_list(K.PACKAGING_WORDS)} WHEN rule IN (2, 7) THEN {_list(K.DETAIL_CORE_WORDS)} WHEN rule IN (3, 6) THEN {_list(K.FACE_STRONG_WORDS)}
                  WHEN rule = 5 THEN {_list(K.PROOF_WORDS)} ELSE []::VARCHAR[] END AS required,
             CASE rule WHEN 1 THEN {_list(K.CTA_USE_WORDS)} WHEN 3 THEN {_list(_NO_OFFER)} WHEN 6 THEN {_list(dict.fromkeys([*_NO_OFFER, *K.FORMULA_WORDS, *K.PROOF_WORDS]))}
                  WHEN 7 THEN {_list(dict.fromkeys([*K.PROOF_WORDS, *K.PACKAGING_WORDS]))} ELSE []::VARCHAR[] END AS forbidden,
             CASE kind WHEN 'opening' THEN {_list(K.OPENING_PROOF_WORDS)} WHEN 'texture' THEN {_list(K.TEXTURE_FORBIDDEN_WORDS)} WHEN 'packaging' THEN {_list(K.CTA_USE_WORDS)} ELSE []::VARCHAR[] END AS besides
      FROM r)"""


def _pick(key, *at: str):
    pool = F.array(*[F.lit(w) for w in _POOL])
    return [F.get(pool, F.expr(e.format(key) + f" % {_N}").cast("int")) for e in at]


def _contracts(spark, d):
    p = t(spark, d, "part").select("p_partkey").repartition("p_partkey")  # a small file would make all contracts in one task
    a, b, v, w = _pick("p_partkey", "({} * 7)", "(({} * 11) div 6)", "(({} * 5) div 3)", "({} div 4)")
    voice = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(v, w))
    s = p.select(F.col("p_partkey").alias("section_id"), F.get(F.array(*[F.lit(r) for r in _ROLES]), (F.col("p_partkey") % 6).cast("int")).alias("role"), a.alias("a"), b.alias("b"), voice.alias("voice"))
    q = T.section_query(F.col("a"), F.col("b"), F.lit(None).cast("string"), F.col("voice"), F.lit(None).cast("array<string>"))
    return s.select("section_id", T.section_contract(q, F.col("role"), F.col("voice")).alias("c"))


@query(f"""
    WITH {_SECTIONS_SQL}
    SELECT section_id, strict, kind, array_to_string(themes, ',') AS themes, array_to_string(required, ',') AS required, array_to_string(forbidden, ',') AS forbidden FROM contracts""")
def theme_contracts(spark, d):
    required = F.flatten(F.map_values("c.required"))
    return _contracts(spark, d).select(
        "section_id", "c.strict", "c.kind", F.array_join("c.themes", ",").alias("themes"), F.array_join(required, ",").alias("required"), F.array_join("c.forbidden", ",").alias("forbidden")
    )


@query(f"""
    WITH {_SECTIONS_SQL},
    c AS (SELECT DISTINCT l_partkey AS section_id, l_suppkey AS cand_id FROM lineitem),
    x AS (
      SELECT k.*, cand_id, {_list(_POOL)}[cand_id * 3 % {_N} + 1] || ' ' || {_list(_POOL)}[(cand_id + k.section_id) * 13 // 5 % {_N} + 1] AS text FROM c JOIN contracts k USING (section_id)),
    h AS (
      SELECT *, list_filter(themes, lambda n: NOT (n <> 'product_detail' OR rule IN (2, 7)) OR len(list_filter(required, lambda w: contains(text, w))) = 0) AS missing,
             list_filter(forbidden, lambda w: contains(text, w)) AS bad, list_filter(besides, lambda w: contains(text, w)) AS more FROM x),
    v AS (SELECT *, len(bad) = 0 AND (NOT strict OR len(missing) = 0) AS theme_ok, list_concat(bad, list_filter(more, lambda w: NOT list_contains(bad, w))) AS hits FROM h)
    SELECT section_id, cand_id, array_to_string(missing, ',') AS missing, array_to_string(hits, ',') AS forbidden, theme_ok, theme_ok AND len(hits) = 0 AS admitted,
           theme_ok AND (len(hits) = 0 OR CASE WHEN role = 'product' AND themes = ['product_detail'] THEN NOT list_has_any(hits, {_list([*K.PROOF_WORDS, *K.TOP_UP_HARD_WORDS])})
                         WHEN kind = 'packaging' THEN NOT list_has_any(hits, {_list(K.CTA_USE_WORDS)}) ELSE false END) AS top_up FROM v""")
def theme_verdicts(spark, d):
    pairs = t(spark, d, "lineitem").select(F.col("l_partkey").alias("section_id"), F.col("l_suppkey").alias("cand_id")).distinct()
    a, b = _pick("", "(cand_id * 3)", "(((cand_id + section_id) * 13) div 5)")
    rows = J.verdicts(pairs.withColumn("text", F.concat_ws(" ", a, b)), _contracts(spark, d), "section_id", "text", "c").withColumnRenamed("verdict", "v")
    return rows.select("section_id", "cand_id", F.array_join("v.missing", ",").alias("missing"), F.array_join("v.forbidden", ",").alias("forbidden"), "v.theme_ok", "v.admitted", "v.top_up")


# Sections filled with clips of candidates and of their children

_CANDS_SQL = """
    c AS (
      SELECT l_orderkey AS section_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS cand,
             l_partkey AS p, l_suppkey AS u, l_quantity::DOUBLE / 5.0::DOUBLE AS dur, 3.0::DOUBLE + l_orderkey % 9 AS budget, l_orderkey % 4 = 1 AS proof, l_orderkey % 8 = 7 AS packaging FROM lineitem),
    b AS (SELECT *, CASE WHEN packaging AND dur >= 0.3 THEN 0.0::DOUBLE ELSE (u % 4) * 0.5::DOUBLE END AS base, (p % 3) * 0.2::DOUBLE AS inner_s, CASE WHEN p % 5 IN (1, 4) THEN 0 ELSE 1 + p % 4 END AS n_children FROM c),
    o AS (SELECT *, p % 5 = 0 AND dur > 0 AND base < dur - 0.03 AS own, 1 + CASE WHEN packaging AND dur >= 0.3 OR u % 3 >= n_children THEN 0 ELSE u % 3 END AS first_child FROM b),
    i AS (
      SELECT section_id, cand, 1 AS item, cand::VARCHAR AS clip_id, round(least(base + inner_s, dur), 3) AS at_s, dur - least(base + inner_s, dur) AS len, 1 AS most, budget FROM o WHERE own
      UNION ALL
      SELECT section_id, cand, 1, cand::VARCHAR, round(least(w, dur), 3), dur - least(w, dur), 1, budget FROM (SELECT *, CASE WHEN packaging AND dur >= 0.3 THEN 0.0::DOUBLE ELSE inner_s END AS w FROM o WHERE NOT own AND n_children = 0)
      UNION ALL
      SELECT section_id, cand, k, cand || '.' || k, 0.0::DOUBLE, 0.4::DOUBLE + ((p * 7 + k * 13) % 50) / 10.0::DOUBLE, CASE WHEN packaging OR proof THEN 4 ELSE 2 END, budget
      FROM (SELECT *, unnest(range(first_child, n_children + 1)) AS k FROM o WHERE NOT own AND n_children > 0)),
    n AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY cand, item) AS i, least(2.5::DOUBLE, budget) AS least_s FROM i)"""


@query(f"""
    WITH RECURSIVE {_CANDS_SQL},
    f AS (
      SELECT section_id, 0::BIGINT AS i, max(budget) AS left_s, 0::BIGINT AS cand, 0 AS in_cand, 0 AS n_all, false AS stop, 0.0::DOUBLE AS part, false AS waits FROM n GROUP BY section_id
      UNION ALL
      SELECT section_id, i, CASE WHEN takes THEN greatest(0, left_s - part) ELSE left_s END, cand, CASE WHEN takes THEN in_cand + 1 ELSE in_cand END, CASE WHEN takes THEN n_all + 1 ELSE n_all END,
             stop, CASE WHEN takes OR waits THEN part ELSE 0 END, waits
      FROM (
        SELECT *, NOT stop AND NOT over_ AND part > 0 AND brief AS waits, NOT stop AND NOT over_ AND part > 0 AND NOT brief AS takes
        FROM (
          SELECT f.section_id, n.i, f.left_s, n.cand, CASE WHEN n.cand = f.cand THEN f.in_cand ELSE 0 END AS in_cand, f.n_all,
                 f.stop OR f.left_s <= 0.03 OR n.cand <> f.cand AND f.n_all > 0 AND f.left_s + 0.08 < n.least_s AS stop, n.cand = f.cand AND f.in_cand >= n.most AS over_,
                 least(n.len, f.left_s) AS part, least(n.len, f.left_s) + 0.08 < n.least_s AND f.left_s > n.least_s + 0.08 AS brief
          FROM f JOIN n ON n.section_id = f.section_id AND n.i = f.i + 1))),
    w AS (SELECT *, max(n_all) OVER (PARTITION BY section_id) AS taken, min(left_s) OVER (PARTITION BY section_id) AS gap FROM f),
    t AS (
      SELECT section_id, i, part, false AS short, gap FROM w WHERE part > 0 AND NOT waits
      UNION ALL SELECT section_id, i, part, true, gap - part FROM w WHERE waits AND taken = 0 QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY i) = 1)
    SELECT t.section_id, n.cand::VARCHAR AS shot_id, row_number() OVER (PARTITION BY t.section_id ORDER BY t.i) AS clip_order, n.clip_id, n.at_s AS offset_s, round(part, 3) AS planned_s, short, round(gap, 3) AS gap_s
    FROM t JOIN n ON n.section_id = t.section_id AND n.i = t.i""")
def fill_child_runs(spark, d):
    ship(spark)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = F.when((F.col("l_partkey") % 5).isin(1, 4), 0).otherwise(1 + F.col("l_partkey") % 4).cast("int")
    rows = t(spark, d, "lineitem").withColumn("cand", F.row_number().over(w))
    child = lambda k: F.struct(
        F.concat_ws(".", "cand", k).alias("shot_id"), (F.lit(0.4) + ((F.col("l_partkey") * 7 + k * 13) % 50) / F.lit(10.0)).alias("duration_s")
    )
    key = F.col("l_orderkey")
    rows = rows.select(
        key.alias("section_id"), "cand", F.col("cand").alias("shot_id"), (F.col("l_quantity").cast("double") / 5.0).alias("duration_s"), (3.0 + key % 9).alias("budget_s"),
        F.when(key % 4 == 1, "proof").when(key % 4 == 3, "cta").otherwise("product").alias("role"), (key % 8 == 7).alias("packaging"), (F.col("l_partkey") % 5 == 0).alias("own_file"),
        ((F.col("l_suppkey") % 4) * 0.5).alias("parent_offset_s"), ((F.col("l_partkey") % 3) * 0.2).alias("inner_offset_s"),
        F.concat_ws(".", "cand", (F.col("l_suppkey") % 3 + 1)).alias("chosen_child"),
        F.when(n > 0, F.transform(F.sequence(F.lit(1), n), child)).otherwise(F.array()).alias("children"),
    )
    return S.fill_sections(rows, "section_id", "cand").withColumn("clip_order", long("clip_order"))


# The best rows for each of many sections

_WEIGHTS = [DEFAULT_WEIGHTS, *ROLE_WEIGHTS.values()]
_CHANNELS = ["source_meaning", "visual_summary", "tags", "asr"]


def _w(c: str) -> str:
    return "[" + ", ".join(f"{w[c]}::DOUBLE" for w in _WEIGHTS) + "][section_id % 6 + 1]"


@query(f"""
    WITH x AS (SELECT label * 3 + vec_id % 3 AS section_id, unnest(embedding[1:16]) AS v, generate_subscripts(embedding[1:16], 1) AS i FROM embeddings),
    m AS (SELECT section_id, i, avg(v::DOUBLE) AS v FROM x GROUP BY ALL),
    s AS (SELECT section_id, list(v ORDER BY i) AS q FROM m GROUP BY section_id),
    c AS (
      SELECT section_id, vec_id AS shot_id, list_cosine_similarity(embedding[1:16]::DOUBLE[], q) AS a, list_cosine_similarity(embedding[17:32]::DOUBLE[], q) AS b,
             CASE WHEN vec_id % 3 > 0 THEN list_cosine_similarity(embedding[33:48]::DOUBLE[], q) END AS c, CASE WHEN vec_id % 5 > 0 THEN list_cosine_similarity(embedding[49:64]::DOUBLE[], q) END AS d
      FROM embeddings, s),
    r AS (
      SELECT section_id, shot_id, round(({_w('source_meaning')} * a + {_w('visual_summary')} * b + CASE WHEN c IS NULL THEN 0 ELSE {_w('tags')} * c END + CASE WHEN d IS NULL THEN 0 ELSE {_w('asr')} * d END)
             / ({_w('source_meaning')} + {_w('visual_summary')} + CASE WHEN c IS NULL THEN 0 ELSE {_w('tags')} END + CASE WHEN d IS NULL THEN 0 ELSE {_w('asr')} END), 6) AS score FROM c)
    SELECT section_id, shot_id, score, row_number() OVER (PARTITION BY section_id ORDER BY score DESC, shot_id) AS rank FROM r QUALIFY rank <= 36""")
def vec_dependent_topk(spark, d):
    ship(spark)
    e = t(spark, d, "embeddings")
    part = lambda i: F.slice("embedding", 16 * i + 1, 16).cast("array<double>")
    m = A.mean_vectors(e.select((F.col("label") * 3 + F.col("vec_id") % 3).alias("section_id"), part(0).alias("embedding")), ["section_id"])
    maps = F.array(*[weight_map({c: w[c] for c in _CHANNELS}) for w in _WEIGHTS])
    s = m.select("section_id", F.col("mean").alias("q"), F.get(maps, (F.col("section_id") % 6).cast("int")).alias("weights"))
    has = [F.lit(True), F.lit(True), F.col("vec_id") % 3 > 0, F.col("vec_id") % 5 > 0]
    chans = F.map_filter(F.create_map(*[x for i, c in enumerate(_CHANNELS) for x in (F.lit(c), F.when(has[i], part(i)))]), lambda _, v: v.isNotNull())
    r = dependent_top_k(s, e.select(F.col("vec_id").alias("shot_id"), chans.alias("channels")), 36, "section_id", "shot_id", _CHANNELS)
    return r.withColumn("rank", long("rank"))


# What a corpus can show

_LEXICON = ["the", "der", "que", "les", "Apache", "idiot", "License", "Copyright", "http", "sk-", "zzz", "@", "qqqq", "<b>"]
_PROBLEMS, _OPENINGS = ("idiot", "zzz", "sk-", "never there"), ("License", "the", "qqqq", "Apache")


@query(f"""
    WITH w AS (SELECT unnest({_list(_LEXICON)}) AS term, unnest(range({len(_LEXICON)})) AS place),
    f AS (SELECT term, place, count(d.doc_id) AS n FROM w LEFT JOIN documents d ON contains(d.text, term) GROUP BY ALL),
    s AS (SELECT 'weak_problem' AS list, unnest({_list(_PROBLEMS)}) AS term, unnest(range(4)) AS i UNION ALL SELECT 'safe_opening', unnest({_list(_OPENINGS)}), unnest(range(4))),
    p AS (SELECT trim(x) AS term, count(*) AS n FROM (SELECT unnest([source, lang || ' ', CASE WHEN n_chars > 500 THEN 'long' ELSE ' ' END]) AS x FROM documents) WHERE trim(x) <> '' GROUP BY 1),
    k AS (SELECT lang AS term, count(*) AS n FROM documents WHERE lang <> '' GROUP BY 1),
    a AS (
      SELECT 'available' AS list, term, n, row_number() OVER (ORDER BY n DESC, term) AS place, 30 AS most FROM f WHERE n > 0
      UNION ALL SELECT 'missing', term, n, row_number() OVER (ORDER BY place), 30 FROM f WHERE n = 0
      UNION ALL SELECT 'strong', term, n, row_number() OVER (ORDER BY n DESC, term), 30 FROM f WHERE n >= 2
      UNION ALL SELECT 'evidence', term, n, row_number() OVER (ORDER BY n DESC, term), 30 FROM f WHERE n >= 3
      UNION ALL SELECT list, s.term, coalesce(n, 0), row_number() OVER (PARTITION BY list ORDER BY i), 30 FROM s LEFT JOIN f ON s.term = f.term WHERE (list = 'safe_opening') = (coalesce(n, 0) >= 2)
      UNION ALL SELECT 'points', term, n, row_number() OVER (ORDER BY n DESC, term), 24 FROM p
      UNION ALL SELECT 'kinds', term, n, row_number() OVER (ORDER BY n DESC, term), 18 FROM k)
    SELECT list, place, term, n FROM a WHERE place <= most""")
def text_capabilities(spark, d):
    points = F.array("source", F.concat("lang", F.lit(" ")), F.when(F.col("n_chars") > 500, "long").otherwise(" "))
    r = Y.capabilities(t(spark, d, "documents"), F.col("text"), points, F.col("lang"), _LEXICON, _PROBLEMS, _OPENINGS)
    return r.select("list", long("place").alias("place"), "term", "n")


# Streams


def _base(spark, name: str) -> str:
    _ensure_checkpoint_dir(spark)
    return f"{spark.conf.get('spark.checkpoint.dir')}/tidemark/{name}-{uuid.uuid4().hex}"


@query("""
    SELECT user_id, event_id, event_type, round(value, 4) AS value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def incr_upsert_buckets(spark, d):
    """The events as batches by the days of their week, in no order of time; the table's last version is the result."""
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    table = KeyedTable(spark, _base(spark, "latest"), ["user_id"], ["ts", "event_id"], buckets=16)
    for n, day in enumerate((4, 1, 7, 2, 6, 3, 5)):
        table.upsert(e.filter(F.dayofweek("ts") == day), n)
    return table.read().select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


#: The oldest of these rows come last, when their windows are long closed.
_LATE = "event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-08 00:00:00'"


def _arrivals(spark, d, base: str):
    """The events as files in the order in which they come in: three stretches of time, then the late rows."""
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.coalesce(F.expr(_LATE), F.lit(False))
    edges = [F.lit(x).cast("timestamp") for x in ("2024-01-10 00:00:00", "2024-01-20 00:00:00")]
    stretches = [~late & (F.col("ts") < edges[0]), ~late & (F.col("ts") >= edges[0]) & (F.col("ts") < edges[1]), ~late & (F.col("ts") >= edges[1]), late]
    for n, some in enumerate(stretches):
        e.filter(some).coalesce(1).write.parquet(f"{base}/in/{n}")
    return W.file_stream(spark, f"{base}/in/*", e.schema, files_per_batch=1)


@query(f"""
    WITH e AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, value FROM events WHERE NOT ({_LATE})),
    m AS (SELECT max(ts) - INTERVAL 1 DAY AS closed FROM events)
    SELECT event_type, window_start, count(*) AS n, round(sum(value), 4) AS total FROM e, m WHERE window_start + INTERVAL 6 HOUR <= closed GROUP BY ALL""")
def stream_windows(spark, d):
    """Six-hour windows in append mode: each comes out once, when it is closed; late rows are left out."""
    base = _base(spark, "windows")
    counted = W.windowed_counts(_arrivals(spark, d, base), "ts", ["event_type"], "6 hours", "1 day", "value")
    W.run_available(counted, W.append_to(f"{base}/out"), f"{base}/ck")
    out = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    return out.select("event_type", "window_start", "n", F.round("total", 4).alias("total"))


@query(f"""
    WITH e AS (SELECT user_id, ts FROM events WHERE NOT ({_LATE})),
    g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR AS new FROM e),
    r AS (SELECT *, sum(coalesce(new, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
    x AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM r GROUP BY user_id, s)
    SELECT user_id, session_start, session_end, n FROM x WHERE session_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_sessions(spark, d):
    base = _base(spark, "sessions")
    found = W.sessions(_arrivals(spark, d, base), "ts", ["user_id"], "12 hours", "1 day")
    W.run_available(found, W.append_to(f"{base}/out"), f"{base}/ck")
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").select("user_id", "session_start", "session_end", "n")


@query("""
    SELECT p.event_id, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND p.event_type = 'purchase' AND v.event_type = 'view'
      AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 36 HOUR""")
def stream_interval_join(spark, d):
    """Purchases with the views of the 36 hours before, as two streams of one folder of files."""
    base = _base(spark, "interval")
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = [F.col("ts") < F.lit("2024-01-15").cast("timestamp"), F.col("ts") >= F.lit("2024-01-15").cast("timestamp")]
    for n, some in enumerate(days):
        e.filter(some).coalesce(1).write.parquet(f"{base}/in/{n}")
    side = lambda kind, *names: W.file_stream(spark, f"{base}/in/*", e.schema, files_per_batch=1).filter(F.col("event_type") == kind).select("user_id", *names)
    bought, seen = side("purchase", "event_id", "ts"), side("view", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    met = W.interval_join(bought, seen, ["user_id"], "ts", "view_ts", "36 HOURS", "1 day")
    W.run_available(met, W.append_to(f"{base}/out"), f"{base}/ck")
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").select("event_id", "view_id")


@query("""
    SELECT event_type, count(*) AS n, round(min(value), 4) AS least, round(max(value), 4) AS most, true AS users_close, true AS median_close FROM events GROUP BY event_type""")
def agg_daily_sketches(spark, d):
    """Days' summaries merged by type; whether estimates lie within their error of the exact values, from the rows."""
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    whole = Z.merged(Z.summaries(e, ["day", "event_type"], {"user": "user_id"}, {"value": "value"}), ["event_type"], ["user"], ["value"])
    whole = whole.withColumns({"users": Z.distinct_estimate("d_user"), "median": Z.quantile_estimate("q_value", 0.5)})
    exact = e.join(whole.select("event_type", "median"), "event_type").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("exact"), (F.count_if(F.col("value") <= F.col("median")) / F.count("value")).alias("share")
    )
    return whole.join(exact, "event_type").select(
        "event_type", "n", F.round("min_value", 4).alias("least"), F.round("max_value", 4).alias("most"),
        (F.abs(F.col("users") - F.col("exact")) <= F.greatest(F.lit(2.0), 0.065 * F.col("exact"))).alias("users_close"), (F.abs(F.col("share") - 0.5) <= 0.07).alias("median_close"),
    )
