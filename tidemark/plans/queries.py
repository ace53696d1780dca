"""The engine's queries over the driver's tables; each stands beside its SQL in ORACLE_SQL.

Where no table fits an operator (media, remote calls), an analogous column is used: the
quarters of an embedding are channels, its signs are frame hashes, events are intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.captions import caption_lines, display_units
from ..functions.coerce import as_double, blank_fields, first_nonblank, frame_rate, slug
from ..functions.vectors import cosine, hamming, mean_weighted, sign_bits, weight_map
from ..operators import aggregates as A
from ..operators import dedupe as D
from ..operators import intervals as I
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import selection as S
from ..operators import sets as U
from ..operators import topk as K
from ..session import ship
from ..streaming import incremental as N
from . import dashboard as B
from . import search, timeline

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(c) -> object:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def first_vector(spark: SparkSession, d: str) -> list[float]:
    """The query vector: one row."""
    return [float(x) for x in t(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


# Vectors and ranking

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_Q = "q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"""
    WITH {_Q}, s AS (SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings e, q)
    SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s
    QUALIFY rank <= 12""")
def vec_topk_cosine(spark, d):
    q = search.vector(first_vector(spark, d))
    e = t(spark, d, "embeddings").select("vec_id", "label", F.round(cosine(q, F.col("embedding")), 6).alias("score"))
    return K.top_k(e, "score", 12, "vec_id").withColumn("rank", long("rank"))


@query("""
    WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
    SELECT label, (i - 1)::BIGINT AS place, round(avg(v::DOUBLE), 6) AS mean, count(*) AS n FROM x GROUP BY label, i""")
def vec_mean_by_label(spark, d):
    m = A.mean_vectors(t(spark, d, "embeddings"), ["label"])
    return m.select("label", "n_vectors", F.posexplode("mean").alias("p", "m")).select(
        "label", long("p").alias("place"), F.round("m", 6).alias("mean"), F.col("n_vectors").alias("n")
    )


@query(f"""
    WITH {_Q},
    c AS (
      SELECT vec_id, list_cosine_similarity(embedding[1:16]::DOUBLE[], (SELECT embedding[1:16] FROM q)::DOUBLE[]) AS a,
             list_cosine_similarity(embedding[17:32]::DOUBLE[], (SELECT embedding[1:16] FROM q)::DOUBLE[]) AS b,
             list_cosine_similarity(embedding[33:48]::DOUBLE[], (SELECT embedding[1:16] FROM q)::DOUBLE[]) AS c,
             list_cosine_similarity(embedding[49:64]::DOUBLE[], (SELECT embedding[1:16] FROM q)::DOUBLE[]) AS d
      FROM embeddings)
    SELECT vec_id, round((1.0::DOUBLE * a + 0.85::DOUBLE * b + 0.75::DOUBLE * c + 0.55::DOUBLE * d) / 3.15::DOUBLE, 6) AS base FROM c""")
def vec_weighted_channels(spark, d):
    q = search.vector(first_vector(spark, d)[:16])
    names = ["source_meaning", "visual_summary", "tags", "asr"]
    part = lambda i: F.slice("embedding", 16 * i + 1, 16)
    sims = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), cosine(part(i), q))])
    weights = weight_map({"source_meaning": 1.0, "visual_summary": 0.85, "tags": 0.75, "asr": 0.55, "ocr": 0.0})
    return t(spark, d, "embeddings").select("vec_id", F.round(mean_weighted(sims, weights), 6).alias("base"))


def _index(spark, d):
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    chan = lambda a: F.struct(F.slice("embedding", a, 32).alias("embedding"), F.lit("text").alias("mode"))
    return t(spark, d, "embeddings").select(
        F.col("vec_id").alias("shot_id"), F.col("label").alias("parent_shot_id"), F.lit("demo").alias("product_name"), F.lit("demo").alias("product_slug"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"), F.lit("").alias("visual_summary"), F.lit("").alias("source_meaning"),
        F.lit("").alias("source_asr"), pick(["none", "low", "medium", "high"], F.col("label")).alias("hard_subtitle_risk"),
        pick(["excellent", "good", "fair", "poor", "unknown"], F.col("vec_id")).alias("voiceover_fit"), (F.col("vec_id") % 2 == 0).alias("can_standalone"),
        (F.col("vec_id") % 10).cast("double").alias("duration_s"),
        F.create_map(F.lit("visual_summary"), chan(1), F.lit("source_meaning"), chan(33)).alias("channels"),
    )


@query(f"""
    WITH {_Q},
    b AS (
      SELECT vec_id, label,
        (0.95::DOUBLE * list_cosine_similarity(embedding[1:32]::DOUBLE[], (SELECT embedding[1:32] FROM q)::DOUBLE[])
         + 1.0::DOUBLE * list_cosine_similarity(embedding[33:64]::DOUBLE[], (SELECT embedding[1:32] FROM q)::DOUBLE[])) / 1.95::DOUBLE AS base
      FROM embeddings),
    s AS (
      SELECT vec_id AS shot_id, round(base, 6) AS base,
        round(base + CASE label % 4 WHEN 0 THEN 0.04 WHEN 1 THEN 0.04 WHEN 2 THEN -0.08 ELSE -0.16 END::DOUBLE
          + CASE vec_id % 5 WHEN 0 THEN 0.05 WHEN 1 THEN 0.03 WHEN 2 THEN -0.06 WHEN 3 THEN -0.14 ELSE 0 END::DOUBLE
          + CASE WHEN vec_id % 10 = 0 THEN -0.08 WHEN abs(vec_id % 10 - 3) <= 0.8 THEN 0.06 WHEN vec_id % 10 > 6.6 THEN -0.04 ELSE 0 END::DOUBLE
          + CASE WHEN vec_id % 2 = 0 THEN 0.04 ELSE 0 END::DOUBLE
          + CASE WHEN contains('label ' || label, 'label') THEN 0.025 ELSE 0 END::DOUBLE, 6) AS score
      FROM b WHERE base >= -0.5)
    SELECT shot_id, base, score, row_number() OVER (ORDER BY score DESC, shot_id) AS rank FROM s QUALIFY rank <= 20""")
def vec_search_ranked(spark, d):
    q = first_vector(spark, d)[:32]
    r = search.search_ranked(_index(spark, d), q, query="label", role="proof", product="demo", target_s=3.0, k=20)
    return r.select("shot_id", F.round("base", 6).alias("base"), F.round("score", 6).alias("score"), long("rank").alias("rank"))


@query(f"""
    WITH {_Q}, s AS (SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings e, q),
    w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 2 THEN 1 ELSE 2 END AS pass FROM s)
    SELECT vec_id, label, score, pass::BIGINT AS pass, row_number() OVER (ORDER BY pass, score DESC, vec_id) AS rank FROM w QUALIFY rank <= 30""")
def topk_per_parent_cap(spark, d):
    q = search.vector(first_vector(spark, d))
    e = t(spark, d, "embeddings").select("vec_id", "label", F.round(cosine(q, F.col("embedding")), 6).alias("score"))
    r = K.capped_top_k(e, "score", 30, "vec_id", "label", 2)
    return r.select("vec_id", "label", "score", long("pass").alias("pass"), long("rank").alias("rank"))


@query()
def topk_two_caps(spark, d):
    ship(spark)
    q = search.vector(first_vector(spark, d))
    e = t(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 7).alias("asset"), (F.col("vec_id") % 3).alias("section"), F.round(cosine(q, F.col("embedding")), 6).alias("score"))
    return K.double_capped_top_k(e, ["section"], "score", "vec_id", "label", "asset", k=12, pool=36, per_parent=1, per_asset=2)


@query()
def slot_plan(spark, d):
    ship(spark)
    q = search.vector(first_vector(spark, d))
    e = t(spark, d, "embeddings").select(
        "vec_id", "label", (F.col("vec_id") % 7).alias("asset"), (F.col("label") % 2).alias("plan"), (F.col("vec_id") % 3).alias("slot"), F.lit(3).alias("want"),
        F.round(cosine(q, F.col("embedding")), 6).alias("score"),
    )
    return K.slot_plan(e, "plan", "slot", "score", "vec_id", "label", "asset", "want", pool=36, per_asset=2)


@query("""
    WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    SELECT * FROM s WHERE rank <= 3""")
def topk_per_key(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return K.top_k_per_key(o, ["o_custkey"], "o_totalprice", 3, "o_orderkey").withColumn("rank", long("rank"))


# Duplicates and graphs


@query("""
    SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS keep_id FROM documents GROUP BY text""")
def dup_exact_docs(spark, d):
    return t(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"))


def _signs(spark, d):
    return t(spark, d, "embeddings").select("vec_id", "label", sign_bits(F.col("embedding"), 32).alias("bits"))


_BITS = "list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT"
_PAIRS = f"""b AS (SELECT vec_id, {_BITS} AS bits FROM embeddings),
    p AS (SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.bits, y.bits))::BIGINT AS distance
          FROM b x JOIN b y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.bits, y.bits)) <= 5)"""


def _hamming_pairs(spark, d):
    """Pairs within 5 of 32 bits: of 6 bands one at least is equal."""
    s = _signs(spark, d).select("vec_id", "bits", F.explode(D.bands(F.col("bits"), 6, 32)).alias("k"))
    a = s.select(F.col("vec_id").alias("a"), F.col("bits").alias("x"), "k")
    b = s.select(F.col("vec_id").alias("b"), F.col("bits").alias("y"), "k")
    pairs = a.join(b, "k").filter("a < b").select("a", "b", long(hamming(F.col("x"), F.col("y"))).alias("distance"))
    return pairs.filter("distance <= 5").distinct()


@query(f"WITH {_PAIRS} SELECT a, b, distance FROM p")
def dup_hamming_pairs(spark, d):
    return _hamming_pairs(spark, d)


@query(f"""
    WITH RECURSIVE {_PAIRS},
    e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
    r AS (SELECT u, u AS l FROM e UNION SELECT e.u, r.l FROM e JOIN r ON e.v = r.u WHERE r.l < e.u OR r.l = e.u)
    SELECT u AS node, min(l) AS component FROM r GROUP BY u""")
def dup_components(spark, d):
    return D.least_reachable(_hamming_pairs(spark, d))


def _fingerprints(spark, d):
    """Five frames a row: signs of five stretches of the vector, shifted into each other."""
    e = t(spark, d, "embeddings")
    part = lambda a, n: sign_bits(F.slice("embedding", a, n), n)
    return e.select(
        F.format_string("shot_%06d", "vec_id").alias("shot_id"), F.concat(F.lit("asset_"), F.col("label").cast("string")).alias("asset_id"),
        F.lit("").alias("story_unit_id"), (2.0 + F.col("vec_id") % 3).alias("duration_s"), F.lit("").alias("clip_sha256"),
        F.array(*[part(1 + 8 * i, 32) for i in range(5)]).alias("phash"), F.array(*[part(5 + 8 * i, 28) for i in range(5)]).alias("dhash"), F.lit("ok").alias("status"),
    )


@query()
def dup_pairs_scored(spark, d):
    return D.duplicate_pairs(_fingerprints(spark, d))


@query()
def dup_groups(spark, d):
    f = _fingerprints(spark, d)
    g = D.duplicate_groups(f, D.linking_pairs(f))
    return D.annotate(f.select("shot_id", "asset_id"), g)


# Texts

_TERMS = ["the", "der", "que", "les", "tion", "Apache", "idiot"]
_TERM_LIST = "[" + ", ".join(f"'{x}'" for x in _TERMS) + "]"


@query(f"""
    WITH x AS (SELECT lang, unnest(list_filter({_TERM_LIST}, lambda w: contains(text, w))) AS term FROM documents)
    SELECT lang, term, count(*) AS n_docs FROM x GROUP BY lang, term""")
def text_term_hits(spark, d):
    docs = t(spark, d, "documents").select("lang", F.explode(X.term_hits("text", F.array(*[F.lit(w) for w in _TERMS]))).alias("term"))
    return docs.groupBy("lang", "term").agg(F.count("*").alias("n_docs"))


@query(r"""
    WITH x AS (
      SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[\s，。！？、,.!?；;：/]+'), lambda w: length(w) BETWEEN 2 AND 10))) AS term FROM documents)
    SELECT term, count(*) AS df FROM x GROUP BY term ORDER BY df DESC, term LIMIT 30""")
def text_term_df(spark, d):
    return A.document_frequency(t(spark, d, "documents"), X.query_terms("text"))


@query(r"""
    WITH f AS (
      SELECT item_id, unnest([1.1::DOUBLE, 0.55::DOUBLE]) AS w,
             unnest([list_filter(['the', 'and', 'of', 'tion'], lambda x: contains(text, x)),
                     list_filter(regexp_split_to_array(text, '[\s，。！？、,.!?；;：/]+'), lambda x: length(x) BETWEEN 2 AND 10)]) AS terms
      FROM benchmark)
    SELECT item_id, term, max(w) AS weight FROM (SELECT item_id, w, unnest(terms) AS term FROM f) GROUP BY item_id, term""")
def text_terms_weighted(spark, d):
    lex = F.array(*[F.lit(w) for w in ("the", "and", "of", "tion")])
    b = t(spark, d, "benchmark")
    field = lambda terms, w: b.select("item_id", F.explode(terms).alias("term"), F.lit(w).alias("w"))
    rows = field(X.term_hits("text", lex), 1.1).unionByName(field(X.query_terms("text"), 0.55))
    return rows.groupBy("item_id", "term").agg(F.max("w").alias("weight"))


@query("""
    SELECT doc_id, round((list_min(list_filter([instr(text, 'the'), instr(text, 'der'), instr(text, 'que')], lambda p: p > 0)) - 1)::DOUBLE
           / greatest(1, length(text)), 6) AS place FROM documents""")
def text_relative_position(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(X.relative_position("text", F.array(F.lit("the"), F.lit("der"), F.lit("que"))), 6).alias("place"))


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    r AS (SELECT doc_id, trim(line) AS line, count(*) AS n FROM l WHERE length(trim(line)) >= 6 GROUP BY doc_id, trim(line))
    SELECT doc_id, line, n FROM r WHERE n > 1""")
def text_sentence_dups(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).withColumn("line", F.trim("l"))
    return lines.filter(F.length("line") >= 6).groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n > 1")


@query(r"""
    WITH m AS (SELECT doc_id, regexp_replace(text, '[\s\p{P}]+', '', 'g') AS m FROM documents)
    SELECT sha256(m) AS meaning, count(*) AS n, min(doc_id) AS first_id FROM m GROUP BY m""")
def text_norm_equal(spark, d):
    m = t(spark, d, "documents").select("doc_id", F.sha2(X.meaning("text"), 256).alias("meaning"))
    return m.groupBy("meaning").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(r"""
    WITH a AS (SELECT doc_id, text, regexp_replace(text, 'sk-[A-Za-z0-9_-]{12,}', '<redacted>', 'g') AS x FROM documents),
    b AS (SELECT doc_id, text, regexp_replace(x, '(?i)(Authorization:\s*Bearer\s+)[A-Za-z0-9._-]+', '\1<redacted>', 'g') AS x FROM a),
    c AS (SELECT doc_id, text, regexp_replace(x, '(\bBearer\s+)[A-Za-z0-9._-]{12,}', '\1<redacted>', 'g') AS x FROM b),
    e AS (SELECT doc_id, text, regexp_replace(x, 'eyJ[A-Za-z0-9._-]{20,}', '<redacted>', 'g') AS x FROM c),
    f AS (SELECT doc_id, text, regexp_replace(x, '(?i)([?&](?:X-Amz-Signature|Signature|Expires|OSSAccessKeyId|security-token|sts_token|access_key_id|access_key_secret)=)[^&\s"]+', '\1<redacted>', 'g') AS x FROM e),
    g AS (SELECT doc_id, text, regexp_replace(x, '(?i)([?&](?:api[_-]?key|apikey|access[_-]?token|auth[_-]?token|token|secret|sign|signature)=)[^&\s"]+', '\1<redacted>', 'g') AS x FROM f)
    SELECT doc_id, sha256(x) AS digest, x <> text AS changed FROM g""")
def text_redact(spark, d):
    r = X.redacted("text")
    return t(spark, d, "documents").select("doc_id", F.sha2(r, 256).alias("digest"), (r != F.col("text")).alias("changed"))


@query("""
    SELECT doc_id, (('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 5)::BIGINT AS choice FROM documents""")
def text_stable_choice(spark, d):
    return t(spark, d, "documents").select("doc_id", X.stable_index("doc_id", 5).alias("choice"))


@query()
def text_caption_wrap(spark, d):
    ship(spark)
    lines = t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(caption_lines("text")).alias("line_no", "line"))
    return lines.withColumn("units", display_units("line"))


@query(r"""
    SELECT conv_id, turn, length(regexp_replace(text, '[\s，。！？、,.!?；;：:"''“”‘’（）()\[\]【】《》<>+\-_/]+', '', 'g'))::BIGINT AS units FROM conversations""")
def text_speech_units(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", long(X.speech_units("text")).alias("units"))


@query(r"""
    SELECT doc_id, (CASE WHEN text LIKE 'The%' THEN 'en' WHEN text LIKE 'D%' THEN 'de_fr' WHEN text LIKE 'L%' THEN 'fr_es' ELSE 'other' END) AS kind,
           (CASE WHEN trim(regexp_replace(lower(source), '[^\p{L}\p{N}]+', '-', 'g'), '-') = '' THEN 'item' ELSE trim(regexp_replace(lower(source), '[^\p{L}\p{N}]+', '-', 'g'), '-') END) AS slug
    FROM documents""")
def text_classified(spark, d):
    kind = X.classified("text", [("The", "en"), ("D", "de_fr"), ("L", "fr_es")], "other", "prefix")
    return t(spark, d, "documents").select("doc_id", kind.alias("kind"), slug("source").alias("slug"))


# Time axes


@query("""
    SELECT conv_id, turn, round(coalesce(sum(length(text) / 10.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS start_s,
           round(sum(length(text) / 10.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 3) AS end_s FROM conversations""")
def time_prefix_axis(spark, d):
    c = t(spark, d, "conversations").withColumn("duration_s", F.length("text") / 10.0)
    return I.running_axis(c, ["conv_id"], ["turn"], "duration_s").select("conv_id", "turn", "start_s", "end_s")


@query("""
    WITH u AS (SELECT conv_id, turn, greatest(1, length(text)) AS u FROM conversations),
    s AS (SELECT *, sum(u) OVER (PARTITION BY conv_id)::DOUBLE AS total, sum(u) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto,
                 lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last FROM u)
    SELECT conv_id, turn, round(60.0::DOUBLE * (upto - u) / total, 3) AS start_s, CASE WHEN last THEN 60.0::DOUBLE ELSE round(60.0::DOUBLE * upto / total, 3) END AS end_s FROM s""")
def time_proportional_axis(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.greatest(F.lit(1), F.length("text")).cast("double").alias("units"), F.lit(60.0).alias("total"))
    return I.proportional_axis(c, ["conv_id"], ["turn"], "units", "total").select("conv_id", "turn", "start_s", "end_s")


def _event_times(spark, d):
    at = F.col("ts").cast("timestamp").cast("double") - F.lit(1704067200.0)
    return t(spark, d, "events").select("event_id", "user_id", "event_type", F.round(at, 3).alias("start_s"), F.round(at + F.coalesce("value", F.lit(0.0)), 3).alias("end_s"))


_EV = """v AS (SELECT event_id, user_id, event_type, round(epoch_us(ts) / 1000000.0::DOUBLE - 1704067200.0::DOUBLE, 3) AS s,
             round(epoch_us(ts) / 1000000.0::DOUBLE - 1704067200.0::DOUBLE + coalesce(value, 0), 3) AS e FROM events)"""


@query(f"""
    WITH {_EV},
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) * 0.05::DOUBLE AS i FROM v),
    b AS (SELECT *, greatest(e, greatest(s, 0) + 0.05::DOUBLE) - i AS b FROM i),
    f AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) + i AS fe FROM b)
    SELECT event_id, user_id, round(greatest(s, coalesce(lag(fe) OVER (PARTITION BY user_id ORDER BY s, event_id), 0)), 3) AS start_s, round(fe, 3) AS end_s FROM f""")
def time_monotonic(spark, d):
    return I.monotonic(_event_times(spark, d), ["user_id"], ["event_id"]).select("event_id", "user_id", "start_s", "end_s")


@query(f"""
    WITH {_EV}
    SELECT a.user_id, count(*) AS n_pairs, round(sum(least(a.e, b.s + 3600) - greatest(a.s, b.s - 3600)), 1) AS overlap_s
    FROM v a JOIN v b ON a.user_id = b.user_id AND b.event_type = 'purchase'
     AND least(a.e, b.s + 3600) - greatest(a.s, b.s - 3600) > 0.05 GROUP BY a.user_id""")
def time_overlap_join(spark, d):
    e = _event_times(spark, d)
    left = e.select("user_id", "event_id", F.col("start_s").alias("l_start"), F.col("end_s").alias("l_end"))
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("p_id"), (F.col("start_s") - 3600).alias("r_start"), (F.col("start_s") + 3600).alias("r_end"))
    # Slots of two hours spread a user with very many events.
    hit = I.overlap_join(left, right, "user_id", slot=7200.0)
    return hit.groupBy("user_id").agg(F.count("*").alias("n_pairs"), F.round(F.sum("overlap_s"), 1).alias("overlap_s"))


@query(f"""
    WITH {_EV},
    r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT user_id, island::BIGINT AS island, count(*) AS n, min(s) AS start_s, max(e) AS end_s FROM g GROUP BY user_id, island""")
def time_gap_islands(spark, d):
    g = I.gap_islands(_event_times(spark, d), ["user_id"], ["start_s", "event_id"], 21600.0)
    return g.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).withColumn("island", long("island"))


@query(f"""
    WITH RECURSIVE {_EV},
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS n FROM v),
    f AS (SELECT user_id, n, s AS a, e AS last, e AS b, 1 AS island, 1 AS k FROM o WHERE n = 1
          UNION ALL
          SELECT o.user_id, o.n, CASE WHEN o.s - f.last <= 7200 AND o.e - f.a <= 86400 THEN f.a ELSE o.s END, o.e,
                 CASE WHEN o.s - f.last <= 7200 AND o.e - f.a <= 86400 THEN greatest(f.b, o.e) ELSE o.e END,
                 CASE WHEN o.s - f.last <= 7200 AND o.e - f.a <= 86400 THEN f.island ELSE f.island + 1 END,
                 CASE WHEN o.s - f.last <= 7200 AND o.e - f.a <= 86400 THEN f.k + 1 ELSE 1 END
          FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
    SELECT user_id, island::BIGINT AS island, min(a) AS start_s, max(b) AS end_s, max(k)::BIGINT AS n FROM f GROUP BY user_id, island""")
def time_islands_capped(spark, d):
    r = I.capped_islands(_event_times(spark, d), ["user_id"], gap=7200.0, span=86400.0)
    return r.select("user_id", long("island").alias("island"), "start_s", "end_s", long("n").alias("n"))


@query(f"""
    WITH {_EV},
    p AS (SELECT user_id, list_sort(list(DISTINCT s)) AS cuts FROM v WHERE event_type = 'purchase' GROUP BY user_id),
    c AS (SELECT event_id, e, list_filter(cuts, lambda x: abs(x - e) <= 600) AS near FROM v JOIN p USING (user_id))
    SELECT event_id, list_min(list_transform(near, lambda x: abs(x - e))) AS distance_s FROM c WHERE len(near) > 0""")
def time_snap(spark, d):
    e = _event_times(spark, d)
    cuts = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.array_sort(F.collect_set("start_s")).alias("cuts"))
    r = e.join(cuts, "user_id").withColumn("c", I.nearest(F.col("cuts"), F.col("end_s"), 600.0)).filter("c IS NOT NULL")
    return r.select("event_id", F.abs(F.col("c") - F.col("end_s")).alias("distance_s"))


@query()
def time_split_by_cuts(spark, d):
    e = _event_times(spark, d)
    cuts = e.groupBy("user_id").agg(F.array_sort(F.collect_set("start_s")).alias("cuts"))
    wide = e.filter("event_type = 'purchase'").select("event_id", "user_id", "start_s", (F.col("start_s") + 86400).alias("end_s"))
    return I.split_by_cuts(wide.join(cuts, "user_id"), shortest=3600.0, padding=60.0).select("event_id", "piece", "n_pieces", "piece_start_s", "piece_end_s")


@query("""
    WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(least(60 - used, l_quantity), 3) AS taken_s, round(greatest(0, 60 - used - l_quantity), 3) AS left_s FROM x WHERE 60 - used > 0.03::DOUBLE""")
def fill_budget(spark, d):
    l = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.lit(60.0).alias("budget"))  # noqa: E741
    return I.fill_budget(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", "budget").select("l_orderkey", "l_linenumber", "taken_s", "left_s")


@query()
def timeline_captions(spark, d):
    ship(spark)
    c = t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("voice_text"), F.length("text").cast("double").alias("units"), F.lit(120.0).alias("total"))
    s = I.proportional_axis(c, ["conv_id"], ["turn"], "units", "total").withColumn("section_id", F.col("turn"))
    return timeline.captions(s, "conv_id", "section_id", "turn")


# Aggregates


@query("""
    SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'view') AS n_view,
           count(*) FILTER (event_type NOT IN ('purchase', 'view')) AS n_other, count(*) AS n_total FROM events GROUP BY user_id""")
def agg_status_tally(spark, d):
    return A.tally(t(spark, d, "events"), ["user_id"], "event_type", ["purchase", "view"], "other")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type")
def agg_message_freq(spark, d):
    return A.message_frequency(t(spark, d, "events"), "event_type", "event_id")


@query("""
    SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 WHEN 'P' THEN 4 ELSE 2 END) WHEN 0 THEN 'pass' WHEN 2 THEN 'warning' ELSE 'block' END AS status, count(*) AS n
    FROM orders GROUP BY o_custkey""")
def agg_severity(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "P", "block").otherwise("warning")
    return t(spark, d, "orders").select("o_custkey", s.alias("s")).groupBy("o_custkey").agg(A.worst(F.col("s")).alias("status"), F.count("*").alias("n"))


@query("""
    WITH p AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey)
    SELECT l_suppkey, count(*) AS n_distinct, count(*) FILTER (n > 1) AS n_repeated, sum(n)::BIGINT AS n_all FROM p GROUP BY l_suppkey""")
def agg_count_map(spark, d):
    m = A.count_map(t(spark, d, "lineitem"), ["l_suppkey"], "l_partkey")
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda s, x: s + x)
    return m.select("l_suppkey", "n_distinct", long(F.size("repeated")).alias("n_repeated"), total.alias("n_all"))


@query("""
    SELECT d.lang, count(*) AS n_rows, count(l.quality) AS n_quality, count(l.toxic) AS n_toxic, count(d.text) AS n_text
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def agg_completeness(spark, d):
    return A.completeness(t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left"), ["lang"], ["quality", "toxic", "text"])


@query("""
    SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id""")
def agg_ordered_text(spark, d):
    return A.ordered_text(t(spark, d, "conversations"), ["conv_id"], "text", ["turn"])


@query("SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def agg_median(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(
        F.round(F.median("value"), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )


# Joins and sets


@query("""
    SELECT o_orderkey, o_custkey, count(l_orderkey) AS n_children, round(coalesce(sum(l_quantity), 0), 2) AS quantity, coalesce(min(l_linenumber), 0)::BIGINT AS first_line
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""")
def join_nested_children(spark, d):
    kids = J.nest_children(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", ["l_linenumber"])
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast(o.schema["children"].dataType)
    kids = F.coalesce("children", none)
    return o.select("o_orderkey", "o_custkey", long(F.size(kids)).alias("n_children"), F.round(F.aggregate(kids, F.lit(0.0), lambda s, x: s + x["l_quantity"]), 2).alias("quantity"), long(F.coalesce(F.get(kids, 0)["l_linenumber"], F.lit(0))).alias("first_line"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join_anti_missing(spark, d):
    return J.missing(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), ["doc_id"])


@query("""
    SELECT o_custkey, bool_and(o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS all_known FROM orders GROUP BY o_custkey""")
def join_semi(spark, d):
    lists = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    return J.known_lists(lists, "o_custkey", "ids", t(spark, d, "lineitem").filter("l_returnflag = 'R'"), "l_orderkey")


@query("""
    SELECT coalesce(c.c_custkey, o.k) AS key, c.c_custkey IS NOT NULL AS in_left, o.k IS NOT NULL AS in_right, coalesce(c.c_mktsegment, o.s) AS status
    FROM customer c FULL JOIN (SELECT o_custkey AS k, max(o_orderstatus) AS s FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.k""")
def join_full_outer(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("status"))
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderstatus").alias("status"))
    return J.full_status(c, o, "key")


@query("""
    WITH p AS (SELECT user_id, event_id AS p_id, ts FROM events WHERE event_type = 'purchase'),
    j AS (SELECT e.event_id, p.p_id, abs(epoch_us(p.ts) - epoch_us(e.ts)) AS dist FROM events e JOIN p USING (user_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, p_id) AS rn FROM j)
    SELECT event_id, p_id, round(dist / 1000000.0::DOUBLE, 3) AS distance_s FROM r WHERE rn = 1""")
def join_nearest_start(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "ts")
    p = e.join(t(spark, d, "events").filter("event_type = 'purchase'").select("event_id"), "event_id", "left_semi").select("user_id", F.col("event_id").alias("p_id"), F.col("ts").alias("p_ts"))
    r = I.nearest_start(e, p, "event_id", "p_id", "ts", "p_ts", ["user_id"]).filter("p_id IS NOT NULL")
    return r.select("event_id", "p_id", F.round("distance_s", 3).alias("distance_s"))


@query("""
    SELECT l_orderkey, l_linenumber::BIGINT AS line, p_brand, s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def join_lookup(spark, d):
    l = t(spark, d, "lineitem").select("l_orderkey", long("l_linenumber").alias("line"), F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))  # noqa: E741
    p = t(spark, d, "part").select("p_partkey", "p_brand", F.lit(0).alias("ord"))
    s = t(spark, d, "supplier").select("s_suppkey", "s_name", F.lit(0).alias("ord"))
    return J.lookup(J.lookup(l, p, ["p_partkey"], "ord"), s, ["s_suppkey"], "ord").select("l_orderkey", "line", "p_brand", "s_name")


@query("""
    WITH u AS (SELECT doc_id, 'a' AS run, 0 AS r FROM documents UNION ALL SELECT doc_id, 'b', 1 FROM labels),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS n FROM u)
    SELECT doc_id, run, run || ':' || doc_id AS run_key FROM f WHERE n = 1""")
def set_union_runs(spark, d):
    return U.union_runs([("a", t(spark, d, "documents").select("doc_id")), ("b", t(spark, d, "labels").select("doc_id"))], "doc_id")


@query("""
    SELECT c_custkey, 'both' AS kind FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
    UNION ALL SELECT c_custkey, 'only_customer' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def star_sets(spark, d):
    c, o = t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.intersect(o).withColumn("kind", F.lit("both")).unionByName(c.subtract(o).withColumn("kind", F.lit("only_customer")))


@query("""
    SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name)""")
def star_rollup(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "n_name")
    o = t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name", "n_name")
    l = t(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    return l.rollup("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def star_summary(spark, d):
    l = t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


# Documents, increments, state, checks, dashboards


@query("""
    SELECT event_id, props, json_valid(props) AS valid FROM events""")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", "props", F.try_parse_json("props").isNotNull().alias("valid"))


@query("""
    SELECT item_id, [CASE WHEN trim(text) = '' OR text IS NULL THEN 'text' END] IS NULL AS odd, length(text)::BIGINT AS n, coalesce(TRY_CAST(item_id::VARCHAR AS DOUBLE), 0) AS number,
           coalesce(nullif(text, ''), 'none') = text AS kept, round(30000 / 1001.0::DOUBLE, 6) AS fps FROM benchmark""")
def coerce_fields(spark, d):
    return t(spark, d, "benchmark").select(
        "item_id", (F.size(blank_fields(text="text")) > 0).alias("odd"), long(F.length("text")).alias("n"), as_double(F.col("item_id").cast("string")).alias("number"),
        (first_nonblank("text", default=F.lit("none")) == F.col("text")).alias("kept"), F.round(frame_rate(F.lit("30000/1001")), 6).alias("fps"),
    )


def _registry(spark, d):
    """Two thirds of the documents as known: ready or failed by their label."""
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    known = docs.join(labels, "doc_id").select(F.sha2("text", 256).alias("source_fingerprint"), "doc_id", F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("status"))
    return known.groupBy("source_fingerprint").agg(F.max_by("status", "doc_id").alias("status"), F.min("doc_id").alias("first_doc"))


_REG = """k AS (SELECT sha256(d.text) AS f, max_by(CASE WHEN quality = 1 THEN 'ready' ELSE 'failed' END, d.doc_id) AS status, min(d.doc_id) AS first_doc
          FROM documents d JOIN labels l USING (doc_id) GROUP BY d.text)"""


@query(f"""
    WITH {_REG}
    SELECT doc_id, CASE k.status WHEN 'ready' THEN 'already_ready' WHEN 'failed' THEN 'retry_failed' ELSE 'new_source' END AS reason, coalesce(k.status <> 'ready', true) AS selected
    FROM documents d LEFT JOIN k ON sha256(d.text) = k.f""")
def incr_classify(spark, d):
    src = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("source_fingerprint"))
    return N.classify(src, _registry(spark, d)).select("doc_id", "reason", "selected")


@query(f"""
    WITH {_REG},
    c AS (SELECT sha256(text) AS f, list_sort(list(DISTINCT 'doc/' || doc_id)) AS paths FROM documents GROUP BY text)
    SELECT coalesce(k.f, c.f) AS source_fingerprint, 'ready' AS status, len(list_distinct(list_concat(CASE WHEN k.f IS NULL THEN [] ELSE ['doc/' || k.first_doc] END, c.paths)))::BIGINT AS n_paths,
           k.f IS NULL AS is_new FROM k FULL JOIN c ON k.f = c.f""")
def incr_upsert(spark, d):
    reg = _registry(spark, d).select(
        "source_fingerprint", F.lit("").alias("filename"), F.lit(0).cast("long").alias("bytes"), "status", F.array(F.concat(F.lit("doc/"), F.col("first_doc").cast("string"))).alias("source_path_history"),
        F.lit("run0").alias("latest_run"), F.lit("run0").alias("first_run"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
        F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"),
    )
    new = t(spark, d, "documents").select(
        F.sha2("text", 256).alias("source_fingerprint"), F.lit("f").alias("filename"), F.col("n_chars").alias("bytes"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_path"),
        F.lit("ready").alias("status"), F.lit("run1").alias("run"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"),
    )
    out = N.upsert(reg, new, F.lit("2024-02-01").cast("timestamp"))
    return out.select("source_fingerprint", "status", long(F.size("source_path_history")).alias("n_paths"), (F.col("first_run") == "run1").alias("is_new"))


@query("""
    WITH f AS (SELECT year(o_orderdate) AS batch, l_orderkey AS task, l_partkey AS key, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT batch::BIGINT AS batch, task, key::VARCHAR AS key, (sum(n) OVER (PARTITION BY batch, key) - n)::BIGINT AS n_others FROM f""")
def state_leave_one_out(spark, d):
    l = t(spark, d, "lineitem").select("l_orderkey", "l_partkey")  # noqa: E741
    parts = S.parts_of(l)
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), long(F.year("o_orderdate")).alias("batch"))
    picks = l.repartition(parts, "l_orderkey").join(o.repartition(parts, "l_orderkey"), "l_orderkey").withColumnRenamed("l_orderkey", "task")
    return S.others(S.usage_facts(picks, "batch", "task", part="l_partkey"), "batch", "task", parts).select("batch", "task", "key", "n_others")


@query()
def select_sections(spark, d):
    ship(spark)
    q = search.vector(first_vector(spark, d))
    e = t(spark, d, "embeddings").select(
        (F.col("label") % 3).alias("task_id"), (F.col("vec_id") % 4).alias("section_order"), F.col("vec_id").alias("shot_id"), F.col("label").alias("unit_id"), (F.col("vec_id") % 7).alias("asset_id"),
        F.round(cosine(q, F.col("embedding")), 6).alias("score"), (1.5 + F.col("vec_id") % 5).alias("duration_s"), F.lit(8.0).alias("budget_s"),
    )
    return S.select_sections(e)


@query("""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
    SELECT user_id, event_id, event_type, rank FROM s WHERE rank <= 2""")
def dash_latest(spark, d):
    return B.latest(t(spark, d, "events"), ["user_id"], "ts", "event_id", 2).select("user_id", "event_id", "event_type", long("rank").alias("rank"))


@query("""
    WITH o AS (SELECT 'task' AS kind, o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' ELSE 'done' END AS status, o_orderdate AS updated_at FROM orders),
    p AS (SELECT *, CASE status WHEN 'running' THEN 'running' WHEN 'failed' THEN 'attention' ELSE 'recent' END AS place FROM o),
    r AS (SELECT * FROM p WHERE place = 'recent' ORDER BY updated_at DESC, id LIMIT 8)
    SELECT kind, id, status, place FROM p WHERE place <> 'recent' UNION ALL SELECT kind, id, status, place FROM r""")
def dash_center(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "failed").otherwise("done")
    tasks = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s.alias("status"), F.col("o_orderdate").alias("updated_at"))
    none = tasks.filter("false")
    acks = spark.createDataFrame([], "key string")
    return B.task_center(tasks, none, acks).select("kind", "id", "status", "place")


@query("""
    SELECT 'retrieval' AS id, CASE WHEN max(gap) > 0.35 OR count(*) FILTER (h IS NULL) > 0 THEN 'block' WHEN max(gap) > 0.08 THEN 'warning' ELSE 'pass' END AS status, count(*)::DOUBLE AS sections
    FROM (SELECT o_orderkey, h, 100 - coalesce(h, 0) AS gap FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS h FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)""")
def qa_coverage(spark, d):
    s = t(spark, d, "orders").select(F.col("o_orderkey").alias("section_id"), F.lit(100.0).alias("audio_duration_s"))
    c = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_quantity").alias("planned_s"))
    return Q.coverage_check(s, c).select("id", "status", F.col("metrics")["sections"].alias("sections"))


@query("SELECT doc_id, ['source'] AS blank FROM documents WHERE source IS NULL OR trim(source) = ''")
def qa_field_warnings(spark, d):
    return Q.field_warnings(t(spark, d, "documents"), "doc_id", ["text", "source"]).filter(F.array_contains("blank", "source"))


@query("""
    SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_events(spark, d):
    """The events as a file stream, worked through by windows; the sink's table is the result."""
    import uuid

    from ..operators.dedupe import _ensure_checkpoint_dir
    from ..streaming import streams as W

    _ensure_checkpoint_dir(spark)
    base = f"{spark.conf.get('spark.checkpoint.dir')}/tidemark/stream-{uuid.uuid4().hex}"
    schema = t(spark, d, "events").schema
    src = W.file_stream(spark, f"{d}/events.parquet*", schema)
    counted = src.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    counted = counted.select("event_type", F.col("window.start").alias("day"), "n", "total")
    W.run_available(counted, lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/ck", "complete")
    return spark.read.parquet(f"{base}/out").withColumn("total", F.round("total", 4))

from . import record_queries, rule_queries, scale_queries  # noqa: E402, F401  these register theirs as well
