"""Queries of record, text, join, set, check and state operators; each stands beside its SQL.

Arrays are shown as texts, so that results compare alike everywhere.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce as O
from ..functions import documents as W
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import projections as P
from ..operators import quality as Q
from ..operators import records as R
from ..operators import sets as U
from ..streaming import incremental as N
from . import dashboard as B
from .queries import long, query, t


#: Tasks that share the orders of a nation.
TASKS_A_NATION = 2


def _pick(xs, c=None):
    c = F.col("event_id") if c is None else c
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))


def _as_text(c):
    return F.array_join(c, ",")


# Texts


@query(r"""
    WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+') AS p FROM documents),
    u AS (SELECT doc_id, unnest(list_filter(list_transform(p, lambda x: trim(x)), lambda x: x <> '')) AS s FROM s)
    SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars, min(s) AS least FROM u GROUP BY doc_id""")
def text_sentences(spark, d):
    s = t(spark, d, "documents").select("doc_id", F.explode(X.sentences("text", ".!?。！？")).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"), F.min("s").alias("least"))


@query(r"""
    WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+') AS p FROM documents),
    u AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM s),
    b AS (SELECT doc_id, i, trim(regexp_replace(trim(s), '[.!?。！？]+$', '')) AS b FROM u),
    r AS (SELECT doc_id, b, i FROM b WHERE length(b) >= 6 QUALIFY row_number() OVER (PARTITION BY doc_id, b ORDER BY i) = 2),
    k AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r)
    SELECT doc_id, k, b AS body FROM k WHERE k <= 3""")
def text_sentence_repeats(spark, d):
    r = t(spark, d, "documents").select("doc_id", F.posexplode(X.repeated_sentences("text", ends=".!?。！？")).alias("k", "body"))
    return r.select("doc_id", long(F.col("k") + 1).alias("k"), "body")


@query(r"""
    WITH f AS (
      SELECT item_id, unnest([1.1::DOUBLE, 0.55::DOUBLE, 1.05::DOUBLE]) AS w,
             unnest([list_filter(['the', 'and', 'of', 'tion'], lambda x: contains(text, x)),
                     list_filter(regexp_split_to_array(text, '[\s，。！？、,.!?；;：/]+'), lambda x: length(x) BETWEEN 2 AND 10), ['the', 'item']]) AS terms
      FROM benchmark)
    SELECT item_id, term, max(w) AS weight FROM (SELECT item_id, w, unnest(terms) AS term FROM f) GROUP BY item_id, term""")
def text_section_terms(spark, d):
    b = t(spark, d, "benchmark").withColumn("keywords", F.array(F.lit("the"), F.lit("item")))
    return R.section_terms(b, "item_id", ["the", "and", "of", "tion"], {"text": 1.1})


@query("""
    WITH a AS (SELECT doc_id, text, unnest(['ending', 'article', 'none']) AS term, unnest([['tion', 'ung'], ['the', 'der', 'les'], []::VARCHAR[]]) AS alias FROM documents)
    SELECT doc_id, term FROM a WHERE contains(text, term) OR len(list_filter(alias, lambda x: contains(text, x))) > 0""")
def text_alias_hits(spark, d):
    of = lambda *xs: F.array(*[F.lit(x) for x in xs])
    aliases = F.create_map(F.lit("ending"), of("tion", "ung"), F.lit("article"), of("the", "der", "les"))
    return t(spark, d, "documents").select("doc_id", F.explode(X.term_hits("text", of("ending", "article", "none"), aliases)).alias("term"))


@query(r"""
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'SPF\s*50\+', 'SPF五十加', 'gi'), 'PA\s*\+\+\+', 'PA三个加', 'gi'), '(^|[^0-9])618([^0-9]|$)', '\1六一八\2', 'g'), '\s+', '', 'g') AS spoken,
           trim(regexp_replace(c, '[，。,\.、､]', '', 'g')) AS caption, p_partkey % 7 + 1 AS n_rules
    FROM (SELECT p_partkey, p_name || CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' spf 50+' ELSE ' SPF50+ PA+++' END || CASE WHEN p_partkey % 2 = 0 THEN ' 618 ' ELSE ' 6180 ' END AS s, ' ' || p_name || ', ' || p_brand || '。' AS c FROM part)""")
def text_spoken(spark, d):
    n = F.col("p_partkey")
    s = F.concat("p_name", F.when(n % 7 == 0, "").when(n % 7 == 1, " spf 50+").otherwise(" SPF50+ PA+++"), F.when(n % 2 == 0, " 618 ").otherwise(" 6180 "))
    c = F.concat(F.lit(" "), "p_name", F.lit(", "), "p_brand", F.lit("。"))
    return t(spark, d, "part").select("p_partkey", X.spoken(s).alias("spoken"), X.caption_text(c).alias("caption"), (n % 7 + 1).alias("n_rules"))


@query("""
    SELECT event_id, 'pts_time:' AS name, round(value, 2) AS first, round(value + 1, 2) AS last, 2 AS n, (event_id % 40)::BIGINT AS processed, 40::BIGINT AS total,
           round_even((event_id % 40) * 100 / 40.0, 0)::INT AS percent, CASE WHEN event_type IN ('error', 'click') THEN 'bad: ' || event_type || ' ' || event_id WHEN user_id % 2 = 0 THEN 'user: user ' || user_id END AS failure
    FROM events""")
def text_log_rules(spark, d):
    v = F.col("value")
    log = F.concat(F.lit("pts_time:"), F.round(v, 2).cast("string"), F.lit(" x pts_time: "), F.round(v + 1, 2).cast("string"))
    progress = X.last_progress(F.concat(F.lit("[1/9] start\n["), (F.col("event_id") % 40).cast("string"), F.lit("/40] go")))
    lines = F.concat(F.lit(" "), "event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(" \nuser "), F.col("user_id").cast("string"))
    even = F.when(F.col("user_id") % 2 == 0, lines).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "), F.col("event_id").cast("string")))
    times = X.all_times(log, "pts_time")
    return t(spark, d, "events").select(
        "event_id", F.lit("pts_time:").alias("name"), F.get(times, 0)["pts_time"].alias("first"), F.get(times, 1)["pts_time"].alias("last"), F.size(times).alias("n"),
        progress["processed"].alias("processed"), progress["total"].alias("total"), progress["percent"].alias("percent"),
        X.failure_line(even, [("error", "bad"), ("click", "bad"), ("user", "user")]).alias("failure"),
    )


@query(r"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    u AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM l),
    c AS (SELECT doc_id, trim(regexp_replace(l, '^\s*(?:[-*•]|\d+[.、)])\s*', '')) AS claim, i FROM u),
    f AS (SELECT doc_id, claim, min(i) AS i FROM c WHERE claim <> '' GROUP BY doc_id, claim),
    r AS (SELECT doc_id, claim, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM f)
    SELECT doc_id, rank, claim, CASE WHEN rank <= 3 THEN 'core' ELSE 'support' END AS tier FROM r WHERE rank <= 10""")
def text_claims(spark, d):
    return P.claims(t(spark, d, "documents"), "doc_id", "text").withColumn("rank", long("rank"))


@query(r"""
    WITH w AS (SELECT item_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ws FROM benchmark),
    u AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
    f AS (SELECT item_id, w, min(i) AS i FROM u GROUP BY item_id, w)
    SELECT item_id, string_agg(w, ',' ORDER BY i) AS words FROM f GROUP BY item_id""")
def text_ordered_distinct(spark, d):
    return t(spark, d, "benchmark").select("item_id", _as_text(X.ordered_distinct(F.split("text", " "))).alias("words"))


@query("""
    WITH s AS (SELECT item_id, [substr(text, 1, 60) || '。ab。', substr(text, 61, 40) || '！', substr(text, 101, 50) || '？cd！efg'] AS s FROM benchmark),
    o AS (SELECT item_id, s, len(s[1]) + len(s[2]) + len(s[3]) - 150 AS over, 3 AS saves3, 3 AS saves1 FROM s)
    SELECT item_id, CASE WHEN over - saves3 > 0 THEN s[1][1:len(s[1]) - saves1] ELSE s[1] END AS a, s[2] AS b, CASE WHEN over > 0 THEN s[3][1:len(s[3]) - saves3] ELSE s[3] END AS c
    FROM o WHERE len(regexp_extract_all(s[1], '[。！？!?]')) = 2 AND len(regexp_extract_all(s[2], '[。！？!?]')) = 1 AND len(regexp_extract_all(s[3], '[。！？!?]')) = 2 AND trim(s[1]) = s[1] AND trim(s[3]) = s[3]""")
def text_within_length(spark, d):
    s = F.array(
        F.concat(F.substring("text", 1, 60), F.lit("。ab。")), F.concat(F.substring("text", 61, 40), F.lit("！")), F.concat(F.substring("text", 101, 50), F.lit("？cd！efg"))
    )
    b = t(spark, d, "benchmark").select("item_id", s.alias("s"))
    ends = lambda i, n: F.size(F.regexp_extract_all(F.col("s")[i], F.lit("[。！？!?]"), 0)) == n
    b = b.filter(ends(0, 2) & ends(1, 1) & ends(2, 2) & (F.trim(F.col("s")[0]) == F.col("s")[0]) & (F.trim(F.col("s")[2]) == F.col("s")[2]))
    cut = b.select("item_id", X.within_length(F.col("s"), 150).alias("o"))
    return cut.select("item_id", F.get("o", 0).alias("a"), F.get("o", 1).alias("b"), F.get("o", 2).alias("c"))


@query("""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN props ELSE NULL END AS found, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS n
    FROM events""")
def json_found(spark, d):
    p = F.col("props")
    said = F.when(F.col("event_id") % 5 == 0, p).when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("Here: "), p, F.lit(" so."))).when(F.col("event_id") % 5 == 3, F.lit("none")).otherwise(F.lit("{broken"))
    cut = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": ['), p, F.lit(', {"k": 1'))).otherwise(F.concat(F.lit("x ["), p))
    fixed = W.repaired_json(cut)
    rows = F.when(F.col("event_id") % 2 == 0, F.get_json_object(fixed, "$.a")).otherwise(fixed)
    return t(spark, d, "events").select(
        "event_id", W.json_object(said).alias("found"), F.get_json_object(rows, "$[0].k").cast("long").alias("k"), F.size(F.from_json(rows, "array<struct<k:long>>")).alias("n")
    )


@query("""
    SELECT event_id, 2 AS n, CASE WHEN event_id % 2 = 0 THEN round((100 + floor(value)) / 1000, 3) ELSE 100 + floor(value) END AS start_s, event_type AS text FROM events""")
def json_subtitles(spark, d):
    v = (100 + F.floor("value")).cast("string")
    item = lambda a, b: F.concat(F.lit('{"text": "'), "event_type", F.lit(f'", "{a}": '), v, F.lit(f', "{b}": 20000.0}}'))
    doc = F.concat(F.lit('{"a": [{"b": '), item("begin_time", "end_time"), F.lit('}, {"sentence": "later", "start": 5000.0, "end": 6000.0}, {"text": "no times"}]}'))
    e = t(spark, d, "events")
    s = e.select("event_id", W.subtitle_items(doc, F.when(F.col("event_id") % 2 == 0, 20.0).otherwise(9000.0)).alias("s"))
    first = F.filter("s", lambda x: x["text"] != "later")
    return s.select("event_id", F.size("s").alias("n"), F.get(first, 0)["start_s"].alias("start_s"), F.get(first, 0)["text"].alias("text"))


# Casts and small projections


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n_list, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS joined, event_id % 5 IN (0, 2, 4) AS truth,
           CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'x' END AS name, CASE WHEN event_id % 4 = 0 THEN 1.5 ELSE value END AS start_s, value + 1 AS end_s,
           ['done', 'failed', 'pending', 'pending'][(event_id % 4) + 1] AS status, substr(event_type, 1, 3) AS short, 's1' AS slot_id, 7 AS timeline_order
    FROM events""")
def coerce_small(spark, d):
    text = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    name = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("")
    pair = F.when(F.col("event_id") % 4 == 0, F.array(F.lit(1.5)))
    span = O.time_range(pair, F.col("value"), F.col("value") + 1)
    rows = t(spark, d, "events").select(
        "event_id", F.size(O.as_list(text)).alias("n_list"), O.as_text(O.as_list(text)).alias("joined"), O.as_bool(_pick(["Yes", "no", " TRUE", "0", "on"])).alias("truth"),
        O.product(name, F.lit("x"))["name"].alias("name"), span[0].alias("start_s"), span[1].alias("end_s"),
        O.status_of(_pick(["SUCCEEDED", "Failed", "other", ""]), {"succeeded": "done", "failed": "failed"}, "pending").alias("status"), P.shortened("event_type", 3).alias("short"),
        F.lit("h").alias("phash"), F.lit(1).alias("_private"),
    )
    return P.public_columns(P.slot_fields(rows, "s1", "l", "r", 7)).drop("slot_label", "slot_role")


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE value END AS start_s, CASE WHEN event_id % 3 = 0 THEN 4.0 ELSE value + 2 END AS end_s,
           CASE WHEN event_id % 5 = 0 THEN 9.0 WHEN event_id % 3 = 0 THEN 3.0 ELSE 2.0 END AS duration_s, CASE WHEN event_id % 2 = 0 THEN 'unique' ELSE event_type END AS duplicate_status FROM events""")
def child_records(spark, d):
    nums = lambda *xs: F.array(*[F.lit(x) for x in xs])
    e = t(spark, d, "events").select(
        F.col("event_id").cast("string").alias("shot_id"), F.lit("p").alias("parent_shot_id"), F.when(F.col("event_id") % 3 == 0, nums(1.0, 4.0)).alias("time_range"), F.col("value").alias("start_s"), (F.col("value") + 2).alias("end_s"),
        F.lit(None).cast("array<double>").alias("usable_range"), F.when(F.col("event_id") % 5 == 0, 9.0).alias("clip_actual_duration_s"), F.lit(0.0).alias("duration_s"), F.lit(None).cast("string").alias("visual_summary"),
        F.lit("m").alias("source_meaning"), F.lit(None).cast("array<string>").alias("visual_actions"), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type")).alias("duplicate_status"),
    )
    return R.child_records(e).select(F.col("shot_id").cast("long").alias("event_id"), "start_s", "end_s", F.round("duration_s", 6).alias("duration_s"), "duplicate_status")


@query("""
    WITH c AS (SELECT event_id, unnest(['source_meaning', 'visual_summary', 'tags', 'asr', 'ocr', 'video_chunk']) AS channel,
                      unnest([event_type, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END, event_type || '; a; b', '', 'o1 o2', '']) AS value FROM events)
    SELECT event_id, channel, value, value <> '' AS enabled FROM c""")
def channel_inputs(spark, d):
    many = lambda *xs: F.array(*[F.lit(x) for x in xs])
    e = t(spark, d, "events").select(
        F.col("event_id").alias("shot_id"), F.col("event_type").alias("source_meaning"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("").alias("visual_summary"), F.col("event_type").alias("label"),
        many("a").alias("selling_points"), many("b").alias("visual_actions"), F.lit("").alias("source_asr"), many("o1", "o2").alias("source_ocr"),
    )
    return P.channel_inputs(e).select(F.col("shot_id").alias("event_id"), "channel", "value", "enabled")


@query("""
    WITH s AS (SELECT conv_id, turn, role, text FROM conversations WHERE turn % 3 <> 1)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS timeline_order, role, md5(text) AS digest FROM s WHERE trim(text) <> ''""")
def script_sections(spark, d):
    c = t(spark, d, "conversations")
    text = F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text"))
    s = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.lit("").alias("section_id"), "role", text.alias("voice_text")))), lambda x: x)
    out = P.script_sections(c.groupBy("conv_id").agg(s.alias("sections")), "conv_id", "sections")
    return out.select("conv_id", long("timeline_order").alias("timeline_order"), "role", F.md5("voice_text").alias("digest"))


# Aggregates


@query("""
    SELECT event_id // 3 AS task_id, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'refund') THEN 'review' WHEN bool_or(event_type = 'click') THEN 'running' ELSE 'done' END AS status
    FROM events GROUP BY event_id // 3""")
def agg_final_status(spark, d):
    s = F.create_map(*[F.lit(x) for x in ("error", "failed", "refund", "review", "click", "running")])
    e = t(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("task_id"), F.coalesce(F.try_element_at(s, F.col("event_type")), F.lit("done")).alias("s"))
    return e.groupBy("task_id").agg(A.final_status(F.col("s")).alias("status"))


@query("""
    SELECT channel, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed
    FROM (SELECT event_type AS channel, event_id % 3 <> 0 AS ok FROM events UNION ALL SELECT 'all', event_id % 5 <> 0 FROM events) GROUP BY channel""")
def agg_channel_success(spark, d):
    one = lambda n: F.struct(F.when(F.col("event_id") % n != 0, "ok").otherwise("failed").alias("status"))
    return A.channel_success(t(spark, d, "events").select(F.create_map(F.col("event_type"), one(3), F.lit("all"), one(5)).alias("c")), "c")


@query("SELECT count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'none') AS n_none FROM events")
def agg_bucket_counts(spark, d):
    return A.bucket_counts(t(spark, d, "events"), "event_type", ["click", "error", "none"])


@query("""
    WITH v AS (SELECT DISTINCT user_id, unnest([event_type, 'x' || event_id % 7]) AS v FROM events)
    SELECT user_id, string_agg(v, ',' ORDER BY v) AS vs FROM v GROUP BY user_id""")
def agg_sorted_set(spark, d):
    e = t(spark, d, "events").select("user_id", F.array("event_type", F.concat(F.lit("x"), (F.col("event_id") % 7).cast("string"))).alias("vs"))
    return A.sorted_set(e, ["user_id"], "vs").select("user_id", _as_text("vs").alias("vs"))


@query("""
    WITH g AS (SELECT CASE WHEN event_id % 6 = 0 THEN 'other' ELSE event_type END AS label, user_id, min(event_id) AS seen FROM events GROUP BY ALL)
    SELECT label, string_agg(user_id::VARCHAR, ',' ORDER BY seen) AS items, min(seen) AS first_seen FROM g GROUP BY label""")
def agg_first_seen(spark, d):
    e = t(spark, d, "events").withColumn("label", F.when(F.col("event_id") % 6 == 0, "").otherwise(F.col("event_type")))
    return A.first_seen_groups(e, "label", "user_id", "event_id", "other").select("label", _as_text("items").alias("items"), "first_seen")


# Joins and sets


@query("""
    WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [o_custkey, o_custkey + 1] ELSE []::BIGINT[] END AS ids FROM orders),
    a AS (SELECT o_orderkey, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM l),
    b AS (SELECT o_orderkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY i) AS kids FROM a JOIN customer ON id = c_custkey GROUP BY o_orderkey),
    k AS (SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS kids FROM customer GROUP BY c_nationkey)
    SELECT l.o_orderkey, coalesce(b.kids, k.kids, '') AS kids FROM l LEFT JOIN b USING (o_orderkey) LEFT JOIN k ON k.c_nationkey = l.o_orderkey % 40""")
def join_fallback_key(spark, d):
    o = t(spark, d, "orders")
    ids = F.when(o["o_orderkey"] % 3 == 0, F.array(F.col("o_custkey"), F.col("o_custkey") + 1)).otherwise(F.array().cast("array<bigint>"))
    o = o.select("o_orderkey", (F.col("o_orderkey") % 40).alias("nation"), ids.alias("ids"))
    kids = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    mine = kids.select(F.lit(None).cast("bigint").alias("none"), "c_custkey")
    names = lambda c: _as_text(F.transform(c, lambda x: x["c_custkey"].cast("string")))
    listed = J.with_children(o, mine, "o_orderkey", "none", "ids", "c_custkey", ["c_custkey"]).select("o_orderkey", "nation", names("children").alias("own"))
    # A row for each of the 25 nations, its text made once; joined last, so that no shuffle carries an order's copy of it.
    nested = J.nest_children(kids.filter("c_nationkey IS NOT NULL"), "c_nationkey", ["c_custkey"]).select("c_nationkey", names("children").alias("all"))
    # Nor does a written result: a task has orders of one nation and none with a list of its own, so a file's dictionary holds the text once.
    task = F.coalesce(F.pmod("nation", F.lit(40)) * TASKS_A_NATION + F.pmod(F.xxhash64("o_orderkey"), F.lit(TASKS_A_NATION)), F.lit(0)).cast("int")
    rest = listed.filter("own IS NULL").select("o_orderkey", "nation").repartitionById(40 * TASKS_A_NATION, task)
    rest = rest.join(F.broadcast(nested), F.col("nation") == F.col("c_nationkey"), "left").select("o_orderkey", F.coalesce("all", F.lit("")).alias("kids"))
    return rest.unionByName(listed.filter("own IS NOT NULL").select("o_orderkey", F.col("own").alias("kids")))


@query("SELECT event_id FROM events WHERE NOT (event_id % 10 = 3 OR user_id % 10 = 4)")
def join_unacknowledged(spark, d):
    e = t(spark, d, "events").select("event_id", F.array(F.concat(F.lit("e"), (F.col("event_id") % 10).cast("string")), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))).alias("keys"))
    acks = spark.createDataFrame([("e3",), ("u4",), ("u4",), ("zz",)], "ack string")
    return J.unacknowledged(e, "event_id", "keys", acks, "ack").select("event_id")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_required(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.required_lookup(t(spark, d, "orders"), c, "o_custkey", "no such customer").select("o_orderkey", "c_mktsegment")


@query("""
    SELECT o_orderkey, bool_and(p_partkey IS NOT NULL) AS all_known FROM orders LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) ON p_partkey IN (o_orderkey % 50, o_orderkey % 50 + 1) GROUP BY o_orderkey
    HAVING count(*) >= 1""".replace("bool_and(p_partkey IS NOT NULL)", "count(p_partkey) = 2"))
def join_known_lists(spark, d):
    n = F.col("o_orderkey") % 50
    known = t(spark, d, "part").filter("p_partkey % 10 <> 0")
    return J.known_lists(t(spark, d, "orders").select("o_orderkey", F.array(n, n + 1).alias("ids")), "o_orderkey", "ids", known, "p_partkey")


@query("""
    WITH r AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN 'clip-' || p_partkey ELSE 'x_' || (1000000000 + p_partkey) || '_y' END AS name FROM part),
    l AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'clip-' || c_custkey ELSE 'other' END AS name, (1000000000 + c_custkey)::VARCHAR AS prefix FROM customer)
    SELECT c_custkey, min(ord) AS ord FROM l JOIN r ON l.name = r.name OR contains(r.name, '_' || l.prefix || '_') GROUP BY c_custkey""")
def join_fuzzy_file(spark, d):
    n, m = F.col("p_partkey"), F.col("c_custkey")
    big = lambda c: (F.lit(1000000000) + c).cast("string")
    r = t(spark, d, "part").select(n.alias("ord"), F.when(n % 2 == 0, F.concat(F.lit("clip-"), n.cast("string"))).otherwise(F.concat(F.lit("x_"), big(n), F.lit("_y"))).alias("rname"))
    c = t(spark, d, "customer").select("c_custkey", F.when(m % 3 == 0, F.concat(F.lit("clip-"), m.cast("string"))).otherwise("other").alias("name"), big(m).alias("prefix"))
    return J.any_key_match(c, r, "c_custkey", "name", "prefix", "rname", "ord")


@query("""
    SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types, arg_min(value, event_id) FILTER (event_id % 3 = 0) AS value FROM events GROUP BY user_id""")
def join_merged_rows(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.array("event_type").alias("types"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return J.merge_rows(e, "user_id", "event_id", ["types"], ["value"]).select("user_id", _as_text("types").alias("types"), "value")


@query("""
    SELECT doc_id, array_to_string(list_filter(['the', 'ending'], lambda x: NOT list_contains(hits, x) AND NOT (x = 'ending' AND list_has_any(hits, ['tion', 'ung']))), ',') AS lacking, list_has_any(hits, ['tion', 'the']) AS meets
    FROM (SELECT doc_id, list_filter(['the', 'tion', 'ung'], lambda w: contains(text, w)) AS hits FROM documents)""")
def set_lacking(spark, d):
    of = lambda *xs: F.array(*[F.lit(x) for x in xs])
    rows = t(spark, d, "documents").select("doc_id", X.term_hits("text", of("the", "tion", "ung")).alias("hits"))
    gone = U.lacking(of("the", "ending"), F.col("hits"), F.create_map(F.lit("ending"), of("tion", "ung")))
    return rows.select("doc_id", _as_text(gone).alias("lacking"), U.intersects(F.col("hits"), of("tion", "the")).alias("meets"))


@query("""
    WITH f AS (
      SELECT event_id % 3 AS r, CASE WHEN event_id % 3 = 2 AND event_id % 4 = 0 THEN ' ' ELSE (event_id * 7 // 11)::VARCHAR END AS k, event_id FROM events)
    SELECT k, event_id FROM f WHERE trim(k) <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY r, event_id) = 1""")
def set_first_key(spark, d):
    n = F.col("event_id")
    e = t(spark, d, "events").select(F.floor(n * 7 / 11).cast("string").alias("k"), "event_id")
    lists = [e.filter(n % 3 == r) for r in range(3)]
    lists[2] = lists[2].withColumn("k", F.when(n % 4 == 0, " ").otherwise(F.col("k")))
    return U.first_key_wins(lists, "k", "event_id")


@query("""
    WITH r AS (SELECT event_id, event_id % 3 = 0 AS is_job, CASE WHEN event_id % 2 = 0 THEN 'j' || event_id // 4 ELSE '' END AS job_id, CASE WHEN event_id % 5 = 0 THEN '/d' || event_id // 17 ELSE '' END AS job_dir FROM events),
    x AS (SELECT * FROM r WHERE NOT is_job)
    SELECT event_id, is_job FROM r WHERE NOT is_job OR (job_id NOT IN (SELECT job_id FROM x WHERE job_id <> '') AND job_dir NOT IN (SELECT job_dir FROM x WHERE job_dir <> ''))""")
def set_jobs_without_runs(spark, d):
    n = F.col("event_id")
    e = t(spark, d, "events").select(
        "event_id", (n % 3 == 0).alias("is_job"), F.when(n % 2 == 0, F.concat(F.lit("j"), F.floor(n / 4).cast("string"))).otherwise("").alias("job_id"),
        F.when(n % 5 == 0, F.concat(F.lit("/d"), F.floor(n / 17).cast("string"))).otherwise("").alias("job_dir"),
    )
    return U.hide_jobs_with_runs(e).select("event_id", "is_job")


@query("""
    SELECT event_id, coalesce(array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS before FROM events""")
def window_previous(spark, d):
    return R.previous(t(spark, d, "events"), ["user_id"], "event_id", "event_type", 3).select("event_id", _as_text("before").alias("before"))


# Checks


def _check(c, *names):
    return c.select("id", "status", *[F.col("metrics")[n].alias(n) for n in names], _as_text("blocks").alias("blocks"), _as_text("warnings").alias("warnings"))


@query("""
    SELECT 'artifacts' AS id, CASE WHEN m > 0 THEN 'block' ELSE 'pass' END AS status, n AS required, m AS missing, CASE WHEN m > 0 THEN 'required artifact is missing' ELSE '' END AS blocks, '' AS warnings
    FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels))::DOUBLE AS m FROM documents)
    UNION ALL SELECT 'artifacts', 'pass', count(*)::DOUBLE, 0, '', '' FROM labels""")
def qa_artifacts(spark, d):
    docs, labels = (t(spark, d, x).select(F.col("doc_id").alias("name")) for x in ("documents", "labels"))
    return _check(Q.artifact_check(docs, labels).unionByName(Q.artifact_check(labels, docs)), "required", "missing")


@query("""
    SELECT 'segmentation' AS id, CASE WHEN n = 0 THEN 'block' WHEN short > 0 OR bare > 0 THEN 'warning' ELSE 'pass' END AS status, n AS shots, short, bare AS no_frames, CASE WHEN n = 0 THEN 'no shots' ELSE '' END AS blocks,
           array_to_string(list_filter([CASE WHEN short > 0 THEN 'very short shots' END, CASE WHEN bare > 0 THEN 'shots without frames' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM (SELECT g, count(*) FILTER (event_id IS NOT NULL)::DOUBLE AS n, count(*) FILTER (value < 0.5)::DOUBLE AS short, count(*) FILTER (event_id % 1000 = 0)::DOUBLE AS bare
          FROM (SELECT 0 AS g UNION ALL SELECT 1 UNION ALL SELECT 2) LEFT JOIN events ON g = 0 OR (g = 1 AND value > 10 AND event_id % 1000 <> 0) GROUP BY g)""")
def qa_segmentation(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("value").alias("duration_s"), F.when(F.col("event_id") % 1000 != 0, F.array(F.lit("f"))).alias("frames"))
    parts = [e, e.filter("duration_s > 10 AND event_id % 1000 <> 0"), e.filter("false")]
    c = [_check(Q.segmentation_check(x), "shots", "short", "no_frames") for x in parts]
    return c[0].unionByName(c[1]).unionByName(c[2])


@query("""
    WITH s AS (SELECT o_orderkey, o_orderkey % 3 AS g, 20 + o_orderkey % 5 AS dur FROM orders), h AS (SELECT l_orderkey, sum(l_quantity) AS h FROM lineitem GROUP BY l_orderkey),
    k AS (SELECT g, h, dur - CASE g WHEN 0 THEN 0 WHEN 1 THEN dur - 0.2 ELSE coalesce(h, 0) END AS gap0, CASE g WHEN 0 THEN dur WHEN 1 THEN dur - 0.2 ELSE h END AS have, dur FROM s LEFT JOIN h ON l_orderkey = o_orderkey),
    r AS (SELECT g, count(*)::DOUBLE AS n, count(*) FILTER (have IS NULL)::DOUBLE AS empty, round(max(dur - coalesce(have, 0))::DOUBLE, 6) AS gap FROM k GROUP BY g)
    SELECT 'retrieval' AS id, CASE WHEN empty > 0 OR gap > 0.35 THEN 'block' WHEN gap > 0.08 THEN 'warning' ELSE 'pass' END AS status, n AS sections, empty, gap AS max_gap_s FROM r""")
def qa_coverage_levels(spark, d):
    s = t(spark, d, "orders").select(F.col("o_orderkey").alias("section_id"), (20.0 + F.col("o_orderkey") % 5).alias("audio_duration_s"))
    clips = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_quantity").alias("planned_s"))
    whole = lambda less: s.select("section_id", (F.col("audio_duration_s") - less).alias("planned_s"))
    out = None
    for g, c in enumerate((whole(0.0), whole(0.2), clips)):
        x = Q.coverage_check(s.filter(F.col("section_id") % 3 == g), c).select("id", "status", *[F.round(F.col("metrics")[n], 6).alias(n) for n in ("sections", "empty", "max_gap_s")])
        out = x if out is None else out.unionByName(x)
    return out


@query("""
    WITH c AS (SELECT 'loops' AS id, count(*) FILTER (event_type = 'error')::DOUBLE AS n FROM events UNION ALL SELECT 'loops', 0 UNION ALL SELECT 'render', max(value - 300) FROM events UNION ALL SELECT 'render', 0.2
              UNION ALL SELECT 'alignment', max(CASE event_type WHEN 'error' THEN 4 WHEN 'click' THEN 0 ELSE 2 END) FROM events)
    SELECT id, round(n, 6) AS n, CASE WHEN id = 'loops' AND n > 0 OR id = 'render' AND n > 0.35 THEN 'block' WHEN id = 'alignment' AND n >= 2 THEN 'warning' ELSE 'pass' END AS status FROM c""")
def qa_small_checks(spark, d):
    e = t(spark, d, "events")
    status = F.create_map(*[F.lit(x) for x in ("error", "block", "click", "pass")])
    durations = e.select(F.col("value").alias("audio_axis_s"), F.lit(300.0).alias("final_s"))
    near = e.select(F.lit(10.0).alias("audio_axis_s"), F.lit(9.8).alias("final_s"))
    checks = {
        "loops": [Q.loop_check(e, F.col("event_type") == "error"), Q.loop_check(e, F.lit(False))], "short_s": [Q.render_check(durations), Q.render_check(near)],
        "worst": [Q.alignment_check(e.select(F.coalesce(F.try_element_at(status, F.col("event_type")), F.lit("odd")).alias("status")))],
    }
    out = None
    for name, cs in checks.items():
        for c in cs:
            x = c.select("id", F.round(F.col("metrics")[name], 6).alias("n"), "status")
            out = x if out is None else out.unionByName(x)
    return out


@query("""
    WITH s AS (SELECT conv_id, 'a, b' || conv_id AS text, conv_id * 10.0 AS a, conv_id * 10.0 + 8 AS b FROM conversations GROUP BY conv_id)
    SELECT 'captions' AS id, 'block' AS status, count(*)::DOUBLE AS sections, count(*) FILTER (conv_id % 7 = 0)::DOUBLE AS missing, count(*) FILTER (conv_id % 7 <> 0 AND conv_id % 5 = 0)::DOUBLE AS text_differs,
           count(*) FILTER (conv_id % 7 <> 0 AND conv_id % 3 = 0)::DOUBLE AS off, count(*) FILTER (conv_id % 7 <> 0 AND conv_id % 4 = 0)::DOUBLE AS overlaps FROM s""")
def qa_captions(spark, d):
    n = F.col("conv_id")
    s = t(spark, d, "conversations").select("conv_id").distinct().select(
        n.alias("section_id"), F.concat(F.lit("a, b"), n.cast("string")).alias("voice_text"), F.lit(None).cast("string").alias("subtitle_text"),
        (n * 10.0).alias("audio_start_s"), (n * 10.0 + 8).alias("audio_end_s"),
    )
    k = F.col("section_id")
    one = lambda order, text, a, b: F.struct(F.lit(order).alias("caption_order"), text.alias("text"), a.alias("start_s"), b.alias("end_s"))
    end = F.when(k % 5 == 0, "z").otherwise("")
    c = s.filter(k % 7 != 0).select(
        "section_id",
        F.explode(F.array(
            one(1, F.lit("a"), k * 10.0 + F.when(k % 3 == 0, 0.5).otherwise(0.0), k * 10.0 + 4),
            one(2, F.concat(F.lit("b"), k.cast("string"), end), k * 10.0 + F.when(k % 4 == 0, 3.5).otherwise(4.0), k * 10.0 + 8),
        )).alias("c"),
    ).select("section_id", "c.*")
    return Q.caption_check(s, c).select("id", "status", *[F.col("metrics")[x].alias(x) for x in ("sections", "missing", "text_differs", "off", "overlaps")])


@query("""
    SELECT message, n FROM (VALUES ('a clip loops', 2), ('final is too short', 1)) v(message, n) WHERE (SELECT count(*) FROM events WHERE event_type = 'error') > 0 AND (SELECT max(value) FROM events) > 300.35""")
def qa_report(spark, d):
    e = t(spark, d, "events")
    loops = Q.loop_check(e, F.col("event_type") == "error")
    _, messages = Q.report(loops, Q.render_check(e.select(F.col("value").alias("audio_axis_s"), F.lit(300.0).alias("final_s"))), loops)
    return messages.select("message", "n")


@query("""
    WITH r AS (SELECT user_id AS run_id, count(*) AS n_rows, count(*) FILTER (event_id % 50 <> 0) AS up, sum(CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS bad, count(*) FILTER (event_id % 70 = 0) AS refine FROM events GROUP BY user_id)
    SELECT run_id, n_rows, up AS n_uploaded, bad AS n_channels_failed, refine AS n_to_refine,
           array_to_string(list_filter([CASE WHEN up < n_rows THEN 'uploads are missing' END, CASE WHEN bad > 0 THEN 'channels failed' END, CASE WHEN refine > 0 THEN 'rows wait for refinement' END], lambda x: x IS NOT NULL), ',') AS warnings FROM r""")
def qa_run_rollup(spark, d):
    rows = t(spark, d, "events").select(
        F.col("user_id").alias("run_id"), (F.col("event_id") % 50 != 0).alias("uploaded"), F.lit(True).alias("trimmed"), F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), 1).otherwise(0).alias("channels_failed"),
        (F.col("event_id") % 70 == 0).alias("needs_refine"),
    )
    return R.run_rollup(rows).drop("n_trimmed").withColumn("warnings", _as_text("warnings"))


@query("""
    SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'text' END, CASE WHEN doc_id % 4 = 0 THEN 'source' END], lambda x: x IS NOT NULL), ',') AS blank FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0""")
def qa_blank_fields(spark, d):
    i = F.col("doc_id")
    docs = t(spark, d, "documents").select("doc_id", F.when(i % 3 != 0, F.col("text")).alias("text"), F.when(i % 4 == 0, "  ").otherwise("s").alias("source"))
    return Q.field_warnings(docs, "doc_id", ["text", "source"]).withColumn("blank", _as_text("blank"))


@query("SELECT count(*) AS n, bool_and(event_id % 3 <> 0) AS complete FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT count(*), false FROM events")
def qa_all_done(spark, d):
    e = t(spark, d, "events")
    done = e.filter("event_id % 3 <> 0").select("event_id", F.lit("ok").alias("status"), F.lit("u").alias("url"))
    a, b = (R.all_done(x.select("event_id"), done, "event_id") for x in (e.filter("event_id % 3 <> 0"), e))
    return a.unionByName(b)


# Steps and views


@query("""
    WITH n AS (SELECT CASE WHEN event_type = 'purchase' THEN -event_id - 1 ELSE event_id END AS event_id, value * 2 AS value FROM events WHERE event_type IN ('error', 'purchase'))
    SELECT event_id, value FROM events e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.event_id = e.event_id) UNION ALL SELECT event_id, value FROM n""")
def incr_retry(spark, d):
    e = t(spark, d, "events")
    again = e.filter(F.col("event_type").isin("error", "purchase"))
    again = again.select(F.when(F.col("event_type") == "purchase", -F.col("event_id") - 1).otherwise(F.col("event_id")).alias("event_id"), (F.col("value") * 2).alias("value"))
    return N.retry_merge(e.select("event_id", "value"), again, "event_id")


@query("""
    WITH n AS (SELECT o_orderkey AS task_id, s.stage, s.r, CASE WHEN o_orderkey % (s.r + 5) = 0 THEN 'new' ELSE 'old' END AS h FROM orders, (VALUES ('copy', 0), ('tts', 1), ('render', 2)) s(stage, r)),
    f AS (SELECT task_id, min(r) AS first FROM n WHERE h = 'new' GROUP BY task_id)
    SELECT task_id, stage, CASE WHEN r = first THEN 'changed' ELSE 'stale' END AS state FROM n JOIN f USING (task_id) WHERE r >= first""")
def incr_stages(spark, d):
    stages = {"copy": 0, "tts": 1, "render": 2}
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(r).alias("r")) for s, r in stages.items()])
    every = t(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.explode(rows).alias("s")).select("task_id", "s.*")
    new = every.withColumn("input_hash", F.when(F.col("task_id") % (F.col("r") + 5) == 0, "new").otherwise("old"))
    return N.changed_stages(every.withColumn("input_hash", F.lit("old")), new, stages)


@query("""
    SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-10 00:00:00' THEN 'expired' ELSE event_type END AS state FROM events""")
def incr_expired(spark, d):
    r = t(spark, d, "events").select("event_id", F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("expires_at"))
    return N.expired(r, F.lit("2024-01-10 00:00:00").cast("timestamp")).select("event_id", "state")


@query("""
    SELECT user_id, count(*) AS n_updates, floor(epoch(max(ts)))::BIGINT AS last_s, max(ts) < TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 120 SECOND AS stalled FROM events GROUP BY user_id""")
def stream_stall(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    h = N.heartbeat(e, "user_id", "ts", F.lit("2024-01-29 00:00:00").cast("timestamp"))
    return h.select("user_id", "n_updates", long(F.floor(F.col("last_update").cast("double"))).alias("last_s"), "stalled")


_ORDERED = ("copy", "tts", "retrieve", "subtitle", "render", "qa")


@query("""
    WITH s AS (SELECT o_orderkey, list_transform(range(0, 6), lambda i: ['done', 'running', 'failed', 'pending', 'done', 'stale', 'done'][((o_orderkey + i * 3) % 7) + 1]) AS st FROM orders)
    SELECT o_orderkey, ['copy', 'tts', 'retrieve', 'subtitle', 'render', 'qa'][coalesce(list_position(st, 'running'), list_position(list_transform(st, lambda x: x IN ('pending', 'stale')), true))] AS now,
           ['copy', 'tts', 'retrieve', 'subtitle', 'render', 'qa'][list_position(st, 'failed')] AS failed FROM s""")
def dash_stages(spark, d):
    k = F.col("o_orderkey")
    at = lambda i: _pick(["done", "running", "failed", "pending", "done", "stale", "done"], k + i * 3)
    st = F.create_map(*[x for i, s in enumerate(_ORDERED) for x in (F.lit(s), at(i))])
    o = t(spark, d, "orders").select("o_orderkey", st.alias("st"))
    return o.select("o_orderkey", B.current_stage(F.col("st")).alias("now"), B.failed_stage(F.col("st")).alias("failed"))


@query("""
    SELECT c_custkey AS batch_id, CASE WHEN count(o_orderkey) > 0 THEN count(*) FILTER (o_orderstatus = 'O') END AS n_running, CASE WHEN count(o_orderkey) > 0 THEN count(*) FILTER (o_orderstatus = 'F') END AS n_done,
           CASE WHEN count(o_orderkey) > 0 THEN count(*) FILTER (o_orderstatus = 'P') END AS n_failed, CASE WHEN count(o_orderkey) > 0 THEN count(o_orderkey) END AS n_total
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def dash_batches(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("failed")
    tasks = t(spark, d, "orders").select(F.col("o_custkey").alias("batch_id"), s.alias("status"))
    batches = t(spark, d, "customer").select(F.col("c_custkey").alias("batch_id"))
    return B.batches(batches, tasks).select("batch_id", "n_running", "n_done", "n_failed", "n_total")


@query("""
    WITH w AS (
      SELECT 'task' AS kind, o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' ELSE 'done' END AS status, o_orderdate AS updated_at FROM orders
      UNION ALL SELECT 'intake', event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'queued' ELSE 'done' END, ts FROM events),
    p AS (SELECT *, CASE WHEN status IN ('running', 'queued') THEN 'running' WHEN status = 'failed' THEN 'attention' ELSE 'recent' END AS place FROM w WHERE id % 3 <> 0 OR status = 'running'),
    c AS (SELECT kind, place FROM p WHERE place <> 'recent' UNION ALL SELECT kind, place FROM (SELECT * FROM p WHERE place = 'recent' ORDER BY updated_at DESC, id LIMIT 8))
    SELECT kind, count(*) FILTER (place = 'running') AS n_running, count(*) FILTER (place = 'attention') AS n_attention, count(*) FILTER (place = 'recent') AS n_recent, count(*) AS n_total FROM c GROUP BY kind""")
def dash_center_acked(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "failed").otherwise("done")
    tasks = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s.alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    s = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "queued").otherwise("done")
    intakes = t(spark, d, "events").select(F.col("event_id").alias("id"), s.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
    every = tasks.withColumn("kind", F.lit("task")).unionByName(intakes.withColumn("kind", F.lit("intake")))
    acks = every.filter("id % 3 = 0 AND status <> 'running'").select(B.occurrence_key("kind", "id", "status", "updated_at").alias("key"))
    return B.center_summary(B.task_center(tasks, intakes, acks))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN 'acked' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -1, 'acked'")
def dash_upsert_one(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    for i in (7, -1):
        o = B.upsert_one(o, spark.createDataFrame([(i, "acked")], "id long, status string"), "id")
    return o


@query("""
    WITH r AS (SELECT CASE WHEN event_id % 8 < 6 THEN 'p' ELSE 'q' END || event_id // 2 AS slug, event_type, event_id FROM events),
    b AS (SELECT slug, max_by('run' || event_id, event_id) FILTER (event_type = 'purchase') AS latest_run, bool_or(event_type = 'click') AS busy, bool_or(event_type = 'error') AS bad FROM r GROUP BY slug),
    a AS (SELECT 'p' || c_custkey AS slug FROM customer)
    SELECT coalesce(a.slug, b.slug) AS slug, latest_run, CASE WHEN latest_run IS NOT NULL THEN 'ready' WHEN busy THEN 'running' WHEN bad THEN 'failed' ELSE 'empty' END AS status FROM a FULL JOIN b ON a.slug = b.slug""")
def dash_products(spark, d):
    n, k = F.col("event_id"), F.col("event_type")
    slug = F.concat(F.when(n % 8 < 6, "p").otherwise("q"), F.floor(n / 2).cast("string"))
    st = F.when(k == "click", "running").when(k == "error", "failed").otherwise("done")
    runs = t(spark, d, "events").select(
        slug.alias("slug"), st.alias("status"), (k == "purchase").alias("ready"), F.lit(False).alias("merged"), n.alias("updated_at"), F.concat(F.lit("run"), n.cast("string")).alias("run")
    )
    dirs = t(spark, d, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("slug"), F.lit("n").alias("name"))
    return B.products(dirs, runs).select("slug", "latest_run", "status")
