"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tables


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = tables(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, tables(spark, sf_dir, "labels")))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    return html_extract.extract(tables(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup

    return exact_dedup.exact_dedup(tables(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    return token_files.round_trip(tables(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    return quality_rules.quality_rules(tables(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.simhash_groups(tables(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(tables(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    return repeats.cut_repeats(tables(spark, sf_dir, "documents")).drop("kept")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.format_chats(tables(spark, sf_dir, "conversations"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(tables(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie

    return prefix_trie.conversation_trie(tables(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.jaccard_groups(tables(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fill_middle as fim

    made = fim.fill_middle(tables(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html_extract": op2_html_extract,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_repeats": op8_repeats,
    "op9_chat_format": op9_chat_format,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_fill_middle": op13_fill_middle,
}

_WS = r"[\x20\x09-\x0D]"

ORACLE_SQL = {
    "op3_exact_dedup": rf"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                 sha256(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) AS text_sha256
          FROM documents),
        r AS (
          SELECT doc_id, text_sha256,
                 first_value(doc_id) OVER w AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size,
                 row_number() OVER w = 1 AS kept
          FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r""",
    "op5_quality_rules": rf"""
        WITH d AS (
          SELECT doc_id, source, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)),
                             lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM documents),
        g AS (
          SELECT row_number() OVER () AS k, * FROM d),
        grams AS (
          SELECT k, i, array_to_string(w[i:i + 4], ' ') AS gram
          FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM g WHERE len(w) >= 5)),
        again AS (
          SELECT k, i FROM grams
          QUALIFY count(*) OVER (PARTITION BY k, gram) > 1),
        covered AS (
          SELECT k, sum(least(5, coalesce(nxt - i, 5))) AS n
          FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM again) GROUP BY k),
        m AS (
          SELECT doc_id, source, len(w) AS n_words,
                 length(regexp_replace(t, '{_WS}', '', 'g')) AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                 CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
          FROM g LEFT JOIN covered c ON g.k = c.k),
        b AS (
          SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
        f AS (
          SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS failed FROM b),
        h AS (
          SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS k FROM f GROUP BY source),
        a AS (
          SELECT sum(k) / sum(n) AS m, sum(n) AS total, count(*) AS hosts, sum(k * k / n) AS sq FROM h),
        s AS (
          SELECT m, sq / total - m * m - m * (1 - m) * hosts / total AS v FROM a),
        p AS (
          SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1e6 END, 1.0), 1e6) AS strength FROM s),
        hosts AS (
          SELECT source, (k + m * strength) / (n + strength) > 0.5 AS host_failed FROM h, p)
        SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT host_failed AS kept
        FROM f JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source""",
    "op11_prefix_trie": """
        WITH t AS (
          SELECT conv_id, strlen(coalesce(text, '')) AS size, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
          FROM conversations WHERE conv_id IS NOT NULL),
        o AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS k FROM t),
        c AS (
          SELECT conv_id, conv_id - conv_id % 5 AS base,
                 xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(conv_id::VARCHAR, '.'), lambda x: ord(x)::BIGINT)),
                   lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: xor(b >> 1, 3988292384 * (b & 1))))) % 9 AS h
          FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (
          SELECT c.conv_id, 0 AS own, o.k, digest, size FROM c JOIN o ON o.conv_id = c.base AND o.k < h
          UNION ALL SELECT conv_id, 1, o.k, digest, size FROM o JOIN c USING (conv_id) WHERE o.k >= h),
        p AS (
          SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, size FROM r
          WINDOW w AS (PARTITION BY conv_id ORDER BY own, k ROWS UNBOUNDED PRECEDING)),
        q AS (
          SELECT conv_id, depth, path, size FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
        n AS (
          SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM q GROUP BY path, depth),
        b AS (
          SELECT path[1:64 * (depth - 1)] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        m AS (
          SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN b USING (path)),
        s AS (
          SELECT path[1:64 * d] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
          FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY 1),
        e AS (
          SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends
          FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY path)
        SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM m JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n u ON m.depth > 0 AND u.path = m.path[1:64 * (m.depth - 1)]""",
    "op12_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        d AS (
          SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
          FROM w),
        n AS (
          SELECT min(doc_id) AS k, s, len(s) AS n FROM d WHERE len(s) > 0 GROUP BY s),
        f AS (
          SELECT k, n, unnest(s) AS g FROM n),
        c AS (
          SELECT g, count(*) AS c FROM f GROUP BY g),
        o AS (
          SELECT k, n, f.g, row_number() OVER (PARTITION BY k ORDER BY c, f.g) AS i FROM f JOIN c ON f.g = c.g),
        x AS (
          SELECT k, n, g FROM o WHERE i <= n - (9 * n + 9) // 10 + 1),
        m AS (
          SELECT DISTINCT a.k AS a, b.k AS b, a.n + b.n AS n FROM x a JOIN x b ON a.g = b.g AND a.k < b.k AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n),
        l AS (
          SELECT a, b FROM m JOIN n p ON p.k = a JOIN n r ON r.k = b WHERE 19 * len(list_intersect(p.s, r.s)) >= 9 * m.n),
        e AS (
          SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (
          SELECT k, k AS root FROM n UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.root),
        t AS (
          SELECT k, min(root) AS root FROM r GROUP BY k)
        SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(t.root, d.doc_id) AS component_id
        FROM d LEFT JOIN n ON n.s = d.s LEFT JOIN t ON t.k = n.k""",
    "op13_fill_middle": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                 sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
          FROM documents),
        h AS (
          SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
                 CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[25:32] AS BIGINT) AS h4
          FROM d),
        f AS (
          SELECT doc_id, t, n,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                 array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
                 array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
                 array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS x
          FROM h)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
                      ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM f""",
    "op9_chat_format": """
        WITH t AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS i
          FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
        c AS (
          SELECT conv_id, count(*) AS n_turns,
                 string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY i) AS chat
          FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, chat FROM c a
        WHERE NOT EXISTS (
          SELECT 1 FROM c b WHERE a.conv_id <> b.conv_id AND starts_with(b.chat, a.chat)
            AND (b.n_turns > a.n_turns OR b.chat = a.chat AND b.conv_id < a.conv_id))""",
}
