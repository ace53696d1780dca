"""Exact multi-channel vector search with rules and constrained top-k.

A full scan: the query is a literal, so there is no join and no shuffle before the top-k
heap of each task. Records have channels as a map of name to struct(embedding, mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import blob
from ..functions.vectors import cosine, mean_weighted, weight_map, weights_for
from ..operators.topk import capped_top_k, top_k

FLOOR = -0.5


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def base_scores(records: DataFrame, query: Column, weights: dict[str, float], channels: str = "channels") -> DataFrame:
    """base: the weighted mean similarity, -1 without a weighted channel; channel_scores: by channel."""
    sims = F.transform_values(channels, lambda k, v: cosine(query, v["embedding"]))
    out = records.withColumn("channel_scores", sims)
    return out.withColumn("base", mean_weighted(F.col("channel_scores"), weight_map(weights)))


def search_ranked(
    index: DataFrame, query_vector: list[float], query: str = "", role: str = "", product: str = "", target_s: float = 0.0, k: int = 12,
    overrides: str = "", per_parent: int = 0, pool: int | None = None,
) -> DataFrame:
    """The best records for a query, with score, reasons and rank.

    Index rows: shot_id, parent_shot_id, product_name, product_slug, the text fields,
    hard_subtitle_risk, voiceover_fit, can_standalone, duration_s, channels.
    """
    q, r = F.lit(query), F.lit(role)
    rows = index.filter(S.product_matches(F.col("product_name"), F.col("product_slug"), product))
    rows = base_scores(rows, vector(query_vector), weights_for(role, overrides)).filter(F.col("base") >= FLOOR)
    text = blob("label", "visual_summary", "source_meaning", "source_asr")
    rows = rows.withColumn("_text", text)
    rows = rows.withColumns({"role_hits": S.role_hits(F.col("_text"), q, r), "keyword_hits": S.keyword_hits(F.col("_text"), q)})
    parts = (
        S.role_bonus(F.col("role_hits")) + S.risk_adjustment(F.col("hard_subtitle_risk"), F.col("voiceover_fit"))
        + S.duration_adjustment(F.col("duration_s"), F.lit(target_s)) + S.standalone_bonus(F.col("can_standalone"), r)
        + S.keyword_bonus(F.col("keyword_hits"))
    )
    rows = rows.withColumn("score", F.bround(F.col("base") + parts, 6)).withColumn(
        "reasons",
        S.reasons(
            role_words=F.size("role_hits") > 0, low_subtitle_risk=F.col("hard_subtitle_risk").isin("none", "low"),
            high_subtitle_risk=F.col("hard_subtitle_risk").isin("medium", "high"), key_words=F.size("keyword_hits") > 0,
            stands_alone=F.col("can_standalone") & r.isin("opening", "proof", "product"),
        ),
    ).drop("_text")
    if pool:
        rows = rows.orderBy(F.desc("score"), "shot_id").limit(pool)
    if per_parent:
        return capped_top_k(rows, "score", k, "shot_id", "parent_shot_id", per_parent)
    return top_k(rows, "score", k, "shot_id")


def build_index(shots: DataFrame, assets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Shots with their asset's product and their channels as a map: what search_ranked takes."""
    ok = embeddings.filter("status = 'ok'")
    chans = ok.groupBy("shot_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.struct("embedding", "mode").alias("v"))))).alias("channels"))
    a = assets.select("asset_id", F.col("product.name").alias("product_name"), F.col("product.slug").alias("product_slug"))
    return shots.join(a, "asset_id", "left").join(chans, "shot_id", "left").withColumn("parent_shot_id", F.col("shot_id"))
