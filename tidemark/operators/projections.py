"""Typed rows from documents: assets, shots, units, pieces, channels, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import first_nonblank
from .intervals import capped_islands, overlap_join

NO_TEXTS = "array<string>"


def shots(documents: DataFrame) -> DataFrame:
    """A row per highlight; bounds are ordered, the usable range lies inside them."""
    h = "_h"
    out = documents.select(
        F.coalesce("id", "asset_id").alias("_v"), F.coalesce("duration_s", F.lit(0.0)).alias("_d"), F.posexplode("highlights").alias("idx", h)
    )
    get = lambda *names: F.coalesce(*[F.col(f"{h}.{n}") for n in names])
    a, b = F.coalesce(get("start", "start_s", "start_time"), F.lit(0.0)), get("end", "end_s", "end_time")
    out = out.withColumns({"_a": a, "_b": F.coalesce(b, a)})
    start, end = F.least("_a", "_b"), F.greatest("_a", "_b")
    inside = lambda c, d: F.greatest(start, F.least(end, F.coalesce(c, d)))
    us, ue = inside(F.col(f"{h}.usable_start"), start), inside(F.col(f"{h}.usable_end"), end)
    text = lambda n, d="": F.coalesce(F.col(f"{h}.{n}"), F.lit(d)).alias(n)
    many = lambda n: F.coalesce(F.col(f"{h}.{n}"), F.array().cast(NO_TEXTS)).alias(n)
    return out.select(
        F.concat_ws("_", F.lit("shot"), "_v", F.lpad(F.col("idx").cast("string"), 2, "0")).alias("shot_id"),
        F.concat_ws("_", F.lit("asset"), "_v").alias("asset_id"), F.concat_ws("_", F.lit("seg"), "_v").alias("segment_id"), "idx",
        F.bround(start, 3).alias("start_s"), F.bround(end, 3).alias("end_s"), F.bround(end - start, 3).alias("duration_s"),
        F.bround(F.least(us, ue), 3).alias("usable_start"), F.bround(F.greatest(us, ue), 3).alias("usable_end"),
        text("label"), text("visual_summary"), text("source_meaning"), text("source_asr"), many("source_ocr"),
        text("hard_subtitle_risk", "unknown"), text("voiceover_fit", "unknown"),
        F.coalesce(F.col(f"{h}.can_standalone"), F.lit(False)).alias("can_standalone"), many("selling_points"), many("visual_actions"),
    )


def segments(documents: DataFrame) -> DataFrame:
    """One row per video with the ids of its shots."""
    s = shots(documents)
    ids = s.groupBy("asset_id", "segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "shot_id"))), lambda x: x["shot_id"]).alias("shot_ids"))
    d = documents.select(F.concat_ws("_", F.lit("asset"), F.coalesce("id", "asset_id")).alias("asset_id"), "product", "duration_s")
    return d.join(ids, "asset_id", "left")


def moments(s: DataFrame) -> DataFrame:
    """A shot by another name."""
    return s.select(F.regexp_replace("shot_id", "^shot_", "moment_").alias("moment_id"), "shot_id", "asset_id", "start_s", "end_s", "label", "visual_summary", "source_meaning")


def inferred_units(s: DataFrame) -> DataFrame:
    """Story units where a model gave none: near neighbours of one video joined to a bounded span."""
    isl = capped_islands(s, ["asset_id"]).withColumn("unit_no", F.col("island") - 1)
    inside = s.join(isl.select("asset_id", "unit_no", F.col("start_s").alias("_a"), F.col("end_s").alias("_b")), "asset_id").filter(
        (F.col("start_s") >= F.col("_a")) & (F.col("end_s") <= F.col("_b"))
    )
    w = Window.partitionBy("shot_id").orderBy("unit_no")  # equal bounds: the first unit has it
    inside = inside.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    texts = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("start_s", "idx", F.col(c).alias("t"))))), lambda x: x["t"])
    return inside.groupBy("asset_id", "unit_no").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        F.array_join(texts("visual_summary"), "；").alias("visual_summary"), F.array_join(texts("source_meaning"), "；").alias("source_meaning"),
        F.array_join(texts("source_asr"), " ").alias("source_asr"), F.bool_or("can_standalone").alias("can_standalone"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("selling_points")))).alias("selling_points"),
        F.transform(F.array_sort(F.collect_list(F.struct("start_s", "idx", "shot_id"))), lambda x: x["shot_id"]).alias("child_shot_ids"),
    ).withColumn("unit_id", F.concat_ws("_", F.regexp_replace("asset_id", "^asset_", "unit_"), F.lpad(F.col("unit_no").cast("string"), 2, "0")))


def unit_children(units: DataFrame, s: DataFrame) -> DataFrame:
    """Units with the shots that they overlap; where there is none, the one that starts nearest."""
    left = units.select("asset_id", "unit_id", F.col("start_s").alias("l_start"), F.col("end_s").alias("l_end"))
    right = s.select("asset_id", "shot_id", F.col("start_s").alias("r_start"), F.col("end_s").alias("r_end"))
    hit = overlap_join(left, right, "asset_id").groupBy("unit_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r_start", "shot_id"))), lambda x: x["shot_id"]).alias("_hit")
    )
    none = left.join(hit, "unit_id", "left_anti").join(right, "asset_id").groupBy("unit_id").agg(
        F.min_by("shot_id", F.struct(F.abs(F.col("r_start") - F.col("l_start")), "shot_id")).alias("_near")
    )
    out = units.drop("child_shot_ids").join(hit, "unit_id", "left").join(none, "unit_id", "left")
    return out.withColumn("child_shot_ids", F.coalesce("_hit", F.when(F.col("_near").isNotNull(), F.array("_near")), F.array().cast(NO_TEXTS))).drop("_hit", "_near")


def physical_shots(pieces: DataFrame) -> DataFrame:
    """Pieces of split shots: text of a parent that was split is kept as the parent's, not the piece's."""
    split = F.col("n_pieces") > 1
    own = lambda c: F.when(split, F.lit("")).otherwise(F.col(c)).alias(c)
    return pieces.select(
        F.concat(F.regexp_replace("shot_id", "^shot_", "pshot_"), F.lit("_p"), F.lpad(F.col("piece").cast("string"), 2, "0")).alias("shot_id"),
        F.col("shot_id").alias("parent_shot_id"), "asset_id", F.col("piece_start_s").alias("start_s"), F.col("piece_end_s").alias("end_s"),
        F.bround(F.col("piece_end_s") - F.col("piece_start_s"), 3).alias("duration_s"),
        own("visual_summary"), own("source_meaning"),
        F.when(split, F.array().cast(NO_TEXTS)).otherwise(F.col("visual_actions")).alias("visual_actions"),
        F.col("visual_summary").alias("parent_visual_summary"), F.col("source_meaning").alias("parent_source_meaning"),
        F.when(split, "blank_until_refined").otherwise("own").alias("text_policy"), split.alias("needs_refine"),
    )


def channel_inputs(s: DataFrame) -> DataFrame:
    """Long form of what is to be embedded: shot_id, channel, mode, value, enabled."""
    tags = F.concat_ws("; ", F.when(F.col("label") != "", F.col("label")), F.array_join("selling_points", "; "), F.array_join("visual_actions", "; "))
    texts = {
        "source_meaning": F.col("source_meaning"), "visual_summary": F.col("visual_summary"), "tags": tags,
        "asr": F.col("source_asr"), "ocr": F.array_join("source_ocr", " "),
    }
    rows = [F.struct(F.lit(k).alias("channel"), F.lit("text").alias("mode"), F.trim(v).alias("value")) for k, v in texts.items()]
    url = F.col("clip_url") if "clip_url" in s.columns else F.lit("")
    rows.append(F.struct(F.lit("video_chunk").alias("channel"), F.lit("video").alias("mode"), url.alias("value")))
    return s.select("shot_id", F.explode(F.array(*rows)).alias("_c")).select("shot_id", "_c.*").withColumn("enabled", F.coalesce(F.col("value"), F.lit("")) != "")


def embeddings_long(wide: DataFrame, channels: str = "embeddings") -> DataFrame:
    """A map of channel structs as rows; the mode defaults by channel."""
    out = wide.select("shot_id", F.explode(channels).alias("channel", "_e"))
    mode = first_nonblank("_e.mode", default=F.when(F.col("channel") == "video_chunk", "video").otherwise("text"))
    return out.select("shot_id", "channel", mode.alias("mode"), F.col("_e.status").alias("status"), F.col("_e.embedding").alias("embedding"))


def shortened(c: Column | str, most: int = 110) -> Column:
    return F.substring(c, 1, most)


def public_columns(df: DataFrame, private: tuple[str, ...] = ("phash", "dhash")) -> DataFrame:
    """Without hash arrays and columns that begin with an underscore."""
    return df.drop(*private, *[c for c in df.columns if c.startswith("_")])


def slot_fields(df: DataFrame, slot_id: str, label: str, role: str, order: int) -> DataFrame:
    return df.withColumns({"slot_id": F.lit(slot_id), "slot_label": F.lit(label), "slot_role": F.lit(role), "timeline_order": F.lit(order)})


def claims(df: DataFrame, key: str, text: str, core_most: int = 3, most: int = 10) -> DataFrame:
    """Lines of a text as ranked claims: the first are core, then supporting; blank and repeated ones go."""
    line = F.trim(F.regexp_replace("_l", r"^\s*(?:[-*•]|\d+[.、)])\s*", ""))
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "_l")).withColumn("claim", line).filter("claim <> ''")
    rows = rows.groupBy(key, "claim").agg(F.min("_i").alias("_i"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_i"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select(
        key, "rank", "claim", F.when(F.col("rank") <= core_most, "core").otherwise("support").alias("tier")
    )


def script_sections(df: DataFrame, key: str, sections: str) -> DataFrame:
    """Sections of a script in order, numbered from 1; blank ones are left out."""
    rows = df.select(key, F.posexplode(sections).alias("_i", "_s")).filter(F.coalesce(F.trim("_s.voice_text"), F.lit("")) != "")
    order = F.row_number().over(Window.partitionBy(key).orderBy("_i"))
    return rows.withColumn("timeline_order", order).select(key, "timeline_order", first_nonblank("_s.section_id", default=F.format_string("s%02d", "timeline_order")).alias("section_id"), "_s.role", "_s.voice_text")


def layered(*layers: dict) -> dict:
    """Settings from several layers, later ones over earlier; nested ones are merged."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = layered(out[k], v)
            elif v is not None:
                out[k] = v
    return out
