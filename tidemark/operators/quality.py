"""Checks of data and results: each gives (id, status, metrics, blocks, warnings)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import blank_fields, first_nonblank
from ..functions.text import meaning
from .aggregates import message_frequency, severity, worst
from .intervals import overlaps_before


def check(df: DataFrame, check_id: str, metrics: dict[str, Column], blocks: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """One row from a table: named sums, then the messages whose tests on them hold."""
    row = df.agg(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in metrics.items()])
    hit = lambda tests: F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    out = row.select(F.create_map(*[x for k in metrics for x in (F.lit(k), F.col(k))]).alias("metrics"), hit(blocks).alias("blocks"), hit(warnings).alias("warnings"))
    status = F.when(F.size("blocks") > 0, "block").when(F.size("warnings") > 0, "warning").otherwise("pass")
    return out.select(F.lit(check_id).alias("id"), status.alias("status"), "metrics", "blocks", "warnings")


def artifact_check(required: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """A required name that is not present blocks."""
    joined = required.select(name).join(present.select(F.col(name).alias("_p")).distinct(), F.col(name) == F.col("_p"), "left")
    return check(
        joined, "artifacts", {"required": F.count("*"), "missing": F.count_if(F.col("_p").isNull())},
        {"required artifact is missing": F.col("missing") > 0}, {},
    )


def segmentation_check(shots: DataFrame, shortest: float = 0.5) -> DataFrame:
    return check(
        shots, "segmentation",
        {"shots": F.count("*"), "short": F.count_if(F.col("duration_s") < shortest), "no_frames": F.count_if(F.coalesce(F.size("frames"), F.lit(0)) <= 0)},
        {"no shots": F.col("shots") == 0}, {"very short shots": F.col("short") > 0, "shots without frames": F.col("no_frames") > 0},
    )


def coverage_check(sections: DataFrame, clips: DataFrame, key: str = "section_id", warn: float = 0.08, block: float = 0.35) -> DataFrame:
    """Sections without clips block, and so do gaps above ``block``; gaps above ``warn`` warn."""
    have = clips.groupBy(key).agg(F.sum("planned_s").alias("_h"))
    gaps = sections.join(have, key, "left").withColumn("_gap", F.col("audio_duration_s") - F.coalesce("_h", F.lit(0.0)))
    return check(
        gaps, "retrieval",
        {"sections": F.count("*"), "empty": F.count_if(F.col("_h").isNull()), "max_gap_s": F.max("_gap")},
        {"section without clips": F.col("empty") > 0, "gap is too long": F.col("max_gap_s") > block},
        {"gap": (F.col("max_gap_s") > warn) & (F.col("max_gap_s") <= block)},
    )


def loop_check(clips: DataFrame, loops: Column) -> DataFrame:
    return check(clips, "loops", {"loops": F.count_if(loops)}, {"a clip loops": F.col("loops") > 0}, {})


def caption_check(sections: DataFrame, captions: DataFrame, key: str = "section_id", delta: float = 0.18, total: float = 0.2) -> DataFrame:
    """Captions against sections: equal texts apart from punctuation, bounds, overlaps, total length."""
    per = captions.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("caption_order", "text"))), lambda x: x["text"]), "").alias("_t"),
        F.min("start_s").alias("_a"), F.max("end_s").alias("_b"),
    )
    rows = sections.join(per, key, "left")
    text = meaning(first_nonblank("subtitle_text", "voice_text"))
    late = captions.withColumn("_all", F.lit(1)).transform(lambda d: overlaps_before(d, [key], ["start_s", "caption_order"])).agg(F.count_if("overlap").alias("_o"))
    rows = rows.crossJoin(F.broadcast(late))  # one row
    return check(
        rows, "captions",
        {
            "sections": F.count("*"), "missing": F.count_if(F.col("_t").isNull()), "text_differs": F.count_if(F.col("_t").isNotNull() & (meaning("_t") != text)),
            "off": F.count_if((F.abs(F.col("_a") - F.col("audio_start_s")) > delta) | (F.abs(F.col("_b") - F.col("audio_end_s")) > delta)),
            "overlaps": F.max("_o"), "total_delta_s": F.abs(F.max("_b") - F.max("audio_end_s")),
        },
        {"text differs": F.col("text_differs") > 0, "section without caption": F.col("missing") > 0},
        {"bounds are off": F.col("off") > 0, "captions overlap": F.col("overlaps") > 0, "total length differs": F.col("total_delta_s") > total},
    )


def alignment_check(reviews: DataFrame) -> DataFrame:
    """A model's verdicts; they ask for a review at most."""
    rank = severity(F.col("status"))
    return check(reviews, "alignment", {"rows": F.count("*"), "worst": F.max(rank)}, {}, {"needs review": F.col("worst") >= 2})


def render_check(durations: DataFrame, most: float = 0.35) -> DataFrame:
    """A final that is shorter than its axis by more than ``most`` blocks."""
    short = F.max(F.col("audio_axis_s") - F.col("final_s"))
    return check(durations, "render", {"short_s": short}, {"final is too short": F.col("short_s") > most}, {})


def report(*checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The checks as one table, and their messages by frequency."""
    all_ = reduce(lambda a, b: a.unionByName(b), [c.withColumn("_i", F.lit(i)) for i, c in enumerate(checks)])
    messages = all_.select("_i", F.explode(F.concat("blocks", "warnings")).alias("message"))
    return all_.drop("_i"), message_frequency(messages, "message", "_i")


def overall(checks: DataFrame) -> DataFrame:
    return checks.agg(worst(F.col("status")).alias("status"), F.count("*").alias("n_checks"), F.count_if(F.col("status") == "block").alias("n_blocks"))


def field_warnings(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with blank required fields, and which."""
    return df.select(key, blank_fields(**{c: c for c in fields}).alias("blank")).filter(F.size("blank") > 0)
