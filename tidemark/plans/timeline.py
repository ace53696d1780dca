"""From script sections and speech to audio sections and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.captions import caption_lines
from ..functions.text import caption_text, speech_units
from ..operators.dedupe import _ensure_checkpoint_dir
from ..operators.intervals import monotonic, proportional_axis


def usable_subtitles(items: DataFrame, key: str, duration: str) -> DataFrame:
    """Whether a voice's subtitle times can be trusted: key, usable.

    The last end must be near the duration, no row may be empty or begin before the one
    before has ended.
    """
    w = Window.partitionBy(key).orderBy("start_s", "end_s")
    rows = items.withColumn("_bad", (F.col("end_s") <= F.col("start_s")) | F.coalesce(F.col("start_s") < F.lag("end_s").over(w) - 0.02, F.lit(False)))
    near = F.abs(F.max("end_s") - F.max(duration)) <= F.greatest(F.lit(1.0), F.max(duration) * 0.08)
    return rows.groupBy(key).agg((near & ~F.bool_or("_bad")).alias("usable"))


def char_times(sections: DataFrame, items: DataFrame, key: str, order: str, length: str, duration: str) -> DataFrame:
    """Section bounds by interpolating character offsets between subtitles: start_s, end_s.

    A bound inside a subtitle is linear in it; one between two lies in the middle of the
    gap. Points of known time are laid on the offset axis with the bounds, and each bound
    looks at the nearest known ones.
    """
    w = Window.partitionBy(key).orderBy(order)
    upto = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = sections.withColumn("_to", upto).withColumn("_from", upto - F.col(length))
    last = F.lead(length).over(w).isNull()
    rows = rows.withColumn("_last", last)
    # At one offset the end of a subtitle and the start of the next meet: their mean counts.
    known = items.select(key, F.col("char_start").alias("_o"), F.col("start_s").alias("_t")).unionByName(
        items.select(key, F.col("char_end").alias("_o"), F.col("end_s").alias("_t"))
    )
    known = known.groupBy(key, "_o").agg(F.avg("_t").alias("_t"))
    inside = items.select(key, F.col("char_start").alias("_a"), F.col("char_end").alias("_b")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_a", "_b"))).alias("_spans"))
    axis = known.select(key, "_o", "_t", F.lit(None).cast("int").alias(order)).unionByName(
        rows.filter(~F.col("_last")).select(key, F.col("_to").alias("_o"), F.lit(None).cast("double").alias("_t"), F.col(order).cast("int").alias(order))
    )
    s = Window.partitionBy(key).orderBy("_o")
    point = F.when(F.col("_t").isNotNull(), F.struct(F.col("_o").alias("o"), F.col("_t").alias("t")))
    axis = axis.withColumns(
        {
            "_lo": F.last(point, ignorenulls=True).over(s.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
            "_hi": F.first(point, ignorenulls=True).over(s.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).filter(F.col(order).isNotNull()).join(inside, key)
    in_span = F.exists("_spans", lambda x: (x["_a"] <= F.col("_o")) & (F.col("_o") <= x["_b"]))
    lerp = F.col("_lo.t") + (F.col("_o") - F.col("_lo.o")) / (F.col("_hi.o") - F.col("_lo.o")) * (F.col("_hi.t") - F.col("_lo.t"))
    t = F.when(F.col("_lo.o") == F.col("_hi.o"), F.col("_lo.t")).when(in_span, lerp).otherwise((F.col("_lo.t") + F.col("_hi.t")) / 2)
    ends = axis.select(key, order, F.round(t, 3).alias("_e"))
    out = rows.join(ends, [key, order], "left").withColumn("end_s", F.when(F.col("_last"), F.round(duration, 3)).otherwise(F.col("_e")))
    return out.withColumn("start_s", F.coalesce(F.lag("end_s").over(w), F.lit(0.0))).drop("_to", "_from", "_last", "_e")


def aligned_sections(sections: DataFrame, items: DataFrame, key: str = "task_id", order: str = "timeline_order", duration: str = "audio_duration_s") -> DataFrame:
    """Sections with times and timing_source: by character offsets, one to one, or in proportion.

    Each form is worked out for the tasks that it fits; the first that fits is taken.
    """
    sections = sections.withColumn("_len", F.length(F.coalesce("tts_text", "voice_text"))).withColumn("_units", speech_units("voice_text"))
    total = sections.groupBy(key).agg(F.sum("_len").alias("_chars"), F.count("*").alias("_n"), F.min("_len").alias("_least"), F.max(duration).alias("_dur"))
    good = usable_subtitles(items.join(total.select(key, "_dur"), key), key, "_dur")
    have = items.groupBy(key).agg(F.count("*").alias("_m"), F.max("char_end").alias("_ce"), F.bool_and(F.col("char_end").isNotNull()).alias("_offs"))
    state = total.join(have, key, "left").join(good, key, "left").select(
        key,
        F.when(F.col("_m").isNull(), "proportional").when(~F.col("usable"), "proportional_unusable_subtitles")
        .when(F.col("_offs") & (F.col("_least") > 0) & (F.abs(F.col("_ce") - F.col("_chars")) <= 2), "character_offsets")
        .when(F.col("_m") == F.col("_n"), "one_to_one").otherwise("proportional_count_differs").alias("timing_source"),
    )
    s = sections.join(state, key)
    cols = [*sections.columns, "timing_source", "start_s", "end_s"]
    by_char = char_times(s.filter("timing_source = 'character_offsets'"), items, key, order, "_len", duration)
    numbered = items.withColumn(order, F.row_number().over(Window.partitionBy(key).orderBy("start_s", "end_s")))
    one = s.filter("timing_source = 'one_to_one'").join(numbered.select(key, order, "start_s", "end_s"), [key, order])
    share = proportional_axis(s.filter(F.col("timing_source").startswith("proportional")), [key], [order], "_units", duration)
    return by_char.select(*cols).unionByName(one.select(*cols)).unionByName(share.select(*cols)).drop("_len", "_units")


def captions(sections: DataFrame, key: str = "task_id", section: str = "section_id", order: str = "timeline_order") -> DataFrame:
    """Caption rows of timed sections: lines of bounded width, times in proportion, in order without overlap.

    The repair of times reads the rows several times, so they are laid out once and written
    to the folder of ``spark.checkpoint.dir``.
    """
    rows = sections.select(key, section, order, F.col("start_s").alias("_a"), F.col("end_s").alias("_b"), F.posexplode(caption_lines("voice_text")).alias("_i", "text"))
    w = Window.partitionBy(key, section).orderBy("_i")
    units = speech_units("text")
    rows = rows.withColumn("_u", units)
    whole, upto = F.sum("_u").over(Window.partitionBy(key, section)), F.sum("_u").over(w.rowsBetween(Window.unboundedPreceding, 0))
    span = F.col("_b") - F.col("_a")
    rows = rows.withColumns(
        {
            "start_s": F.round(F.col("_a") + span * (upto - F.col("_u")) / whole, 3),
            "end_s": F.round(F.when(F.lead("_i").over(w).isNull(), F.col("_b")).otherwise(F.col("_a") + span * upto / whole), 3),
            "caption_order": F.row_number().over(Window.partitionBy(key).orderBy(order, "_i")),
        }
    )
    _ensure_checkpoint_dir(sections.sparkSession)
    rows = rows.select(key, section, "text", "start_s", "end_s", "caption_order").checkpoint()
    out = monotonic(rows, [key], ["caption_order"])
    return out.select(key, section, "caption_order", caption_text("text").alias("text"), "start_s", "end_s", "adjusted")
