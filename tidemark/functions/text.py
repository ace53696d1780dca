"""Text expressions: blobs, terms, sentences, redaction, stable choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blob(*columns: Column | str) -> Column:
    """Non-empty texts joined by spaces."""
    return F.concat_ws(" ", *[F.when(_c(c) != "", _c(c)) for c in columns])


def folded(c: Column | str) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(_c(c)), r"\s+", "")


def query_terms(c: Column | str, low: int = 2, high: int = 10) -> Column:
    """Pieces between punctuation of fitting length, each once, in order."""
    # One character for all breaks, then a split by it: several times as fast as a split by a class.
    parts = F.split(F.translate(_c(c), K.QUERY_BREAKS[1:-2].replace(r"\s", "\t\n\x0b\f\r"), " " * 40), " ")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= low) & (F.length(t) <= high)))


def with_aliases(term: Column, aliases: Column) -> Column:
    """The term and what a map of lists has for it."""
    return F.concat(F.array(term), F.coalesce(F.try_element_at(aliases, term), F.array().cast("array<string>")))


def term_hits(text: Column | str, terms: Column, aliases: Column | None = None) -> Column:
    """Those terms of which the text holds a form, in their order."""
    t = _c(text)
    if aliases is None:
        return F.filter(terms, lambda x: (x != "") & F.contains(t, x))
    return F.filter(terms, lambda x: F.exists(with_aliases(x, aliases), lambda v: (v != "") & F.contains(t, v)))


def relative_position(text: Column | str, terms: Column) -> Column:
    """Where the earliest term begins, from 0 to 1; null without one."""
    t = _c(text)
    places = F.filter(F.transform(terms, lambda x: F.instr(t, x)), lambda p: p > 0)
    return (F.array_min(places) - 1) / F.greatest(F.lit(1), F.length(t))


def sentences(c: Column | str, ends: str = K.SENTENCE_ENDS) -> Column:
    """Texts up to and with their end marks, trimmed, blank ones left out."""
    parts = F.split(_c(c), f"(?<=[{ends}])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def repeated_sentences(c: Column | str, shortest: int = 6, most: int | None = 3, ends: str = K.SENTENCE_ENDS) -> Column:
    """Sentence bodies of some length that come twice, in the order of their first repeat."""
    bodies = F.filter(
        F.transform(sentences(c, ends), lambda s: F.trim(F.regexp_replace(s, f"[{ends}]+$", ""))),
        lambda s: F.length(s) >= shortest,
    )
    again = F.transform(
        F.array(bodies),
        lambda b: F.array_distinct(F.filter(b, lambda x, i: F.array_position(b, x) <= i)),
    )[0]
    return F.slice(again, 1, most) if most else again


def speech_units(c: Column | str) -> Column:
    """Characters that are spoken, 1 at least."""
    return F.greatest(F.lit(1), F.length(F.regexp_replace(F.coalesce(_c(c), F.lit("")), K.SPEECH_SILENT, "")))


def caption_text(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), K.CAPTION_DROPPED, ""))


def meaning(c: Column | str) -> Column:
    """The text without white space and punctuation, for comparison."""
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[\s\p{P}]+", "")


def redacted(c: Column | str, mark: str = "<redacted>") -> Column:
    """The text with all secrets of SECRETS replaced; a prefix that names one stays."""
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1] + mark), K.SECRETS, _c(c))


def redacted_map(c: Column | str, mark: str = "<redacted>") -> Column:
    """A map with the values of secret names replaced and all others redacted as texts."""
    return F.transform_values(
        _c(c), lambda k, v: F.when(k.rlike(K.SECRET_NAMES) & (v != ""), F.lit(mark)).otherwise(redacted(v, mark))
    )


def stable_index(c: Column | str, n: int) -> Column:
    """A number below n that depends on the text alone."""
    if n <= 0:
        return F.lit(0).cast("long")
    return F.conv(F.substring(F.sha1(F.coalesce(_c(c).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % n


def stable_choice(options: list[str], c: Column | str) -> Column:
    if not options:
        return F.lit("")
    return F.element_at(F.array(*[F.lit(o) for o in options]), (stable_index(c, len(options)) + 1).cast("int"))


def variant_index(c: Column | str, n: int) -> Column:
    """By the number that stands alone in the text (from 1), else a stable choice."""
    number = F.regexp_extract(_c(c), r"(?:^|[^0-9])(\d{1,4})(?:[^0-9]|$)", 1)
    return F.when(number != "", F.greatest(F.lit(0), number.try_cast("int") - 1) % n).otherwise(stable_index(c, n)).cast("long")


def spoken(c: Column | str) -> Column:
    """As a speaker says it: PRONUNCIATION in order, then no white space."""
    t = reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), K.PRONUNCIATION, _c(c))
    return F.regexp_replace(t, r"\s+", "")


def spoken_notes(c: Column | str) -> Column:
    """Labels of the rules that changed something."""
    notes, now = [], _c(c)
    for pattern, form, label in K.PRONUNCIATION:
        after = F.regexp_replace(now, pattern, form)
        notes.append(F.when(now != after, F.lit(label)))
        now = after
    return F.filter(F.array(*notes), lambda x: x.isNotNull())


def all_times(c: Column | str, *names: str) -> Column:
    """Numbers after ``name: `` or ``name=``, one struct for each round of the names."""
    lists = [
        F.transform(F.regexp_extract_all(_c(c), F.lit(rf"{n}\s*[:=]\s*(-?[0-9.]+)"), 1), lambda x: x.try_cast("double")).alias(n)
        for n in names
    ]
    return F.arrays_zip(*lists)


def last_progress(c: Column | str) -> Column:
    """The last ``[i/n]``: processed, total, percent."""
    last = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(_c(c), F.lit(r"\[\d+/\d+\]"), 0)), -1)
    done, total = F.regexp_extract(last, r"\[(\d+)/", 1).try_cast("long"), F.regexp_extract(last, r"/(\d+)\]", 1).try_cast("long")
    percent = F.when(total > 0, F.bround(done * 100 / total).cast("int"))
    return F.when(last.isNotNull(), F.struct(done.alias("processed"), total.alias("total"), percent.alias("percent")))


def classified(c: Column | str, rules: list[tuple[str, str]], default: str | None = None, how: str = "contains") -> Column:
    """The label of the first rule that a text meets; rules are (needle, label)."""
    t = _c(c)
    test = {"contains": lambda n: F.contains(t, F.lit(n)), "prefix": lambda n: F.startswith(t, F.lit(n)), "regex": lambda n: t.rlike(n)}[how]
    out = F.lit(default)
    for needle, label in reversed(rules):
        out = F.when(test(needle), F.lit(label)).otherwise(out)
    return out


def failure_line(log: Column | str, rules: list[tuple[str, str]]) -> Column:
    """``label: line`` of the first rule that some line meets, the latest such line."""
    lines = F.filter(F.transform(F.split(_c(log), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = []
    for needle, label in rules:
        holds = lambda x: F.contains(x, F.lit(needle))  # noqa: B023, E731  used at once
        hit = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(lines, holds)), -1)
        out.append(F.when(hit.isNotNull(), F.concat(F.lit(f"{label}: "), redacted(hit))))
    return F.coalesce(*out)


def ordered_distinct(c: Column | str) -> Column:
    """Elements with white space collapsed, blanks left out, each at its first place."""
    clean = F.transform(_c(c), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def rewritten(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Replacements one after another; rules are (pattern, form)."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, _c(c))


def within_length(sections: Column, most: int) -> Column:
    """Texts of a script, each less its last sentence from the end on until all fit.

    A section keeps one sentence at least. What a drop saves is known beforehand, so the
    sections that drop one are those from the end whose savings are still needed.
    """
    parts = F.transform(sections, lambda t: F.struct(t.alias("t"), sentences(t).alias("s")))
    with_cut = F.transform(
        parts,
        lambda p: F.struct(
            p["t"].alias("t"),
            F.when(F.size(p["s"]) > 1, F.array_join(F.slice(p["s"], 1, F.size(p["s"]) - 1), "")).otherwise(p["t"]).alias("cut"),
        ),
    )
    over = F.aggregate(sections, F.lit(-most), lambda n, t: n + F.length(t))
    kind = "struct<over:int,out:array<string>>"
    start = F.struct(over.cast("int").alias("over"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        cut = acc["over"] > 0
        text = F.when(cut, p["cut"]).otherwise(p["t"])
        saved = F.length(p["t"]) - F.length(text)
        return F.struct((acc["over"] - saved).cast("int").alias("over"), F.concat(F.array(text), acc["out"]).alias("out")).cast(kind)

    return F.aggregate(F.reverse(with_cut), start.cast(kind), step)["out"]
