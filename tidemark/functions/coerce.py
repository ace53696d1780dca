"""Coalescing, casts and repairs of loosely typed records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_nonblank(*columns: Column | str, default: Column | None = None) -> Column:
    """The first value that is neither null nor an empty text (text columns)."""
    kept = [F.when(_c(c) != "", _c(c)) for c in columns]
    return F.coalesce(*kept, *([default] if default is not None else []))


def first_truthy(*columns: Column | str, default: Column | None = None) -> Column:
    """The first value that is not null, zero or false (numbers and booleans)."""
    kept = [F.when(_c(c).cast("double") != 0, _c(c)) for c in columns]
    return F.coalesce(*kept, *([default] if default is not None else []))


def first_positive(*columns: Column | str) -> Column:
    return F.coalesce(*[F.when(_c(c) > 0, _c(c)) for c in columns])


def as_double(c: Column | str, default: float | None = 0.0) -> Column:
    """A number, or the default where the text is none."""
    v = _c(c).try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(default))


def as_int(c: Column | str, default: int | None = 0) -> Column:
    v = F.floor(_c(c).try_cast("double")).cast("long")
    return v if default is None else F.coalesce(v, F.lit(default))


def rounded(c: Column | str, places: int = 3) -> Column:
    """Half to even, null for what is no number."""
    return F.bround(_c(c).try_cast("double"), places)


def as_list(c: Column | str) -> Column:
    """Null and empty text give no element, another text one."""
    v = _c(c)
    return F.when(v.isNull() | (v == ""), F.array().cast("array<string>")).otherwise(F.array(v))


def as_text(c: Column | str) -> Column:
    """A list's elements joined by spaces; null gives an empty text."""
    return F.coalesce(F.array_join(_c(c), " "), F.lit(""))


def as_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def product(name: Column | str, slug: Column | str) -> Column:
    """A struct with both, each standing in for the other."""
    n, s = first_nonblank(name, slug, default=F.lit("")), first_nonblank(slug, name, default=F.lit(""))
    return F.struct(n.alias("name"), s.alias("slug"))


def time_range(pair: Column | str, start: Column | str, end: Column | str) -> Column:
    """[start, end] from a two-element list, or from scalar columns where the list lacks one."""
    p = _c(pair)
    at = lambda i, other: F.coalesce(F.get(p, i), _c(other).cast("double"), F.lit(0.0))
    return F.array(at(0, start), at(1, end))


def frame_rate(c: Column | str) -> Column:
    """A rate from ``30000/1001`` or ``25``; 0 where there is none."""
    parts = F.split(_c(c).cast("string"), "/")
    top, bottom = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    rate = F.when(F.size(parts) == 2, F.try_divide(top, bottom)).when(F.size(parts) == 1, top)
    return F.coalesce(rate, F.lit(0.0))


def slug(c: Column | str, length: int = 64, fallback: str = "item") -> Column:
    """Lower-case letters and digits of any script, other runs as one dash."""
    s = F.regexp_replace(F.lower(F.trim(_c(c))), r"[^\p{L}\p{N}]+", "-")
    s = F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, length)
    return F.coalesce(F.when(s != "", s), F.lit(fallback))


def status_of(c: Column | str, mapping: dict[str, str], default: str) -> Column:
    """A status by lookup, with a default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(_c(c))), F.lit(default))


def blank_fields(**columns: Column | str) -> Column:
    """Names of those columns that are null or blank, in the given order."""
    return F.filter(
        F.array(*[F.when(_c(c).isNull() | (F.trim(_c(c).cast("string")) == ""), F.lit(n)) for n, c in columns.items()]),
        lambda x: x.isNotNull(),
    )
