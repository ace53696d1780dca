"""Vectors as arrays, summed in order so that results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(
        F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """-1 where the lengths differ, a vector is empty, null or zero."""
    size = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(ok, dot(a, b) / size).otherwise(F.lit(-1.0))


def mean_weighted(similarities: Column, weights: Column) -> Column:
    """sum(w s) / sum(w) of maps by channel, over channels with a positive weight; -1 without any."""
    names = F.filter(F.map_keys(similarities), lambda k: F.coalesce(F.try_element_at(weights, k), F.lit(0.0)) > 0)
    top = F.aggregate(names, F.lit(0.0), lambda s, k: s + F.element_at(similarities, k) * F.element_at(weights, k))
    low = F.aggregate(names, F.lit(0.0), lambda s, k: s + F.element_at(weights, k))
    return F.when(low > 0, top / low).otherwise(F.lit(-1.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(v: Column, n: int = 63) -> Column:
    """A 64-bit number with bit i set if element i is positive."""
    return F.aggregate(
        F.transform(F.slice(v, 1, n), lambda x, i: F.when(x > 0, F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda s, x: s.bitwiseOR(x),
    )


def weights_for(role: str | None, overrides: str = "") -> dict[str, float]:
    """A role's channel weights with ``name=value`` overrides; what is no number is passed over."""
    from .constants import DEFAULT_WEIGHTS, ROLE_WEIGHTS

    out = dict(ROLE_WEIGHTS.get(role or "", DEFAULT_WEIGHTS))
    for part in filter(None, (p.strip() for p in overrides.split(","))):
        name, _, value = part.partition("=")
        try:
            out[name.strip()] = float(value)
        except ValueError:
            continue
    return out


def weight_map(weights: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
