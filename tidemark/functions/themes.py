"""What a section may show: a contract from its own words, and the verdict on a candidate's text.

A section's role and words say which themes it is about; rules in a fixed order then say
what a picture has to show and what it must not. Contracts are made once a section, before
candidates come in, so that a pair costs only a search for the contract's own words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import blob, term_hits

#: The type of a contract.
CONTRACT = (
    "struct<themes:array<string>,required:map<string,array<string>>,forbidden:array<string>,strict:boolean,"
    "kind:string,role_forbidden:array<string>,role:string>"
)


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _any(text: Column, words) -> Column:
    return F.exists(_words(words), lambda w: F.contains(text, w))


def first_place(text: Column, words) -> Column:
    """Where the first of the words begins, from 1; null without any."""
    places = F.transform(_words(words), lambda w: F.instr(text, w))
    return F.array_min(F.filter(places, lambda p: p > 0))


def section_query(intention: Column, meaning: Column, visual: Column, voice: Column, keywords: Column) -> Column:
    """All that a section says of itself, as one text."""
    return blob(intention, meaning, visual, voice, F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " "))


def section_contract(query: Column, role: Column, voice: Column) -> Column:
    """A section's contract (CONTRACT) from its query text, role and spoken text; nulls count as empty.

    ``themes``, their ``required`` words, ``forbidden`` words and ``strict`` (whether a
    theme has to be met) follow from the words; ``kind`` and ``role_forbidden`` are what its
    role forbids besides: an opening that names no solution shows none, a product's texture
    is shown without proofs, an offer's packaging without the product in use.
    """
    q, role, voice = (F.coalesce(c, F.lit("")) for c in (query, role, voice))

    def made(q: Column) -> Column:
        packaging, proof = (role == "cta") | _any(q, K.PACKAGING_WORDS), (role == "proof") | _any(q, K.PROOF_WORDS)
        detail, face = _any(q, K.DETAIL_WORDS), _any(q, K.FACE_WORDS)
        strict = packaging | proof | (detail & (role == "product")) | (face & role.isin("opening", "product"))
        # Where both could be shown, what the spoken text names first decides; if it names neither, the query's words do.
        main = F.when(voice != "", voice).otherwise(q)
        in_main = (first_place(main, K.FACE_WORDS), first_place(main, K.DETAIL_WORDS))
        silent = in_main[0].isNull() & in_main[1].isNull()
        far = F.lit(9999)
        f, d = (F.coalesce(F.when(silent, first_place(q, w)).otherwise(p), far) for p, w in zip(in_main, (K.FACE_WORDS, K.DETAIL_WORDS), strict=True))
        both = role.isin("opening", "product") & face & detail
        flags = F.struct(
            (packaging & ~both).alias("packaging"), (proof & ~both).alias("proof"), F.when(both, f > d).otherwise(detail).alias("detail"),
            F.when(both, f <= d).otherwise(face).alias("face"), strict.alias("strict"),
        )
        return F.transform(F.array(flags), lambda x: _ruled(x, q, role))[0]

    return F.transform(F.array(q), made)[0]


def _ruled(x: Column, q: Column, role: Column) -> Column:
    """The first rule that holds."""
    no_offer = [w for w in K.PACKAGING_WORDS if w not in K.PACKAGING_OFFER_WORDS]

    def rule(themes: Column, required: dict, forbidden) -> Column:
        words = F.create_map(*[y for k, v in required.items() for y in (F.lit(k), _words(v))]) if required else F.create_map().cast("map<string,array<string>>")
        return F.struct(themes.alias("themes"), words.alias("required"), _words(dict.fromkeys(forbidden)).alias("forbidden"))

    one = lambda name: _words([name])
    rules = (
        F.when(x["packaging"] & (role == "cta"), rule(one("packaging"), {"packaging": K.PACKAGING_WORDS}, K.CTA_USE_WORDS))
        .when(x["packaging"] & x["detail"], rule(one("product_detail"), {"product_detail": K.DETAIL_CORE_WORDS}, ()))
        .when(x["packaging"] & x["face"], rule(one("face_apply"), {"face_apply": K.FACE_STRONG_WORDS}, no_offer))
        .when(x["packaging"], rule(one("packaging"), {"packaging": K.PACKAGING_WORDS}, ()))
        .when(x["proof"], rule(one("proof_test"), {"proof_test": K.PROOF_WORDS}, ()))
        # Both themes may stand here; only the face's words are then looked for.
        .when(x["face"], rule(F.when(x["detail"], _words(["product_detail", "face_apply"])).otherwise(one("face_apply")), {"face_apply": K.FACE_STRONG_WORDS}, [*no_offer, *K.FORMULA_WORDS, *K.PROOF_WORDS]))
        .when(x["detail"], rule(one("product_detail"), {"product_detail": K.DETAIL_CORE_WORDS}, [*K.PROOF_WORDS, *K.PACKAGING_WORDS]))
        .otherwise(rule(_words([]), {}, ()))
    )
    kind = (
        F.when((role == "opening") & ~_any(q, K.OPENING_ALLOWED_WORDS), "opening")
        .when((role == "product") & ~_any(q, K.OPENING_ALLOWED_WORDS) & _any(q, K.TEXTURE_WORDS), "texture")
        .when((role == "cta") & _any(q, K.CTA_PACKAGING_WORDS), "packaging")
    )
    besides = F.when(kind == "opening", _words(K.OPENING_PROOF_WORDS)).when(kind == "texture", _words(K.TEXTURE_FORBIDDEN_WORDS)).when(kind == "packaging", _words(K.CTA_USE_WORDS)).otherwise(_words([]))
    return F.struct(rules["themes"].alias("themes"), rules["required"].alias("required"), rules["forbidden"].alias("forbidden"), x["strict"].alias("strict"), kind.alias("kind"), besides.alias("role_forbidden"), role.alias("role")).cast(CONTRACT)


def contract_verdict(text: Column, contract: Column) -> Column:
    """A candidate's text against a contract.

    A struct: ``theme_ok``; ``missing`` themes; ``theme_forbidden`` and all ``forbidden``
    words that the text holds; ``admitted`` to the section; ``top_up``, whether it may fill
    what the section still lacks, where a product's detail and an offer's packaging are
    judged by their hard words only.
    """
    t, c = F.coalesce(text, F.lit("")), contract
    themes = F.coalesce(c["themes"], F.array().cast("array<string>"))
    hits = F.transform(themes, lambda n: F.struct(n.alias("theme"), F.exists(F.coalesce(F.try_element_at(c["required"], n), F.array().cast("array<string>")), lambda w: F.contains(t, w)).alias("hit")))
    missing = F.transform(F.filter(hits, lambda h: ~h["hit"]), lambda h: h["theme"])
    by_theme = term_hits(t, c["forbidden"])
    every = F.array_distinct(F.concat(by_theme, term_hits(t, c["role_forbidden"])))
    found = F.struct(missing.alias("missing"), by_theme.alias("theme_forbidden"), every.alias("forbidden"))

    def judged(x: Column) -> Column:
        ok = (F.size(x["theme_forbidden"]) == 0) & (~F.coalesce(c["strict"], F.lit(False)) | (F.size(x["missing"]) == 0))
        free = F.size(x["forbidden"]) == 0
        detail = (c["role"] == "product") & (themes == _words(["product_detail"]))
        relaxed = F.when(detail, ~F.arrays_overlap(x["forbidden"], _words([*K.PROOF_WORDS, *K.TOP_UP_HARD_WORDS]))).when(c["kind"] == "packaging", ~F.arrays_overlap(x["forbidden"], _words(K.CTA_USE_WORDS))).otherwise(False)
        return F.struct(
            ok.alias("theme_ok"), x["missing"].alias("missing"), x["theme_forbidden"].alias("theme_forbidden"), x["forbidden"].alias("forbidden"),
            (ok & free).alias("admitted"), (ok & (free | F.coalesce(relaxed, F.lit(False)))).alias("top_up"),
        )

    return F.transform(F.array(found), judged)[0]


def verdict_reason(verdict: Column, contract: Column, most: int = 8) -> Column:
    """What speaks for or against a candidate, as text; empty without a theme."""
    missing = F.when(F.size(verdict["missing"]) > 0, F.concat(F.lit("missing themes: "), F.array_join(verdict["missing"], ", ")))
    bad = F.when(F.size(verdict["theme_forbidden"]) > 0, F.concat(F.lit("forbidden here: "), F.array_join(F.slice(verdict["theme_forbidden"], 1, most), ", ")))
    said = F.concat_ws("; ", missing, bad)
    return F.when(said != "", said).when(F.size(contract["themes"]) > 0, "themes met").otherwise("")
