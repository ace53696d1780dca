"""Contracts and verdicts against a plain reading of the rules, over sections and texts of many kinds."""

import random

from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import themes as T

LISTS = [K.OPENING_ALLOWED_WORDS, K.TEXTURE_WORDS, K.CTA_PACKAGING_WORDS, K.FACE_WORDS, K.DETAIL_WORDS, K.PACKAGING_WORDS, K.PROOF_WORDS, K.FORMULA_WORDS, K.CTA_USE_WORDS, K.TEXTURE_FORBIDDEN_WORDS]
NO_OFFER = [w for w in K.PACKAGING_WORDS if w not in K.PACKAGING_OFFER_WORDS]


def contract(q, role, voice):
    has = lambda ws: any(w in q for w in ws)
    names = []
    if role == "cta" or has(K.PACKAGING_WORDS):
        names.append("packaging")
    if role == "proof" or has(K.PROOF_WORDS):
        names.append("proof_test")
    if has(K.DETAIL_WORDS):
        names.append("product_detail")
    if has(K.FACE_WORDS):
        names.append("face_apply")
    strict = bool({"packaging", "proof_test"} & set(names)) or ("product_detail" in names and role == "product") or ("face_apply" in names and role in ("opening", "product"))
    if role in ("opening", "product") and {"face_apply", "product_detail"} <= set(names):
        for text in (voice or q, q):
            f, d = (min((text.index(w) for w in ws if w in text), default=9999) for ws in (K.FACE_WORDS, K.DETAIL_WORDS))
            if (f, d) != (9999, 9999):
                break
        names = ["face_apply" if f <= d else "product_detail"]
    if "packaging" in names and role == "cta":
        out = ["packaging"], {"packaging": K.PACKAGING_WORDS}, K.CTA_USE_WORDS
    elif {"packaging", "product_detail"} <= set(names):
        out = ["product_detail"], {"product_detail": K.DETAIL_CORE_WORDS}, ()
    elif {"packaging", "face_apply"} <= set(names):
        out = ["face_apply"], {"face_apply": K.FACE_STRONG_WORDS}, NO_OFFER
    elif "packaging" in names:
        out = ["packaging"], {"packaging": K.PACKAGING_WORDS}, ()
    elif "proof_test" in names:
        out = ["proof_test"], {"proof_test": K.PROOF_WORDS}, ()
    elif "face_apply" in names:
        out = names, {"face_apply": K.FACE_STRONG_WORDS}, [*NO_OFFER, *K.FORMULA_WORDS, *K.PROOF_WORDS]
    elif "product_detail" in names:
        out = names, {"product_detail": K.DETAIL_CORE_WORDS}, [*K.PROOF_WORDS, *K.PACKAGING_WORDS]
    else:
        out = [], {}, ()
    kind, more = None, ()
    if role == "opening" and not has(K.OPENING_ALLOWED_WORDS):
        kind, more = "opening", K.OPENING_PROOF_WORDS
    elif role == "product" and not has(K.OPENING_ALLOWED_WORDS) and has(K.TEXTURE_WORDS):
        kind, more = "texture", K.TEXTURE_FORBIDDEN_WORDS
    elif role == "cta" and has(K.CTA_PACKAGING_WORDS):
        kind, more = "packaging", K.CTA_USE_WORDS
    return *out, strict, kind, more


def verdict(text, q, role, voice):
    names, required, forbidden, strict, kind, more = contract(q, role, voice)
    missing = [n for n in names if not any(w in text for w in required.get(n, ()))]
    bad = [w for w in dict.fromkeys(forbidden) if w in text]
    every = list(dict.fromkeys(bad + [w for w in more if w in text]))
    ok = not bad and not (strict and missing)
    top = ok and (not every or (role == "product" and names == ["product_detail"] and not set(every) & {*K.PROOF_WORDS, *K.TOP_UP_HARD_WORDS}) or (not (role == "product" and names == ["product_detail"]) and kind == "packaging" and not set(every) & set(K.CTA_USE_WORDS)))
    return names, kind, strict, missing, bad, every, ok, ok and not every, top


def test_contracts_and_verdicts(spark):
    rng = random.Random(6)
    some = lambda k: " ".join(rng.choice(rng.choice(LISTS)) for _ in range(rng.randrange(k)))
    data = []
    for i in range(1500):
        parts = [some(3), some(2), some(2), some(3) if rng.random() < 0.5 else ""]
        data.append((i, rng.choice(["opening", "product", "proof", "cta", "transition", ""]), *parts, rng.sample(["国风", "x", "手持"], rng.randrange(3)), some(4)))
    data += [(9001, None, None, None, None, None, None, None), (9002, "cta", "", None, "", "", [], ""), (9003, "product", "", "", "", "", None, "x" * 50_000 + "礼盒"), (9004, "product", "膏体 质感", "", "", "", [], "膏体 手臂")]
    df = spark.createDataFrame(data, "i int, role string, a string, b string, c string, voice string, kw array<string>, text string")
    df = df.withColumn("q", T.section_query(F.col("a"), F.col("b"), F.col("c"), F.col("voice"), F.col("kw")))
    df = df.withColumn("k", T.section_contract(F.col("q"), F.col("role"), F.col("voice")))
    df = df.withColumn("v", T.contract_verdict(F.col("text"), F.col("k"))).withColumn("why", T.verdict_reason(F.col("v"), F.col("k")))
    kinds = set()
    for r in df.collect():
        q = " ".join(x for x in (r.a, r.b, r.c, r.voice, " ".join(r.kw or [])) if x)
        assert r.q == q
        want = verdict(r.text or "", q, r.role or "", r.voice or "")
        got = (r.k.themes, r.k.kind, r.k.strict, r.v.missing, r.v.theme_forbidden, r.v.forbidden, r.v.theme_ok, r.v.admitted, r.v.top_up)
        assert got == want, r
        assert (r.why == "") == (not want[0] and not want[4])
        kinds.add((tuple(want[0]), want[1], want[6], want[7], want[8]))
    assert {k[0] for k in kinds} >= {(), ("packaging",), ("proof_test",), ("product_detail",), ("face_apply",), ("product_detail", "face_apply")}
    assert {k[1] for k in kinds} == {None, "opening", "texture", "packaging"} and any(k[4] and not k[3] for k in kinds)


def test_texts_are_judged_once_for_each_contract(spark, monkeypatch):
    """many pairs of few texts and contracts cost few verdicts, and each pair gets its own."""
    from tidemark.operators import joins

    roles = ["opening", "product", "proof", "cta"]
    words = [K.FACE_WORDS[0], K.DETAIL_WORDS[0], K.PROOF_WORDS[0]]
    sections = spark.createDataFrame([(i, words[i % 3], roles[i % 4]) for i in range(120)], "s int, q string, role string")
    sections = sections.select("s", T.section_contract(F.col("q"), F.col("role"), F.lit("")).alias("c"))
    texts = [*words, "plain", None]
    pairs = spark.createDataFrame([(s, t, texts[t % 5]) for s in range(120) for t in range(50)], "s int, t int, text string")
    got = {(r.s, r.t): r.verdict for r in joins.verdicts(pairs, sections, "s", "text", "c").collect()}
    want = {(r.s, r.t): r.v for r in pairs.join(sections, "s").select("s", "t", T.contract_verdict(F.col("text"), F.col("c")).alias("v")).collect()}
    assert len(got) == 6000 and got == want
    monkeypatch.setattr(joins, "contract_verdict", lambda text, c: F.monotonically_increasing_id())
    assert joins.verdicts(pairs, sections, "s", "text", "c").select("verdict").distinct().count() <= 12 * 5
