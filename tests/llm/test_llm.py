"""Each operator against a brute-force version, a round trip or held-out accuracy, and its odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import chat, exact_dedup, html_extract, html_labelled, html_tree, mixing, packing, quality_rules, queries, repeats, run_index, shared, simhash, token_files, tokens, toxicity
from tidemark.llm.graph import components

WS = " \t\n\x0b\x0c\r"
LONG = "lorem ipsum dolor sit amet " * 8000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, kept string, copy int, size long, key string, fp long, root long"
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "one", "en", None), (4, "one", "en", None), (None, "one", "en", "a"),
    (None, None, None, None), (5, LONG, "en", "b"), (6, LONG + " ", "en", "b"), (7, "a b c\na b c\na b c d e f g h", "en", "b"),
    (8, "é 日本 😀 " * 30, "fr", "a"), (9, "x" * 9000, "en", "a"), (10, "tab\tsep  double \n line\x0b", "en", "a"), (11, "x" * 9000, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, g, s, None, "n", "k", 1, 2, "k", 3, 4) for i, t, g, s in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(same, name):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


# 1


def test_toxicity_holds_out(spark, sf):
    import os

    d = sf.replace("sf0.001", "sf0.01") if os.path.isdir(sf.replace("sf0.001", "sf0.01")) else sf
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = queries.op1_toxicity(spark, d).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(r.doc_id, r.held_out))
    assert r.score.between(0, 1).all() and ((r.score >= 0.5) == (r.predicted == 1)).all()
    out = r[r.held_out]
    assert (out.predicted == out.toxic).mean() >= 0.93
    assert out[out.toxic == 0].predicted.mean() <= 0.05
    assert docs.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (5, 0), (7, 1), (7, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    m = toxicity.train(odd, labels)
    assert toxicity.score(odd, m).count() == len(ODD)
    assert toxicity.score(empty, m).count() == 0
    none = toxicity.train(odd, labels.filter("false"))
    assert toxicity.score(odd, none).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_toxicity_keeps_the_labels_share(spark):
    rows = [(i, f"same text {i % 7}", int(i % 10 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows]
    toxic, clean = (sum(y == k and not h for (*_, y), h in zip(rows, held)) for k in (1, 0))
    for most in (20, 6000):  # nothing to tell by: the score is the share
        score = toxicity.train(df, df.select("doc_id", "toxic"), most).scores([""])[0]
        assert score == pytest.approx(toxic / (toxic + clean), abs=0.01)


def test_fit_equals_a_plain_one():
    rng = np.random.default_rng(4)
    x = rng.random((60, 40)) < 0.3
    y = (x[:, 3] | x[:, 7]).astype(float)
    r = rng.normal(size=1 << toxicity.BITS)
    cuts, features = np.cumsum([0, *x.sum(1)]), np.concatenate([np.flatnonzero(row) * 5 for row in x]).astype(np.int32)
    scaled, w, b = x * r[np.arange(40) * 5], np.zeros(40), 0.0
    for _ in range(20000):  # plain gradient steps on the same loss
        e = 1 / (1 + np.exp(-(scaled @ w + b))) - y
        w, b = w - 0.01 * (scaled.T @ e + w), b - 0.01 * e.sum()
    old = toxicity.CHUNK
    try:
        for toxicity.CHUNK in (old, 50):
            weights, bias = toxicity.fit(cuts, features, y, r, rounds=4000)
            assert np.allclose(weights[np.arange(40) * 5], w * r[np.arange(40) * 5], atol=1e-3) and abs(bias - b) < 1e-2
    finally:
        toxicity.CHUNK = old


def test_ngrams_do_not_depend_on_chunks():
    t = ["ab cd" * 50, None, "xyz " * 40, "q"]
    whole = toxicity.present(t)
    old = toxicity.CHUNK
    try:
        toxicity.CHUNK = 37
        parts = toxicity.present(t)
    finally:
        toxicity.CHUNK = old
    assert all((a == b).all() for a, b in zip(whole, parts))


# 2


def test_html_on_labelled_pages():
    m, bad, total = html_extract.default_model(), 0, 0
    for page in html_labelled.labelled_pages(150, seed=77):
        nodes = html_tree.parse(page, labels=True)
        p = m.marginals(nodes)
        for i, n in enumerate(nodes):
            if n.text is not None:
                total += 1
                bad += (p[i] >= 0.5) != (n.label == 1)
    assert bad / total < 0.06


def test_marginals_equal_enumeration():
    m = html_extract.default_model()
    nodes = html_tree.parse("<body><nav><a href=x>one</a></nav><div><p>Some words here.</p>more</div></body>")
    n = len(nodes)
    local = [sum(m.weights.get(f, 0.0) for f in html_extract.features(nodes, i)) for i in range(n)]
    weights = np.zeros((n, 2))
    for code in range(1 << n):
        x = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(local[i] * x[i] for i in range(n)))
        for i in range(1, n):
            w *= m.edges[nodes[i].text is not None][2 * x[nodes[i].parent] + x[i]]
        for i in range(n):
            weights[i, x[i]] += w
    assert np.allclose(weights[:, 1] / weights.sum(1), m.marginals(nodes))


def test_html_pages(spark, sf, empty):
    import html as H
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    some = spark.createDataFrame(
        [(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<article><h1>T &amp; x</h1><p>a<b>b</b>\n c<p>d<script>if(a<b)</p>"), (4, "u", "<" * 2000), (None, "u", "<p>" * 3000)],
        "page_id long, url string, html string",
    )
    out = html_extract.extract(some).collect()
    assert len(out) == 6
    assert next(r for r in out if r.page_id == 3).text == "T & x\n\nab c\n\nd"
    assert html_extract.extract(some.filter("false")).count() == 0


def test_html_that_lacks_tags():
    m = html_extract.default_model()
    main = "Main words of the story, which is one long sentence that says a good deal about what happened there."
    for page in (
        f"<html><head><title>x</title><p>{main}", f"<head><meta charset=utf-8><div>{main}</div>", f"<title>y</title>{main}",
        f"<body><noscript><p>{main}</p>", f"<body><svg><path d='x'><p>{main}", f"<select><option>Aa<option>Bb<p>{main}</p>", f"<p>{main}</p><title>z",
        f"<p>{main}</p><svg><title>icon</title><g/></svg><select><option>One</select><noscript>turn it on</noscript>", f"<p a='>' b=c\">{main}</p>",
        f"<p class='a>b'>{main}</p><!-- {main} <p>", f"<p>{main}</p><script>if (a < b) {{ x('</p>') }}", f"<td data-label>{main}</td>",
    ):
        assert [n.text for n in html_tree.parse(page) if n.text] == [main], page
    cells = '<article><h1>Prices</h1><table><tr><td data-label="Price">ten of the coins that they use</td><td data-label>and more</td></tr></table></article>'
    assert html_extract.main_text(cells, m).split("\n\n")[0] == "Prices"
    assert [n.text for n in html_tree.parse("a < b <3 &lt;c&gt; &#" + "9" * 6000 + "; &#0000000065;<wbr>B")] == [None, "a < b <3 <c> � AB"]
    assert [n.text for n in html_tree.parse("<b>x<p>y</b>z</p>w")][1:] == ["x", None, "yz", "w"]


@pytest.mark.parametrize("unit", ['<a x="b" ', "<a ", "<b></i>", "<!--", "<title>", "<a x='>\" ", "<p", "<", "</", "&#9", "<noscript>", "<option>", '=  "', "<a =\" ='", "<td><tr>", "<div></i>"])
def test_html_is_linear(unit):
    import time

    m, page = html_extract.default_model(), (unit * (1 << 20))[: 1 << 20]
    began = time.process_time()
    html_extract.main_text(page, m)
    assert time.process_time() - began < 20  # seconds at most here, hours if a step looked back


# 3


def test_exact_dedup_odd(odd, empty):
    got = [tuple(r) for r in exact_dedup.exact_dedup(odd).collect()]
    groups = defaultdict(list)
    for i, t, _, _ in ODD:
        groups["".join(c for c in t or "" if c not in WS)].append((-len(t or ""), i is None, i if i is not None else 0))
    assert len(got) == len(ODD)
    for i, keep, n, kept, sha in got:
        g = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == sha)
        best = min(g)
        assert n == len(g) and keep == (None if best[1] else best[2])
    assert sum(r[3] for r in got) == len(groups)
    out = exact_dedup.drop_exact(odd)
    assert out.columns == odd.columns and out.count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact(empty).count() == 0


# 4 and the encoder


def test_encoder_equals_library(docs):
    e = tokens.Encoder(tokens.default_path())
    end = "<|endoftext|>"
    t = [x or "" for _, x in texts_of(docs)] + [x or "" for _, x, _, _ in ODD] + [" a\n b", "a \n b", "it's  don't", "\x1f a\x85 b", "end ", "  "]
    t += [end, f"{end} a", f"a{end}b", f"a {end}  {end}{end} b ", "<|endoftext|", f"<|{end}|>", f"x \n{end}\n y"]
    rng = random.Random(6)
    t += ["".join(rng.choice([" ", "  ", "\n", "ab", "é", "9", ",", "'s", end, end[:5], "日本"]) for _ in range(30)) for _ in range(300)]
    fresh = Tokenizer.from_file(tokens.default_path())
    want = [x.ids for x in fresh.encode_batch_fast(t, add_special_tokens=False)]
    assert 50256 in sum(want, [])
    assert [x.tolist() for x in e.encode(t)] == want
    old, tokens.MEMO = tokens.MEMO, 20
    try:
        assert [x.tolist() for x in e.encode(t)] == want
    finally:
        tokens.MEMO = old


def test_encoder_memo_is_small_and_ids_stay(monkeypatch):
    """Line ends begin chunks as spaces do, long chunks aren't kept, and one text can't outgrow the memo."""
    rng = random.Random(7)
    fresh = Tokenizer.from_file(tokens.default_path())
    same = lambda e, t: [x.tolist() for x in e.encode(t)] == [x.ids for x in fresh.encode_batch_fast(t, add_special_tokens=False)]
    words = ["".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(40)]
    lines = ["\n".join(rng.sample(words, 40)) + "." for _ in range(60)]
    e = tokens.Encoder(tokens.default_path())
    assert same(e, [*lines, "a " + "日本" * 500])
    assert len(e.memo) <= 3 * len(words) and max(map(len, e.memo)) <= tokens.LONGEST
    units = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "\u2028", "ab", "é", "ǅ", "9", "_", "'", "'s", ",.", "***", "日本"]
    odd = ["".join(rng.choice(units) for _ in range(25)) for _ in range(2000)]
    monkeypatch.setattr(tokens, "MEMO", 50)
    monkeypatch.setattr(tokens, "STRETCH", 10)
    e = tokens.Encoder(tokens.default_path())
    assert same(e, [*odd, " ".join(f"{w}{v}" for w in words for v in words)])
    assert len(e.memo) <= 50 + 2 * 10


def ids_of(texts):
    """By the library itself."""
    fresh = Tokenizer.from_file(tokens.default_path())
    return [np.array([*x.ids, 0], "<u4") for x in fresh.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark, docs, odd, empty, tmp_path):
    rows = sorted(texts_of(docs))
    want, start = {}, 0
    for (i, _), ids in zip(rows, ids_of([t for _, t in rows])):
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(docs).collect()}
    assert got == want
    assert token_files.round_trip(odd).count() == len(ODD)
    assert token_files.round_trip(empty).count() == 0
    path = str(tmp_path / "t")
    m = token_files.write_token_files(docs, path, length=64).orderBy("shard").first()
    shard = token_files.Shard(f"{path}/{m.shard:08d}.arrow")
    whole = np.concatenate(list(shard.ids(0, m.n_tokens)))
    n = -(-m.n_tokens // 64)
    assert np.concatenate([shard.sequence(i) for i in range(n)])[: m.n_tokens].tolist() == whole.tolist()
    assert sum(int(shard.mask(i).sum()) for i in range(n)) == m.n_tokens
    assert not shard.sequence(0).flags.owndata  # a slice, no copy


# 5


def test_quality_odd(odd, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[7].n_dup_lines == 1 and got[7].n_words == 14
    w = LONG.split()
    assert got[5].n_words == len(w) and got[5].n_repeat_words == len(w)
    assert quality_rules.quality_rules(odd).count() == len(ODD)
    assert quality_rules.quality_rules(empty).count() == 0


def test_repeat_words_brute(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in quality_rules.measure(df).collect():
        w = texts[r.doc_id].split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        assert r.n_repeat_words == len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})


# 6


def brute_simhash(rows):
    from xxhash import xxh64_intdigest

    def fp(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = [x for x in "".join(" " if c in WS else c for c in w).split(" ") if x]
        if not w:
            return 0
        g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
        h = [xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(t) for _, t in rows]
    distinct = list(set(prints))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 2:
                parent[find(a)] = find(b)
    least = {}
    for (i, _), f in zip(rows, prints):
        r = find(f)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, prints)), key=str)


def test_simhash_brute(spark, docs, odd, empty):
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect()), key=str)
        assert got == brute_simhash(texts_of(df))
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.drop_near(odd)
    assert kept.columns == odd.columns


def test_links_brute(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:12]:
        x = b
        for _ in range(25):
            x ^= (1 << rng.randrange(64)) ^ ((1 << rng.randrange(64)) if rng.random() < 0.6 else 0)
            prints.add(x)
        prints |= {b ^ (1 << i) for i in range(30)}
    prints = sorted(prints)
    signed = [simhash._signed(p) for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    for r in edges.collect():
        assert bin((r.a ^ r.b) % (1 << 64)).count("1") <= 2
    got = {r.node: r.root for r in components(edges).collect()}
    parent = dict(zip(signed, signed))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) % (1 << 64)).count("1") <= 2:
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    assert {s: got.get(s, s) for s in signed} == {s: find(s) for s in signed}


def test_masks_cover():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    assert all(any(not m & ((1 << i) | (1 << j)) for m in masks) for i in range(64) for j in range(i, 64))


def shingle_sets(texts, size=5):
    w = [t.encode().lower().split() for t in texts]
    return [frozenset(tuple(x[i : i + size]) for i in range(max(1, len(x) - size + 1))) if x else frozenset() for x in w]


def is_near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def smallest_of_groups(sets):
    """Places of the first of what likeness connects."""
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for b in range(len(sets)):
        for a in range(b):
            if sets[a] and sets[b] and is_near(sets[a], sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return [i for i in range(len(sets)) if find(i) == i]


@pytest.mark.parametrize("crowd", [1, 2, 16, 1000])
def test_near_copies_are_dropped_at_any_distance(spark, crowd):
    from tidemark.llm import jaccard_join

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    line = rng.choices(vocabulary, k=25)
    texts = ["", "one", "one two", "One  two"]
    for size in (12, 40, 120, 300):
        for _ in range(12):
            base = rng.choices(vocabulary, k=size)
            texts.append(" ".join(base))
            for _ in range(rng.randrange(1, 8)):
                x = list(base)
                for _ in range(rng.randrange(0, max(2, size // 20))):
                    x[rng.randrange(size)] = rng.choice(vocabulary)
                texts.append(" ".join(x + line if rng.random() < 0.2 else x))
    base = rng.choices(vocabulary, k=100)
    for _ in range(60):
        x = list(base)
        x[rng.randrange(100)] = rng.choice(vocabulary)
        texts.append(" ".join(x))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in jaccard_join.drop_similar(df, crowd=crowd, different=2 * crowd).collect())
    s = shingle_sets(texts)
    assert not [(a, b) for a in kept for b in kept if a < b and s[a] and is_near(s[a], s[b])]
    assert kept == smallest_of_groups(s)
    if crowd == 16:
        assert sorted(r.doc_id for r in simhash.drop_near(df).collect()) == kept
    far = [(a, b) for a in range(len(s)) for b in range(a) if is_near(s[a], s[b]) and bin(simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).count("1") > 2]
    assert far  # what a radius of 2 bits cannot see


@pytest.mark.parametrize("crowd", [1, 16])
def test_a_chain_of_copies_is_one_group_in_any_crowd(spark, crowd):
    from tidemark.llm import jaccard_join

    w = [f"w{i}" for i in range(104)]
    swap = lambda x, at: [*x[:at], f"new{at}", *x[at + 1 :]]
    first, other = swap(swap(w, 20), 50), swap(swap(w, 70), 90)  # each alike to w, not to each other
    texts = [first, other, w, *[w[:60] + [f"x{i}{j}" for j in range(40)] for i in range(4)]]
    s = shingle_sets([" ".join(t) for t in texts])
    assert is_near(s[0], s[2]) and is_near(s[1], s[2]) and not is_near(s[0], s[1])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.drop_similar(df, crowd=crowd, different=crowd).collect()) == smallest_of_groups(s) == [0, 3, 4, 5, 6]


def test_pipeline_drops_near_copies(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(texts_of(P.STAGES[1][1](spark, docs, sf)))
    s = shingle_sets([t or "" for _, t in rows])
    gone = {r[0] for r in rows} - {rows[i][0] for i in smallest_of_groups(s)}
    assert gone
    assert sorted(texts_of(P.STAGES[2][1](spark, P.STAGES[1][1](spark, docs, sf), sf))) == [r for r in rows if r[0] not in gone]


def test_near_copies_go_whose_ids_repeat_or_are_null(spark):
    """rows of one id, or without any, are judged one by one; what else they are called by doesn't keep a copy."""
    rng = random.Random(3)
    base = [[f"w{rng.randrange(9999)}" for _ in range(80)] for _ in range(6)]
    near = lambda i, j: " ".join([*base[i][:79], f"x{j}"])
    rows = [(None, 0, 0), (None, 0, 1), (None, 1, 0), (3, 1, 1), (7, 2, 0), (7, 2, 1), (7, 3, 0), (5, 3, 1), (9, 4, 0), (None, 5, 0)]
    df = spark.createDataFrame([(k, i, near(i, j), f"s{j}") for k, i, j in rows], "doc_id long, row int, text string, source string")
    want = [(3, 1), (5, 3), (7, 2), (9, 4), (None, 0), (None, 5)]
    for parts in (1, 4):
        kept = simhash.drop_near(df.repartition(parts))
        assert kept.columns == df.columns
        got = kept.collect()
        assert sorted(((r.doc_id, r.row) for r in got), key=str) == want
        assert all(r.text == near(r.row, int(r.source[1])) for r in got)
    one = simhash.drop_near(df.filter("doc_id IS NULL AND row = 1 OR doc_id = 3"))
    assert [r.doc_id for r in one.collect()] == [3]


def test_fingerprints_find_close_copies_for_the_pipeline(spark, monkeypatch):
    """F8: with the join's own lists left out, copies of close fingerprints go all the same, and others stay."""
    from tidemark.llm import jaccard_join

    rng = random.Random(8)
    long = [[f"w{rng.randrange(5000)}" for _ in range(600)] for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(long)] + [(100 + i, " ".join([*w[:-1], "other"])) for i, w in enumerate(long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(df).collect()}
    close = {100 + i for i in range(12) if bin(prints[i] ^ prints[100 + i]).count("1") <= 2}
    assert len(close) > 6
    whole = sorted(r.doc_id for r in simhash.drop_near(df).collect())
    assert whole == list(range(12))
    monkeypatch.setattr(jaccard_join, "_skip_join", lambda rows, p, q: spark.createDataFrame([], "a long, b long"))
    assert close.isdisjoint(r.doc_id for r in simhash.drop_near(df).collect())
    # What fingerprints link without being alike enough stays: the exact check decides.
    assert jaccard_join.drop_similar(df, 5, 1.0, prints=simhash.fingerprints(df)).count() == 24


# 7


def test_mixing(spark, docs, odd, empty):
    r = mixing.mix(docs).toPandas()
    sizes = r.groupby("source")["size"].sum().sort_index()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes.index)}
    left, target, open_ = 1.5 * sizes.sum(), {}, set(sizes.index)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    for s, g in r.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - target[s]) <= max(0.02 * target[s], g["size"].max() / 2)
    assert (r.taken <= 2 * r["size"]).all() and r.taken.sum() == pytest.approx(1.5 * sizes.sum(), rel=0.01)
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, r[key].values)) == sorted(map(tuple, again[key].values))
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    copies = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == copies
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(empty).count() == 0
    named = docs.limit(30).withColumns({c: F.lit(1) for c in ("m_id", "m_rows", "m_copies", "_n", "row", "k_id", "_row", "score", "keep_id", "part")})
    for kept in (mixing.mixed_documents(named), exact_dedup.drop_exact(named), simhash.drop_near(named)):
        assert kept.columns == named.columns and kept.count() > 0


# 8


def brute_repeats(rows, k=50):
    key = lambda i: (1 << 63) - 1 if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - k + 1):
            w = b[p : p + k]
            least[w] = min(least.get(w, 1 << 64), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - k + 1):
            if least[b[p : p + k]] < key(i):
                gone[p : p + k] = [True] * k
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_brute(spark, odd, empty):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé \n") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            b, a = rng.choice(base), rng.randrange(0, 300)
            parts.append(b[a : a + rng.randrange(20, 200)] if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(90))))
        rows.append((None if i % 37 == 5 else i // 2 * 2 if i % 11 == 3 else i, None if i % 41 == 7 else "".join(parts)))
    rows += [(500, "a" * 300), (501, "a" * 260), (502, "a" * 49), (503, "ab" * 100), (504, "ab" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = repeats.CHUNK, repeats.BUCKET
    try:
        for hot, indexed in ((repeats.HOT, 2 << 20), (repeats.HOT, 300), (3, 2 << 20)):
            repeats.CHUNK, repeats.BUCKET = 4000, 9000
            got = sorted((tuple(r) for r in repeats.cut_repeats(df, hot, indexed).drop("kept").collect()), key=str)
            assert got == brute_repeats(rows)
    finally:
        repeats.CHUNK, repeats.BUCKET = old
    got = sorted((tuple(r) for r in repeats.cut_repeats(odd).drop("kept").collect()), key=str)
    assert got == brute_repeats([(i, t) for i, t, _, _ in ODD])
    assert repeats.cut_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_run_index(seed):
    rng = random.Random(seed)
    letters, k = rng.choice((2, 3, 20)), rng.choice((7, 20, 50))
    base = bytes(rng.randrange(97, 97 + letters) for _ in range(300))

    def some(n):
        return [base[a : a + rng.randrange(1, 81)] if rng.random() < 0.7 else bytes(rng.randrange(97, 105) for _ in range(rng.randrange(70))) for a in (rng.randrange(0, 215) for _ in range(n))]

    held, foreign = some(30), [*some(20), b"", b"\0\xff" * 30]
    owners = np.array([rng.randrange(30) for _ in held], np.int64)
    index = run_index.RunIndex(held, owners, k)
    text = b"".join(s + b"\0" for s in held)
    for s, found in zip(foreign + held, index.matching_statistics(foreign + held)):
        for i, (n, q) in enumerate(found):
            assert n == max(m for m in range(len(s) - i + 1) if any(s[i : i + m] in h for h in held))
            assert text[q : q + n] == s[i : i + n]
    for s, row in zip(foreign + held, index.least_owners(foreign + held, 31)):
        for i in range(min(31, len(s) - k + 1)):
            assert row[i] == min((o for h, o in zip(held, owners) if s[i : i + k] in h), default=run_index.NO_OWNER)
    assert len(index.starts) < len(text)


# 9


def test_chats(spark, empty):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 7, "user", "hi"), (5, 9, "assistant", "yo"), (5, 12, "user", "more"), (5, 12, "user", "more"),
        (None, 0, "user", "x"), (6, None, None, None), (7, 0, "user", LONG),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, at string")
    got = {r.conv_id: (r.n_turns, r.chat) for r in chat.format_chats(df).collect()}
    assert set(got) == {3, 4, 6, 7}
    assert got[3] == (3, "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n<|user|>\nmore\n<|end|>\n")
    assert chat.format_chats(df.filter("false")).count() == 0


# 10


def check_packing(rows, texts):
    ids = ids_of([t for _, t in texts])
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
        assert 0 < r.length <= 2048
    for g in by.values():
        at = 0
        for r in sorted(g, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    want = Counter()
    for (i, _), x in zip(texts, ids):
        first = len(x) % 2048 or min(len(x), 2048)
        cuts = [0, *range(first, len(x) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, p, a, b - a, zlib.crc32(x[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by), sum(map(len, ids))


def test_packing(docs, odd, empty):
    for df in (docs, odd):
        n, total = check_packing(packing.pack(df).collect(), texts_of(df))
        assert n <= -(-total // 2048) * 1.02 + 1
    assert packing.pack(empty).count() == 0


def test_plans():
    rng = random.Random(2)

    def best(items, cap):  # exact, for few items
        items = sorted(items, reverse=True)
        low = [len(items)]

        def go(i, bins):
            if len(bins) >= low[0]:
                return
            if i == len(items):
                low[0] = len(bins)
                return
            for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
                go(i + 1, [*bins[:k], bins[k] - items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, cap - items[i]])

        go(0, [])
        return low[0]

    over = 0
    for _ in range(60):
        items = [rng.randrange(1, 61) for _ in range(rng.randrange(1, 11))]
        plan = packing.complete(Counter(items), 100)
        assert Counter({k: n for k, n in sum((Counter({x: f.count(x) * t for x in set(f)}) for f, t in plan), Counter()).items()}) == Counter(items)
        assert all(sum(f) <= 100 for f, _ in plan)
        over += sum(t for _, t in plan) - best(items, 100)
    assert over <= 1
    places = packing.Places([((60, 20, 20), 3), ((60,), 2)])
    assert [tuple(map(int, x)) for x in zip(*places.find(20, np.arange(6)))] == [(0, 60), (1, 60), (2, 60), (0, 80), (1, 80), (2, 80)]


def test_every_undominated_filling_is_tried():
    found = [sorted(f.elements()) for f in map(Counter, packing.fillings(Counter([30, 25, 15, 10]), [30, 25, 15, 10], 40, 0, lambda: None))]
    assert sorted(found) == [[10, 30], [15, 25]]
    rng = random.Random(4)
    for _ in range(150):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        counts, space = Counter(items), rng.randrange(5, 60)
        subsets = {tuple(sorted(x for i, x in enumerate(items) if m >> i & 1)) for m in range(1 << len(items))}
        want = set()
        for s in (s for s in subsets if sum(s) <= space):
            rest, waste = counts - Counter(s), space - sum(s)
            parts = [tuple(x for i, x in enumerate(s) if m >> i & 1) for m in range(1 << len(s))]
            if not any(sum(t) <= x <= sum(t) + waste and t != (x,) for x in rest for t in parts):
                want.add(s)
        got = [tuple(sorted(Counter(f).elements())) for f in packing.fillings(counts, sorted(counts, reverse=True), space, space, lambda: None)]
        assert len(got) == len(set(got)) and set(got) == want


def test_one_id_documents_beside_large_ones():
    counts = {1025: 3000, 1: 1500}
    plan = packing.complete(counts)
    assert sum(t for _, t in plan) == packing.lower_bound(counts) == 3000
    # Best fit needs one bin more than there must be, and the search fills with over a thousand pieces.
    counts = {1024: 2, 1: 2500, 700: 3, 648: 3, 1400: 3}
    plan, done = packing.best_plan(counts)
    used = Counter()
    for f, t in plan:
        assert sum(f) <= 2048
        used.update({k: n * t for k, n in Counter(f).items()})
    assert used == counts and sum(t for _, t in plan) >= packing.lower_bound(counts)
    assert list(packing.fillings({1: 1500}, [1], 1023, 0, lambda: None)) == [{1: 1023}]


def test_plans_are_optimal():
    rng = random.Random(9)

    def fewest(items, cap):
        items, low = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= low[0]:
                return
            if i == len(items):
                low[0] = len(bins)
                return
            for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
                go(i + 1, [*bins[:k], bins[k] - items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, cap - items[i]])

        go(0, [])
        return low[0]

    for _ in range(150):
        items = [rng.randrange(10, 61) for _ in range(rng.randrange(6, 13))]
        plan, done = packing.best_plan(Counter(items), 100)
        assert done and sum(t for _, t in plan) == fewest(items, 100) >= packing.lower_bound(Counter(items), 100)


def test_packing_search_holds_one_state():
    """The pipeline's packing: what the search keeps for each step doesn't hold all lengths and counts again."""
    import tracemalloc

    rng = np.random.default_rng(1)
    x = np.clip(rng.lognormal(6.9, 1.0, 400_000), 2, 2047).astype(int)
    counts = dict(zip(*[a.tolist() for a in np.unique(x, return_counts=True)], strict=True))
    tracemalloc.start()
    plan, _ = packing.best_plan(counts, nodes=60_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    used = Counter()
    for filling, times in plan:
        for length in filling:
            used[length] += times
    assert used == counts and peak < 80e6


# Graphs and the pipeline


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_eased_session_hands_few_texts_over_at_once(spark):
    """An executor's memory followed 10,000 whole texts a core, in the JVM and in Python, and stayed with both."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 3000, 1, 1).withColumn("text", F.repeat(F.lit("text "), 2000))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    try:
        shared.ease(spark, 0)
        got = rows.mapInArrow(sizes, "size long, n long").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 2 * shared.BATCH_BYTES


def test_release_gives_freed_native_memory_back(spark):
    """The driver's limit counts what its C library keeps of freed memory, which grew from plan to plan."""
    from tidemark.llm.shared import release

    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def resident() -> int:
        return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) >> 10

    for _ in range(2):
        jvm.System.gc()
    held = [jvm.java.util.zip.Deflater() for _ in range(1200)]  # each takes over 128 KB outside of the heap
    full = resident()
    for x in held[:-1]:
        x.end()
    freed = resident()
    release(spark)
    assert full - resident() > 80, (full, freed, resident())


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    rows = [(i, t) for i, t in texts_of(docs) if i not in toxic]
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in WS)].append((-len(t or ""), i))
    keep = {min(g)[1] for g in groups.values()}
    rows = [(i, t) for i, t in rows if i in keep]
    rows.sort()
    sets = shingle_sets([t or "" for _, t in rows])
    rows = [rows[i] for i in smallest_of_groups(sets)]
    stage = docs
    for _, f in P.STAGES[:3]:
        stage = f(spark, stage, sf)
        assert stage.columns == docs.columns
    assert sorted(texts_of(stage)) == rows
    copies = {r.doc_id: r.copies for r in mixing.mix(stage).collect()}
    mixed = [(i, t) for i, t in rows for _ in range(copies[i])]
    packed = P.run(spark, sf).collect()
    check_packing(packed, mixed)
