"""The Jaccard join against all pairs, whatever counts as a crowd."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import jaccard_join

SCHEMA = "doc_id long, text string, n long, k long, g long, token long, sig long, set string, part int, n_shingles int"


def plain(rows, p=9, q=10):
    def of(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])

    sets = [of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and q * len(a & sets[j]) >= p * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "s", 6, 7) for r in rows], SCHEMA).repartition(3)
    out = jaccard_join.jaccard_groups(df, **how)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return Counter(tuple(r) for r in out.collect())


def copies(seed, bases=4, each=40, words=70, edits=5):
    """Groups around a text, with up to ``edits`` words exchanged, some of them alike; and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    out, passage = [], [word() for _ in range(40)]
    for _ in range(bases):
        base = [word() for _ in range(words + rng.randrange(30))]
        twins = [(rng.randrange(len(base)), word()) for _ in range(4)]
        for _ in range(each):
            t = list(base)
            for _ in range(rng.randrange(edits)):
                i, x = rng.choice(twins) if rng.random() < 0.4 else (rng.randrange(len(t)), word())
                t[i] = x
            out.append(" ".join(t[: rng.randrange(len(t) - 9, len(t))]))
    out += [" ".join([*passage, *[word() for _ in range(rng.randrange(3, 60))]]) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


ODD = [
    (None, None), (None, "a b c d"), (-1, "A b C d"), (900, ""), (901, " \n"), (901, " \n"), (902, "two words"), (903, "two Words"), (904, "one"),
    (905, "É b c"), (906, "é b c"), (907, "lorem ipsum dolor sit amet " * 4000), (908, "lorem ipsum dolor sit " * 4000), (902, "other words than before"),
]


@pytest.mark.parametrize(("crowd", "different"), [(1, 2), (6, 8), (64, 256)])
def test_equals_all_pairs(spark, crowd, different):
    rows = copies(crowd) + ODD
    want = plain(rows)
    assert got(spark, rows, crowd=crowd, different=different) == want
    assert len({c for *_, c in want}) > 50 and max(Counter(c for *_, c in want.elements()).values()) > 20


def test_other_bounds(spark):
    rows = copies(5, edits=9)
    assert got(spark, rows, similarity=0.8, crowd=4, different=8) == plain(rows, 4, 5)


def test_empty(spark):
    assert got(spark, []) == Counter() and got(spark, [(1, None)]) == Counter({(1, 0, 1): 1})


def test_skipping_loses_no_first_meeting():
    rng, p, q = random.Random(2), 9, 10
    sets = [sorted(rng.sample(range(30), rng.randrange(18, 27))) for _ in range(60)]
    met = set()
    for token in range(30):
        rows = sorted((len(s), s.index(token), k) for k, s in enumerate(sets) if token in s)
        n, at, k = (np.array(x) for x in zip(*rows))
        for x, y in jaccard_join.skipped(n, at, k, p, q):
            met |= {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    for j in range(60):
        for i in range(j):
            a, b = set(sets[i]), set(sets[j])
            if q * len(a & b) >= p * len(a | b):
                assert (i, j) in met
