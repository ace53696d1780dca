"""The trie of conversation prefixes against a plain one, however it is split."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, g string, at int, digest string, size long, end boolean, up long, n_turns int, parent string"


def plain(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by[c].append((turn is not None, turn or 0, digest, role, text))
    seqs = {c: [t[3:] for t in sorted(v)] for c, v in by.items()}
    built = {}
    for c in seqs:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = seqs.get(c - c % 5, [])[:h] + seqs[c][h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
        ends[tuple(s)].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()
    )


def got(spark, rows, **how):
    full = [(*r, "g", 1, "d", 2, True, 3, 4, "p") for r in rows]
    df = prefix_trie.conversation_trie(spark.createDataFrame(full, SCHEMA).repartition(3), **how)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def some(seed, n=80):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randrange(1, 14)):
            hot = "same" if turn < 6 and rng.random() < 0.8 else rng.choice("xyé")
            out.append((c, rng.choice([turn, turn, None]), rng.choice(["user", None]), hot * rng.randrange(1, 3)))
    return out


ODD = [
    (None, 1, "user", "none"), (0, None, None, None), (0, 1, "", ""), (1, 3, "user", "a"), (1, 3, "user", "a"), (1, 3, "use", "ra"), (-7, 1, "user", "minus"),
    (4, 1, "user", "x" * 100_000), (12, 0, "user", "short"), (13, 0, "user", "short"), (14, 0, "user", None), (10**15, 1, "a", "b"),
]


@pytest.mark.parametrize("limit", [1, 20, 1 << 12])
def test_equals_a_plain_trie(spark, limit):
    rows = some(limit) + ODD
    assert got(spark, rows, limit=limit, part=50) == plain(rows)


def test_copies_and_a_long_conversation(spark):
    rows = [(5 * k, t, "user", f"copy {t}") for k in range(60) for t in range(6)]
    rows += [(1001, t, "user", f"long {t}") for t in range(300)] + [(3000 + k, 0, "user", "one") for k in range(30)]
    assert got(spark, rows, limit=10, part=40) == plain(rows)


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "a", "b")]) == []


def test_blocks_of_ids(spark):
    old = prefix_trie.BLOCK
    try:
        prefix_trie.BLOCK = 16
        rows = [(k, 0, "user", "same") for k in range(-40, 200)]
        assert got(spark, rows, limit=3) == plain(rows)
    finally:
        prefix_trie.BLOCK = old
