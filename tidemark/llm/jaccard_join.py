"""Exact Jaccard join of word n-gram sets by index lists that skip, and by differences from a common set.

Two sets are linked if their similarity reaches p/q. With all sets in one order, rare
shingles first, linked sets share a shingle among the first few of each, so only these
are indexed. A list of the index is kept in blocks of one size, each by the shingle's
place in its set: for two sizes the overlap that is needed says up to which place a block
counts, and what stands behind is skipped at once, unseen.

Lists of many sets would still need all their pairs, and they are long because their sets
are alike. What is known of one set then answers for the others: the sets that long lists
connect get a common set C, of the shingles that most of them have, and each is put as its
difference D from C. How two sets differ follows from these alone, as |D1 ^ D2|. A set
whose difference leaves it enough slack is linked to the one with the most slack without
a look at any shingle, and any two that have enough slack between them meet there. Other
pairs have to share a part of their differences, so these are indexed in turn; lists of
them that are still long take differences anew, by a common set of their own, which
always shortens them. The answer is exact whatever C is.

Sets are of 64-bit hashes of shingles; equal sets are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .near import _close, _levels, _sets
from .shared import SALTS, materialize, ship, with_group
from .simhash import candidates

SHINGLE = 3
SIMILARITY = 0.9
#: Sets in a list beyond which differences are taken, and in a list of differences.
CROWD = 64
DIFFERENT = 256
#: Shingles that a task counts before it says how many it has seen.
COUNTED = 1 << 20

KEY = ["sig", "sig2", "n"]


def _lists(rows: DataFrame, key: str, of: list[str]) -> DataFrame:
    """Rows of a key together and in order; a task gets many keys."""
    return rows.select(key, *of).repartition(key).sortWithinPartitions(key, *of)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with equal first values, those of two rows or more."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        ends = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        edges = [0, *ends.tolist()]
        for a, e in zip(edges, edges[1:], strict=False):
            if e - a > 1:
                yield [c[a:e] for c in now[1:]]
        rest = [c[edges[-1] :] for c in now]
    if rest is not None and len(rest[0]) > 1:
        yield rest[1:]


def _paired(found: Iterator[tuple[np.ndarray, np.ndarray]], at_once: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Pairs as rows (a < b)."""
    xs, ys, n = [], [], 0

    def flushed() -> pa.RecordBatch:
        x, y = np.concatenate(xs), np.concatenate(ys)
        return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    for x, y in found:
        if len(x):
            xs.append(x)
            ys.append(y)
            n += len(x)
            if n >= at_once:
                yield flushed()
                xs, ys, n = [], [], 0
    if n:
        yield flushed()


def skipped(n: np.ndarray, at: np.ndarray, k: np.ndarray, p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a list's sets that may be linked and have nothing in common before this shingle.

    The list is in the order of (n, at). Sets of n and m need o = p (n + m) / (p + q) in
    common; with nothing before, places up to n - o and m - o leave enough.
    """
    starts = np.concatenate([[0], np.flatnonzero(n[1:] != n[:-1]) + 1, [len(n)]]).tolist()
    for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        small = int(n[a])
        for c, d in zip(starts[i:], starts[i + 1 :], strict=False):
            large = int(n[c])
            if q * small < p * large:
                break
            o = -(-p * (small + large) // (p + q))
            x = k[a : a + int(np.searchsorted(at[a:b], small - o, side="right"))]
            y = k[c : c + int(np.searchsorted(at[c:d], large - o, side="right"))]
            if a == c:
                u, v = np.triu_indices(len(x), 1)
                yield x[u], x[v]
            elif len(x) and len(y):
                yield np.repeat(x, len(y)), np.tile(y, len(x))


def _skip_join(rows: DataFrame, p: int, q: int) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _paired(pair for n, at, k in _by_key(batches) for pair in skipped(n, at, k, p, q))

    return _lists(rows, "token", ["n", "at", "k"]).mapInArrow(listed, "a long, b long")


def _difference_join(rows: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs of a list of differences that may be linked; two in the star are linked already."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for k, n, slack, left, star in _by_key(batches):
                u, v = np.triu_indices(len(k), 1)
                may = ~(star[u] & star[v]) & (q * np.minimum(n[u], n[v]) >= p * np.maximum(n[u], n[v]))
                may &= slack[u] + slack[v] + 2 * (p + q) * np.minimum(left[u], left[v]) >= 0
                yield k[u[may]], k[v[may]]

        return _paired(pairs())

    return _lists(rows, "g", ["k", "n", "slack", "left", "star"]).mapInArrow(listed, "a long, b long")


def _common(members: DataFrame) -> DataFrame:
    """g and common: the shingles that more than half of its sets have, the rarer ones first; n_members."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        n = 0

        def flushed() -> pa.RecordBatch:
            each = {g: np.unique(np.concatenate(x), return_counts=True) for g, x in held.items()}
            gs = np.repeat(np.array(list(each), np.int64), [len(t) for t, _ in each.values()])
            columns = [pa.array(gs), pa.array(np.concatenate([t for t, _ in each.values()])), pa.array(np.concatenate([c for _, c in each.values()]))]
            return pa.record_batch(columns, names=["g", "token", "c"])

        for b in batches:
            for g, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(g, []).append(s.values.to_numpy())
                n += len(s.values)
                if n >= COUNTED:
                    yield flushed()
                    held, n = {}, 0
        if n:
            yield flushed()

    sizes = members.groupBy("g").agg(F.count("*").alias("n_members"))
    seen = members.select("g", "set").mapInArrow(counted, "g long, token long, c long").groupBy("g", "token").agg(F.sum("c").alias("c"))
    most = seen.join(sizes, "g").filter(2 * F.col("c") > F.col("n_members"))
    found = most.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("common"))
    return sizes.join(found, "g", "left").select("g", F.coalesce(F.col("common.token"), F.array().cast("array<long>")).alias("common"))


def _beside(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Rows with the one row of their g in ``few``; large groups are split."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("short"))
    salts = F.explode(F.array(*[F.lit(i).cast("short") for i in range(SALTS)]))
    return salted.join(few.withColumn("_salt", salts), ["g", "_salt"]).drop("_salt")


def _crowds(members: DataFrame, p: int, q: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links (a, b), and pairs that have to be compared, of groups (g, k, n, set) of any size.

    All linked pairs of a group are connected by the links and by those of the pairs that
    are linked. With slack s = (q - p) n - (p + q) |D|, two sets are linked if and only if
    s1 + s2 + 2 (p + q) |D1 & D2| is not below 0.
    """
    links, pairs = [], []
    w = 2 * (p + q)
    while True:
        members = materialize(members, "jaccard-members")
        if members.isEmpty():
            return links, pairs
        put = _beside(members, _common(members))
        own, gone = F.array_except("set", "common"), F.array_except("common", "set")
        put = put.select("g", "k", F.col("n").cast("long").alias("n"), own.alias("own"), gone.alias("gone"))
        put = put.withColumn("d", (F.size("own") + F.size("gone")).cast("long"))
        put = materialize(put.withColumn("slack", (q - p) * F.col("n") - (p + q) * F.col("d")), "jaccard-differences")
        best = put.groupBy("g").agg(F.max(F.struct("slack", "k")).alias("best")).select("g", F.col("best.slack").alias("most"), F.col("best.k").alias("v"))
        put = _beside(put, best).withColumn("star", F.col("slack") + F.col("most") >= 0)
        links.append(materialize(put.filter("star AND k <> v").select(F.least("k", "v").alias("a"), F.greatest("k", "v").alias("b")).distinct(), "jaccard-links"))
        # Sets outside the star may be linked to any; so only groups that have such are looked into.
        others = put.filter("NOT star").groupBy("g").agg(F.max("slack").alias("other"))
        put = _beside(put, others)
        partner = F.when(F.col("star"), F.col("other")).otherwise(F.col("most"))
        need = F.greatest(F.lit(1), F.ceil(-(F.col("slack") + partner) / w))
        far = F.floor((q - p) * F.col("n") / p)
        size = F.least(F.col("d") - need + 1, F.when(F.size("own") > far, far + 1))
        put = put.withColumn("size", F.greatest(size, F.lit(0)).cast("int")).withColumn("set", F.concat("own", "gone"))
        part = put.select("g", "k", "n", "slack", "d", "star", F.posexplode(F.slice("set", F.lit(1), F.col("size"))).alias("at", "token"))
        part = part.select(F.xxhash64("g", "token").alias("g"), "k", "n", "slack", "star", (F.col("d") - F.col("at")).alias("left"))
        part = materialize(part, "jaccard-parts")
        sizes = part.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
        pairs.append(materialize(_difference_join(part.join(sizes.filter(F.col("m") <= most), "g"), p, q).distinct(), "jaccard-pairs"))
        again = part.select("g", "k", "n").join(sizes.filter(F.col("m") > most).select("g"), "g")
        sets = put.select(F.col("g").alias("from"), "k", "set", F.slice("set", F.lit(1), F.col("size")).alias("head"))
        sets = sets.select("k", "set", F.explode(F.transform("head", lambda t: F.xxhash64("from", t))).alias("g"))
        members = again.join(sets, ["g", "k"]).dropDuplicates(["g", "k"])


def _alike(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are linked."""
    a = sets.select(F.col("k").alias("a"), F.col("set").alias("s"))
    b = sets.select(F.col("k").alias("b"), F.col("set").alias("t"))
    both = F.size(F.array_intersect("s", "t")).cast("long")
    return pairs.distinct().join(a, "a").join(b, "b").filter((p + q) * both >= p * (F.size("s") + F.size("t")).cast("long")).select("a", "b")


def _unknown(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the pairs that the links in ``known`` don't connect already."""
    roots = materialize(components(known), "jaccard-known")
    for s in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(s), F.col("root").alias(s + "r")), s, "left")
    return pairs.filter("ar IS NULL OR br IS NULL OR ar <> br").select("a", "b")


def jaccard_groups(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD, different: int = DIFFERENT, prints: DataFrame | None = None
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set has its distinct word shingles, A-Z in lower case; fewer words are one
    shingle, null and wordless texts have an empty set and are linked with nothing. Two
    documents are linked if their sets' similarity is at least ``similarity``; component_id
    is the smallest doc_id that links reach, the document's own included. ``crowd`` and
    ``different`` say how links are found, never which. With ``prints`` (doc_id, fp), pairs of
    close SimHash fingerprints are compared first, and what they link is not compared again. Rows with a null doc_id belong to
    components but name none, unless all their members have none. Repeated rows come back as
    often as they stand; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    p, q = Fraction(str(similarity)).as_integer_ratio()
    levels = spark.sparkContext.broadcast(_levels(docs, shingle))  # bounded by the number of cells
    docs_sets = _sets(docs, shingle, levels, p, q).withColumn("sig2", F.xxhash64("bits"))
    docs_sets = materialize(docs_sets.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("short")), "jaccard-prefixes")
    # A row for each set: parts of its documents first, so that no task gets all of a hot one's.
    parts = materialize(docs_sets.groupBy(*KEY, "part").agg(F.min("doc_id").alias("first_id")), "jaccard-parts-of-sets")
    firsts = parts.groupBy(*KEY).agg(F.min("first_id").alias("first_id"))
    whole = docs_sets.filter("n > 0").groupBy(*KEY).agg(F.any_value("bits").alias("bits"), F.any_value("set").alias("prefix"))
    nodes = materialize(whole.join(firsts, KEY).withColumn("k", F.monotonically_increasing_id()), "jaccard-nodes")
    rows = nodes.select("k", "n", F.posexplode("prefix").alias("at", "token"))
    lists = materialize(rows.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"), "jaccard-lists")
    pairs = _skip_join(rows.join(lists.filter(F.col("size") <= crowd).select("token"), "token"), p, q)
    pairs = [materialize(_close(pairs, nodes, p, q), "jaccard-close")]
    hot = materialize(rows.select("token", "k", "n").join(lists.filter(F.col("size") > crowd).select("token"), "token"), "jaccard-hot")
    # The whole sets of what is still in question, rare shingles first.
    near = []
    if prints is not None:
        of = nodes.select("k", "first_id").join(prints, F.col("first_id") == F.col("doc_id")).select("k", "fp")
        near = [materialize(_close(candidates(of), nodes, p, q), "jaccard-near")]
    met = hot.select("k")
    for x in pairs + near:
        met = met.unionByName(x.select(F.col("a").alias("k"))).unionByName(x.select(F.col("b").alias("k")))
    met = met.distinct()
    met = materialize(nodes.select(*KEY, "first_id", "k").join(met, "k"), "jaccard-met")
    ids = met.select(F.col("first_id").alias("m_id")).distinct()
    some = docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["m_id"]), "left_semi")
    sets = _sets(some, shingle, levels, 0, 1).withColumn("sig2", F.xxhash64("bits")).select(*KEY, "set")
    sets = materialize(sets.join(met.select(*KEY, "k"), KEY).groupBy("k", "n").agg(F.any_value("set").alias("set")), "jaccard-sets")
    # Long lists that have a set in common make one crowd.
    edges = hot.select(F.col("k").alias("a"), F.col("token").alias("b"))
    crowds = hot.select("k").distinct().join(components(edges), F.col("k") == F.col("node")).select(F.col("root").alias("g"), "k")
    links, more = _crowds(crowds.join(sets, "k"), p, q, different)
    pairs += [materialize(_close(m, nodes, p, q), "jaccard-close") for m in more]
    levels.destroy()  # what it was for is written
    ask = pairs[0]
    for x in pairs[1:]:
        ask = ask.unionByName(x)
    if near:
        links.append(materialize(_alike(near[0], sets, p, q), "jaccard-near-links"))
        ask = _unknown(ask, links[-1])
    linked = _alike(ask, sets, p, q)
    for x in links:
        linked = linked.unionByName(x)
    joined = components(linked)
    named = nodes.select(*KEY, "k", "first_id").join(joined, F.col("k") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k"))
    named = materialize(named.drop("node"), "jaccard-roots")
    of_set = with_group(named, ["root"], F.col("k"), component_id="first_id").select(*KEY, "component_id")
    of_part = parts.select(*KEY, "part").join(of_set, KEY)
    with_set = docs_sets.filter("n > 0").select("doc_id", *KEY, "part").join(of_part, [*KEY, "part"])
    without = docs_sets.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_set.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(without)


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """The documents that stay when near copies go, with their own columns: of each group of jaccard_groups() the smallest id.

    Groups are what links connect, so a chain of copies is one group. Null and wordless
    texts have no near copies and stay. Rows with equal ids, and those with a null id, stay
    or go together: null ids stay if some group has no other.
    """
    groups = materialize(jaccard_groups(docs, shingle, similarity, **how), "near-groups")
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("k_id")).distinct()
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["k_id"]), "left_semi")
