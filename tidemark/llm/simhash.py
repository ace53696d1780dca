"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has the bits that are set in over half of a text's shingle hashes. Equal
fingerprints fold into one row first, however many documents have them. Then each of
2^(r+1) - 1 bit masks keeps the bits whose random nonzero (r+1)-bit label is odd against
the mask's vector; whatever r bits two fingerprints differ in, some mask keeps none of
them, so the pair meets in that mask's table. Tables hold (mask, kept bits) keys.

A key with two fingerprints is a pair, compared bit by bit. A key with more is split by a
second covering of the bits that its mask leaves out, which again loses no pair. Where
even then more than two share a key, over 50 bits are the same: such crowds (thousands of
copies that differ in a word) would need all their pairs. Their fingerprints are linked
through the points of their radius-1 balls instead: two fingerprints differ in at most 2
bits if and only if their balls meet, and all that have a point in common are within 2 of
each other. A star on each point's smallest member then links exactly what all pairs
would, with 65 rows a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import repeats_ids
from .graph import components
from .shared import SALTS, materialize, ship, with_group

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Shingles hashed and counted at a time, so that a long text takes bounded memory.
CHUNK = 1 << 14


def shingles(text: str | None, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, up to CHUNK at a time; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know ASCII only: A-Z and the six white-space bytes.
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return
    size = min(size, len(w))
    n = len(w) - size + 1
    for at in range(0, n, CHUNK):
        part = w[at : min(at + CHUNK, n) + size - 1]
        grams = zip(*[part[k:] for k in range(size)], strict=False)
        yield np.array([xxh64_intdigest(g, SEED) for g in map(b" ".join, grams)], dtype="<u8")


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text; 0 if it has no word."""
    n, counts = 0, np.zeros(64, dtype=np.int64)
    for h in shingles(text):
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype="u8").view("i8")
        yield pa.record_batch([b.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def covering_masks(radius: int = RADIUS, seed: int = 7, within: int = (1 << 64) - 1) -> list[int]:
    """Masks of bits ``within`` such that any ``radius`` bits or fewer are all left out by one of them.

    Labels are dealt evenly, so that all masks keep about as many bits.
    """
    import random

    bits = [i for i in range(64) if within >> i & 1]
    random.Random(seed).shuffle(bits)
    size = 1 << (radius + 1)
    labels = {bit: 1 + k % (size - 1) for k, bit in enumerate(bits)}
    return [sum(1 << i for i in bits if bin(labels[i] & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _met(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (fp, t, key): linked pairs from keys with two fingerprints, and the rows of keys with more."""
    sized = materialize(with_group(keyed, ["t", "key"], F.col("fp"), counted="n", a="fp"), "simhash-buckets").filter("n > 1")
    pairs = sized.filter("n = 2 AND fp <> a").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= RADIUS)
    return pairs.select("a", F.col("fp").alias("b")), sized.filter("n > 2").select("fp", "t", "key")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that join what is linked: prints has distinct fingerprints ``fp``.

    Every pair within RADIUS bits is joined, directly or through a third fingerprint that
    is within RADIUS of both; no other pair is. Works for a radius of 2.
    """
    first = covering_masks()
    masks = F.array(*[F.lit(_signed(m)) for m in first])
    pairs, crowded = _met(
        prints.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    )
    # A second mask adds bits to the first one's: both leave out whatever RADIUS bits differ.
    second = [[m | s for s in covering_masks(seed=11, within=~m & (1 << 64) - 1)] for m in first]
    finer = F.array(*[F.array(*[F.lit(_signed(x)) for x in row]) for row in second])
    few, many = _met(
        crowded.select("fp", "t", F.posexplode(F.get(finer, F.col("t"))).alias("s", "mask")).select(
            "fp", (F.col("t") * len(first) + F.col("s")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")
        )
    )
    steps = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    balls = many.select("fp").distinct().select("fp", F.explode(steps).alias("s")).select("fp", F.col("fp").bitwiseXOR(F.col("s")).alias("point"))
    centres = balls.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("point", "a")
    stars = balls.join(centres, "point").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(few).unionByName(stars).distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints within 2 bits are linked, and component_id is the smallest doc_id that
    links reach. Null and wordless texts have fingerprint zero and are linked like any
    other. Rows with a null doc_id belong to components but never name one, unless all
    their members have none. Repeated rows are returned as often as they stand; empty
    tables give no rows; other columns are ignored.
    """
    prints = materialize(fingerprints(docs), "simhash")
    # Parts of the documents of a fingerprint, so that no task gets all of a hot one's.
    salted = prints.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("short"))
    parts = materialize(salted.groupBy("fp", "part").agg(F.min("doc_id").alias("first_id")), "simhash-parts")
    distinct = materialize(parts.groupBy("fp").agg(F.min("first_id").alias("first_id")), "simhash-distinct")
    joined = components(links(distinct.select("fp")))
    named = distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    of_print = with_group(materialize(named, "simhash-roots"), ["root"], F.col("fp"), component_id="first_id").select("fp", "component_id")
    of_part = parts.select("fp", "part").join(of_print, "fp")
    return salted.join(of_part, ["fp", "part"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def candidates(prints: DataFrame) -> DataFrame:
    """Pairs (a < b) of the ids k of rows (k, fp) that fingerprints link, directly or through others.

    Rows with one fingerprint are paired with the smallest of them, and those smallest ones
    as links() says.
    """
    grouped = materialize(with_group(prints, ["fp"], F.col("k"), first="k"), "simhash-firsts")
    same = grouped.filter("k <> first").select(F.col("first").alias("a"), F.col("k").alias("b"))
    firsts = grouped.filter("k = first").select("fp", "k")
    apart = links(firsts.select("fp"))
    for s in "ab":
        apart = apart.join(firsts.select(F.col("fp").alias(s), F.col("k").alias(s + "k")), s)
    apart = apart.select(F.least("ak", "bk").alias("a"), F.greatest("ak", "bk").alias("b"))
    return same.unionByName(apart).distinct()


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, a number of its own for each row in the order of (id, text) with null ids last; text; row, the whole of it.

    Splitters of the sort have a fixed width, and the hash of the text lets them fall inside a hot id.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = [F.col("doc_id").cast("long").asc_nulls_last(), F.sha2(F.col("text").cast("string"), 256)] + ([F.xxhash64(*rest)] if rest else [])
    rows = docs.orderBy(*order).select(F.monotonically_increasing_id().alias("doc_id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return materialize(rows, "simhash-rows").select("doc_id", F.col("row.text").alias("text"), "row")


def drop_near(docs: DataFrame) -> DataFrame:
    """The documents that stay when near copies go; see jaccard_join.drop_similar().

    Fingerprints within 2 bits name the pairs that are compared first, text against text.
    They see close copies only: texts with a similarity of 0.8 are mostly further apart than
    any radius that tables of masks can cover. So the join finds what links they leave.
    Where rows share an id, or several have none, each row is judged on its own: of a group
    the smallest id stays (null last), and of its rows the first in the order of the texts' hashes.
    """
    from .jaccard_join import drop_similar

    rows = _numbered(docs) if repeats_ids(docs) else docs
    kept = drop_similar(rows, prints=materialize(fingerprints(rows), "simhash"))
    return kept if rows is docs else kept.select("row.*")
