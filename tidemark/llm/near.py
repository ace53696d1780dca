"""What near-duplicate joins of shingle sets share: the sets, their order, bitmaps of them.

Two texts are alike if the Jaccard similarity of their sets of word shingles reaches a
bound p/q. With all sets in one order, sets of n and m that are alike have a shingle in
common among their first n - ceil(pn/q) + 1 and m - ceil(pm/q) + 1. So only these
prefixes need to meet. The order puts common shingles last, by counts over all texts in a
table of cells of a fixed size; it decides how many meet, never what is found.

A set's bitmap has, for each of n to 2n slots, whether an odd number of shingles falls
there. Sets that differ in d shingles have bitmaps that differ in d bits at most, so what
differs in more than alike sets can needs no comparison of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize
from .simhash import SEED, shingles

SHINGLE = 5
#: Shingles are counted by cells, which are their first bits; cells go in blocks, as many at once as a task may hold.
CELL_BITS = 23
BLOCK = 1 << 16
CELLS_AT_ONCE = 1 << 21
ROWS = 256


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; none if it has no word."""
    parts = [np.unique(h) for h in shingles(text, size)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def _levels(docs: DataFrame, shingle: int) -> np.ndarray:
    """For each cell, by how many sets have a shingle there: the count's root less the least one, in eighths, 255 at most.

    What falls into a cell by chance scatters about as the root of what is expected there, so
    that a step means as much at any size of the corpus. All texts are counted; memory,
    and what goes through the driver, is bounded by the number of cells.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = [], 0
        for b in batches:
            for t in b.column(0):
                cells.append((shingle_set(t.as_py(), shingle) >> np.uint64(64 - CELL_BITS)).astype("<u4"))
                n += len(cells[-1])
                if n >= CELLS_AT_ONCE:
                    yield _blocks(cells)
                    cells, n = [], 0
        if n:
            yield _blocks(cells)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for block, low in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = np.bincount(np.frombuffer(low.as_buffer(), "<u2"), minlength=BLOCK)
                counts[block] = counts[block] + found if block in counts else found
        for block, n in counts.items():
            level = np.rint(8 * np.sqrt(n)).astype("<u4")
            columns = [pa.array([block], pa.int32()), pa.array([int(level.min())], pa.int64()), pa.array([level.tobytes()])]
            yield pa.record_batch(columns, names=["block", "least", "level"])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, level in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                low = np.minimum(np.frombuffer(level.as_buffer(), "<u4") - np.uint32(least), 255).astype(np.uint8)
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([low.tobytes()])], names=["block", "level"])

    kind = "block int, level binary"
    cells = docs.select(F.col("text").cast("string")).mapInArrow(dealt, kind).repartition("block")
    found = materialize(cells.mapInArrow(summed, "block int, least long, level binary"), "near-cells")
    blocks = (1 << CELL_BITS) // BLOCK
    seen, least = found.agg(F.count("*"), F.coalesce(F.min("least"), F.lit(0))).first()
    least = least if seen == blocks else 0
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for r in found.select("block", "level").mapInArrow(narrow, kind).collect():  # bounded by the number of cells
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["level"], np.uint8)
    discard(docs.sparkSession, found)
    return out


def _blocks(cells: list[np.ndarray]) -> pa.RecordBatch:
    """Numbers of cells by block, each as its place in the block."""
    every = np.sort(np.concatenate(cells))
    ends = np.searchsorted(every, np.arange(1, (1 << CELL_BITS) // BLOCK) * BLOCK)
    parts = [(i, x) for i, x in enumerate(np.split(every, ends)) if len(x)]
    low = pa.array([(x % BLOCK).astype("<u2").tobytes() for _, x in parts], pa.binary())
    return pa.record_batch([pa.array([i for i, _ in parts], pa.int32()), low], names=["block", "level"])


def parity(s: np.ndarray) -> np.ndarray:
    """A set's bitmap: for each of a power of two of slots (n to 2n, 64 at least) the parity of what falls there."""
    slots = max(64, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view("i8")))


def _sets(docs: DataFrame, shingle: int, levels: Broadcast | None = None, p: int = 0, q: int = 1) -> DataFrame:
    """doc_id, sig (the same for equal sets), n, bits, set; with ``levels`` of cells the set's prefix, rare shingles first."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        level = levels.value if levels else None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                sigs, sizes, sets, bits = [], [], [], []
                for t in part.column(1):
                    s = shingle_set(t.as_py(), shingle)
                    sigs.append(xxh64_intdigest(s.tobytes(), SEED))
                    sizes.append(len(s))
                    bits.append(parity(s))
                    if level is not None:
                        s = s[np.lexsort((s, level[s >> np.uint64(64 - CELL_BITS)]))]
                        s = s[: len(s) + (-p * len(s)) // q + 1]
                    sets.append(s)
                columns = [part.column(0), pa.array(np.array(sigs, "u8").view("i8")), pa.array(sizes, pa.int32()), _lists(bits), _lists(sets)]
                yield pa.record_batch(columns, names=["doc_id", "sig", "n", "bits", "set"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        listed, "doc_id long, sig long, n int, bits array<long>, set array<long>"
    )


def _close(pairs: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """Those of the pairs whose sizes and bitmaps allow them to be alike."""
    met = pairs.select("a", "b").distinct()
    for s in "ab":
        met = met.join(nodes.select(F.col("k").alias(s), F.col("n").cast("long").alias(s + "n"), F.col("bits").alias(s + "bits")), s)
    met = met.filter(q * F.least("an", "bn") >= p * F.greatest("an", "bn"))
    xor = lambda x, y: x.bitwiseXOR(y)
    # Sizes within a factor of two: bitmaps are of one width, or one folds once onto the other's.
    half = lambda c: F.zip_with(F.slice(c, 1, F.size(c) / 2), F.slice(c, F.size(c) / 2 + 1, F.size(c) / 2), xor)
    fitted = lambda c, other: F.when(F.size(c) > F.size(other), half(c)).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(fitted("abits", "bbits"), fitted("bbits", "abits"), xor), F.lit(0), lambda n, x: n + F.bit_count(x))
    return met.filter((p + q) * apart.cast("long") <= (q - p) * (F.col("an") + F.col("bn"))).select("a", "b")
