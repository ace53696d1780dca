"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

Features are hashed character n-grams of the lower-cased text, present or not. Each is
scaled by its log-count ratio r = log((p + 1) / |p|) - log((q + 1) / |q|), p and q being
in how many toxic and other training documents it is; a logistic regression is fitted on
the scaled features. Those that are rare, or about as frequent in both classes, are left
out. Training takes at most PER_CLASS labelled documents of each class, chosen by a hash
of their ids: that bounds the model and what the driver sees. The fitted bias is then moved
by the log-odds of all labels against those taken. Every text is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

ORDERS = (4, 5)
BITS = 20
PER_CLASS = 6000
MIN_DOCS = 4
MIN_RATIO = 1.5
#: Tasks of the training; each sends the driver 12 bytes a feature at most.
PARTS = 6
#: Texts worked on at a time, and characters hashed at a time.
ROWS = 128
CHUNK = 1 << 20


def ngram_slots(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number, feature) of every n-gram, in chunks; repeats included.

    Runs of white space count as one space, and one stands at both ends. A chunk overlaps
    the next by the longest n-gram less one, so no n-gram is lost; those at a seam that
    both have are repeats like any other.
    """
    units, owner = [], []

    def hashed():
        c = np.concatenate(units)
        d = np.repeat(np.array([o for o, _ in owner], np.int64), [n for _, n in owner])
        x = (c + np.uint32(1)) * np.uint32(2654435761)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            m = len(c) - n + 1
            if m <= 0:
                return
            h = h[:m] * np.uint32(16777619) ^ x[n - 1 : n - 1 + m]
            if n in ORDERS:
                same = d[:m] == d[n - 1 :]
                g = h ^ (h >> np.uint32(15))
                g = g * np.uint32(2246822519) + np.uint32(n)
                g ^= g >> np.uint32(13)
                yield d[:m][same], (g >> np.uint32(32 - BITS))[same]

    held = 0
    for i, t in enumerate(texts):
        padded = f" {' '.join((t or '').lower().split())} "
        c = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        for at in range(0, len(c), CHUNK):
            part = c[max(0, at - max(ORDERS) + 1) : at + CHUNK]
            units.append(part)
            owner.append((i, len(part)))
            held += len(part)
            if held >= CHUNK:
                yield from hashed()
                units, owner, held = [], [], 0
    if units:
        yield from hashed()


def present(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document number, feature) pairs; with ``wanted`` only features that it marks."""
    keys = [np.zeros(0, np.int64)]
    for d, s in ngram_slots(texts):
        if wanted is not None:
            on = wanted[s]
            d, s = d[on], s[on]
        keys.append(np.unique(d << BITS | s))
    k = np.unique(np.concatenate(keys))
    return k >> BITS, k & ((1 << BITS) - 1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that memory is bound by a few texts and not by Spark's batches."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


class Model:
    """Weights by feature; score is the probability of label 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.wanted = weights.astype(np.float32), bias, weights != 0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        d, s = present(texts, self.wanted)
        z = np.bincount(d, self.weights[s].astype(np.float64), minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(cuts: np.ndarray, features: np.ndarray, y: np.ndarray, ratio: np.ndarray, l2: float = 1.0, rounds: int = 300):
    """Logistic regression on presence times ratio, by accelerated gradient steps.

    ``cuts`` has where each document's features begin, and their end. Documents are worked
    through in stretches of about CHUNK features, so that the driver holds the features
    once, in 32 bits, and little beside them if the caller keeps no name for ``features``.
    """
    n = len(y)
    ends = np.unique(np.append(np.searchsorted(cuts, np.arange(CHUNK, cuts[-1], CHUNK)), n))
    stretches = [(a, b) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True) if b > a]
    present_in = np.zeros(1 << BITS, bool)
    for a, b in stretches:
        present_in[features[cuts[a] : cuts[b]]] = True
    used = np.flatnonzero(present_in)
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    f = np.empty(len(features), np.int32)
    for a, b in stretches:
        f[cuts[a] : cuts[b]] = place[features[cuts[a] : cuts[b]]]
    del features
    r, m = ratio[used], len(used)

    def scores(w: np.ndarray) -> np.ndarray:
        wr, out = w * r, np.zeros(n)
        for a, b in stretches:
            rows = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
            out[a:b] = np.bincount(rows, wr[f[cuts[a] : cuts[b]]], minlength=b - a)
        return out

    def gathered(e: np.ndarray) -> np.ndarray:
        out = np.zeros(m)
        for a, b in stretches:
            out += np.bincount(f[cuts[a] : cuts[b]], np.repeat(e[a:b], np.diff(cuts[a : b + 1])), minlength=m)
        return out * r

    w, b, last_w, last_b = np.zeros(m), 0.0, np.zeros(m), 0.0
    # A step by the largest eigenvalue of the squared features, found by power iteration.
    u = np.ones(m) / max(1, m) ** 0.5
    top = 1.0
    for _ in range(12):
        u = gathered(scores(u))
        top = float(np.linalg.norm(u)) or 1.0
        u = u / top
    step = 1 / (0.25 * (top + n) + l2)
    for k in range(rounds):
        go = k / (k + 3)
        yw, yb = w + go * (w - last_w), b + go * (b - last_b)
        e = 1 / (1 + np.exp(-np.clip(scores(yw) + yb, -500, 500))) - y
        last_w, last_b = w, b
        w = yw - step * (gathered(e) + l2 * yw)
        b = yb - step * float(e.sum())
    out = np.zeros(1 << BITS)
    out[used] = w * r
    return out, b


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """All parts in one; the list is emptied, so that the parts can go."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def labelled(labels: DataFrame) -> DataFrame:
    """Labelled ids outside the held-out fifth: l_id, toxic."""
    return (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .filter(~held_out("l_id"))
    )


def training_rows(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` labelled ids of each class: l_id, toxic."""
    said = labelled(labels)
    pick = lambda k: said.filter(F.col("toxic") == k).orderBy(F.xxhash64("l_id"), "l_id").limit(per_class)
    return pick(1).unionByName(pick(0))


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled documents outside the held-out fifth.

    Without labelled documents every score is next to 0; with one class only, it is that class's
    share. Of several labels of an id the highest counts.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = training_rows(labels, per_class).collect()  # at most 2 * per_class pairs of numbers
    if not chosen:
        return Model(np.zeros(1 << BITS), -500.0)
    every = {r["toxic"]: r["count"] for r in labelled(labels).groupBy("toxic").count().collect()}
    taken = Counter(r["toxic"] for r in chosen)
    shift = sum((1 if k == 1 else -1) * float(np.log(every[k] / n)) for k, n in taken.items())
    few = spark.createDataFrame([(r["l_id"], r["toxic"]) for r in chosen], "l_id long, toxic int")
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(few), F.col("doc_id") == F.col("l_id"))  # bounded by per_class
        .select("toxic", "text")
        .repartition(PARTS)
        .persist()
    )

    def counted(batches):
        by_class, docs_in = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for b in _slices(batches):
            y = b.column(0).to_numpy()
            d, s = present(b.column(1).to_pylist())
            for k in (0, 1):
                np.add.at(by_class[k], s[y[d] == k], 1)
                docs_in[k] += int((y == k).sum())
        at = np.flatnonzero(by_class.sum(axis=0))
        yield pa.record_batch(
            [pa.array([x], pa.binary()) for x in (at.astype("<i4").tobytes(), by_class[0, at].tobytes(), by_class[1, at].tobytes())]
            + [pa.array([n], pa.int64()) for n in docs_in],
            names=["at", "others", "toxic", "n_others", "n_toxic"],
        )

    q, p, n = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(2)
    for r in texts.mapInArrow(counted, "at binary, others binary, toxic binary, n_others long, n_toxic long").collect():
        at = np.frombuffer(r["at"], "<i4")
        q[at] += np.frombuffer(r["others"], "<i4")
        p[at] += np.frombuffer(r["toxic"], "<i4")
        n += (r["n_others"], r["n_toxic"])
    if not n.all():
        texts.unpersist()
        return Model(np.zeros(1 << BITS), 500.0 if n[1] else -500.0)
    ratio = np.log((p + 1) / (n[1] + 1)) - np.log((q + 1) / (n[0] + 1))
    wanted = (p + q >= MIN_DOCS) & (np.abs(ratio) >= MIN_RATIO)
    mask = spark.sparkContext.broadcast(np.packbits(wanted))

    def selected(batches):
        on = np.unpackbits(mask.value).astype(bool)
        for b in _slices(batches):
            texts_in = b.column(1).to_pylist()
            d, s = present(texts_in, on)
            cuts = np.searchsorted(d, np.arange(1, len(texts_in)))
            yield pa.record_batch([b.column(0), pa.array([x.astype("<i4").tobytes() for x in np.split(s, cuts)], pa.binary())], names=["toxic", "features"])

    y, parts = [], []
    for r in texts.mapInArrow(selected, "toxic int, features binary").collect():
        y.append(r["toxic"])
        parts.append(np.frombuffer(r["features"], "<i4"))
    texts.unpersist()
    mask.destroy()
    cuts = np.cumsum([0, *map(len, parts)])
    if not cuts[-1]:
        return Model(np.zeros(1 << BITS), float(np.log(n[1] / n[0])) + shift)
    weights, bias = fit(cuts, _joined(parts), np.array(y, float), ratio)
    return Model(weights, bias + shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other (they have no n-gram but white space).
    A null doc_id is not held out. Repeated rows are scored each; empty tables give no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    def scored(batches):
        m = Model(*shared.value)
        for b in _slices(batches):
            yield pa.record_batch([b.column(0), pa.array(m.scores(b.column(1).to_pylist()))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scored, "doc_id long, score double"
    )
    return out.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not call toxic, with their own columns.

    Texts are scored and filtered in the same pass, so nothing is joined back.
    """
    spark = docs.sparkSession
    model = train(docs, labels)
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index("text")

    def clean(batches):
        m = Model(*shared.value)
        for b in _slices(batches):
            s = m.scores([None if t is None else str(t) for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(s < 0.5)).columns, schema=b.schema)

    return docs.mapInArrow(clean, docs.schema)
