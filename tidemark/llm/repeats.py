"""Removal of repeated passages through run-length indexes.

A byte goes if a K-byte string that covers it also starts in a document with a smaller
id. An index of the whole corpus fits no machine, so the K-byte windows are dealt out by
content: each belongs to its minimizer, the GRAM-byte string in it whose hash is least.
Equal windows have equal minimizers. Consecutive windows with one minimizer make a piece
of K to K + WINDOWS - 1 bytes, so every window is in exactly one piece.

1. Documents are written once to the shared folder, in chunks of about CHUNK bytes. Texts
   that a smaller id has as a whole are known by their digests from then on: all of such a
   text is a repeat, and it tells the others nothing, so it stays out of steps 2 to 4.
2. Each chunk lists its minimizers; those that only one document of the corpus has can't
   be part of a repeat. The lists are dealt by hash and each tells its chunks the rest.
3. Each chunk sends its distinct pieces with those minimizers, each with its least
   document id, to their minimizer's bucket.
4. A bucket folds equal pieces and builds run-length indexes of at most INDEXED bytes over
   all distinct ones, in the order of their minimizers. Each piece is streamed through
   every index that holds pieces of its minimizer, its own or the next, and the matching
   statistics tell the least document that has each of its windows.
5. Each chunk gets that back for its pieces, as marks of the windows that a document
   before its own has, and cuts its documents.

The two foldings (whole texts, pieces) compress what the indexes are built of; the index
judges every window that is left, and what folded has the windows of what it folded with.
A minimizer that has more than HOT pieces in the corpus (the seams of a very common
passage) would give one bucket all of them; its windows are dealt out one by one, by their
own hash, and then indexed and streamed like any other piece.

Buckets are made for BUCKET bytes of text each, and a task works through many, one at a
time: the number of tasks follows the session's shuffle partitions, or the bytes at TASK
bytes each where that is more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .run_index import RunIndex
from .shared import discard, materialize, scratch, ship, with_group

K = 50
GRAM = 20
WINDOWS = K - GRAM + 1
CHUNK = 4 << 20
#: Bytes of text to a bucket, and to a task at most.
BUCKET, TASK = 8 << 20, 128 << 20
#: Pieces of a minimizer that are dealt together.
HOT = 20_000
#: Bytes in one run-length index. Building takes about 100 bytes of memory for each.
INDEXED = 2 << 20
#: Pieces streamed through an index at a time.
STREAMED = 1 << 14
#: Positions hashed at a time, and the bits that number them.
SEGMENT, PLACE = 1 << 18, np.uint64(19)
#: Stands for a null id: larger than any.
NO_ID = (1 << 63) - 1

_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    h1 = _RANDOM[b]
    p = _P
    with np.errstate(over="ignore"):
        h2 = h1[:-1] * p + h1[1:]
        p2 = p * p
        h4 = h2[:-2] * p2 + h2[2:]
        p4 = p2 * p2
        h8 = h4[:-4] * p4 + h4[4:]
        p8 = p4 * p4
        h16 = h8[:-8] * p8 + h8[8:]
        h = h16[: len(b) - GRAM + 1] * p4 + h4[16 : len(b) - GRAM + 17]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, out = 1, key
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def pieces_of(data: np.ndarray, ends: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer hash) of each piece of concatenated texts.

    ends has where each text ends; no window spans two. Texts whose numbers are in skip
    have no windows.
    """
    starts, counts, hashes = [], [], []
    if len(data) >= K:
        valid = np.ones(len(data), bool)
        for e, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True):
            valid[e - min(n, K - 1) : e] = False
        for i in () if skip is None else skip.tolist():
            valid[ends[i - 1] if i else 0 : ends[i]] = False
        valid = valid[: len(data) - K + 1]
        for at in range(0, len(valid), SEGMENT):
            ok = valid[at : at + SEGMENT]
            h = _gram_hashes(data[at : at + len(ok) + K - 1])
            key = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
            place = (_least(key, WINDOWS) & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
            new = ok.copy()
            new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
            first = np.flatnonzero(new)
            if len(first):
                # A piece ends where the next begins or windows are no longer valid.
                total = np.concatenate(([0], np.cumsum(ok)))
                counts.append(total[np.append(first[1:], len(ok))] - total[first])
                starts.append(first + at)
                hashes.append(h[place[first]])
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(starts, np.int64), join(counts, np.int64), join(hashes, np.uint64)


class Chunk:
    """A chunk's documents: ids and their texts' bytes, end to end."""

    def __init__(self, path: str):
        table = pa.ipc.open_file(files.reader(path)).read_all().combine_chunks()
        self.ids = table.column(0)
        text = table.column(1).chunk(0) if table.num_rows else pa.array([], pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        raw = text.buffers()[2] if len(text) else None
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.ends = (offsets - offsets[0])[1:]
        self.order = np.array([NO_ID if i is None else i for i in self.ids.to_pylist()], np.int64)


def _write_arrow(path: str, attempt: str, columns: dict) -> None:
    with files.replacing(path, attempt) as out:
        batch = pa.record_batch(list(columns.values()), names=list(columns))
        with pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_batch(batch)


def _chunked(docs: DataFrame, path: str) -> DataFrame:
    """Write the documents in chunks; one row per document: chunk, place, rank (its id), digest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt = files.attempt()
        ids, texts, held, number = [], [], 0, 0

        def put():
            chunk = task << 20 | number
            _write_arrow(f"{path}/{chunk}.arrow", attempt, {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
            digests = [hashlib.blake2b(t, digest_size=16).digest() if len(t) >= K else None for t in texts]
            ranks = [NO_ID if i is None else i for i in ids]
            return pa.record_batch(
                [pa.array([chunk] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ranks, pa.int64()), pa.array(digests, pa.binary())],
                names=["chunk", "place", "rank", "digest"],
            )

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= CHUNK:
                    yield put()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield put()

    return materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            write, "chunk long, place int, rank long, digest binary"
        ),
        "chunks",
    )


def _with_later_copies(rows: DataFrame) -> DataFrame:
    """A row per chunk (key, other = -1, blob): the places of texts that a smaller id has as a whole."""
    known = with_group(rows.filter("digest IS NOT NULL"), ["digest"], F.struct("chunk", "place"), least="rank")
    later = known.filter("rank > least")
    places = later.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda x: x.cast("string")), ",").alias("places"))
    return rows.select("chunk").distinct().join(places, "chunk", "left").select(
        F.col("chunk").alias("key"), F.lit(-1).cast("long").alias("other"), F.encode(F.coalesce("places", F.lit("")), "utf-8").alias("blob")
    )


def _skipped(blob: bytes) -> np.ndarray:
    return np.array([int(x) for x in blob.split(b",") if x], np.int64)


def _packed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of one length, by bytes of equal weight, and a tail, compressed."""
    parts = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    raw = b"".join([len(arrays[0]).to_bytes(4, "little"), *parts, tail])
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    raw = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), "zstd", asbytes=True)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for k in map(np.dtype, kinds):
        planes = np.frombuffer(raw, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * k.itemsize
    return out, raw[at:]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows (key, other, blob) that are sorted by key, key by key."""
    now, rows = None, []
    for b in batches:
        for k, o, blob in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
            if k != now:
                if rows:
                    yield now, rows
                now, rows = k, []
            rows.append((o, blob))
    if rows:
        yield now, rows


def _rows(found: list[tuple[int, int, bytes]], names: list[str]) -> pa.RecordBatch:
    a, b, blob = zip(*found, strict=True) if found else ((), (), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(blob, pa.binary())], names=names)


_ROW = "key long, other long, blob binary"
_NAMES = ["key", "other", "blob"]
#: What blobs hold: minimizers as steps of their sorted hashes, with how many documents (2: or more)
#: and pieces; the wanted ones, with whether they are hot; pieces as (hash, step of their numbers,
#: length, least id) and their bytes; marks, a bit for each window.
_LISTED, _WANTED, _PIECES, _MARKS = ("<u4", "u1", "<u4"), ("<u4", "u1"), ("<u4", "<u4", "u1", "<i8"), ("<u4", "<u4")


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """An even deal: minimizers have small hashes, so these are hashed once more."""
    with np.errstate(over="ignore"):
        m = h * np.uint64(0xFF51AFD7ED558CCD)
        m ^= m >> np.uint64(33)
        m *= np.uint64(0xC4CEB9FE1A85EC53)
    return ((m >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64).astype(np.uint32)


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def cut_repeats(docs: DataFrame, hot: int = HOT, indexed: int = INDEXED) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    Texts are taken as UTF-8; null counts as empty. Texts of fewer than K bytes lose
    nothing, and neither do the rows of the smallest id that has a string. Rows with one
    id don't count as earlier than each other; a null id is later than any other.
    Repeated rows are returned each; empty tables give no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    path = scratch(spark, "repeats")
    written = _chunked(docs, path)
    every = materialize(_with_later_copies(written), "chunk-copies")
    discard(spark, written)
    size = every.count() * CHUNK
    buckets = max(1, -(-size // BUCKET))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))

    def listed(batches):
        for b in batches:
            for chunk, _, copies in zip(*(x.to_pylist() for x in b.columns), strict=True):
                c = Chunk(f"{path}/{chunk}.arrow")
                first, _, h = pieces_of(c.data, c.ends, _skipped(copies))
                doc = np.searchsorted(c.ends, first, side="right")
                pair = np.lexsort((doc, h))
                h, doc = h[pair], doc[pair]
                new_h = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
                new_pair = new_h.copy()
                new_pair[1:] |= doc[1:] != doc[:-1]
                at = np.flatnonzero(new_h)
                if not len(at):
                    continue
                docs_of = np.minimum(np.add.reduceat(new_pair.astype(np.int64), at), 2).astype(np.uint8)
                pieces = np.diff(np.append(at, len(h))).astype(np.uint32)
                low, out = _low(h[at]), []
                for k, i in _split(_bucket(h[at], buckets)):
                    i = i[np.argsort(low[i], kind="stable")]
                    out.append((k, chunk, _packed(_steps(low[i]), docs_of[i], pieces[i])))
                yield _rows(out, _NAMES)

    def repeated(batches):
        for bucket, rows in _by_key(batches):
            lows, docs_of, pieces = [], [], []
            for _, blob in rows:
                (steps, d, p), _ = _unpacked(blob, *_LISTED)
                lows.append(_sums(steps))
                docs_of.append(d)
                pieces.append(p)
            _, back = np.unique(np.concatenate(lows), return_inverse=True)
            repeats, is_hot = np.bincount(back, np.concatenate(docs_of)) > 1, np.bincount(back, np.concatenate(pieces)) > hot
            out, at = [], 0
            for (chunk, _), low in zip(rows, lows, strict=True):
                i = back[at : at + len(low)]
                at += len(low)
                keep = repeats[i]
                if keep.any():
                    out.append((chunk, bucket, _packed(_steps(low[keep]), is_hot[i[keep]].astype(np.uint8))))
            if out:
                yield _rows(out, _NAMES)

    def sent(batches):
        _, attempt = files.attempt()
        for chunk, rows in _by_key(batches):
            c = Chunk(f"{path}/{chunk}.arrow")
            first, windows, h = pieces_of(c.data, c.ends, _skipped(next(x for o, x in rows if o < 0)))
            known, single = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for bucket, blob in rows:
                if bucket >= 0:
                    (steps, is_hot), _ = _unpacked(blob, *_WANTED)
                    known.append(np.uint64(bucket) << np.uint64(32) | _sums(steps).astype(np.uint64))
                    single.append(is_hot > 0)
            known, single = np.concatenate(known), np.concatenate(single)
            order = np.argsort(known)
            known, single = known[order], single[order]
            bucket = _bucket(h, buckets)
            mine = bucket.astype(np.uint64) << np.uint64(32) | _low(h).astype(np.uint64)
            at = np.searchsorted(known, mine)
            at[at == len(known)] = 0
            is_in = known[at] == mine if len(known) else np.zeros(len(mine), bool)
            first, windows, h, bucket, single = first[is_in], windows[is_in], h[is_in], bucket[is_in], single[at[is_in]] if len(known) else np.zeros(0, bool)
            if single.any():
                first, windows, h, bucket = _one_by_one(c.data, first, windows, h, bucket, single, buckets)
            doc = np.searchsorted(c.ends, first, side="right")
            data = c.data.tobytes()
            numbers: dict[bytes, int] = {}
            give = numbers.setdefault
            number = np.array([give(data[a : a + w + K - 1], len(numbers)) for a, w in zip(first.tolist(), windows.tolist(), strict=True)], np.int64)
            least = np.full(len(numbers), NO_ID, np.int64)
            np.minimum.at(least, number, c.order[doc])
            _write_arrow(
                f"{path}/{chunk}.pieces.arrow", attempt,
                {"first": pa.array(first, pa.int64()), "windows": pa.array(windows.astype(np.uint8)), "number": pa.array(number.astype(np.uint32)), "least": pa.array(least[number])},
            )
            if not numbers:
                continue
            texts = list(numbers)
            shown = np.empty(len(texts), np.int64)
            shown[number[::-1]] = np.arange(len(number))[::-1]  # one place where each stands
            low, length = _low(h[shown]), (windows[shown] + K - 1).astype(np.uint8)
            out = []
            for k, i in _split(bucket[shown]):
                out.append((k, chunk, _packed(low[i], _steps(i.astype(np.uint32)), length[i], least[i], tail=b"".join([texts[x] for x in i.tolist()]))))
                if len(out) >= 64:
                    yield _rows(out, _NAMES)
                    out = []
            if out:
                yield _rows(out, _NAMES)

    def marked(batches):
        for _, rows in _by_key(batches):
            numbers: dict[bytes, int] = {}
            parts, ids, lows = [], [], []
            for chunk, blob in rows:
                (low, steps, length, first_id), body = _unpacked(blob, *_PIECES)
                at, mine = 0, []
                for end in np.cumsum(length.astype(np.int64)).tolist():
                    mine.append(numbers.setdefault(body[at:end], len(numbers)))
                    at = end
                parts.append((chunk, _sums(steps), first_id, np.array(mine, np.int64)))
                ids.append(parts[-1][3])
                lows.append(low)
            of, lows = np.concatenate(ids), np.concatenate(lows)
            least = np.full(len(numbers), NO_ID, np.int64)
            np.minimum.at(least, of, np.concatenate([x for _, _, x, _ in parts]))
            low = np.empty(len(numbers), np.uint32)
            low[of] = lows
            earliest = _earliest(list(numbers), low, least, indexed)
            out = []
            for chunk, number, first_id, mine in parts:
                before = earliest[mine] < first_id[:, None]
                mark = (before * (np.uint32(1) << np.arange(WINDOWS, dtype=np.uint32))).sum(axis=1, dtype=np.uint32)
                on = mark > 0
                if on.any():
                    out.append((chunk, 0, _packed(_steps(number[on]), mark[on])))
            if out:
                yield _rows(out, _NAMES)

    def cut(batches):
        for chunk, rows in _by_key(batches):
            c = Chunk(f"{path}/{chunk}.arrow")
            p = pa.ipc.open_file(files.reader(f"{path}/{chunk}.pieces.arrow")).read_all()
            first, windows, number, least = (p.column(k).to_numpy() for k in ("first", "windows", "number", "least"))
            windows = windows.astype(np.int64)
            marks = np.zeros(int(number.max(initial=0)) + 1, np.uint32)
            copies = np.zeros(0, np.int64)
            for other, blob in rows:
                if other < 0:
                    copies = _skipped(blob)
                else:
                    (steps, mark), _ = _unpacked(blob, *_MARKS)
                    marks[_sums(steps)] |= mark
            mark = marks[number] if len(number) else np.zeros(0, np.uint32)
            doc = np.searchsorted(c.ends, first, side="right")
            # Where the chunk's first owner of a piece stands, the index has told; all later ones repeat it.
            whole = c.order[doc] > least
            starts = np.concatenate(([0], c.ends))
            change = np.zeros(len(c.data) + 1, np.int32)
            np.add.at(change, starts[copies], 1)
            np.add.at(change, starts[copies + 1], -1)
            np.add.at(change, first[whole], 1)
            np.add.at(change, first[whole] + windows[whole] + K - 1, -1)
            rest = np.flatnonzero(~whole & (mark > 0))
            for bit in range(WINDOWS):
                hit = first[rest[mark[rest] >> np.uint32(bit) & np.uint32(1) > 0]] + bit
                np.add.at(change, hit, 1)
                np.add.at(change, hit + K, -1)
            gone = np.cumsum(change[:-1]) > 0
            keep = c.data[~gone].tobytes()
            removed = np.concatenate(([0], np.cumsum(gone)))
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            inner = starts[:-1][(c.ends > starts[:-1])]
            rise[inner] = gone[inner]  # a run that goes on in the next document is two
            spans = np.concatenate(([0], np.cumsum(rise)))
            total = lambda x: x[starts[1:]] - x[starts[:-1]]
            n_removed = total(removed)
            at = starts - removed[starts]
            texts = [keep[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            for i in range(0, len(texts), 2048):
                j = slice(i, i + 2048)
                yield pa.record_batch(
                    [
                        c.ids.slice(i, 2048).combine_chunks() if isinstance(c.ids, pa.ChunkedArray) else c.ids.slice(i, 2048),
                        pa.array(np.diff(starts)[j]), pa.array(n_removed[j]), pa.array(total(spans)[j]),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts[j]]), pa.array(texts[j], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "key").sortWithinPartitions("key", "other")

    lists = every.repartition(tasks, "key").mapInArrow(listed, _ROW)
    candidates = dealt(lists).mapInArrow(repeated, _ROW)
    to_buckets = dealt(candidates.unionByName(every)).mapInArrow(sent, _ROW)
    marks = materialize(dealt(to_buckets).mapInArrow(marked, _ROW), "marks")
    return dealt(marks.unionByName(every)).mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _earliest(texts: list[bytes], low: np.ndarray, least: np.ndarray, indexed: int = INDEXED) -> np.ndarray:
    """For each piece and window the least id that has it, through run-length indexes.

    Pieces in the order of their minimizers are cut into indexes of ``indexed`` bytes. Those of
    a minimizer that lies in several are streamed through each.
    """
    order = np.argsort(low, kind="stable")
    lows = low[order]
    block = np.cumsum([len(texts[i]) + 1 for i in order.tolist()]) // (indexed + 1)
    out = np.full((len(texts), WINDOWS), NO_ID, np.int64)
    for b in np.unique(block).tolist():
        held = order[np.searchsorted(block, b) : np.searchsorted(block, b, side="right")]
        asked = order[np.searchsorted(lows, low[held[0]]) : np.searchsorted(lows, low[held[-1]], side="right")]
        index = RunIndex([texts[i] for i in held.tolist()], least[held], K)
        for at in range(0, len(asked), STREAMED):
            some = asked[at : at + STREAMED]
            out[some] = np.minimum(out[some], index.least_owners([texts[i] for i in some.tolist()], WINDOWS))
    return out


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, where it stands) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        if len(part):
            yield int(keys[part[0]]), part


def _one_by_one(data, first, windows, h, bucket, single, buckets):
    """Pieces of hot minimizers as single windows, dealt by a hash of the window."""
    n = windows[single]
    base = np.repeat(first[single], n)
    place = base + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = np.array([int.from_bytes(hashlib.blake2b(data[a : a + K].tobytes(), digest_size=8).digest(), "little") for a in place.tolist()], np.uint64)
    keep = ~single
    return (
        np.concatenate((first[keep], place)),
        np.concatenate((windows[keep], np.ones(len(place), np.int64))),
        np.concatenate((h[keep], own)),
        np.concatenate((bucket[keep], _bucket(own, buckets))),
    )
