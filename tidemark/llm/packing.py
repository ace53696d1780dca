"""Best-fit packing of token pieces into sequences by bin completion.

What is to be packed is fully described by how many pieces there are of each length, and
lengths end at the sequence's: the histogram has at most CAPACITY rows however large the
corpus is. The driver packs it. Best fit, done for all pieces of a length at once, gives
an incumbent. Where it misses the lower bound, branch and bound completes one bin at a
time around the largest piece that is left. All fillings are tried that no other one
dominates and whose waste lets the plan beat the incumbent, least waste first, and each
as often as its pieces allow, then less often. Only NODES ends this before it is through;
best_plan() says so. The plan, a list of fillings and how often each is used, is bounded
by the number of lengths as well.

Pieces then find their places without meeting: a piece's rank among those of its length
is its rank inside its task plus an offset by (task, length), and ranks are places in the
plan.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, tokens
from .shared import materialize, ship, worker_release

CAPACITY = 2048
#: Steps of the whole search, over all fillings and plans, before the best so far is taken.
NODES = 1_000_000

Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """The sum's, or what pieces of over half the capacity need beside those of a least length."""
    n = np.zeros(capacity + 1, np.int64)
    for length, k in counts.items():
        n[length] = k
    upto, size = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    least, half = np.arange(1, capacity // 2 + 1), capacity // 2
    large = upto[capacity] - upto[half]
    room = (upto[capacity - least] - upto[half]) * capacity - (size[capacity - least] - size[half])
    more = -((room - (size[half] - size[least - 1])) // capacity)
    return int(max(-(-size[capacity] // capacity), large + max(0, more.max(initial=0))))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing, for all pieces of a length at once."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # by space left: [filling, bins]
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            space = min((s for s, g in open_bins.items() if s >= length and g), default=0)
            if not space:
                per = capacity // length
                for filling, bins in ((per, n // per), (n % per, 1)):
                    if filling and bins:
                        open_bins[capacity - filling * length].append([(length,) * filling, bins])
                n = 0
                continue
            filling, bins = open_bins[space].pop()
            take = min(n, bins)
            if bins > take:
                open_bins[space].append([filling, bins - take])
            open_bins[space - length].append([(*filling, length), take])
            n -= take
    return [(f, b) for groups in open_bins.values() for f, b in groups]


def dominated(filling: dict[int, int], counts: dict[int, int], waste: int, lengths: array) -> bool:
    """Whether a piece that is left could replace some of the filling's (or none) that are together no larger."""

    def sums(without: int = 0) -> int:
        out = 1
        for x, n in filling.items():
            k = 1
            while n and x != without:
                k = min(k, n)
                out |= out << k * x
                n, k = n - k, 2 * k
        return out

    near = (1 << waste + 1) - 1
    every = sums()
    for x in lengths:
        if counts[x] > filling.get(x, 0):
            # A piece of the same length is the same piece: only others count then.
            reached = sums(x) if x in filling else every
            low = x - waste
            if (reached >> low if low > 0 else reached) & (near if low > 0 else (1 << x + 1) - 1):
                return True
    return False


def fillings(counts: dict[int, int], lengths: array, space: int, slack: int, tick: Callable[[], None]) -> Iterator[dict[int, int]]:
    """All undominated ways to fill a space with a waste of at most ``slack``: perfect ones, then others.

    lengths are those with pieces left, in descending order; larger pieces are tried
    first. Each step goes to the next length and takes some number of its pieces.
    """
    ascending = lengths[::-1]
    behind = array("q", [0])
    for x in ascending:
        behind.append(behind[-1] + x * counts[x])
    for low, high in ((0, 0), (1, slack)):
        stack = [(len(ascending), space, None, -1)] if low <= high else []
        while stack:
            tick()
            end, left, chosen, take = stack.pop()
            if take < 0:
                end = bisect_right(ascending, left, 0, end)
                if left - behind[end] > high:
                    continue  # all that still fits leaves too much
                if not end:
                    filling = dict(_unlinked(chosen))
                    if low <= left <= high and not dominated(filling, counts, left, ascending[: bisect_right(ascending, space)]):
                        yield filling
                    continue
                take = min(counts[ascending[end - 1]], left // ascending[end - 1])
            x = ascending[end - 1]
            if take:
                stack.append((end, left, chosen, take - 1))
            stack.append((end - 1, left - take * x, (chosen, x, take) if take else chosen, -1))


class _Spent(Exception):
    pass


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = None) -> tuple[Plan, bool]:
    """The plan with the fewest bins that was found, and whether nothing was left to try."""
    counts = {k: n for k, n in counts.items() if n}
    best = best_fit(counts, capacity)
    best_bins, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    total = sum(k * n for k, n in counts.items())
    steps = NODES if nodes is None else nodes

    def tick():
        nonlocal steps
        steps -= 1
        if steps < 0:
            raise _Spent

    #: What is left in the state at the top of the stack: a step takes its pieces out and puts them back.
    left = dict(counts)

    def options(plan, bins, waste):
        """States that one filling more leads to."""
        nonlocal best, best_bins
        lengths = array("i", sorted((k for k, n in left.items() if n), reverse=True))
        if not lengths:
            if bins < best_bins:
                best_bins, best = bins, _unlinked(plan)
            return
        top = lengths[0]
        left[top] -= 1  # the bin's first piece
        lengths = lengths if left[top] else lengths[1:]
        # The waste alone tells how many bins there will be.
        slack = min((best_bins - 1) * capacity - total - waste, capacity)
        for f in fillings(left, lengths, capacity - top, slack, tick):
            need = {**f, top: f.get(top, 0) + 1}
            filling = tuple(x for x in sorted(need, reverse=True) for _ in range(need[x]))
            empty = capacity - sum(filling)
            for times in range(min((left[k] + (k == top)) // n for k, n in need.items()), 0, -1):
                tick()
                spoiled = waste + times * empty
                if spoiled <= (best_bins - 1) * capacity - total:
                    for k, n in need.items():
                        left[k] += (k == top) - n * times
                    yield (plan, filling, times), bins + times, spoiled
                    for k, n in need.items():
                        left[k] -= (k == top) - n * times
        left[top] += 1

    stack = [options(None, 0, 0)] if best_bins > bound else []
    try:
        while stack and best_bins > bound:
            after = next(stack[-1], None)
            if after is None:
                stack.pop()
            else:
                stack.append(options(*after))
    except _Spent:
        return best, False
    return best, True


def complete(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan with as few bins as the search finds; best fit where it finds none better."""
    return best_plan(counts, capacity)[0]


def _unlinked(plan) -> list[tuple]:
    out = []
    while plan:
        plan, filling, times = plan
        out.append((filling, times))
    return out


class Places:
    """Looks up (length, rank) in a plan: number of the sequence and offset in it."""

    def __init__(self, plan: Plan):
        rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        base = 0
        for filling, times in plan:
            offset = 0
            for length, n in sorted(Counter(filling).items(), reverse=True):
                rows[length].append((n * times, base, times, offset))
                offset += n * length
            base += times
        self.by = {}
        for length, r in rows.items():
            a = np.array(r, dtype=np.int64)
            self.by[length] = (np.cumsum(a[:, 0]) - a[:, 0], *a[:, 1:].T)

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, base, times, offset = self.by[length]
        i = np.searchsorted(starts, rank, side="right") - 1
        k = rank - starts[i]
        return base[i] + k % times[i], offset[i] + k // times[i] * length


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Encoded and cut: doc_id, piece, start, length, ids_crc32, task, rank (in its task and length)."""
    ship(docs.sparkSession)
    tokenizer = tokenizer or tokens.default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        encoder = tokens.encoder(tokenizer)
        task, _ = files.attempt()
        seen: Counter = Counter()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    whole = np.append(ids.astype("<u4"), np.uint32(tokens.END))
                    n = len(whole)
                    first = n % capacity or capacity
                    start = 0
                    for i in range(-(-n // capacity)):
                        end = first if i == 0 else start + capacity
                        length = end - start
                        rows.append((doc, i, start, length, zlib.crc32(whole[start:end]), task, seen[length]))
                        seen[length] += 1
                        start = end
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    )
    return materialize(out, "pieces")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and END (null text: END alone). Longer ones than ``capacity``
    are cut, the first piece taking what does not divide. Sequences are filled from
    offset 0 without gaps. Repeated rows are documents of their own; empty tables give no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, capacity)
    per_task = materialize(cut.groupBy("task", "length").agg((F.max("rank") + 1).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(complete(counts, capacity)))  # bounded by the number of lengths
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_task.select(F.col("task").alias("o_task"), F.col("length").alias("o_length"), F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(offsets, (F.col("task") == F.col("o_task")) & (F.col("length") == F.col("o_length"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(group):
                    sequence[group], offset[group] = places.value.find(int(length[group[0]]), rank[group])
            yield pa.record_batch(
                [*b.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
