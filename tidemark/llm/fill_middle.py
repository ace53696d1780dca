"""Fill-in-middle: texts cut at two line ends and rearranged, by a parallel automaton scan.

Where lines start, and whether a text holds one of the markers already, is what a finite
automaton says. Read in one piece it depends on all that stands before, so texts are read
in chunks that know nothing of each other: a chunk says for every state that it may be
entered in, in which state it is left and how many lines start in it. Such summaries are
functions; two neighbours' compose to one, in any grouping, and composing them in order
gives the state that each chunk is really entered in. A cut is then found by selection:
counts lead to the chunk where a line of that number starts, and inside the chunk a tree
of composed summaries leads to the byte.

Long documents have their chunks dealt to tasks as rows, and what meets in one task is
a summary of a few hundred bytes for each chunk, until a document is put together again
(a value is two GB at the most). All others are read by the same steps in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, materialize, ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that are read at a time, and bytes from which a document's chunks are dealt to tasks.
CHUNK = 1 << 14
LONG = 1 << 16
SEED = 7
#: Of a hundred documents, how many are rearranged, and of these how many with the suffix first.
RATE, SUFFIX_FIRST = 100, 50

COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Summary:
    """What a stretch does: by the state that it is entered in, the state it is left in and the marks made."""

    exits: np.ndarray
    marks: np.ndarray

    def then(self, other: Summary) -> Summary:
        return Summary(other.exits[self.exits], self.marks + other.marks[self.exits])


class Automaton:
    """A finite automaton over bytes; some of its steps make a mark.

    ``classes`` has a byte's class, ``step`` the next state and ``mark`` whether it marks,
    each by state and class.
    """

    def __init__(self, classes: np.ndarray, step: np.ndarray, mark: np.ndarray):
        self.classes, self.step, self.mark = classes, step.astype(np.uint8), mark.astype(np.int64)
        states, n = step.shape
        # Bytes of such a class in a row do what the first one does.
        same = [(step[step[:, c], c] == step[:, c]).all() and not mark[step[:, c], c].any() for c in range(n)]
        self.idle = np.array(same)
        self.empty = Summary(np.arange(states, dtype=np.uint8), np.zeros(states, np.int64))

    def tree(self, data: bytes | memoryview) -> tuple[list[Summary], np.ndarray]:
        """Summaries of single steps, of two, of four and so on; and where each single step is in the data."""
        seen = self.classes[np.frombuffer(data, np.uint8)]
        new = np.ones(len(seen), bool)
        new[1:] = (seen[1:] != seen[:-1]) | ~self.idle[seen[1:]]
        at = np.flatnonzero(new)
        seen = seen[at]
        levels = [Summary(self.step.T[seen], self.mark.T[seen])]
        while len(levels[-1].exits) > 1:
            f = levels[-1]
            even, odd = len(f.exits) & ~1, len(f.exits) & 1
            left, right = f.exits[0:even:2], f.exits[1:even:2]
            exits = np.take_along_axis(right, left.astype(np.intp), 1)
            marks = f.marks[0:even:2] + np.take_along_axis(f.marks[1:even:2], left.astype(np.intp), 1)
            if odd:
                exits, marks = np.concatenate([exits, f.exits[-1:]]), np.concatenate([marks, f.marks[-1:]])
            levels.append(Summary(exits, marks))
        return levels, at

    def summary(self, data: bytes | memoryview) -> Summary:
        if not len(data):
            return self.empty
        top = self.tree(data)[0][-1]
        return Summary(top.exits[0], top.marks[0])

    def find(self, data: bytes | memoryview, state: int, rank: int) -> int:
        """Where the mark of that number (from 0) is made when the data is entered in ``state``."""
        levels, at = self.tree(data)
        node = 0
        for f in reversed(levels[:-1]):
            node *= 2
            if rank >= f.marks[node, state]:
                rank -= int(f.marks[node, state])
                state = int(f.exits[node, state])
                node += 1
        return int(at[node])


def line_automaton(markers: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> Automaton:
    """Marks each byte that starts a line; its odd states are inside lines, its last two have met a marker."""
    words = [m.encode() for m in markers]
    if any(not w or b"\n" in w for w in words):
        raise ValueError("a marker is empty or holds a line end")
    used = sorted({*b"".join(words), 10})
    parts = sorted({w[:i] for w in words for i in range(len(w))}, key=lambda p: (len(p), p))
    classes = np.zeros(256, np.uint8)
    classes[used] = np.arange(1, len(used) + 1)

    def after(part: bytes, byte: bytes) -> int:
        ends = [(part + byte)[i:] for i in range(len(part) + 1 + bool(byte))] if byte else [b""]
        if any(e in words for e in ends):
            return len(parts)
        return parts.index(next(e for e in ends if e in parts))

    met = len(parts)
    step = np.zeros((2 * (met + 1), len(used) + 1), np.int64)
    for p in range(met + 1):
        for c, byte in enumerate([b"", *[bytes([b]) for b in used]]):
            nxt = met if p == met else after(parts[p], byte)
            step[2 * p : 2 * p + 2, c] = 2 * nxt + (byte != b"\n")
    mark = np.zeros_like(step)
    mark[::2] = 1
    return Automaton(classes, step, mark)


def code_points(data: bytes | memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _form(n: int, met: bool, h: list[int], rate: int, suffix_first: int) -> str:
    if not n or met or h[2] % 100 >= rate:
        return "plain"
    return "spm" if h[3] % 100 < suffix_first else "psm"


def _joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join([p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle])


def _bounds(n: int, h: list[int]) -> tuple[int, int]:
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return min(a, b), max(a, b)


def _plan(of: Automaton, parts: list[Summary], h: list[int], rate: int, suffix_first: int):
    """Lines, form, and for each of both cuts (chunk, the state it is entered in, which of its marks); None is the end."""
    run, before = of.empty, [of.empty]
    for f in parts:
        run = run.then(f)
        before.append(run)
    n = int(run.marks[0])
    form = _form(n, int(run.exits[0]) >= len(of.step) - 2, h, rate, suffix_first)
    cuts: list[tuple[int, int, int] | None] = []
    if form != "plain":
        starts = np.array([f.marks[0] for f in before])
        for rank in _bounds(n, h):
            k = int(np.searchsorted(starts, rank, side="right")) - 1
            cuts.append(None if rank == n else (k, int(before[k].exits[0]), rank - int(starts[k])))
    return n, form, cuts


def rearrange(text: bytes | memoryview, h: list[int], of: Automaton, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK):
    """n, form, code points of prefix and middle (None if plain) and the output of one text."""
    chunks = [text[i : i + chunk] for i in range(0, len(text), chunk)]
    n, form, cuts = _plan(of, [of.summary(c) for c in chunks], h, rate, suffix_first)
    if form == "plain":
        return n, form, None, None, bytes(text)
    a, b = (len(text) if c is None else c[0] * chunk + of.find(chunks[c[0]], c[1], c[2]) for c in cuts)
    return n, form, code_points(text[:a]), code_points(text[a:b]), _joined(form, text[:a], text[a:b], text[b:])


def _numbers(seed: int) -> Column:
    """The four numbers of a document, from its id alone."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return let(sha, lambda s: F.array(*[F.conv(F.substring(s, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]))


def fill_middle(
    docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, chunk: int = CHUNK, long: int = LONG
) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    Lines end behind their line end. A text is plain (output the text, no counts) if it is
    empty or null, holds a marker, or is not among ``rate`` of a hundred; else its prefix,
    suffix and middle stand behind markers, the suffix first ("spm") for ``suffix_first``
    of a hundred and the prefix first ("psm") for the others. All choices follow from
    ``seed`` and the document's id; rows with equal ids are cut alike, a null id counts as an
    empty text. ``chunk`` and ``long`` (bytes) say how texts are read, never what comes out.
    Rows stay as many as they are; an empty table gives none; other columns are ignored.
    """
    ship(docs.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = line_automaton()
        for b in batches:
            rows = []
            for t, h in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                rows.append(rearrange(memoryview(t.as_buffer()), h, of, rate, suffix_first, chunk))
            yield _batch(b.column(0), rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), _numbers(seed).alias("h"))
    short = rows.filter(F.octet_length("text") <= long).mapInArrow(whole, COLUMNS)
    return short.unionByName(_long_ones(rows.filter(F.octet_length("text") > long), rate, suffix_first, chunk))


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, form, p, m, out = zip(*rows, strict=True) if rows else ([],) * 5
    columns = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
    return pa.record_batch(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _long_ones(rows: DataFrame, rate: int, suffix_first: int, chunk: int) -> DataFrame:
    """fill_middle() of documents whose chunks go to many tasks."""
    places = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "h", "text", F.explode(places).alias("at"))
    # Written once, so that rows keep their numbers whatever is lost later.
    pieces = materialize(numbered.select("row", "at", "doc_id", "h", F.substring("text", F.col("at") * chunk + 1, F.lit(chunk)).alias("piece")), "fim-pieces")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = line_automaton()
        for b in batches:
            found = [of.summary(p.as_py()) for p in b.column("piece")]
            exits, marks = pa.array([f.exits.tobytes() for f in found], pa.binary()), pa.array([f.marks.tolist() for f in found], pa.list_(pa.int64()))
            yield pa.record_batch([b.column("row"), b.column("at"), b.column("h"), exits, marks], names=["row", "at", "h", "exits", "marks"])

    def planned(group: pa.Table) -> pa.Table:
        of, group = line_automaton(), group.sort_by("at")
        parts = [Summary(np.frombuffer(e, np.uint8), np.array(m)) for e, m in zip(group["exits"].to_pylist(), group["marks"].to_pylist(), strict=True)]
        n, form, cuts = _plan(of, parts, group["h"][0].as_py(), rate, suffix_first)
        a, b = (cuts or [None, None])
        at = lambda c: [None, None, None] if c is None else list(c)
        names = ["row", "n", "form", "at_a", "state_a", "rank_a", "at_b", "state_b", "rank_b"]
        values = [group["row"][0].as_py(), n, form, *at(a), *at(b)]
        return pa.table({k: pa.array([v], pa.string() if k == "form" else pa.int64()) for k, v in zip(names, values, strict=True)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece in up to three: 0 before both cuts, 1 between them, 2 behind."""
        of = line_automaton()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "n", "form", "part", "at", "piece", "chars")}
            for r in b.to_pylist():
                ends = []
                for c in "ab":
                    where = r[f"at_{c}"]
                    if where is None or r["at"] < where:
                        ends.append(len(r["piece"]))
                    else:
                        ends.append(of.find(r["piece"], r[f"state_{c}"], r[f"rank_{c}"]) if r["at"] == where else 0)
                edges = [0, *ends, len(r["piece"])]
                for part in range(3):
                    if (some := r["piece"][edges[part] : edges[part + 1]]) or (part == 0 and r["at"] == 0):
                        for k, v in (("part", part), ("piece", some), ("chars", code_points(some))):
                            out[k].append(v)
                        for k in ("row", "doc_id", "n", "form", "at"):
                            out[k].append(r[k])
            kinds = {"form": pa.string(), "part": pa.int32(), "at": pa.int32(), "piece": pa.binary()}
            yield pa.record_batch([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    def together(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("at", "ascending")])
        texts, chars, parts = group["piece"].to_pylist(), group["chars"].to_pylist(), group["part"].to_pylist()
        some = [b"".join(t for t, p in zip(texts, parts, strict=True) if p == k) for k in range(3)]
        n, form = group["n"][0].as_py(), group["form"][0].as_py()
        p, m = (sum(c for c, x in zip(chars, parts, strict=True) if x == k) for k in (0, 1))
        row = (n, form, None, None, b"".join(some)) if form == "plain" else (n, form, p, m, _joined(form, *some))
        return pa.Table.from_batches([_batch(group["doc_id"].combine_chunks()[:1], [row])])

    sums = pieces.repartition("row", "at").mapInArrow(summed, "row long, at int, h array<long>, exits binary, marks array<long>")
    plans = sums.groupBy("row").applyInArrow(planned, "row long, n long, form string, at_a long, state_a long, rank_a long, at_b long, state_b long, rank_b long")
    split = pieces.drop("h").join(plans, "row").mapInArrow(cut, "row long, doc_id long, n long, form string, part int, at int, piece binary, chars long")
    return split.groupBy("row").applyInArrow(together, COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    between = lambda t, a, b: F.substring(t, a, F.greatest(b - a, F.lit(0)))  # noqa: E731  code points, from 1
    n = len(PREFIX), len(SUFFIX), len(MIDDLE)

    def back(t: Column) -> Column:
        p, s, m = (F.locate(x, t) for x in (PREFIX, SUFFIX, MIDDLE))
        middle = F.substring(t, m + n[2], F.length(t))
        psm = F.concat(between(t, p + n[0], s), middle, between(t, s + n[1], m))
        spm = F.concat(between(t, p + n[0], m), middle, between(t, s + n[1], p))
        return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(t)

    return let(output, back)
