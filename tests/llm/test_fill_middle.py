"""Fill-in-middle against a plain version, whatever the chunks; its automaton against a byte-by-byte run."""

import hashlib
import random
import re

import pytest

from tidemark.llm import fill_middle as fim

SCHEMA = "doc_id long, text string, n long, form string, output string, row long, at int, piece string"


def plain(doc_id, text, rate=100, first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    sha = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < first:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(3)
    some = ["".join(rng.choice(["\n", "\n\n", "<", "<P", "a", "é日", "😀 ", "S>", "\r", "<M"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    odd = [None, "", "\n", "x", "\n\n\n", "a<P>b", "a<S>", "<M>", "<\nP>", "<<P>", "<P<S<M", "no end\nlast", "line\n" * 3000, "x" * 20000, "é\n" * 9000 + "<S>"]
    return [(i, t) for i, t in enumerate(some + odd)] + [(4, "again\n" * 9), (4, "again\n" * 9), (None, "none\nat all\n"), (-3, "minus\nthree")]


@pytest.mark.parametrize(("chunk", "long"), [(1, 1 << 30), (7, 30), (1 << 14, 1 << 16)])
def test_equals_a_plain_version(spark, chunk, long):
    rows = [(i, t, 9, "plain", "o", 1, 2, "p") for i, t in texts()]
    if chunk < 1 << 14:
        rows = [r for r in rows if len(r[1] or "") < 1000]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = fim.fill_middle(docs, chunk=chunk, long=long)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((plain(r[0], r[1]) for r in rows), key=key)
    back = got.select("doc_id", fim.restored(got["output"], got["form"]).alias("t")).collect()
    assert sorted((tuple(r) for r in back), key=key) == sorted(((r[0], r[1] or "") for r in rows), key=key)


def test_shares_and_empty_table(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc\n") for i in range(400)], "doc_id long, text string")
    rows = [tuple(r) for r in fim.fill_middle(docs, rate=30, suffix_first=80).collect()]
    assert sorted(rows) == sorted(plain(i, f"a{i}\nb\nc\n", 30, 80) for i in range(400)) and {r[2] for r in rows} == {"plain", "psm", "spm"}
    none = spark.createDataFrame([], SCHEMA)
    assert fim.fill_middle(none).count() == 0


def test_summaries_compose():
    of, rng = fim.line_automaton(), random.Random(5)
    for _ in range(200):
        data = bytes(rng.choice(b"\n<PSM>ab\xc3") for _ in range(rng.randrange(40)))
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(4))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        run = of.empty
        for p in parts:
            run = run.then(of.summary(p))
        for start in range(len(of.step)):
            state, marks = start, []
            for i, byte in enumerate(data):
                if of.mark[state, of.classes[byte]]:
                    marks.append(i)
                state = of.step[state, of.classes[byte]]
            assert run.exits[start] == state and run.marks[start] == len(marks)
            assert [of.find(data, start, r) for r in range(len(marks))] == marks


def test_markers_must_fit_in_lines():
    with pytest.raises(ValueError):
        fim.line_automaton(("<P>", "a\nb"))
