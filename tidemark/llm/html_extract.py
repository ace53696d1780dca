"""Main text of web pages by a tree-structured graphical model.

Every node of a page's tree (elements and text blocks) is main text or not. A node's own
evidence is a logistic model of its tag, its name parts, its length and its share of
links; edges couple a node with its parent by a 2 by 2 potential, one for blocks of text
and one for elements. Sum-product messages go from the leaves up and from the root down,
which is exact on a tree; blocks with a marginal of at least a half are the text. Both
parts are trained on labelled pages: the potentials are ratios of label counts along
edges, the evidence is fitted to the labels and freed of their base rate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_labelled import labelled_pages, plain_pages
from .html_tree import Node, parse
from .shared import ship


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def features(nodes: list[Node], i: int) -> list[str]:
    n = nodes[i]
    link = _bucket(n.linked / n.chars if n.chars else 0, (0.01, 0.3, 0.7))
    if n.text is not None:
        p = nodes[n.parent]
        end = n.text[-1] in ".!?:;\"'»”"
        return ["text", f"in={p.tag}", f"len={_bucket(n.words, (4, 9, 21, 60))}", f"link={link}", f"end={end}"]
    share = _bucket(n.chars / (nodes[0].chars or 1), (0.05, 0.2, 0.5))
    place = [f"{n.tag} in {nodes[n.parent].tag}"] if n.parent >= 0 and n.tag != "#root" else []
    place += [f"within={m}" for m in nodes[n.parent].marks] if n.parent >= 0 else []
    return ["element", *place, f"tag={n.tag}", f"elink={link}", f"share={share}", *[f"name={m}" for m in n.marks]]


class Model:
    """Weights of the evidence by feature, and the potentials (parent label, own label) by kind."""

    def __init__(self, weights: dict[str, float], edges: tuple[tuple[float, ...], tuple[float, ...]]):
        self.weights, self.edges = weights, edges

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of main text for every node."""
        get, n = self.weights.get, len(nodes)
        up = [sum(get(f, 0.0) for f in features(nodes, i)) for i in range(n)]  # log-odds from below
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            sent[i] = _message(up[i], self.edges[nodes[i].text is not None], True)
            up[nodes[i].parent] += sent[i]
        full = up
        for i in range(1, n):
            p = nodes[i].parent
            full[i] += _message(full[p] - sent[i], self.edges[nodes[i].text is not None], False)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in full]


def _message(odds: float, edge: tuple[float, ...], to_parent: bool) -> float:
    """Log-odds that one end of an edge sends to the other."""
    e00, e01, e10, e11 = edge  # parent label, then child label
    x = math.exp(max(-500.0, min(500.0, odds)))
    if to_parent:
        return math.log((e10 + e11 * x) / (e00 + e01 * x))
    return math.log((e01 + e11 * x) / (e00 + e10 * x))


def train(pages: list[str]) -> Model:
    """Evidence by logistic regression, potentials by counts; sizes follow the labelled pages."""
    names: dict[str, int] = {}
    rows, cols, y = [], [], []
    counts = np.ones((2, 2, 2))
    for page in pages:
        nodes = parse(page, labels=True)
        for i, n in enumerate(nodes):
            if i:
                counts[int(n.text is not None), nodes[n.parent].label, n.label] += 1
            for f in features(nodes, i):
                rows.append(len(y))
                cols.append(names.setdefault(f, len(names)))
            y.append(n.label)
    r, c, t = np.array(rows), np.array(cols), np.array(y, float)
    w, b, m = np.zeros(len(names)), 0.0, np.zeros(len(names))
    frequency = np.bincount(c, minlength=len(names))
    for _ in range(400):  # diagonal steps: features are 0 or 1 and at most about ten a node
        e = 1 / (1 + np.exp(-(np.bincount(r, w[c], minlength=len(t)) + b))) - t
        m = 0.9 * m + (np.bincount(c, e[r], minlength=len(names)) + 0.5 * w) / (0.25 * 8 * frequency + 0.5)
        w -= 0.3 * m
        b -= 0.3 * e.mean() * 4
    base = math.log(t.mean() / (1 - t.mean()))
    # A potential is how much more often two labels meet than if they were independent.
    edges = []
    for k in counts:
        p = k / k.sum()
        edges.append(tuple((p / np.outer(p.sum(1), p.sum(0))).ravel().tolist()))
    weights = {f: float(w[i]) for f, i in names.items()}
    for f in ("text", "element"):
        weights[f] = weights.get(f, 0.0) + b - base + base * 0.5
    return Model(weights, (edges[0], edges[1]))


_trained: dict[int, Model] = {}


def default_model() -> Model:
    """The model of the labelled and the plain pages, trained once per process."""
    if 0 not in _trained:
        _trained[0] = train(labelled_pages() + plain_pages())
    return _trained[0]


def main_text(page: str | None, model: Model) -> str:
    """Blocks of main text in page order, joined by an empty line; empty if there is none. A page without elements is all text."""
    nodes = parse(page or "")
    if len(nodes) == 1:
        return ""
    p = [1.0] * len(nodes) if all(n.text is not None for n in nodes[1:]) else model.marginals(nodes)
    return "\n\n".join(n.text for i, n in enumerate(nodes) if n.text is not None and p[i] >= 0.5)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html counts as empty, and pages without main text have an empty text. Repeated
    rows are extracted each; empty tables give no rows; other columns are ignored. Tags
    may be unclosed, crossed or cut off at the end.
    """
    spark = pages.sparkSession
    ship(spark)
    model = model or default_model()
    shared = spark.sparkContext.broadcast((model.weights, model.edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([main_text(h, m) for h in part.column(2).to_pylist()], pa.string())],
                    names=["page_id", "url", "text"],
                )

    out = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = dict(out.dtypes)["page_id"]
    return out.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
