"""HTML extraction by a tree-structured graphical model over the DOM.

Every block element and every run of inline text is a binary variable (content or not) with a
log-linear potential of its own features; each edge to the parent has a potential table, chosen by the
kind of the child. Sum-product messages go up from the leaves and down from the root and give exact
marginals; a run whose marginal of content is a half or more is part of the main text. Weights maximise
the likelihood of labelled pages (:mod:`rillflow.llm.html_pages`), whose gradient is the observed minus the
expected features under the same messages.

Training is on the driver, over a few hundred pages, once per Python process; the weights are some
hundred numbers. Extraction is one Arrow pass without a shuffle, pages of a batch level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm import words as W
from rillflow.llm.html_pages import NAMES, labelled
from rillflow.llm.html_tree import Tree, read
from rillflow.session import ship

#: Bytes of pages that are read together.
PIECE = 1 << 19
TAGS = "html head body article main section div p h1 h2 h3 h4 ul ol li table tr td nav header footer aside form button fieldset select blockquote pre figure figcaption dl dd dt #".split()
TAG_NO = {t: i for i, t in enumerate(TAGS)}
KINDS = list(NAMES)
WORD_KIND = {w: i for i, k in reversed(list(enumerate(KINDS))) for w in NAMES[k]}
SPLIT = re.compile(r"[^a-z0-9]+")
N_TAG, N_KIND, N_NUM = len(TAGS) + 1, len(KINDS), 8
N_FEATURES = N_TAG + N_KIND + N_NUM + 2


@lru_cache(maxsize=100_000)
def kinds_of(names: str) -> tuple[int, ...]:
    """Which groups of NAMES the class, id and role of an element speak of, whole names before parts of them."""
    found = set()
    for value in names.split():
        value = value.split("=", 1)[-1]
        if value in WORD_KIND:
            found.add(WORD_KIND[value])
        else:
            found.update(WORD_KIND[p] for p in SPLIT.split(value) if p in WORD_KIND)
    return tuple(sorted(found))


class Forest:
    """The trees of several pages in one set of arrays, with nodes grouped by depth."""

    def __init__(self, trees: list[Tree]):
        base = np.cumsum([0, *[len(t.tag) for t in trees]])
        self.first = base
        n = int(base[-1])
        self.parent = np.fromiter((p + b if p >= 0 else -1 for t, b in zip(trees, base) for p in t.parent), np.int64, n)
        self.depth = np.zeros(n, np.int64)
        parent, depth = self.parent.tolist(), [0] * n
        for i, p in enumerate(parent):
            if p >= 0:
                depth[i] = depth[p] + 1
        self.depth = np.array(depth)
        order = np.argsort(self.depth, kind="stable")
        ends = np.searchsorted(self.depth[order], np.arange(1, (max(depth) if depth else 0) + 2))
        self.levels = np.split(order, ends)[1:-1] if n else []  # below the roots
        self._features(trees, n)

    def _features(self, trees: list[Tree], n: int) -> None:
        """A node's tag, the groups its names speak of, and, of runs of text only, the numbers: what is not 0 of a row of N_FEATURES."""
        self.tag, self.kind = np.full(n, N_TAG - 1, np.int16), np.zeros(n, np.int64)
        spoken, groups, runs, numbers, named = [], [], [], [], []
        i = 0
        for t in trees:
            size = max(1, len(t.tag))
            for k, (tag, names, text, linked) in enumerate(zip(t.tag, t.names, t.text, t.linked)):
                self.tag[i] = TAG_NO.get(tag, N_TAG - 1)
                if names:
                    named.append(i)
                    for kind in kinds_of(names):
                        spoken.append(i)
                        groups.append(kind)
                if text:
                    chars, spaces = len(text), text.count(" ")
                    runs.append(i)
                    numbers.append((
                        np.log1p(chars) / 5, spaces < 3, spaces > 12, linked / chars, linked * 2 > chars,
                        text[-1] in ".!?", text[0] == "©", k / size,
                    ))
                i += 1
        self.spoken, self.groups, self.named, self.runs = (np.array(x, np.int64) for x in (spoken, groups, named, runs))
        self.numbers = np.array(numbers, float).reshape(-1, N_NUM)
        self.kind[self.tag == TAG_NO["#"]] = 1

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Each node's features times the weights."""
        out = weights[self.tag] + weights[-1]
        np.add.at(out, self.spoken, weights[N_TAG + self.groups])
        out[self.named] += weights[-2]
        out[self.runs] += self.numbers @ weights[N_TAG + N_KIND : N_TAG + N_KIND + N_NUM]
        return out

    def total(self, p: np.ndarray) -> np.ndarray:
        """The sum of all nodes' features, each node's times its ``p``."""
        out = np.zeros(N_FEATURES)
        out[:N_TAG] = np.bincount(self.tag, p, N_TAG)
        out[N_TAG : N_TAG + N_KIND] = np.bincount(self.groups, p[self.spoken], N_KIND)
        out[N_TAG + N_KIND : N_TAG + N_KIND + N_NUM] = p[self.runs] @ self.numbers
        out[-2:] = p[self.named].sum(), p.sum()
        return out


def beliefs(forest: Forest, weights: np.ndarray, pairs: np.ndarray, pairwise: bool = True) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(marginals of content, pairwise marginals [node, parent's value, own value] where asked for, log of the partition function).

    One numpy step up and one down per depth: some 0.1 ms, so that 60,000 nested elements take seconds.
    """
    n = len(forest.parent)
    own = np.zeros((n, 2))
    own[:, 1] = forest.score(weights)
    up = np.zeros((n, 2))  # message of a node to its parent
    inner = own.copy()  # own potential and the messages of the children
    for level in reversed(forest.levels):
        score = pairs[forest.kind[level]] + inner[level][:, None, :]
        up[level] = np.logaddexp(score[:, :, 0], score[:, :, 1])
        np.add.at(inner, forest.parent[level], up[level])
    roots = np.flatnonzero(forest.parent < 0)
    log_z = float(np.logaddexp(inner[roots, 0], inner[roots, 1]).sum())
    total = inner.copy()  # with the message of the parent
    joint = np.zeros((n, 2, 2)) if pairwise else None
    for level in forest.levels:
        above = total[forest.parent[level]] - up[level]
        if pairwise:
            score = above[:, :, None] + pairs[forest.kind[level]] + inner[level][:, None, :]
            flat = score.reshape(len(level), 4)
            flat = np.exp(flat - flat.max(axis=1, keepdims=True))
            joint[level] = (flat / flat.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
        total[level] = inner[level] + np.logaddexp(
            above[:, :1] + pairs[forest.kind[level]][:, 0, :], above[:, 1:] + pairs[forest.kind[level]][:, 1, :]
        )
    top = total.max(axis=1, keepdims=True) if n else total
    p = np.exp(total - top)
    return p[:, 1] / p.sum(axis=1), joint, log_z


def train(pages: list[tuple[Tree, list[int]]], turns: int = 250, ridge: float = 0.5, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """(weights, pair tables by kind of child) of greatest penalised likelihood, by gradient steps with adaptive rates."""
    forest = Forest([t for t, _ in pages])
    y = np.array([v for _, labels in pages for v in labels])
    below = forest.parent >= 0
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[below], y[forest.parent[below]], y[below]), 1)
    size = N_FEATURES + 8
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    observed = forest.total(y.astype(float))
    for t in range(1, turns + 1):
        w, pairs = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2)
        p, joint, _ = beliefs(forest, w, pairs)
        expected = np.stack([joint[below & (forest.kind == k)].sum(axis=0) for k in (0, 1)])
        g = np.concatenate([observed - forest.total(p), (seen - expected).ravel()]) - ridge * theta
        g /= len(pages)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2)


@lru_cache(maxsize=2)
def trained(n: int = 800, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    return train(labelled(n, seed))


def main_texts(pages: list[str | None], model, threshold: float = 0.5) -> list[str]:
    trees = [read(p) for p in pages]
    forest = Forest(trees)
    p, _, _ = beliefs(forest, *model, pairwise=False)
    keep = p >= threshold
    out = []
    for tree, base in zip(trees, forest.first):
        out.append("\n\n".join(text for i, text in enumerate(tree.text) if text and keep[base + i]))
    return out


def extractor(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pages, texts, piece, size = batch.column(0), [], [], 0
            for page in pages:
                piece.append(page.as_py())
                size += len(piece[-1] or "")
                if size >= PIECE:
                    texts += main_texts(piece, model, threshold)
                    piece, size = [], 0
            texts += main_texts(piece, model, threshold) if piece else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])

    return run


def extract(pages: DataFrame, columns: list[str], html_col: str = "html", model=None, threshold: float = 0.5) -> DataFrame:
    """``columns`` of ``pages`` and ``text``: the main text, blocks in page order joined by an empty line.

    A block is a run of inline content between block tags; references are decoded, white space inside
    becomes one space. Null and empty pages give the empty text, broken tags and quotes never show in it.
    Repeated rows stay, an empty table stays empty; a page of any length is read whole, in time that goes
    with its length. Ids may be of any type; a column named ``text`` among ``columns`` is replaced.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    names = [c for c in columns if c != "text"]
    picked = pages.select(F.col(f"`{html_col}`").alias("__page"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    found = picked.mapInArrow(W.tidy(extractor(shared, threshold)), T.StructType([*picked.schema.fields[1:], T.StructField("text", T.StringType())]))
    return found.toDF(*names, "text")
