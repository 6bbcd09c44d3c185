"""Quality classifier: a generalised additive model with pairwise interactions.

Numeric features of the text are cut into bins; cyclic boosting adds one shallow tree (up to three
leaves over the bins) per feature and turn to that feature's lookup table, then to tables over
pairs of coarser bins. Scoring adds up table entries, vectorised, in one Arrow pass without a shuffle.

Features are computed on the executors for a bounded fit set (:mod:`rillflow.llm.labelled`); the driver
gets those rows of a few numbers (``max_rows`` x features) and fits the tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import words as W
from rillflow.llm.common import scope
from rillflow.llm.labelled import fit_rows, held_out
from rillflow.llm.quality_rules import STOP_WORDS
from rillflow.llm.toxicity import APART
from rillflow.session import ship

NAMES = (
    "log_words", "word_length", "symbols", "upper", "digits", "marks", "bars", "shouts", "distinct",
    "stop_words", "repeated_lines", "line_words", "beyond_ascii", "longest", "repeated_triples", "word_cv",
)


@dataclass(frozen=True)
class Gam:
    bins: int = 48
    coarse: int = 8
    turns: int = 150
    pair_turns: int = 40
    n_pairs: int = 8
    rate: float = 0.15
    shrink: float = 5.0
    max_rows: int = 8000
    max_bytes: int = 128 << 20


def _stops() -> np.ndarray:
    words = sorted({w.encode() for w in STOP_WORDS})
    offsets = np.cumsum([0, *map(len, words)])
    return np.unique(W.find(np.frombuffer(b"".join(words), np.uint8), offsets, APART).hashes())


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS, _MARKS = _table("#*$%&|<>@^~=+_\\{}[]"), _table(".,;:!?'\"()-")
_UPPER, _DIGITS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")


def features(data: np.ndarray, offsets: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text; texts without words get zeros where a ratio has no meaning."""
    texts = len(offsets) - 1
    found = W.find(data, offsets)
    h, owner = found.hashes(), found.owner()
    n = np.diff(found.first).astype(float)
    chars, words = np.maximum(np.diff(offsets), 1).astype(float), np.maximum(n, 1)

    def bytes_in(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return np.diff(sums[offsets]).astype(float)

    def per_text(who: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(who, weights=values, minlength=texts).astype(float)

    length = (found.ends - found.starts).astype(float)
    mean = per_text(owner, length) / words
    spread = np.sqrt(np.maximum(per_text(owner, length**2) / words - mean**2, 0)) / np.maximum(mean, 1)
    longest = np.zeros(texts)
    np.maximum.at(longest, owner, length)
    plain = W.find(data, offsets, APART)
    plain_owner = plain.owner()
    stop = np.isin(plain.hashes(), stops)

    def distinct(hashes: np.ndarray, who: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, who))
        a, b = hashes[order], who[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return per_text(b[new])

    triples, whose = W.runs(h, found.first, 3, W.constants(31, 3) | W.U64(1))
    n_triples = np.maximum(per_text(whose), 1)
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = W.find(data, offsets, newline)
    line_owner = lines.owner()
    n_lines = np.maximum(per_text(line_owner), 1)
    columns = [
        np.log1p(n),
        mean,
        bytes_in(_SYMBOLS) / words,
        bytes_in(_UPPER) / chars,
        bytes_in(_DIGITS) / chars,
        bytes_in(_MARKS) / words,
        bytes_in(_table("|")) / words,
        bytes_in(_table("!")) / words,
        distinct(h, owner) / words,
        per_text(plain_owner[stop]) / np.maximum(per_text(plain_owner), 1),
        1 - distinct(lines.hashes(), line_owner) / n_lines,
        np.log1p(n / n_lines),
        bytes_in(np.arange(256) > 127) / chars,
        longest,
        1 - distinct(triples, whose) / n_triples,
        spread,
    ]
    return np.stack(columns, axis=1)


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stops = _stops()
    for batch in batches:
        rows = [features(d, o, stops) for _, _, d, o in W.slices(batch.column(1))]
        x = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *[pa.array(x[:, j]) for j in range(len(NAMES))]], names=["place", "y", *NAMES]
        )


def _tree(g: np.ndarray, h: np.ndarray, shrink: float) -> np.ndarray:
    """Leaf values over the bins of one feature: the best cut, and the better of the cuts of its two sides."""

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, 0
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        gain = cg[:-1] ** 2 / (ch[:-1] + shrink) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + shrink) - cg[-1] ** 2 / (ch[-1] + shrink)
        at = int(np.argmax(gain))
        return float(gain[at]), a + at + 1

    _, cut = best(0, len(g))
    if not cut:
        return np.zeros(len(g))
    left, right = best(0, cut), best(cut, len(g))
    cuts = sorted({0, cut, len(g), *([left[1]] if left[0] >= right[0] else [right[1]])} - ({0} if len(g) == 0 else set()))
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + shrink)
    return out


def fit_tables(x: np.ndarray, y: np.ndarray, o: Gam = Gam()):
    """(bias, edges, tables, coarse edges, pairs, pair tables), or None where there are no rows."""
    if not len(y):
        return None
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, o.bins + 1)[1:-1])) for j in range(k)]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, o.coarse + 1)[1:-1])) for j in range(k)]
    at = np.stack([np.searchsorted(edges[j], x[:, j], "right") for j in range(k)], axis=1)
    rough = np.stack([np.searchsorted(coarse[j], x[:, j], "right") for j in range(k)], axis=1)
    share = np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1))
    bias = float(np.log(share / (1 - share)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), bias)
    sigmoid = lambda t: 1 / (1 + np.exp(-t))
    for _ in range(o.turns):
        for j in range(k):
            p = sigmoid(total)
            size = len(tables[j])
            step = o.rate * _tree(np.bincount(at[:, j], y - p, size), np.bincount(at[:, j], p * (1 - p), size), o.shrink)
            tables[j] += step
            total += step[at[:, j]]
    cells = lambda a, b: rough[:, a] * (len(coarse[b]) + 1) + rough[:, b]
    sizes = lambda a, b: (len(coarse[a]) + 1) * (len(coarse[b]) + 1)
    p = sigmoid(total)
    gains = []
    for a, b in combinations(range(k), 2):
        c, n = cells(a, b), sizes(a, b)
        gains.append(((np.bincount(c, y - p, n) ** 2 / (np.bincount(c, p * (1 - p), n) + o.shrink)).sum(), a, b))
    pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[: o.n_pairs]]
    pair_tables = [np.zeros(sizes(a, b)) for a, b in pairs]
    for _ in range(o.pair_turns):
        for i, (a, b) in enumerate(pairs):
            p, c, n = sigmoid(total), cells(a, b), sizes(a, b)
            step = o.rate * np.bincount(c, y - p, n) / (np.bincount(c, p * (1 - p), n) + o.shrink)
            pair_tables[i] += step
            total += step[c]
    return bias, edges, tables, coarse, pairs, pair_tables


def add_up(x: np.ndarray, model) -> np.ndarray:
    bias, edges, tables, coarse, pairs, pair_tables = model
    total = np.full(len(x), bias)
    for j, (e, t) in enumerate(zip(edges, tables)):
        total += t[np.searchsorted(e, x[:, j], "right")]
    rough = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(x.shape[1])]
    for (a, b), t in zip(pairs, pair_tables):
        total += t[rough[a] * (len(coarse[b]) + 1) + rough[b]]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, options: Gam = Gam(), label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text"):
    ship(docs.sparkSession)
    schema = "place long, y int, " + ", ".join(f"{n} double" for n in NAMES)
    with scope():
        rows = fit_rows(docs, labels, label_col, options.max_rows, id_col, text_col, options.max_bytes)
        found = rows.mapInArrow(W.tidy(featured), schema).toPandas().sort_values(["place", "y", *NAMES])
    return fit_tables(found[list(NAMES)].to_numpy(), found["y"].to_numpy().astype(float), options)


def scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops, model = _stops(), shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for a, b, data, offsets in W.slices(batch.column(0)) if model else ():
                scores[a:b] = add_up(features(data, offsets, stops), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], names=[*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): 0 to 1, higher where label 1 is likelier.

    Null and empty texts count as texts without words; whole texts are scored, however long; equal texts score
    alike, repeated rows stay, an empty table stays empty; without a model all scores are 0. Ids may be of any
    type and name but ``score``; no other column is read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(f"`{text_col}`").alias("__text"), F.col(f"`{id_col}`").alias("__id"))
    out = picked.mapInArrow(W.tidy(scorer(shared)), f"__id {picked.schema['__id'].dataType.simpleString()}, score double")
    return out.withColumnRenamed("__id", id_col)


def quality(docs: DataFrame, labels: DataFrame, options: Gam = Gam()) -> DataFrame:
    """(doc_id, held_out, score, predicted at 0.3) of every row of ``docs``."""
    scored = score(docs, fit(docs, labels, options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
