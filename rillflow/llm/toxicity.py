"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

One task learns online from the bounded fit set (:mod:`rillflow.llm.labelled`), with a rate of its own for
each coordinate; the L1 term leaves few weights other than zero, which are broadcast: at most
2**BITS of 12 bytes, whatever the corpus is. Scoring is one Arrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm import words as W
from rillflow.llm.common import scope
from rillflow.llm.labelled import fit_rows, held_out
from rillflow.session import ship

BITS = 20
#: The first coordinate of runs and skips.
RUNS = 1 << (BITS - 1)
#: Separators: all ASCII but letters and digits.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_PAIR = [(int(a) | 1, int(b) | 1) for a, b in W.constants(21, 6).reshape(3, 2)]
_TRIPLE = W.constants(22, 3) | W.U64(1)


@dataclass(frozen=True)
class Ftrl:
    """Rates, penalties, turns over the fit set, the weight of a toxic row, and the bounds of the fit set.

    A strong L1 with several turns and a large rate keeps a few hundred coordinates, with weights that carry
    a text over the threshold even where one of them stands alone. Single words have the value 1, runs and skips
    ``run_value``: there are many more of them, and a smaller value is a stronger L1.
    """

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.0
    epochs: int = 8
    toxic_weight: float = 3.0
    run_value: float = 0.3
    max_rows: int = 16000
    max_bytes: int = 128 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, text) of words (the lower half), and of runs of two and three words and pairs that skip one or two."""
    found = W.find(data, offsets, APART)
    h, owner = found.hashes(), found.owner()
    cut = W.U64(65 - BITS)
    codes, texts = [h >> cut], [owner]
    with np.errstate(over="ignore"):
        for gap, (a, b) in enumerate(_PAIR, start=1):
            n = len(h) - gap
            if n > 0:
                same = owner[:n] == owner[gap:]
                pair = W.mix(h[:n] * W.U64(a) + h[gap:] * W.U64(b) + W.U64(gap))
                codes.append(((pair >> cut) + W.U64(RUNS))[same])
                texts.append(owner[:n][same])
    triples, whose = W.runs(h, found.first, 3, _TRIPLE)
    codes.append((triples >> cut) + W.U64(RUNS))
    texts.append(whose)
    return np.concatenate(codes).astype(np.int64), np.concatenate(texts)


class Learner:
    """The state of FTRL-proximal over 2**BITS coordinates and a bias without penalty."""

    def __init__(self, options: Ftrl):
        self.o = options
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.zb = self.nb = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, o = self.z[at], self.o
        return np.where(np.abs(z) <= o.l1, 0.0, -(z - np.sign(z) * o.l1) / ((o.beta + np.sqrt(self.n[at])) / o.alpha + o.l2))

    def bias(self) -> float:
        return -self.zb / ((self.o.beta + self.nb**0.5) / self.o.alpha)

    def values(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < RUNS, 1.0, self.o.run_value)

    def learn(self, at: np.ndarray, y: int) -> None:
        w, b, a, x = self.weights(at), self.bias(), self.o.alpha, self.values(at)
        e = (self.o.toxic_weight if y else 1.0) * (1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35))) - y)
        g, n = e * x, self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / a * w
        self.n[at] = n + g * g
        self.zb += e - ((self.nb + e * e) ** 0.5 - self.nb**0.5) / a * b
        self.nb += e * e


def learned(options: Ftrl):
    """The Arrow function that turns the fit set into what each coordinate adds to a score, where that is not zero; -1 is the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Codes lie in one array per slice: few large pieces of memory, which go back to the system.
        pieces, rows = [], []
        for batch in batches:
            places, ys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b, data, offsets in W.slices(batch.column(1)):
                code, text = features(data, offsets)
                each = np.unique((text << BITS) | code)
                ends = np.searchsorted(each >> BITS, np.arange(b - a + 1))
                rows += [(places[a + i], ys[a + i], ends[i + 1] - ends[i], len(pieces), ends[i]) for i in range(b - a)]
                pieces.append((each & ((1 << BITS) - 1)).astype(np.int32))
        rows.sort()
        model = Learner(options)
        for _ in range(options.epochs):
            for _, y, n, piece, start in rows:
                model.learn(pieces[piece][start : start + n], y)
        del pieces
        some = bool(rows)
        every = np.arange(1 << BITS)
        found = model.weights(every) * model.values(every) if some else np.zeros(0)
        at, bias = np.flatnonzero(found), model.bias() if some else 0.0
        weights = found[at]
        del model, every, found, rows
        W.release()
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int64)), pa.array(np.append(weights, bias))], names=["code", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, options: Ftrl = Ftrl(), label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text"):
    """(codes, weights, bias), or None where no row is labelled. The fit set is :func:`rillflow.llm.labelled.fit_rows`."""
    ship(docs.sparkSession)
    with scope():
        rows = fit_rows(docs, labels, label_col, options.max_rows, id_col, text_col, options.max_bytes).repartition(1)
        found = rows.mapInArrow(W.tidy(learned(options)), "code long, weight double").toPandas()
    if not len(found):
        return None
    codes, weights = found["code"].to_numpy(), found["weight"].to_numpy()
    return codes[codes >= 0], weights[codes >= 0], float(weights[codes < 0][0])


def scorer(shared, field: int | None = None):
    """The Arrow function that replaces the first column, the text, by nothing and adds the score.

    ``field``: the first column is a struct, stays, and has the text at that place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = np.zeros(1 << BITS)
        if model:
            table[model[0]] = model[1]
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            texts = batch.column(0) if field is None else batch.column(0).field(field)
            for a, b, data, offsets in W.slices(texts) if model else ():
                code, text = features(data, offsets)
                some = table[code] != 0
                each = np.unique((text[some] << BITS) | code[some])
                total = np.bincount(each >> BITS, weights=table[each & ((1 << BITS) - 1)], minlength=b - a)
                scores[a:b] = 1 / (1 + np.exp(-np.clip(total + model[2], -35, 35)))
            skip = int(field is None)
            yield pa.RecordBatch.from_arrays([*batch.columns[skip:], pa.array(scores)], names=[*batch.schema.names[skip:], "score"])

    return run


def score(docs: DataFrame, model, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` and ``score`` (0 to 1).

    Null and empty texts get the bias alone; whole texts are scored, however long; equal texts score alike, repeated
    rows stay, an empty table stays empty; without a model all scores are 0. A column named ``score`` among
    ``columns`` is replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in columns if c != "score"]
    picked = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    return picked.mapInArrow(W.tidy(scorer(shared)), T.StructType([*picked.schema.fields[1:], T.StructField("score", T.DoubleType())])).toDF(*names, "score")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, options: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay, whatever their names.

    Rows are judged one by one by their whole text: null and empty texts by the bias alone, repeated rows alike. An
    empty table stays empty; without labels nothing goes.
    """
    model = fit(docs, labels, options, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text_col)
    scored = row.mapInArrow(W.tidy(scorer(shared, at)), T.StructType([*row.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.where(F.col("score") < threshold).select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame, options: Ftrl = Ftrl()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    scored = score(docs, fit(docs, labels, options), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
