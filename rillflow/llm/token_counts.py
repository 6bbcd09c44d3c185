"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes with failure links; every node knows how many pieces are popped
when the link is followed (after the linear-time word-piece matching of Song et al., 2021). Counting
follows links and adds those counts up, so no piece is ever built, and no byte is looked at twice.

Each word ``[^\\x20\\x09-\\x0D]+`` is matched with one leading space, greedily from the left; a word that
the vocabulary cannot cover is one unknown token. The automaton is built on the driver from a
vocabulary file whose path is a parameter, and broadcast (about 3 MB for 50,000 pieces; its size goes
with the vocabulary only). Equal words of a slice are matched once, all of them byte by byte together while
there are many; the few longest ones are walked one by one, so that a word of a whole text costs its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import words as W
from rillflow.session import ship

U64 = np.uint64
NONE = -1
#: So many words left are quicker one by one than together.
FEW = 48


def load_pieces(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie edges in an open-addressed table, failure links and popped counts, all as arrays."""

    def __init__(self, pieces: list[bytes]):
        self._plain = None
        edges: list[dict[int, int]] = [{}]
        last = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                nxt = edges[at].get(byte)
                if nxt is None:
                    nxt = edges[at][byte] = len(edges)
                    edges.append({})
                    last.append(False)
                at = nxt
            if at:
                last[at] = True
        link, popped = [NONE] * len(edges), [0] * len(edges)
        level = [0]
        while level:
            below = []
            for u in level:
                for byte, v in edges[u].items():
                    below.append(v)
                    if last[v]:
                        link[v], popped[v] = 0, 1
                        continue
                    count, z = popped[u], link[u]
                    while z != NONE and byte not in edges[z]:
                        count, z = count + popped[z], link[z]
                    if z != NONE:
                        link[v], popped[v] = edges[z][byte], count
            level = below
        self.link, self.popped = np.array(link, np.int32), np.array(popped, np.int32)
        keys = np.array([(u << 8) | b for u, e in enumerate(edges) for b in e], np.int64)
        to = np.array([v for e in edges for v in e.values()], np.int32)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 2.5 + 1))))
        self.keys, self.to = np.full(1 << self.bits, NONE, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == NONE
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot the last one stays
            won = self.keys[slot] == keys[left]
            self.to[slot[won]] = to[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where each node's edge of its byte leads, or NONE."""
        keys = (nodes.astype(np.int64) << 8) | byte
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.to[slot], NONE)
        left = np.flatnonzero((found != keys) & (found != NONE))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (found != NONE)]
        return out

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each span of ``data`` with a leading space; 1 for a span that cannot be covered."""
        n = len(starts)
        total, node, bad = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)

        def feed(who: np.ndarray, byte: np.ndarray) -> None:
            while len(who):
                nxt = self.step(node[who], byte)
                ok = nxt != NONE
                node[who[ok]] = nxt[ok]
                who, byte = who[~ok], byte[~ok]
                self.follow(who, node, total, bad)
                alive = ~bad[who]
                who, byte = who[alive], byte[alive]

        feed(np.arange(n), np.full(n, 32))
        order = np.argsort(starts - ends, kind="stable")  # the longest first
        length = (ends - starts)[order]
        for k in range(int(length[0]) if n else 0):
            who = order[: np.searchsorted(-length, -k, "left")]
            who = who[~bad[who]]
            if len(who) <= FEW:
                for i in who:
                    node[i], total[i], bad[i] = self.walk(int(node[i]), int(total[i]), data[starts[i] + k : ends[i]].tobytes())
                break
            feed(who, data[starts[who] + k].astype(np.int64))
        who = np.flatnonzero(~bad & (node != 0))
        while len(who):
            self.follow(who, node, total, bad)
            who = who[~bad[who] & (node[who] != 0)]
        return np.where(bad, 1, total)

    def walk(self, node: int, total: int, rest: bytes) -> tuple[int, int, bool]:
        """(node, total, whether the word can't be covered) after the rest of one word."""
        edges, link, popped = self.plain()
        for byte in rest:
            nxt = edges.get(node << 8 | byte)
            while nxt is None:
                total += popped[node]
                node = link[node]
                if node == NONE:
                    return 0, total, True
                nxt = edges.get(node << 8 | byte)
            node = nxt
        return node, total, False

    def plain(self) -> tuple[dict[int, int], list[int], list[int]]:
        """Edges, links and counts as Python objects, made once in a process that needs them."""
        if self._plain is None:
            used = self.keys != NONE
            self._plain = dict(zip(self.keys[used].tolist(), self.to[used].tolist())), self.link.tolist(), self.popped.tolist()
        return self._plain

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_plain": None}

    def follow(self, who: np.ndarray, node: np.ndarray, total: np.ndarray, bad: np.ndarray) -> None:
        at = node[who]
        to = self.link[at]
        bad[who] = to == NONE
        total[who] += self.popped[at]
        node[who] = np.maximum(to, 0)


def counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b, data, offsets in W.slices(batch.column(0), 4 * W.SLICE):
                found = W.find(data, offsets)
                n_words[a:b] = np.diff(found.first)
                _, first, which = np.unique(found.hashes(fold=False), return_index=True, return_inverse=True)
                pieces = automaton.count(data, found.starts[first], found.ends[first])
                n_tokens[a:b] = np.bincount(found.owner(), weights=pieces[which], minlength=b - a)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(n_words), pa.array(n_tokens)], names=[*batch.schema.names[1:], "n_words", "n_tokens"]
            )

    return run


def count_tokens(docs: DataFrame, vocabulary: str | list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of every row. ``vocabulary``: a file's path, or the pieces.

    Null and empty texts have no words; whole texts are read, in time that goes with their length whatever the length
    of their words; repeated rows stay, an empty table stays empty. Ids may be of any type and name but those two; no
    other column is read.
    """
    ship(docs.sparkSession)
    pieces = load_pieces(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))
    picked = docs.select(F.col(f"`{text_col}`").alias("__text"), F.col(f"`{id_col}`").alias("__id"))
    kind = picked.schema["__id"].dataType.simpleString()
    return picked.mapInArrow(W.tidy(counter(shared)), f"__id {kind}, n_words long, n_tokens long").withColumnRenamed("__id", id_col)
