"""Alignment of two tokenizers: which tokens of one cover the bytes that tokens of the other cover.

A byte-level tokenizer (A) and a piece tokenizer (B) cut the same bytes, a space and the text, in different
places. Byte offsets where both cut part the tokens into groups; every A token is linked with every B token of its group.

Groups come from a dangling-suffix transducer. Its state is the side that leads and the bytes by which it
does; the other side's next token shortens them, or takes the lead with what it has more; without a rest the group
closes. A transition depends on the rest and the token alone and is kept, so that no bytes are compared twice. Rests are
suffixes of tokens, hence there are no more states than vocabularies have suffixes.

Neither tokenizer looks across a single space between two other characters: A's pattern ends a word there, and
no piece of B has a space after another character (tested when it is loaded; otherwise whole texts are encoded).
Texts are cut there, and what a segment gives is kept while memory for it lasts; a segment is as long as it likes.

The corpus counts in how many documents a pair of ids is linked. Documents carry their distinct pairs to that sum, and
meet the counts again: those of the pairs that most documents hold in a broadcast of at most ``max_pairs`` rows,
the others in a join by pair, where by then no key has many rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import words as W
from rillflow.llm.common import materialise, scope
from rillflow.session import ship

#: A single space that no white space touches.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of segments and their results that a worker keeps, roughly.
KEEP_BYTES = 160 << 20
#: Pairs of a document that are put together at a time.
PAIRS = 1 << 21
#: Segments that are encoded at a time.
RUN = 64
#: Pairs of a segment from which on they are not written out but kept as groups.
WIDE = 1 << 14


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A, from the content of its file. Special tokens' strings are plain text."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_str(content.decode())
        self.model.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        kind = json.loads(content).get("pre_tokenizer") or {}
        self.cuts = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B, from the content of its file; it puts a space before a text by itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class State(dict):
    """A state of the transducer: which side is to go on (0: A), the other's bytes beyond it, and where its tokens lead."""

    __slots__ = ("machine", "side", "rest")

    def __init__(self, machine: Transducer, side: int, rest: bytes):
        self.machine, self.side, self.rest = machine, side, rest

    def __missing__(self, token: int) -> State:
        own, rest = self.machine.sides[self.side][token], self.rest
        if not own:
            found = self
        elif rest.startswith(own):
            found = self.machine.state(self.side, rest[len(own) :])
        elif own.startswith(rest):
            found = self.machine.state(1 - self.side, own[len(rest) :])
        else:
            raise ValueError("the tokens are not of the same bytes")
        self[token] = found
        return found


class Transducer:
    def __init__(self, a: list[bytes], b: list[bytes]):
        self.sides, self.states = (a, b), {}
        self.empty = State(self, 0, b"")

    def state(self, side: int, rest: bytes) -> State:
        if not rest:
            return self.empty
        key = side, rest
        if key not in self.states:
            self.states[key] = State(self, side, rest)
        return self.states[key]

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """The ends of the groups: so many A and B tokens end where both do."""
        empty, out, i, j, n = self.empty, [], 0, 0, len(a)
        while i < n:
            state = empty[a[i]]
            i += 1
            while state is not empty:
                if state.side:
                    state = state[b[j]]
                    j += 1
                else:
                    state = state[a[i]]
                    i += 1
            out.append((i, j))
        return out


def product(a: list[int], b: list[int], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, times) of all links between two groups of ids; a pair is a * wide + b."""
    ua, ca = np.unique(np.asarray(a, np.int64), return_counts=True)
    ub, cb = np.unique(np.asarray(b, np.int64), return_counts=True)
    return (ua[:, None] * wide + ub).reshape(-1), (ca[:, None] * cb).reshape(-1)


@dataclass(slots=True, eq=False)
class Found:
    """What a segment gives; ``times`` only where a pair is linked in another number than it stands in ``pairs``, ``groups`` only where its pairs are too many to keep."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    text: str = ""
    pairs: list[int] = field(default_factory=list)
    times: list[int] | None = None
    groups: list[tuple[list[int], list[int]]] | None = None


class Aligner:
    """Encodes, aligns and remembers segments; one per Python worker."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.machine = Transducer(self.a.bytes, self.b.bytes)
        self.wide = len(self.b.bytes)
        self.sizes = [np.array([len(x) for x in table]) for table in (self.a.bytes, self.b.bytes)]
        self.names = [str(i) for i in range(max(len(self.a.bytes), self.wide))]
        self.cuts = self.a.cuts and self.b.cuts
        self.kept: dict[str, Found | None] = {}
        self.older: dict[str, Found | None] = {}
        self.held = 0

    def segments(self, text: str) -> list[str]:
        """The segments of a space and the text, each without the space that it starts with."""
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def learn(self, segments: list[str]) -> None:
        """Segments that white space neither begins nor ends are encoded many at a time, as the text that they make in a row."""
        plain, others = [], []
        for s in segments:
            (plain if self.cuts and s and not s[0].isspace() and not s[-1].isspace() else others).append(s)
        runs = [plain[i : i + RUN] for i in range(0, len(plain), RUN)] + [[s] for s in others]
        texts = [" ".join(r) for r in runs]
        for run, text, a, b in zip(runs, texts, self.a.encode(texts), self.b.encode(texts), strict=True):
            whole = (" " + text).encode()
            if b"".join(map(self.a.bytes.__getitem__, a)) == whole == b"".join(map(self.b.bytes.__getitem__, b)):
                i = j = 0
                ends = np.cumsum([len(s.encode()) + 1 for s in run])
                for seg, k, m in zip(run, self.upto(a, 0, ends), self.upto(b, 1, ends), strict=True):
                    self.keep(seg, self.align(a[i:k], b[j:m]))
                    i, j = k, m
            elif len(run) == 1:
                self.keep(run[0], None)
            else:
                for seg in run:
                    self.learn([seg])

    def upto(self, ids: list[int], side: int, ends: np.ndarray) -> list[int]:
        """How many of the tokens lie before each of the byte offsets, at all of which a token ends."""
        return (np.searchsorted(np.cumsum(self.sizes[side][ids]), ends) + 1).tolist()

    def keep(self, seg: str, found: Found | None) -> None:
        self.kept[seg] = found
        self.held += 300 + 2 * len(seg) + (len(found.text) + 40 * len(found.pairs) if found else 0)

    def align(self, a: list[int], b: list[int]) -> Found:
        """Runs the transducer; most groups are of one token on each side."""
        names, wide, empty, shown, pairs, n_links, large = self.names, self.wide, self.machine.empty, [], [], 0, False
        i, j, n = 0, 0, len(a)
        while i < n:
            x, y = a[i], b[j]
            state = empty[x][y]
            if state is empty:
                i += 1
                j += 1
                n_links += 1
                shown.append(names[x] + "|" + names[y])
                pairs.append(x * wide + y)
                continue
            k, m = i + 1, j + 1
            while state is not empty:
                if state.side:
                    state = state[b[m]]
                    m += 1
                else:
                    state = state[a[k]]
                    k += 1
            ga, gb = a[i:k], b[j:m]
            i, j, links = k, m, (k - i) * (m - j)
            n_links += links
            shown.append(",".join([names[x] for x in ga]) + "|" + ",".join([names[y] for y in gb]))
            if links <= 64:
                for x in ga:
                    x *= wide
                    pairs += [x + y for y in gb]
            else:
                large = True
        out = Found(n, len(b), len(shown), n_links, ";".join(shown), pairs)
        return self.large(out, a, b, self.machine.groups(a, b)) if large else out

    def large(self, out: Found, a: list[int], b: list[int], groups: list[tuple[int, int]]) -> Found:
        """With large groups: a group's distinct pairs and how often each, or the groups themselves where they are too many to keep."""
        parts, i, j = [], 0, 0
        for k, m in groups:
            parts.append((a[i:k], b[j:m]))
            i, j = k, m
        out.pairs = []
        if sum(len(set(ga)) * len(set(gb)) for ga, gb in parts) > WIDE:
            out.groups = parts
            return out
        each = [product(ga, gb, self.wide) for ga, gb in parts]
        out.pairs = [p for pairs, _ in each for p in pairs.tolist()]
        out.times = [t for _, times in each for t in times.tolist()]
        return out

    def slice(self, texts: list[str | None]) -> list[list[Found] | None]:
        """What the segments of each text give; None for texts without tokens.

        Of what is kept, one half is what was met since the other half was full; the rest is let go then.
        """
        if self.held > KEEP_BYTES // 2:
            self.older, self.kept, self.held = self.kept, {}, 0
            if len(self.machine.states) > 1 << 18:
                self.machine = Transducer(self.a.bytes, self.b.bytes)
        cut = [self.cut(t) if t else [] for t in texts]
        unmet = set(chain.from_iterable(cut)) - self.kept.keys()
        if unmet:
            old = unmet & self.older.keys()
            for s in old:
                self.keep(s, self.older[s])
            if new := list(unmet - old):
                self.learn(new)
        found = [list(map(self.kept.__getitem__, segs)) for segs in cut]
        return [x if x and None not in x else None for x in found]

    def cut(self, text: str) -> list[str]:
        first, *rest = self.segments(text)
        return [first[1:], *rest]

    def pairs_of(self, found: list[Found]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(distinct pairs ascending, times), in parts that share no pair; more than one part only for more than :data:`PAIRS`."""
        pairs = np.fromiter(chain.from_iterable([f.pairs for f in found]), np.int64)
        groups = [g for f in found if f.groups is not None for g in f.groups]
        if not groups and not any([f.times for f in found]):
            yield np.unique(pairs, return_counts=True)
            return
        times = np.fromiter(chain.from_iterable([f.times or [1] * len(f.pairs) for f in found]), np.int64)
        if not groups:
            yield total(pairs, times)
            return
        # Parts of the A ids, so that the pairs of a part are about as many as fit; one A id has at most as many as B has ids.
        load = np.zeros(len(self.a.bytes), np.int64)
        np.add.at(load, pairs // self.wide, 1)
        for ga, gb in groups:
            load[list(set(ga))] += len(set(gb))
        part = np.cumsum(load) // PAIRS
        for p in np.unique(part[load > 0]):
            own = part[pairs // self.wide] == p
            each = [(pairs[own], times[own]), *(product([x for x in ga if part[x] == p], gb, self.wide) for ga, gb in groups)]
            yield total(np.concatenate([x for x, _ in each]), np.concatenate([t for _, t in each]))


def total(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, which = np.unique(pairs, return_inverse=True)
    return one, np.bincount(which, weights=times, minlength=len(one)).astype(np.int64)


_aligners: dict[str, Aligner] = {}


def aligner(a: bytes, b: bytes) -> Aligner:
    """One per worker process and pair of tokenizers."""
    key = hashlib.sha256(a + b).hexdigest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(a, b)
    return _aligners[key]


def worker(shared, groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*shared.value)
        gc.disable()  # many small objects are kept, none in a cycle
        for batch in batches:
            texts = batch.column(0)
            for first, end, _, _ in W.slices(texts):
                found = own.slice(texts.slice(first, end - first).to_pylist())
                at, rows = [], {c: [] for c in ("head", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")}
                shown, held = [], 0
                for i, segs in enumerate(found):
                    segs = segs or []
                    text = ";".join([f.text for f in segs])
                    sums = [sum([f.n_a for f in segs]), sum([f.n_b for f in segs]), sum([f.n_groups for f in segs]), sum([f.n_links for f in segs])]
                    for k, (pairs, times) in enumerate(own.pairs_of(segs)):
                        at.append(first + i)
                        for c, v in zip(rows, [k == 0, *sums, hashlib.sha256(text.encode()).hexdigest() if segs else "", pairs, times], strict=True):
                            rows[c].append(v)
                        shown.append(text if k == 0 else None)
                        held += len(pairs)
                        if held > PAIRS:
                            yield emit(batch, at, rows, shown, groups)
                            at, rows, shown, held = [], {c: [] for c in rows}, [], 0
                if at:
                    yield emit(batch, at, rows, shown, groups)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return W.tidy(tidied)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values) if values else [], kind))


def emit(batch: pa.RecordBatch, at: list[int], rows: dict[str, list], shown: list[str | None], groups: bool) -> pa.RecordBatch:
    names = [*batch.schema.names[1:], *rows]
    index = pa.array(at, pa.int64())
    columns = [c.take(index) for c in batch.columns[1:]]
    for c, v in rows.items():
        columns.append(lists(v, pa.int64()) if c in ("pairs", "times") else pa.array(v, pa.bool_() if c == "head" else pa.string() if c == "groups_sha256" else pa.int64()))
    if groups:
        names, columns = [*names, "groups"], [*columns, pa.array(shown, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Written: row, id, head, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times and, where asked for, ``groups``.

    ``pairs`` are the distinct linked ids of the document, A id * B's size + B id, and ``times`` how often each is
    linked; ``groups`` is their text, ``a1,a2|b1;a3|b2,b3``, whose digest is ``groups_sha256``. A document is
    one row, but for those with more than :data:`PAIRS` pairs, whose further rows (``head`` false) hold more of
    them. Null and empty texts, and texts whose tokens don't join to a space and the text, have no tokens, zeros and an
    empty digest. Rows with equal ids or texts are documents of their own; an empty table stays empty; whole texts are
    encoded. Ids may be of any type; other columns are not read.

    The files are read on the driver and broadcast (2 MB): executors need none of them.
    """
    spark = docs.sparkSession
    ship(spark)
    content = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            content.append(f.read())
    shared = spark.sparkContext.broadcast(tuple(content))
    picked = docs.select(F.col(f"`{text_col}`").alias("__text"), F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"))
    kind = picked.schema["id"].dataType.simpleString()
    out = f"row long, id {kind}, head boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    found = picked.mapInArrow(worker(shared, groups), out + (", groups string" if groups else ""))
    # Ids of 50,000 and 32,000 pieces make pairs that fit 32 bits.
    if max_pair(content) < 1 << 31:
        found = found.withColumn("pairs", F.col("pairs").cast("array<int>"))
    return materialise(found, "aligned")


def max_pair(content: list[bytes]) -> int:
    return len(ByteLevel(content[0]).bytes) * len(Pieces(content[1]).bytes)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """Written: (pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more.

    Pairs are summed within tasks before they are shuffled; A's largest counts are a row per id of its vocabulary.
    """
    counts = materialise(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    a = F.expr(f"pair div {b_size}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return materialise(counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def often(counts: DataFrame, max_pairs: int) -> tuple[int, bool]:
    """The least power of two that at most ``max_pairs`` counts reach, and whether others don't; 64 sums come to the driver."""
    by = {r[0]: r[1] for r in counts.groupBy(F.length(F.bin("n"))).count().collect()}
    left, bits = 0, 64
    while bits > 1 and left + by.get(bits - 1, 0) <= max_pairs:
        bits -= 1
        left += by.get(bits, 0)
    return 1 << (bits - 1), left < sum(by.values())


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = 1 << 18) -> DataFrame:
    """Per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``count_sum`` sums, over the document's links, in how many documents of the corpus their pair is linked, and
    ``n_best`` counts the links whose pair is in as many as any of its A id. On nulls, repeated rows and others
    see :func:`align`. At most ``max_pairs`` pairs are broadcast; each of the others is in few documents and met in a join.
    """
    with open(b_path, "rb") as f:
        b_size = len(Pieces(f.read()).bytes)
    with scope() as kept:
        aligned = align(docs, a_path, b_path, id_col, text_col)
        counts = pair_counts(aligned, b_size)
        least, others = often(counts, max_pairs)
        kept += [aligned, counts]
    facts = ["id", "head", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    sums = [F.sum(F.col("time") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("time")).otherwise(0)).alias("n_best")]
    each = aligned.select("row", *facts, F.explode_outer(F.arrays_zip("pairs", "times")).alias("x"))
    each = each.select("row", *facts, F.col("x.pairs").alias("pair"), F.col("x.times").alias("time"))
    heavy = F.broadcast(counts.where(F.col("n") >= least))
    # A document's rows stand together, so that each task sums them up before anything is shuffled.
    many = each.join(heavy, "pair", "left").groupBy("row", *facts).agg(*sums)
    if others:
        few = each.where("pair is not null").join(heavy.select("pair"), "pair", "left_anti").select("row", "pair", "time")
        few = few.join(counts.where(F.col("n") < least).hint("merge"), "pair").groupBy("row").agg(*sums)
        none = [F.lit(None).cast(many.schema[c].dataType).alias(c) for c in facts]
        many = many.unionByName(few.select("row", *none, "count_sum", "n_best"))
    whole = lambda c: F.max(F.when(F.col("head"), F.col(c))).alias(c)
    out = many.groupBy("row").agg(
        F.first(F.when(F.col("head"), F.struct("id")), ignorenulls=True).alias("own"), *[whole(c) for c in facts[2:]], F.coalesce(F.sum("n_best"), F.lit(0)).alias("n_best"), F.coalesce(F.sum("count_sum"), F.lit(0)).alias("count_sum")
    )
    return out.select(F.col("own.id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
