"""Merkle manifest of a dataset: a digest per row, a tree per part, a tree over the parts, and a proof per row.

A leaf is the hash of a row's fields. The leaves of a part, in the order of their ids, are hashed in runs of
``fanout`` neighbours, and so on, until one node is left, the part's subroot; the subroots, in the order of the
parts, give the root in the same way. A proof holds the other nodes of every run on the way from a leaf to
the root, so that one row can be checked against the root without the rest.

No task sees a whole part. Leaves are hashed by Spark where the texts are read, and narrow rows are numbered by
a range sort. Aligned blocks of ``fanout ** k`` leaves (1,024 at most) are packed into rows; a block's digests
are one contiguous numpy matrix of 64 hex digits a row, which is reshaped by the fan-out and hashed level by level.
Roots of blocks are the leaves of the next round, so that there are ``log(rows) / log(1024)`` rounds. Then paths go
down again: a block adds the siblings within it, found by index arithmetic, to the path from its root up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import materialise, numbered, scope, stratum
from rillflow.session import ship

HEX = 64
#: Leaves of a block, at most.
BLOCK = 1024


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value in UTF-8, ``:`` and the value."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row with these values."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def block_levels(fanout: int, block: int = BLOCK) -> int:
    """Levels within a block: at least one, and no more than ``block`` leaves."""
    k = 1
    while fanout ** (k + 1) <= block:
        k += 1
    return k


def counts(n: int, fanout: int) -> list[int]:
    """Nodes of each level above n leaves, the leaves' own left out; none for a lone leaf."""
    out = []
    while n > 1:
        n = -(-n // fanout)
        out.append(n)
    return out


def hash_levels(digests: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    """``digests`` (a row of 64 hex digits each) and the ``levels`` levels above them."""
    out = [digests]
    for _ in range(levels):
        rows, full = out[-1], len(out[-1]) // fanout
        runs = list(rows[: full * fanout].reshape(full, fanout * HEX))
        if full * fanout < len(rows):
            runs.append(rows[full * fanout :].reshape(-1))
        above = "".join([hashlib.sha256(r).hexdigest() for r in runs])
        out.append(np.frombuffer(above.encode(), np.uint8).reshape(-1, HEX))
    return out


def siblings(levels: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """(digests, there) of the siblings of all leaves, by level and from left to right: leaves x places x 64, leaves x places."""
    at, digests, there = np.arange(len(levels[0])), [], []
    for nodes in levels[:-1]:
        own = at % fanout
        other = np.arange(fanout - 1)[None, :]
        index = (at - own)[:, None] + other + (other >= own[:, None])
        there.append(index < len(nodes))
        digests.append(nodes[np.minimum(index, len(nodes) - 1)])
        at = at // fanout
    if not digests:
        return np.zeros((len(at), 0, HEX), np.uint8), np.zeros((len(at), 0), bool)
    return np.concatenate(digests, 1), np.concatenate(there, 1)


def matrix(cell: pa.ListScalar) -> np.ndarray:
    """The digests of a list of strings as one matrix."""
    values = cell.values
    _, offsets, data = values.buffers()
    first = np.frombuffer(offsets, np.int32 if pa.types.is_string(values.type) else np.int64)[values.offset]
    return np.frombuffer(data, np.uint8)[first : first + HEX * len(values)].reshape(-1, HEX)


def upward(fanout: int, k: int):
    """Blocks (part, block, n, digests) to the nodes above them (part, pos, digest, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, block, n, digests = batch.columns
            tops = []
            for i in range(batch.num_rows):
                levels = min(k, len(counts(n[i].as_py(), fanout)))
                tops.append(hash_levels(matrix(digests[i]), fanout, levels)[-1].tobytes().decode())
            width = fanout**k
            above = pa.array([-(-c // width) for c in n.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part, block, pa.array(tops, pa.string()), above], names=["part", "pos", "digest", "n"])

    return run


def downward(fanout: int, k: int):
    """Blocks (n, block, digests, proof of the block's root, lists.., plain columns..) to rows: pos, digest, proof, the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, block, digests, above = batch.columns[:4]
            for i in range(batch.num_rows):
                own = matrix(digests[i])
                inner, there = siblings(hash_levels(own, fanout, min(k, len(counts(n[i].as_py(), fanout)))), fanout)
                upper = np.frombuffer(above[i].as_py().encode(), np.uint8).reshape(1, -1, HEX)
                m = len(own)
                path = np.concatenate([inner, np.broadcast_to(upper, (m, upper.shape[1], HEX))], 1)
                there = np.concatenate([there, np.ones((m, upper.shape[1]), bool)], 1)
                ends = np.zeros(m + 1, np.int32)
                np.cumsum(there.sum(1) * HEX, out=ends[1:])
                proof = pa.StringArray.from_buffers(m, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(path[there])))
                pos = pa.array(block[i].as_py() * fanout**k + np.arange(m), pa.int64())
                rest = [c[i].values if pa.types.is_list(c.type) else pa.repeat(c[i], m) for c in batch.columns[4:]]
                yield pa.RecordBatch.from_arrays([pos, digests[i].values, proof, *rest], names=["pos", "digest", "proof", *batch.schema.names[4:]])

    return run


def climb(nodes: DataFrame, fanout: int, k: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The packed blocks of every round, lowest first, and (part, pos, digest, n) with one node a part. ``nodes``: part, pos, digest, n, carried."""
    most, rounds = nodes.agg(F.max("n")).first()[0] or 0, []
    while not rounds or most > 1:
        rows = F.struct("pos", "digest", *carried) if not rounds else F.struct("pos", "digest")
        block = F.expr(f"pos div {fanout**k}")
        packed = nodes.groupBy("part", block.alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(rows)).alias("x"))
        lists = [F.col(f"x.{c}").alias(c) for c in ("digest", *(carried if not rounds else []))]
        rounds.append(materialise(packed.select("part", "block", "n", *lists), "merkle-blocks"))
        nodes = rounds[-1].select("part", "block", "n", "digest").mapInArrow(upward(fanout, k), "part string, pos long, digest string, n long")
        most = -(-most // fanout**k)
    return rounds, materialise(nodes, "merkle-tops")


def descend(rounds: list[DataFrame], tops: DataFrame, fanout: int, k: int, info: list[str]) -> DataFrame:
    """(part, pos, digest, proof, n, carried, info) of the nodes of the lowest round. ``tops``: part, pos, proof, info."""
    for packed in reversed(rounds):
        above = tops.select("part", F.col("pos").alias("block"), "proof", *info)
        met = packed.join(above, ["part", "block"])
        more = [c for c in packed.columns if c not in ("part", "block", "n", "digest")]
        met = met.select("n", "block", "digest", "proof", *more, "part", F.col("n").alias("of"), *info)
        kinds = {c: met.schema[c].dataType.elementType if c in more else met.schema[c].dataType for c in met.columns[4:]}
        out = ", ".join(["pos long", "digest string", "proof string", *[f"{c} {t.simpleString()}" for c, t in kinds.items()]])
        tops = met.mapInArrow(downward(fanout, k), out)
    return tops


def manifest(
    docs: DataFrame, fields: list[str], part_col: str = "lang", id_col: str = "doc_id", fanout: int = 2, block: int = BLOCK, **carried: Column
) -> DataFrame:
    """Per row of ``docs``: id, part (as text), leaf, subroot, root, proof, pos, n, top_pos, n_tops, and the text columns ``carried``.

    ``proof`` is the siblings' digests one after another, lowest level first, each run from left to right without the
    node itself; ``pos`` of ``n`` leaves of the part and ``top_pos`` of ``n_tops`` subroots say on which side of it they
    stand. Leaves ascend by id, null first, rows of one id by leaf; equal leaves may stand in either order, which is
    the same tree. A null part is a part of its own, before all others; parts are in the order of their bytes. A null
    field hashes other than an empty one. Whole texts are hashed, whatever their length. A lone leaf is its part's
    subroot; an empty table has no rows and no root. Ids and parts of any type that casts to text; other
    columns of ``docs`` are not read, whatever their names.
    """
    ship(docs.sparkSession)
    k, own = block_levels(fanout, block), list(carried)
    col = lambda c: F.col(f"`{c}`")
    leaves = docs.select(stratum(col(part_col)).alias("part"), col(id_col).alias("id"), leaf(*[col(c) for c in fields]).alias("digest"), *[v.alias(f"c_{c}") for c, v in carried.items()])
    with scope() as kept:
        # The last key parts a third of all rows that are wholly equal.
        nodes = numbered(leaves, [F.col("id"), F.col("digest"), F.rand(3)])
        rounds, subroots = climb(nodes, fanout, k, ["id", *[f"c_{c}" for c in own]])
        parts = subroots.select(F.col("part").alias("name"), "digest", F.lit("").alias("part"))
        above, roots = climb(numbered(parts, [F.col("name")]), fanout, k, ["name"])
        first = roots.select("part", "pos", F.lit("").alias("proof"), F.col("digest").alias("root"))
        top = descend(above, first, fanout, k, ["root"])
        names = [F.col("name").alias("part"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), F.col("pos").alias("top_pos"), F.col("of").alias("n_tops")]
        tops = materialise(top.select("proof", "root", *names), "merkle-parts")
        kept += [*rounds, tops]
    out = descend(rounds, tops, fanout, k, ["subroot", "root", "top_pos", "n_tops"])
    part = F.when(F.col("part") != "n", F.expr("substring(part, 2)"))
    names = [F.col("digest").alias("leaf"), "subroot", "root", "proof", "pos", F.col("of").alias("n"), "top_pos", "n_tops"]
    return out.select(F.col("id").alias(id_col), part.alias("part"), *names, *[F.col(f"c_{c}").alias(c) for c in own])


def fold(leaf: str, proof: str, places: list[tuple[int, int]]) -> str:
    """The root that a leaf and its siblings give; places: siblings to the left and to the right, by level."""
    at = 0
    for left, right in places:
        mid, end = at + HEX * left, at + HEX * (left + right)
        leaf = hashlib.sha256((proof[at:mid] + leaf + proof[mid:end]).encode()).hexdigest()
        at = end
    return leaf


def sides(pos: int, n: int, fanout: int) -> list[tuple[int, int]]:
    """Siblings to the left and to the right of leaf ``pos`` of ``n``, by level."""
    out = []
    while n > 1:
        first = pos // fanout * fanout
        out.append((pos - first, min(first + fanout, n) - pos - 1))
        pos, n = pos // fanout, -(-n // fanout)
    return out


def folder(fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, proofs, pos, n, top_pos, n_tops = (c.to_pylist() for c in batch.columns[:6])
            roots = [
                fold(leaf, proof, sides(p, m, fanout) + sides(q, t, fanout))
                for leaf, proof, p, m, q, t in zip(leaves, proofs, pos, n, top_pos, n_tops, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[6:], pa.array(roots, pa.string())], names=[*batch.schema.names[6:], "folded_root"])

    return run


def verify(proofs: DataFrame, leaf_col: str = "leaf", fanout: int = 2) -> DataFrame:
    """``proofs`` (of :func:`manifest`) with ``folded_root``, recomputed from ``leaf_col`` and the siblings, and ``verified``: whether it is the root.

    No shuffle; a row costs a hash per level.
    """
    ship(proofs.sparkSession)
    used = [F.col(c).alias(f"__{i}") for i, c in enumerate((leaf_col, "proof", "pos", "n", "top_pos", "n_tops"))]
    out = T.StructType([*proofs.schema.fields, T.StructField("folded_root", T.StringType())])
    return proofs.select(*used, *[F.col(f"`{c}`") for c in proofs.columns]).mapInArrow(folder(fanout), out).withColumn("verified", F.col("folded_root") == F.col("root"))
