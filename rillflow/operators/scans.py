"""Scans along sequences of any length: recurrences whose steps are maps that compose.

A step takes the state x to f(x), and two steps in a row are again a map of the same kind. So the rows of a range-sorted
table need not pass one task: each partition composes the maps of its rows, the partitions' maps are folded into the state
that each starts with (a row per partition), and a row's state is its own composed map at that start. A sequence
fits no array and no task; one that holds a third of all rows is many partitions.

Kinds of maps, each with the numbers that stand for one:

* :class:`Affine` (d): x to A x + b. Advantages, discounted returns, running sums.
* :class:`MaxPlus` (d): x_i to the greatest of A_ij + x_j and b_i. Token buckets, queues of requests.
* :class:`Clamp`: x to min(max(x + a, lo), hi). Levels and lengths between bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rillflow.functions.masked import double
from rillflow.operators.batch import _LOCAL, _orders
from rillflow.scratch import materialise, scope
from rillflow.session import ship

INF = float("inf")
_MAP = T.ArrayType(T.DoubleType())
#: Rows that are composed side by side, in numpy.
LANES = 128


@dataclass(frozen=True)
class Affine:
    """x to A x + b: the rows of A one after another, then b."""

    d: int = 1

    @property
    def identity(self) -> list[float]:
        return [float(i == j) for i in range(self.d) for j in range(self.d)] + [0.0] * self.d

    def compose(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        """g first, then f; the last axis holds the numbers."""
        d, e = self.d, self.d * self.d
        a, b = f[..., :e].reshape(*f.shape[:-1], d, d), g[..., :e].reshape(*g.shape[:-1], d, d)
        out = np.empty(np.broadcast_shapes(f.shape, g.shape))
        out[..., :e] = np.einsum("...ik,...kj->...ij", a, b).reshape(*out.shape[:-1], e)
        out[..., e:] = np.einsum("...ik,...k->...i", a, g[..., e:]) + f[..., e:]
        return out

    def apply(self, f: list[Column], x: list[Column]) -> list[Column]:
        d = self.d
        return [sum((f[i * d + j] * x[j] for j in range(d)), f[d * d + i]) for i in range(d)]


@dataclass(frozen=True)
class MaxPlus:
    """x_i to max(A_ij + x_j, b_i): the rows of A one after another, then b; minus infinity where nothing counts."""

    d: int = 1

    @property
    def identity(self) -> list[float]:
        return [0.0 if i == j else -INF for i in range(self.d) for j in range(self.d)] + [-INF] * self.d

    def compose(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        d, e = self.d, self.d * self.d
        a, b = f[..., :e].reshape(*f.shape[:-1], d, d), g[..., :e].reshape(*g.shape[:-1], d, d)
        out = np.empty(np.broadcast_shapes(f.shape, g.shape))
        out[..., :e] = (a[..., :, :, None] + b[..., None, :, :]).max(-2).reshape(*out.shape[:-1], e)
        out[..., e:] = np.maximum((a + g[..., None, e:]).max(-1), f[..., e:])
        return out

    def apply(self, f: list[Column], x: list[Column]) -> list[Column]:
        d = self.d
        return [F.greatest(*[f[i * d + j] + x[j] for j in range(d)], f[d * d + i]) for i in range(d)]


@dataclass(frozen=True)
class Clamp:
    """x to min(max(x + a, lo), hi): a, lo, hi."""

    d: int = 1

    @property
    def identity(self) -> list[float]:
        return [0.0, -INF, INF]

    def compose(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        inner = lambda x: np.minimum(np.maximum(x + f[..., 0], f[..., 1]), f[..., 2])
        return np.stack(np.broadcast_arrays(g[..., 0] + f[..., 0], inner(g[..., 1]), inner(g[..., 2])), -1)

    def apply(self, f: list[Column], x: list[Column]) -> list[Column]:
        return [F.least(F.greatest(x[0] + f[0], f[1]), f[2])]


def prefixes(kind, maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each row's map composed with those of the rows before it since the last ``first``; rows lie in lanes that go on side by side."""
    n, width = maps.shape
    length = -(-n // LANES)
    lanes = np.empty((LANES * length, width))
    lanes[:n], lanes[n:] = maps, kind.identity
    starts = np.zeros(LANES * length, bool)
    starts[:n] = first
    lanes, starts = lanes.reshape(LANES, length, width), starts.reshape(LANES, length)
    with np.errstate(invalid="ignore"):
        for i in range(1, length):
            lanes[:, i] = np.where(starts[:, i, None], lanes[:, i], kind.compose(lanes[:, i], lanes[:, i - 1]))
        begun = np.logical_or.accumulate(starts, 1)
        carry = np.empty((LANES, width))
        carry[0] = kind.identity
        for j in range(1, LANES):
            end = lanes[j - 1, -1]
            carry[j] = end if begun[j - 1, -1] else kind.compose(end, carry[j - 1])
        out = np.where(begun[..., None], lanes, kind.compose(lanes, carry[:, None, :]))
    return out.reshape(-1, width)[:n]


def _changes(columns: list[pa.Array], last: list[pa.Scalar] | None) -> np.ndarray:
    """Whether a row's key differs from the row's before it; the first row's from ``last``, which is no row if None."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[0] = last is None
    for i, c in enumerate(columns):
        if n > 1:
            a, b = c[1:], c[:-1]
            differ = pc.fill_null(pc.not_equal(a, b), pa.scalar(False))
            out[1:] |= pc.or_(differ, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
        if last is not None:
            out[0] |= c[0].as_py() != last[i].as_py()
    return out


def _local(kind, keys: int, width: int):
    """Sorted rows (partition, keys.., maps.., others..) to others.., whether the key began in the partition, and the composed maps up to the row and before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, begun, before = None, None, False, None
        identity = np.array(kind.identity)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, own = batch.columns[1 : 1 + keys], batch.column(0)[0].as_py()
            if own != part:  # a task reads one partition of the sort, whose first key may go on from the one before
                part, last, begun, before = own, [c[0] for c in columns], False, identity
            first = _changes(columns, last)
            maps = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1 + keys : 1 + keys + width]], 1).astype(float)
            found, since = prefixes(kind, maps, first), np.logical_or.accumulate(first)
            with np.errstate(invalid="ignore"):
                found = np.where(since[:, None], found, kind.compose(found, before[None]))
            ahead = np.where(first[:, None], identity, np.concatenate([before[None], found[:-1]]))
            whole = since | begun
            before, begun, last = found[-1], bool(whole[-1]), [c[len(c) - 1] for c in columns]
            names = [*batch.schema.names[1 + keys + width :], "__whole", "__map", "__ahead"]
            yield pa.RecordBatch.from_arrays([*batch.columns[1 + keys + width :], pa.array(whole), _rows(found), _rows(ahead)], names=names)

    return run


def _rows(x: np.ndarray) -> pa.ListArray:
    n, width = x.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _chain(kind, start: list[float]):
    """Partitions in order (p, goes_on: whether its first key is the last of the one before, whole, map) to (p, the state its first key starts with)."""
    d = kind.d

    def at(f: np.ndarray, x: np.ndarray) -> np.ndarray:
        constant = np.array(kind.identity)
        if isinstance(kind, Clamp):
            return np.minimum(np.maximum(x + f[0], f[1]), f[2])
        constant[: d * d], constant[d * d :] = (-INF if isinstance(kind, MaxPlus) else 0.0), x
        with np.errstate(invalid="ignore"):
            return kind.compose(f, constant)[d * d :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.array(start)
        for batch in batches:
            out = []
            for goes_on, whole, f in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                begin = state if goes_on else np.array(start)
                out.append(begin.tolist())
                state = at(np.array(f), np.array(start) if whole else begin)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["__p", "__start"])

    return run


def scan(df: DataFrame, keys: list[str], order_by, kind, maps: list[Column], start: list[float], names: list[str], before: bool = False) -> DataFrame:
    """``df`` with the state after each row (or ``before`` it) in the columns ``names``.

    A key's rows are taken in the given order, from the state ``start``; ``maps`` are the numbers of a row's map as
    :class:`Affine`, :class:`MaxPlus` and :class:`Clamp` order them. Rows should differ in key and order, else equal ones may
    change places. Null keys are keys; a null among the numbers makes a map that changes nothing.

    One range sort and one written table, whatever the keys' sizes; what partitions hand on is a row each.
    """
    ship(df.sparkSession)
    width = len(kind.identity)
    if len(maps) != width or len(start) != kind.d or len(names) != kind.d:
        raise ValueError(f"{kind} takes {width} numbers and {kind.d} states")
    some = reduce(lambda a, m: a & m.isNotNull(), maps, F.lit(True))
    numbers = [F.when(some, m.cast("double")).otherwise(double(i)).alias(f"__f{j}") for j, (m, i) in enumerate(zip(maps, kind.identity, strict=True))]
    ordered = df.orderBy(*keys, *_orders(order_by)).withColumn("__m", F.monotonically_increasing_id())
    p, l = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit(_LOCAL))  # noqa: E741
    own, key = [F.col(f"`{c}`") for c in df.columns], F.struct(*keys).alias("__key")
    given = ordered.select(p.alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *numbers, *own, p.alias("__q"), l.alias("__l"), key)
    schema = given.select(*own, "__q", "__l", "__key").schema.add("__whole", "boolean").add("__map", _MAP).add("__ahead", _MAP)
    with scope() as kept:
        rows = materialise(given.mapInArrow(_local(kind, len(keys), width), schema), "scanned")
        end = F.struct("__key", "__whole", "__map")
        ends = rows.groupBy("__q").agg(F.min_by("__key", "__l").alias("a"), F.max_by(end, "__l").alias("z"))
        # One row per partition, a few thousand at most.
        on = F.coalesce(F.lag("z.__key").over(Window.orderBy("__q")) == F.col("a"), F.lit(False))
        ends = ends.select("__q", on.alias("on"), F.col("z.__whole").alias("whole"), F.col("z.__map").alias("map"))
        starts = ends.coalesce(1).sortWithinPartitions("__q").mapInArrow(_chain(kind, start), "__p long, __start array<double>")
        starts = materialise(starts, "starts")
        kept += [rows, starts]
    begin = [F.when(F.col("__whole"), double(s)).otherwise(F.get("__start", F.lit(i))) for i, s in enumerate(start)]
    states = kind.apply([F.get("__ahead" if before else "__map", F.lit(i)) for i in range(width)], begin)
    out = rows.join(F.broadcast(starts), F.col("__q") == F.col("__p"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[s.alias(n) for s, n in zip(states, names, strict=True)])


def running_sums(df: DataFrame, keys: list[str], order_by, sums: dict[str, Column], before: bool = False) -> DataFrame:
    """``df`` with the sums, by name, of each key's rows up to each row (or ``before`` it); null counts as 0."""
    kind = Affine(len(sums))
    values = [F.coalesce(v.cast("double"), double(0)) for v in sums.values()]
    return scan(df, keys, order_by, kind, [double(x) for x in kind.identity[: kind.d**2]] + values, [0.0] * kind.d, list(sums), before)
