"""Balancing sequences by work: exact partitioners for a batch, and for whole tables a deal over the histogram of lengths and a serpentine one."""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.batch import index_within, row_index
from rillflow.scratch import materialise
from rillflow.session import ship


def workload(length: Column) -> Column:
    """24576 L + L squared: linear layers and attention of a 7B decoder."""
    return 24576 * length.cast("long") + length.cast("long") * length.cast("long")


def largest_differences(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """k sets of places with sums close to each other (largest differencing); ``equal``: with as many places each.

    A state is k sets by falling sum; the two states of the greatest spread are merged, the heaviest set of one
    with the lightest of the other. With ``equal`` the states start from k items each, so that sizes agree.
    """
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    ticket, heap = count(), []

    def push(sets: list[tuple[int, list[int]]]) -> None:
        sets.sort(key=lambda s: (-s[0], s[1]))
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], next(ticket), sets))

    if equal:
        if len(lengths) % k:
            raise ValueError(f"{len(lengths)} sequences are no multiple of {k}")
        for a in range(0, len(order), k):
            push([(lengths[i], [i]) for i in order[a : a + k]])
    else:
        for i in order:
            push([(lengths[i], [i])] + [(0, []) for _ in range(k - 1)])
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        push([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))])
    return [s for _, s in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Each place in turn to the lightest set; ``equal`` adds a bias of the whole sum per item, so that counts level first."""
    bias = sum(lengths) + 1 if equal else 0
    sets: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, j) for j in range(k)]
    for i, n in enumerate(lengths):
        total, j = heapq.heappop(heap)
        sets[j].append(i)
        heapq.heappush(heap, (total + n + bias, j))
    if equal and any(len(s) * k != len(lengths) for s in sets):
        raise ValueError(f"{len(lengths)} sequences are no multiple of {k}")
    return sets


def balanced(lengths: list[int], k: int, equal: bool = False, method=largest_differences) -> list[list[int]]:
    """Partitions in which every place is once, none is empty, and places ascend."""
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} sequences for {k} partitions")
    parts = [sorted(p) for p in method(lengths, k, equal)]
    if any(not p for p in parts) or sorted(i for p in parts for i in p) != list(range(len(lengths))):
        raise ValueError("a partition is empty or a sequence is lost")
    return parts


def micro_batches(lengths: list[int], max_tokens: int, least: int | None = None, divisible_by: int | None = None, interleave: bool = True) -> list[list[int]]:
    """As few micro-batches of at most ``max_tokens`` as sums allow, of balanced work, heavy ones in the middle.

    Their number is ceil(sum / max_tokens), at most one per sequence, at least ``least``, rounded up to
    a multiple of ``divisible_by``.
    """
    if max(lengths, default=0) > max_tokens:
        raise ValueError("a sequence is longer than a micro-batch")
    n = min(len(lengths), -(-sum(lengths) // max_tokens))
    n = max(n, least or 1)
    if divisible_by:
        n = -(-n // divisible_by) * divisible_by
    work = [24576 * x + x * x for x in lengths]
    parts = balanced(work, n)
    if interleave:
        parts.sort(key=lambda p: (sum(work[i] for i in p), p[0]), reverse=True)
        parts = parts[::2][::-1] + parts[1::2]
    return parts


def inverse(order: list[int]) -> list[int]:
    out = [0] * len(order)
    for at, i in enumerate(order):
        out[i] = at
    return out


def data_parallel(lengths: list[int], ranks: int, minibatch: int | None = None) -> list[list[int]]:
    """Equal counts per rank; within a rank light sequences stand at both ends.

    ``minibatch``: every so many sequences are dealt by themselves, so that each rank has its equal share of each; what
    is left over behind the last whole mini-batch is not dealt.
    """
    work = [24576 * x + x * x for x in lengths]
    parts: list[list[int]] = [[] for _ in range(ranks)]
    size = minibatch or len(work)
    for start in range(0, len(work) // size * size if size else 0, max(size, 1)):
        for rank, part in enumerate(balanced(work[start : start + size], ranks, equal=True)):
            parts[rank] += [start + i for i in part]
    out = []
    for part in parts:
        part = sorted(part, key=lambda i: (work[i], i))
        out.append(part[::2] + part[1::2][::-1])
    return out


def assign(df: DataFrame, batch: str, row: str, length: str, split) -> DataFrame:
    """(batch, row, part, place): a batch's rows dealt by ``split(lengths) -> lists of places``. A batch is a few thousand rows at most."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        rows = pdf[row].tolist()
        out = [(pdf[batch].iloc[0], rows[i], p, at) for p, part in enumerate(split(pdf[length].tolist())) for at, i in enumerate(part)]
        return pd.DataFrame(out, columns=[batch, row, "part", "place"])

    ship()
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (batch, row))
    return df.select(batch, row, length).groupBy(batch).applyInPandas(run, f"{kinds}, part int, place int")


def restore(df: DataFrame, key: str = "row_idx") -> DataFrame:
    return df.orderBy(key)


def serpentine(df: DataFrame, length: str, k: int, key: str, name: str = "part") -> DataFrame:
    """Rows by falling work dealt 0..k-1, k-1..0, and so on: for tables of any size, in one sort."""
    indexed = row_index(df, [workload(F.col(length)).desc(), F.col(key)], "__i")
    place = F.pmod("__i", F.lit(2 * k))
    return indexed.withColumn(name, F.when(place < k, place).otherwise(2 * k - 1 - place).cast("int")).drop("__i")


#: Parts that a histogram is dealt to at a time: a step per length looks at the loads of all parts.
MOST_PARTS = 1 << 16


def loads_of(counts: list[tuple[int, int]], parts: int, equal: bool = False) -> tuple[list[tuple[int, int, list[int]]], np.ndarray]:
    """([(length, rows that every part gets, parts that get one more)], load of each part) for counts of rows by length.

    Every part gets the same rows of a length as far as they go; what is left goes, from the greatest length down, to the
    parts that are lightest so far, or with ``equal`` to the lightest of those with the fewest rows.
    """
    load, rows, out = np.zeros(parts), np.zeros(parts, np.int64), []
    for length, n in sorted(counts, reverse=True):
        every, left = divmod(n, parts)
        order = np.lexsort((load, rows)) if equal else np.argsort(load, kind="stable")
        extra = order[:left]
        load += every * length
        load[extra] += length
        rows[extra] += 1
        out.append((length, every, extra.tolist()))
    return out, load


def deal(df: DataFrame, length: str, parts: int, key: str, name: str = "part", equal: bool = False) -> DataFrame:
    """Rows of a table of any size dealt to ``parts`` with loads (sums of ``length``) as even as the greatest-first rule makes them.

    Only a histogram is solved, a row per distinct length; rows are numbered within their length, in the order of ``key``, and
    their number says where they go. ``equal``: counts of parts differ by one at most. Null lengths count as 0.
    """
    if not 0 < parts <= MOST_PARTS:
        raise ValueError(f"1 to {MOST_PARTS} parts")
    spark, own = df.sparkSession, F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long"))
    sized = df.withColumn("__size", own)
    counts = [(r[0], r[1]) for r in sized.groupBy("__size").count().collect()]
    plan, _ = loads_of(counts, parts, equal)
    table = pa.table({"__len": pa.array([p[0] for p in plan], pa.int64()), "__every": pa.array([p[1] for p in plan], pa.int64()), "__extra": pa.array([p[2] for p in plan], pa.list_(pa.int32()))})
    where = materialise(spark.createDataFrame(table), "parts-of-lengths")
    # At most (parts - 1) places a length.
    where = F.broadcast(where) if sum(len(p[2]) for p in plan) <= 1 << 22 else where.hint("merge")
    numbered = index_within(sized, ["__size"], [key], "__i")
    over = F.col("__i") - F.col("__every") * parts
    part = F.when(over < 0, F.pmod("__i", F.lit(parts))).otherwise(F.get("__extra", over.cast("int"))).cast("int")
    return numbered.join(where, F.col("__size") == F.col("__len")).withColumn(name, part).drop("__size", "__i", "__len", "__every", "__extra")


def table_micro_batches(df: DataFrame, length: str, max_tokens: int, key: str, group_rows: int = 4096) -> DataFrame:
    """(group, key, part, place): a whole table in micro-batches of balanced work, of about ``max_tokens`` tokens as :func:`micro_batches` makes them.

    The histogram deals rows to groups of like lengths, about ``group_rows`` each, and each group is divided by itself.
    """
    groups = max(1, -(-df.count() // group_rows))
    dealt = deal(df.select(key, F.col(length).cast("long").alias(length)), length, groups, key, "group")
    return assign(dealt, "group", key, length, lambda lengths: micro_batches(lengths, max_tokens))


def least_loaded(df: DataFrame, request: str, order: list[str], servers: int, name: str = "server") -> DataFrame:
    """A server for each request id, the same for every turn: ids go, in the order of their first turn, to the server that has had the fewest.

    As no id ever leaves, that is a deal in turn: the place of the id's first turn among first turns, modulo ``servers``.
    """
    first = df.groupBy(F.col(request).alias("__id")).agg(F.min(F.struct(*order)).alias("__first"))
    placed = row_index(first, ["__first", "__id"], "__i").select("__id", F.pmod("__i", F.lit(servers)).cast("int").alias(name))
    return df.join(placed, F.col(request).eqNullSafe(F.col("__id"))).drop("__id")


def sticky(request: Column, servers: int) -> Column:
    """A server for a request id, the same for every turn."""
    return F.pmod(F.xxhash64(request), F.lit(servers)).cast("int")
