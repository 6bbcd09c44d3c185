"""Sample queues, versions and rate limits: as batch algebra over an ordered log, and as stateful streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillflow.operators import scans
from rillflow.operators.batch import index_within
from rillflow.scratch import materialise, scope
from rillflow.session import ship


def replay(df: DataFrame, key: str, order: list[str], columns: list[str], schema: str, fresh, step, finish=lambda k, state: []) -> DataFrame:
    """Rows of each key, in order, through ``step(key, state, row) -> rows``; the end of a key through ``finish``.

    Keys are dealt to tasks and sorted there, and rows pass in batches: a task holds one batch and one key's state, however
    long the key's log is.
    """
    ship()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0].strip("`") for c in schema.split(", ")]
        current, state, begun = None, None, False
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if not begun or row[0] != current:
                    out += finish(current, state) if begun else []
                    current, state, begun = row[0], fresh(), True
                out += step(current, state, row[1:])
            if out:
                yield pd.DataFrame(out, columns=names)
        if begun and (out := finish(current, state)):
            yield pd.DataFrame(out, columns=names)

    return df.select(key, *columns).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def drop_oldest(df: DataFrame, capacity: int, queue: str = "queue", order: str = "seq", kind: str = "kind") -> DataFrame:
    """What becomes of each ``put`` of an ordered log of puts and gets: (queue, seq, fate), ``got``, ``dropped`` or ``queued``.

    A queue holds ``capacity`` samples, one at least; a put to a full one drops the oldest, a get from an empty one gets nothing; any
    kind but ``put`` is a get. Nothing is replayed: a queue's length is a walk between 0 and its capacity, each step of which is
    a clamp, so that a queue with most of the log is many tasks' work. Samples leave in the order they came, so that
    the n-th get that finds one, or put that finds the queue full, takes the n-th put.
    """
    if capacity < 1:
        raise ValueError("a queue holds one sample at least")
    put = F.col("kind") == "put"
    log = df.select(F.col(queue).alias("queue"), F.col(order).alias("seq"), F.coalesce(F.col(kind), F.lit("")).alias("kind"))
    step = F.when(put, 1.0).otherwise(-1.0)
    walk = scans.scan(log, ["queue"], ["seq"], scans.Clamp(), [step, F.lit(0.0), F.lit(float(capacity))], [0.0], ["held"], before=True)
    with scope() as kept:
        walk = materialise(walk, "queue-lengths")
        kept.append(walk)
    puts = index_within(walk.where(put).select("queue", "seq"), ["queue"], ["seq"], "n")
    fate = F.when(put & (F.col("held") >= capacity), "dropped").when(~put & (F.col("held") > 0), "got")
    left = index_within(walk.select("queue", "seq", fate.alias("fate")).where("fate is not null"), ["queue"], ["seq"], "n")
    left = left.select(F.col("queue").alias("__q"), F.col("n").alias("__n"), "fate")
    out = puts.join(left, F.col("queue").eqNullSafe(F.col("__q")) & (F.col("n") == F.col("__n")), "left")
    return out.select(F.col("queue").alias(queue), F.col("seq").alias(order), F.coalesce("fate", F.lit("queued")).alias("fate"))


def newest(df: DataFrame, capacity: int, queue: str, order: list[str]) -> DataFrame:
    """Of puts alone, what a queue still holds: the last ``capacity`` of each."""
    return index_within(df, [queue], [F.col(c).desc() for c in order], "__n").where(F.col("__n") < capacity).drop("__n")


def queue_statistics(df: DataFrame, queue: str = "queue") -> DataFrame:
    """(produced, consumed, dropped, queued) per queue of the fates."""
    n = lambda f: F.sum((F.col("fate") == f).cast("long"))
    return df.groupBy(queue).agg(F.count(F.lit(1)).alias("produced"), n("got").alias("consumed"), n("dropped").alias("dropped"), n("queued").alias("queued"))


class BoundedQueue(StatefulProcessor):
    """The same as a stream keyed by queue: rows (kind, seq, payload) in, rows (queue, event, seq, payload) out.

    State is the samples held and the counters; rows of a micro-batch are taken in the order of ``seq``.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "seq bigint, payload string")
        self.counts = handle.getValueState("counts", "produced bigint, consumed bigint, dropped bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        produced, consumed, dropped = self.counts.get() if self.counts.exists() else (0, 0, 0)
        held = [(int(s), p) for s, p in self.held.get()] if self.held.exists() else []
        batch = pd.concat(list(rows)).sort_values("seq")
        out = []
        for kind, seq, payload in batch[["kind", "seq", "payload"]].itertuples(index=False):
            if kind == "put":
                produced += 1
                if len(held) >= self.capacity:
                    dropped += 1
                    out.append((key[0], "dropped", *held.pop(0)))
                held.append((int(seq), payload))
            elif held:
                consumed += 1
                out.append((key[0], "got", *held.pop(0)))
        if held:
            self.held.put(held)
        else:
            self.held.clear()
        self.counts.update((produced, consumed, dropped))
        if out:
            yield pd.DataFrame(out, columns=["queue", "event", "seq", "payload"])

    def close(self) -> None:
        pass


def bounded_queue_stream(stream: DataFrame, capacity: int) -> DataFrame:
    """Events of bounded queues from a stream of (queue, kind, seq, payload). Needs the RocksDB state store."""
    ship()
    return stream.groupBy("queue").transformWithStateInPandas(
        BoundedQueue(capacity), outputStructType="queue string, event string, seq bigint, payload string", outputMode="Append", timeMode="None"
    )


def staleness_budget(required: int, threshold: float, sync_steps: int) -> int:
    """How many samples of one parameter version may be in the making."""
    return int(required * (threshold + 1) * sync_steps)


def admitted(df: DataFrame, budget: int, version: str = "param_version", order: list[str] = ("seq",), queue_size: str | None = None, max_queue: int | None = None) -> DataFrame:
    """With ``admitted``: whether generation goes on at a sample: its version's budget is not used up and the queue has room."""
    ok = F.col("__n") < budget
    if queue_size and max_queue is not None:
        ok = ok & (F.col(queue_size) < max_queue)
    return index_within(df, [version], list(order), "__n").withColumn("admitted", ok).drop("__n")


def version_resets(df: DataFrame, order: list[str] = ("seq",), key: str = "stream") -> DataFrame:
    """Rows of kind ``version`` (with ``active``, ``cancelled``, ``queued``) and ``sample``: ``stale``, the count since the last version on top of what it found in flight.

    A version sets the count and a sample adds one: an affine step each, so that a long stream is many tasks' work.
    """
    base = F.coalesce(F.col("active"), F.lit(0)) + F.coalesce(F.col("cancelled"), F.lit(0)) + F.coalesce(F.col("queued"), F.lit(0))
    version = F.col("kind") == "version"
    maps = [F.when(version, 0.0).otherwise(1.0), F.when(version, base).otherwise(1)]
    return scans.scan(df, [key], list(order), scans.Affine(), maps, [0.0], ["stale"]).withColumn("stale", F.col("stale").cast("long"))


def lifecycle(df: DataFrame, sample: str = "sample_id", order: str = "ts") -> DataFrame:
    """Per sample, of an event log (pending, active, cancelled, done): times it ran, was cancelled and its last state."""
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    return df.groupBy(sample).agg(
        n("active").alias("runs"), n("cancelled").alias("cancels"), F.max_by("state", order).alias("state"), F.min(order).alias("first"), F.max(order).alias("last")
    )


def full_batches(df: DataFrame, size: int, key: str, order: list[str]) -> DataFrame:
    """With ``batch``: every ``size`` samples in order; an unfinished batch is left out."""
    t = index_within(df, [key], list(order), "__n").withColumn("batch", F.expr(f"__n div {size}"))
    n = df.groupBy(F.col(key).alias("__k")).agg(F.expr(f"count(1) div {size}").alias("__full"))
    return t.join(n, F.col(key).eqNullSafe(F.col("__k"))).where(F.col("batch") < F.col("__full")).drop("__n", "__k", "__full")


def flush_windows(df: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Long metrics with ``flush``, the count window of ``every`` steps they are reported in."""
    return df.withColumn("flush", F.expr(f"{step} div {every}"))


def token_bucket(df: DataFrame, rate: float, capacity: float, key: str = "key", at: str = "t", tokens: str = "tokens") -> DataFrame:
    """(key, t, tokens, start): when each request may start, requests of a key in order of their times, then tokens.

    The bucket fills at ``rate`` up to ``capacity``; a request larger than the bucket waits until it is full and overdraws it. What
    a request leaves behind is the time at which the bucket was empty, in effect, and the time it started; both are the
    greatest of sums of what it found, its own time and numbers of its own. Such steps compose, so that a hot key's
    requests are many tasks' work. Requests without a time or tokens start never and change nothing.
    """
    n, t = F.col("__n"), F.col("__t")
    src = df.select(key, F.col(at).cast("double").alias("__t"), F.col(tokens).cast("double").alias("__n"))
    over = (n - capacity) / rate
    maps = [n / rate, over, F.least(n, F.lit(float(capacity))) / rate, F.when(n.isNotNull(), 0.0), t + over, t]
    out = scans.scan(src, [key], ["__t", "__n"], scans.MaxPlus(2), maps, [-scans.INF, -scans.INF], ["__empty", "start"])
    return out.select(key, t.alias(at), n.alias(tokens), F.when(t.isNotNull() & n.isNotNull(), F.col("start")).alias("start"))


def backoff(attempt: int, longest: float = 30.0) -> float:
    """Seconds before the next attempt."""
    return min(float(2**attempt), longest)


def ready(fields: list[DataFrame], key: str = "sample_id") -> DataFrame:
    """Samples whose fields have all arrived: streams or tables of (key, field columns), joined on the key."""
    out = fields[0]
    for f in fields[1:]:
        out = out.join(f, key)
    return out


def consumable(fields: list[DataFrame], consumed: DataFrame, task: str, key: str = "sample_id") -> DataFrame:
    """Samples whose fields have all arrived and that a task has not consumed yet; ``consumed`` logs (task, key) of what tasks took."""
    taken = consumed.where(F.col("task") == task).select(F.col(key).alias("__taken"))
    return ready(fields, key).join(taken, F.col(key) == F.col("__taken"), "left_anti")


def until_end(df: DataFrame, payload: str = "payload", queue: str = "queue", order: str = "seq") -> DataFrame:
    """Per queue, the samples before its first end mark, a row whose payload is null; all of them where it has none."""
    ends = df.where(F.col(payload).isNull()).groupBy(F.col(queue).alias("__q")).agg(F.min(order).alias("__end"))
    t = df.join(ends, F.col(queue).eqNullSafe(F.col("__q")), "left")
    return t.where(F.col(payload).isNotNull() & (F.col("__end").isNull() | (F.col(order) < F.col("__end")))).drop("__q", "__end")


def one_step_off(df: DataFrame, batch: str = "batch") -> DataFrame:
    """With ``generated_with``, the parameter version a batch was generated with while the batch before was trained on, and its ``staleness``."""
    version = F.greatest(F.col(batch) - 1, F.lit(0)).cast("long")
    return df.withColumn("generated_with", version).withColumn("staleness", F.col(batch).cast("long") - version)


def scheduled(df: DataFrame, slots: int, sample: str = "sample_id", order: str = "seq", seconds: str = "seconds", key: str = "stream", stops: list[float] = ()) -> DataFrame:
    """(stream, sample, run, start, end, done): samples in order on ``slots`` places at once; at each stop what runs is cancelled and queued again, first in line.

    A stream is a sequence by nature, replayed by one task; its state is the samples that run.
    """
    import heapq

    def fresh() -> dict:
        return {"clock": 0.0, "running": [], "stops": sorted(stops), "again": []}

    def free_slot(name, s: dict, out: list, until_empty: bool = False) -> None:
        """Lets time pass until a slot is free (or all are), queueing again what stops cut off."""
        while s["running"] and (until_empty or len(s["running"]) >= slots):
            end, start, sid, run, length = s["running"][0]
            if s["stops"] and s["stops"][0] < end:
                at = s["stops"].pop(0)
                cut = [r for r in s["running"] if r[1] <= at]
                s["running"] = [r for r in s["running"] if r[1] > at]
                for _, start, sid, run, length in sorted(cut, key=lambda r: (r[1], r[2])):
                    out.append((name, sid, run, start, at, False))
                    s["again"].append((sid, run + 1, length))
                s["clock"] = max(s["clock"], at)
                for sid, run, length in s["again"]:
                    heapq.heappush(s["running"], (s["clock"] + length, s["clock"], sid, run, length))
                s["again"] = []
                heapq.heapify(s["running"])
                continue
            heapq.heappop(s["running"])
            s["clock"] = max(s["clock"], end)
            out.append((name, sid, run, start, end, True))

    def step(name, s: dict, row: tuple) -> list[tuple]:
        out: list[tuple] = []
        _, sid, length = row
        free_slot(name, s, out)
        heapq.heappush(s["running"], (s["clock"] + length, s["clock"], sid, 1, length))
        return out

    def finish(name, s: dict) -> list[tuple]:
        out: list[tuple] = []
        free_slot(name, s, out, True)
        return out

    kind = lambda c: df.schema[c].dataType.simpleString()
    kinds = f"{key} {kind(key)}, {sample} {kind(sample)}, run int, start double, end double, done boolean"
    src = df.select(key, order, sample, F.col(seconds).cast("double").alias(seconds))
    return replay(src, key, [order], [order, sample, seconds], kinds, fresh, step, finish)
