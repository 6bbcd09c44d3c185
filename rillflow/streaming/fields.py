"""Samples whose fields arrive on streams of their own: readiness, consumption per task and end marks, as one stateful stream.

Several streams are brought to one form and united: (key, field, payload, ts) for a field's value, (key, task) for
what a task took, an end mark for a field that will not come any more. The state of a sample is what has arrived and who took it;
it is kept per key by ``transformWithState``, so that samples are spread over tasks, and the checkpoint makes a restart go
on where the stream stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillflow.session import ship

#: What an event of a sample is.
FIELD, TAKEN, END = "field", "taken", "end"
EVENTS = "sample_id string, event string, name string, payload string"
OUT = "sample_id string, task string, event string, fields string"


def arrivals(df: DataFrame, key: str, name: str, payload: Column) -> DataFrame:
    """Events of one field's stream or table: a null payload is its end mark, after which the field is not waited for."""
    event = F.when(payload.isNull(), END).otherwise(FIELD)
    return df.select(F.col(key).cast("string").alias("sample_id"), event.alias("event"), F.lit(name).alias("name"), payload.cast("string").alias("payload"))


def taken(df: DataFrame, key: str, task: str) -> DataFrame:
    """Events of a log of (key, task): a task took a sample by other means."""
    return df.select(F.col(key).cast("string").alias("sample_id"), F.lit(TAKEN).alias("event"), F.col(task).alias("name"), F.lit(None).cast("string").alias("payload"))


def united(*events: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, events)


class Readiness(StatefulProcessor):
    """Rows (sample, task, event, fields as JSON): ``ready`` once per sample and task when the task's fields are there, ``late`` when the time is over.

    ``tasks`` names the fields that each task reads. A field with an end mark counts as there, without a value. A sample that
    has not been given to every task ``late_ms`` after its first event is reported for those that still wait, with what there is, and
    forgotten: what comes afterwards begins a new one.
    """

    def __init__(self, tasks: dict[str, list[str]], late_ms: int | None):
        self.tasks, self.late_ms = tasks, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "name string", "payload string")
        self.done = handle.getMapState("done", "task string", "at string")
        self.begun = handle.getValueState("begun", "seen int")

    def _held(self) -> dict[str, str | None]:
        return {k[0]: v[0] for k, v in self.values.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.begun.exists():
            self.begun.update((1,))
            if self.late_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.late_ms)
        for batch in rows:
            for event, name, payload in batch[["event", "name", "payload"]].itertuples(index=False):
                if event == TAKEN:
                    self.done.updateValue((name,), (TAKEN,))
                elif event == FIELD:  # a repeated field: the last value of the stream counts
                    self.values.updateValue((name,), (payload,))
                elif not self.values.containsKey((name,)):
                    self.values.updateValue((name,), (None,))
        held, out = self._held(), []
        for task, fields in self.tasks.items():
            if all(f in held for f in fields) and not self.done.containsKey((task,)):
                self.done.updateValue((task,), ("ready",))
                out.append((key[0], task, "ready", json.dumps({f: held[f] for f in fields}, sort_keys=True)))
        if out:
            yield pd.DataFrame(out, columns=["sample_id", "task", "event", "fields"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        out = [(key[0], t, "late", json.dumps({f: held[f] for f in fields if f in held}, sort_keys=True)) for t, fields in self.tasks.items() if not self.done.containsKey((t,))]
        self.values.clear()
        self.done.clear()
        self.begun.clear()
        if out:
            yield pd.DataFrame(out, columns=["sample_id", "task", "event", "fields"])

    def close(self) -> None:
        pass


def readiness_stream(events: DataFrame, tasks: dict[str, list[str]], late_ms: int | None = None) -> DataFrame:
    """(sample_id, task, event, fields) from a stream of :func:`united` events. Needs the RocksDB state store."""
    ship()
    return events.groupBy("sample_id").transformWithStateInPandas(
        Readiness(tasks, late_ms), outputStructType=OUT, outputMode="Append", timeMode="None" if late_ms is None else "ProcessingTime"
    )


def readiness(events: DataFrame, tasks: dict[str, list[str]]) -> DataFrame:
    """The same of a table, by one aggregate per sample: (sample_id, task, fields) of the samples that are ready for a task which has not taken them.

    Of a field that comes several times, the greatest value counts, as a table has no order.
    """
    value = F.when(F.col("event") == FIELD, F.col("payload"))
    there = F.col("event").isin(FIELD, END)
    names = sorted({f for fields in tasks.values() for f in fields})
    own = [F.struct(F.max((there & (F.col("name") == f)).cast("int")).alias("there"), F.max(F.when(F.col("name") == f, value)).alias("value")).alias(f"f_{f}") for f in names]
    took = [F.max(((F.col("event") == TAKEN) & (F.col("name") == t)).cast("int")).alias(f"t_{t}") for t in tasks]
    rows = events.groupBy("sample_id").agg(*own, *took)
    each = [
        F.struct(F.lit(t).alias("task"), (reduce(lambda a, b: a & b, [F.col(f"f_{f}")["there"] == 1 for f in fields], F.lit(True)) & (F.col(f"t_{t}") == 0)).alias("ok"),
                 F.to_json(F.struct(*[F.col(f"f_{f}")["value"].alias(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}).alias("fields"))
        for t, fields in tasks.items()
    ]
    return rows.select("sample_id", F.explode(F.array(*each)).alias("x")).where("x.ok").select("sample_id", "x.task", "x.fields")
