"""Readiness of samples whose fields arrive on several streams: the stream, stopped and started again, equals the table."""

import json
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from rillflow.streaming import events, fields

TASKS = {"actor": ["logp", "reward"], "critic": ["reward", "value"]}


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def log(spark, n=40, seed=3):
    """Events of n samples: some fields never come, some with an end mark, some samples are taken already."""
    r, rows = random.Random(seed), []
    for i in range(n):
        for f in ("logp", "reward", "value"):
            if r.random() < 0.85:
                rows.append((f"s{i}", "end" if r.random() < 0.1 else "field", f, f"{f}{i}"))
        if r.random() < 0.2:
            rows.insert(0, (f"s{i}", "taken", r.choice(list(TASKS)), None))
    taken = [x for x in rows if x[1] == "taken"]
    rest = [x for x in rows if x[1] != "taken"]
    r.shuffle(rest)
    return [(*x[:3], None if x[1] != "field" else x[3]) for x in taken + rest]


def want(rows):
    held, out = {}, set()
    for key, event, name, payload in rows:
        s = held.setdefault(key, ({}, set()))
        if event == "taken":
            s[1].add(name)
        else:
            s[0].setdefault(name, payload)
    for key, (values, took) in held.items():
        for task, names in TASKS.items():
            if task not in took and all(f in values for f in names):
                out.add((key, task, json.dumps({f: values[f] for f in names}, sort_keys=True)))
    return out


def as_set(rows):
    return {(r["sample_id"], r["task"], json.dumps(json.loads(r["fields"]), sort_keys=True)) for r in rows}


def test_stream_with_a_restart_equals_the_table(spark):
    rows = log(spark)
    assert as_set(fields.readiness(spark.createDataFrame(rows, fields.EVENTS), TASKS).collect()) == want(rows)
    base = tempfile.mkdtemp(prefix="fields-")
    found = []

    def sink(df, batch):
        found.extend((batch, r) for r in df.collect())

    for part in range(3):  # each part of the log comes after the stream has been stopped
        size = len(rows) // 3 + 1
        spark.createDataFrame(rows[part * size : (part + 1) * size], fields.EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/log")
        stream = events.stream_parquet(spark, f"{base}/log", fields.EVENTS)
        events.run_available(fields.readiness_stream(stream, TASKS), sink, f"{base}/checkpoint")
    assert len({b for b, _ in found}) > 1
    got = [r for _, r in found]
    assert len(got) == len(want(rows)) and as_set(got) == want(rows) and {r["event"] for r in got} == {"ready"}


def test_late_samples_are_reported_and_forgotten(spark):
    """Timers go by the clock, so the query runs on until what is late has been told."""
    base = tempfile.mkdtemp(prefix="fields-")
    rows = [("a", "field", "logp", "1"), ("b", "field", "reward", "2"), ("b", "field", "logp", "3"), ("b", "field", "value", "4")]
    found = []
    spark.createDataFrame(rows, fields.EVENTS).coalesce(1).write.parquet(f"{base}/log")
    late = fields.readiness_stream(events.stream_parquet(spark, f"{base}/log", fields.EVENTS), TASKS, late_ms=500)
    query = late.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime="1 second").foreachBatch(lambda df, b: found.extend(map(tuple, df.collect()))).start()
    until = time.time() + 60
    while time.time() < until and sum(x[2] == "late" for x in found) < 2:
        time.sleep(0.5)
    query.stop()
    assert {x for x in found if x[0] == "b"} == {("b", "actor", "ready", '{"logp": "3", "reward": "2"}'), ("b", "critic", "ready", '{"reward": "2", "value": "4"}')}
    assert {x for x in found if x[2] == "late"} == {("a", "actor", "late", '{"logp": "1"}'), ("a", "critic", "late", "{}")}


def test_streams_of_several_fields_in_one_form(spark):
    logp = fields.arrivals(spark.createDataFrame([(1, 0.5), (2, None)], "id long, x double"), "id", "logp", F.col("x"))
    reward = fields.arrivals(spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id long, y int"), "id", "reward", F.col("y"))
    took = fields.taken(spark.createDataFrame([(1, "actor")], "id long, task string"), "id", "task")
    got = fields.readiness(fields.united(logp, reward, took), {"actor": ["logp", "reward"], "other": ["reward"]})
    assert as_set(got.collect()) == {("2", "actor", '{"logp": null, "reward": "0"}'), ("1", "other", '{"reward": "1"}'), ("2", "other", '{"reward": "0"}'), ("3", "other", '{"reward": "1"}')}
    none = spark.createDataFrame([], fields.EVENTS)
    assert fields.readiness(none, TASKS).collect() == []
