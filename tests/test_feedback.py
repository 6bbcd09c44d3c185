"""Feedback as a stream, and calls as rows."""

import json

from pyspark.sql import functions as F

from rillflow.operators import calls
from rillflow.streaming import events
from rillflow.streaming.feedback import Feedback

SCHEMA = "k long, reward double, made struct<k:long,text:string>"


def test_feedback_decides_the_next_order_and_a_batch_twice_changes_nothing(spark, tmp_path):
    data = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "k long, text string")
    f = Feedback(f"{tmp_path}/feedback", "k", "reward")
    order = lambda: [r["k"] for r in f.next_order(data, SCHEMA, -F.col("mean")).orderBy("row_idx").collect()]
    assert order() == [0, 1, 2, 3, 4, 5]
    parts = [[(0, 1.0, None), (1, 0.5, None), (1, 0.0, None)], [(2, 0.9, (9, "new")), (0, 0.0, None), (3, None, (9, "new"))]]
    sent = []

    def sink(df, batch):
        f.sink(df, batch)
        sent.append((spark.createDataFrame(df.collect(), SCHEMA), batch))

    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        events.run_available(events.stream_parquet(spark, f"{tmp_path}/log", SCHEMA), sink, f"{tmp_path}/checkpoint")
    assert [b for _, b in sent] == [0, 1]
    before = order()
    assert before[:2] == [4, 5] or before[:3] == [3, 4, 5]
    assert [k for k in before if k < 3] == [2, 0, 1]
    summary = lambda d: {r["k"]: (r["n"], r["mean"], r["last"]) for r in f.summary(spark, SCHEMA, d).collect()}
    once = summary(0.5)
    assert once[0] == (2, (0.5 * 1.0 + 0.0) / 1.5, 0.0) and once[1] == (2, 0.25, 0.25) and once[3] == (0, None, None)
    for df, batch in sent * 2:
        f.sink(df, batch)
    assert summary(0.5) == once and order() == before
    grown = f.grown(data, SCHEMA, "made", F.coalesce(F.col("reward"), F.lit(0.0)) >= 0)
    assert sorted(r["k"] for r in grown.collect()) == [0, 1, 2, 3, 4, 5, 9]


def tag(name, arguments):
    return f"<tool_call>{json.dumps({'name': name, 'arguments': arguments})}</tool_call>"


def test_calls_as_rows(spark):
    rows = [(1, 0, tag("a", {"x": 1}) + " text " + tag("b", {})), (1, 2, tag("a", {"x": 1})), (1, 1, "none <tool_call>{</tool_call>"), (2, 0, tag("a", {"x": 1})), (2, 1, None), (None, 0, tag("c", "é"))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, text string").repartition(3)
    got = sorted((tuple(r) for r in calls.conversation_calls(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, "a", '{"x":1}', False), (1, 0, 2, "b", "{}", False), (1, 2, 3, "a", '{"x":1}', True), (2, 0, 1, "a", '{"x":1}', False), (None, 0, 1, "c", '"é"', False)], key=str)
    mine = calls.conversation_calls(df, lambda t: [("len", str(len(t)))])
    assert mine.count() == 5 and calls.conversation_calls(df.where("false")).count() == 0
    native = calls.call_rows(df.withColumnRenamed("text", "response"))
    assert sorted((r["conv_id"] or 0, r["turn"], r["place"], r["name"]) for r in native.collect()) == [(0, 0, 0, "c"), (1, 0, 0, "a"), (1, 0, 1, "b"), (1, 2, 0, "a"), (2, 0, 0, "a")]
    assert calls.call_rows(df.withColumnRenamed("text", "response"), outer=True).count() == 7
