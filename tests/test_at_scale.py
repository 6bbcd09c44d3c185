"""Operators that have no task, group or driver for everything: against plain Python, with bounds so small that they are met."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import answers
from rillflow.operators import balance, batch, filters, metrics, search


def accuracy(rows):
    by = {}
    for u, i, s, a in rows:
        by.setdefault(u, []).append((i, s, a))
    out = []
    for u, own in by.items():
        x = y = 0.0
        own = sorted(r for r in own if r[2] is not None) if u is not None else []
        for k, (_, s, a) in enumerate(own):
            for _, t, b in own[k + 1 :]:
                y += abs(a - b)
                if s is not None and t is not None:
                    x += abs(a - b) * ((s - t > 0) == (a - b > 0))
        out.append(x / y if y else 0.5)
    return sum(out) / len(out)


@pytest.mark.parametrize("most", [1 << 18, 30])
def test_pair_accuracy(spark, monkeypatch, most):
    r = random.Random(6)
    rows = [(None if not i % 50 else 0 if i % 2 else r.randrange(1, 40), i, None if r.random() < 0.05 else float(r.randrange(12)), None if r.random() < 0.05 else r.choice([0.0, 0.25, 0.5, 1.0])) for i in range(600)]
    rows += [(99, 1000, 1.0, 0.5), (98, 1001, 1.0, None), (97, 1002, 1.0, 1.0), (97, 1003, 1.0, 0.0)]
    monkeypatch.setattr(metrics, "MOST", most)
    df = spark.createDataFrame(rows, "uid long, idx long, s double, a double").repartition(4)
    out = metrics.pair_accuracy(df, "s", "a")
    assert out.first()["accuracy"] == pytest.approx(accuracy(rows), abs=1e-9)


def test_pair_accuracy_joins_no_rows_with_rows(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 1.0)], "uid long, idx long, s double, a double")
    text = metrics.pair_accuracy(df, "s", "a")._jdf.queryExecution().optimizedPlan().toString()
    assert "i#" not in "".join(line for line in text.splitlines() if "Join" in line)


@pytest.mark.parametrize("equal", [False, True])
def test_deal_over_a_histogram(spark, equal):
    r = random.Random(1)
    lengths = [r.randint(1, 900) if i % 3 else 64 for i in range(4000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n int").repartition(4)
    out = [(x["id"], x["n"], x["part"]) for x in balance.deal(df, "n", 16, "id", equal=equal).collect()]
    assert sorted(x[0] for x in out) == list(range(4000))
    load, count = np.bincount([x[2] for x in out], [x[1] for x in out], 16), np.bincount([x[2] for x in out], minlength=16)
    want = [sum(lengths[i] for i in p) for p in balance.largest_differences(lengths, 16, equal)]
    assert load.max() <= 1.01 * max(want) and load.min() >= 0.99 * min(want)
    assert not equal or count.max() - count.min() <= 0
    again = {x["id"]: x["part"] for x in balance.deal(df.repartition(7), "n", 16, "id", equal=equal).collect()}
    assert again == {x[0]: x[2] for x in out}


def test_deal_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5)], "id long, n int")
    assert {x["part"] for x in balance.deal(df, "n", 5, "id").collect()} == {0, 1, 2}
    assert balance.deal(df.where("false"), "n", 5, "id").count() == 0
    with pytest.raises(ValueError):
        balance.deal(df, "n", 0, "id")


def test_micro_batches_of_a_table(spark):
    r = random.Random(7)
    df = spark.createDataFrame([(i, r.randint(1, 100)) for i in range(900)], "id long, n int").repartition(3)
    out = balance.table_micro_batches(df, "n", 1000, "id", group_rows=200).join(df, "id").groupBy("group", "part").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c")).collect()
    assert sum(x["c"] for x in out) == 900 and len({x["group"] for x in out}) == 5
    assert max(x["s"] for x in out) <= 1.1 * 1000


@pytest.mark.parametrize("block", [1024, 7])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_dense_topk_by_pairs_of_blocks(spark, block, ids, monkeypatch):
    r = np.random.default_rng(3)
    corpus, asked = r.integers(-3, 4, (150, 6)).astype(float), r.integers(-3, 4, (60, 6)).astype(float)
    name = (lambda i: i) if ids == "long" else (lambda i: f"d{i:03d}")
    docs = spark.createDataFrame([(name(i), x.tolist()) for i, x in enumerate(corpus)] + [(name(900), None)], f"doc_id {ids}, embedding array<double>").repartition(4)
    qs = spark.createDataFrame([(name(i), x.tolist()) for i, x in enumerate(asked)] + [(name(901), None)], f"query_id {ids}, embedding array<double>").repartition(3)
    got = {}
    for x in search.dense_topk(docs, qs, 5, block=block).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["doc_id"], x["score"]))
    scores = asked @ corpus.T
    assert set(got) == {name(i) for i in range(60)}
    for i in range(60):
        best = sorted(range(150), key=lambda j: (-scores[i, j], j))[:5]
        assert sorted(got[name(i)]) == [(n + 1, name(j), scores[i, j]) for n, j in enumerate(best)]


def test_groups_without_a_label(spark):
    rows = [(None, 1, 0.0), (None, 2, 1.0), ("a", 3, 0.0), ("a", 4, 0.0)]
    df = spark.createDataFrame(rows, "uid string, id long, acc double").withColumn("gen_batch", F.lit(0))
    assert sorted(x["id"] for x in filters.dynamic_sampling(df, "acc", 5).collect()) == [1, 2]
    assert sorted(x["id"] for x in filters.sample_groups(df, "uid", 9, 1).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("text, want", [("answer: İ 5", (True, "İ 5")), ("ANSWER IS 7", (True, "7")), ("6 is the answer. 7 is the answer", (False, "the answer")), ("so 7 Is The Answer", (True, "so 7")), ("x", (False, "x")), ("", (False, "")), ("we get 4", (True, "4"))])
def test_answers_behind_marks_of_any_case(text, want):
    assert answers.find_answer(text) == want


def test_newest_and_admission_of_a_hot_key(spark, monkeypatch):
    from rillflow.streaming import queues

    df = spark.createDataFrame([(i % 4 // 3, i) for i in range(400)], "q int, seq int").repartition(4)
    few = sorted(tuple(r) for r in queues.newest(df, 9, "q", ["seq"]).collect())
    plain = batch.index_within
    monkeypatch.setattr(queues, "index_within", lambda *a: plain(*a, most=10))
    assert sorted(tuple(r) for r in queues.newest(df, 9, "q", ["seq"]).collect()) == few == sorted([(0, i) for i in range(400) if i % 4 != 3][-9:] + [(1, i) for i in range(3, 400, 4)][-9:])
