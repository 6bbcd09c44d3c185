"""Order statistics against sorted lists, with cells so small that rounds repeat."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillflow.operators import batch, losses, metrics, order


def exact(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    lo = math.floor(at)
    return values[lo] + (values[min(lo + 1, len(values) - 1)] - values[lo]) * (at - lo) if values else None


@pytest.fixture(scope="module")
def values():
    r = random.Random(4)
    spread = [r.gauss(0, 1) * 10 ** r.randint(-12, 12) for _ in range(3000)]
    return {"a": spread, "b": [1.5] * 2000 + [r.random() for _ in range(1000)], "c": [7.0], None: [float(i) for i in range(50)], "d": [None, None]}


@pytest.fixture(scope="module")
def frame(spark, values):
    rows = [(k, x) for k, xs in values.items() for x in xs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, v double, id long").repartition(5)


@pytest.mark.parametrize("cell", [1 << 18, 4])
def test_quantiles_by_key(frame, values, cell):
    fractions = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {r["name"]: r for r in order.quantiles(frame, "v", fractions, ["name"], cell=cell).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, row in got.items():
        for name, q in fractions.items():
            assert row[name] == pytest.approx(exact(values[k], q), rel=1e-12, abs=1e-300), (k, name)


def test_all_rows_and_no_rows(spark, frame, values):
    every = [x for xs in values.values() for x in xs if x is not None]
    assert order.quantiles(frame, "v", {"m": 0.37}, cell=30).collect()[0]["m"] == pytest.approx(exact(every, 0.37), rel=1e-12)
    none = frame.where("false")
    assert [tuple(r) for r in order.quantiles(none, "v", {"m": 0.5}).collect()] == [(None,)]
    assert order.quantiles(none, "v", {"m": 0.5}, ["name"]).collect() == []
    found = order.at_ranks(frame, "v", {"low": F.lit(-1), "high": F.col("n"), "first": F.lit(0)}).first()
    assert found["low"] is None and found["high"] is None and found["first"]["value"] == min(every) and found["n"] == len(every)


@pytest.mark.parametrize("k, cell", [(0, 8), (1, 1 << 18), (700, 8), (4500, 1 << 18), (4500, 8), (99999, 8)])
def test_first_rows_by_a_threshold(frame, k, cell):
    out = order.flag_first(frame, F.col("v"), F.lit(k).cast("long"), [F.col("id")], "in", cell=cell)
    rows = [(r["v"], r["id"]) for r in out.collect() if r["v"] is not None]
    got = sorted((r["v"], r["id"]) for r in out.where("in").collect())
    assert got == sorted(rows)[:k]


def test_first_rows_of_those_that_take_part(spark):
    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(100)], "id long, v double, m int").repartition(3)
    out = order.flag_first(df.withColumn("k", F.lit(11)), -F.col("v"), F.col("k").cast("long"), [F.col("id")], "in", F.col("m") == 1, ["k"], cell=5)
    want = sorted([(-(i % 7), i) for i in range(100) if i % 2])[:11]
    assert sorted((-r["v"], r["id"]) for r in out.where("in").collect()) == want


def test_numbers_within_keys(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 11}", (i * 7919) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(6)
    for most in (1 << 18, 100, 1):
        got = {r["id"]: r["at"] for r in batch.index_within(df, ["k"], ["v", "id"], "at", most=most).collect()}
        for key in {r[0] for r in rows}:
            assert [got[i] for _, _, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))] == list(range(sum(r[0] == key for r in rows)))


def test_many_samples_come_from_a_range_sort(spark, monkeypatch):
    df = spark.range(500).withColumnRenamed("id", "k").repartition(4)
    few = sorted(r[0] for r in batch.first_samples(df, 200, "k", seed=3).collect())
    monkeypatch.setattr(batch, "MOST", 10)
    assert sorted(r[0] for r in batch.first_samples(df, 200, "k", seed=3).collect()) == few


def test_first_rows_by_values_that_differ_from_run_to_run(spark):
    # In each run all values are shifted by the time, as a mean whose partial results arrive in another order shifts them.
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "id long, x double").repartition(3)
    df = df.withColumn("v", F.col("x") + F.expr("unix_micros(current_timestamp()) % 1000000") * 1e-9)
    for cell in (1 << 18, 4):
        out = order.flag_first(df, F.col("v"), F.lit(13).cast("long"), [F.col("id")], "in", cell=cell)
        assert sorted((r["x"], r["id"]) for r in out.where("in").collect()) == sorted((i % 5, i) for i in range(50))[:13]


def test_losses_without_a_token(spark):
    schema = "seq_id long, pos int, mask int, old_lp double, log_prob double, advantage double"
    rows = [(1, 0, 0, -0.1, -0.2, 1.0), (1, 1, 0, -0.3, -0.2, 1.0)]
    for data in (rows, []):
        for loss in (losses.kl_cov, losses.clip_cov, losses.vanilla):
            assert loss(spark.createDataFrame(data, schema)).first()["loss"] is None


def test_timings(spark):
    df = spark.createDataFrame([("gen", 3.0), ("gen", 1.0), ("gen", 2.5), (None, 4.0)], "name string, seconds double")
    got = {r["name"]: tuple(r)[1:] for r in metrics.reduce_timing(df).collect()}
    assert got == {"gen": (pytest.approx(6.5 / 3), 3, 1.0, 2.5, 3.0), None: (4.0, 1, 4.0, 4.0, 4.0)}
    assert sorted(tuple(r) for r in metrics.gathered_timing(df).where("name is not null").collect()) == [("gen", 1.0, 0), ("gen", 2.5, 1), ("gen", 3.0, 2)]


def test_plans_sort_no_whole_table(frame):
    text = order.flag_first(frame.where("id >= 0"), F.col("v"), F.lit(9).cast("long"), [F.col("id")], "in")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text.replace("Exchange RoundRobin", "") and "Sort" not in text
