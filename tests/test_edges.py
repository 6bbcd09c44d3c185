"""Ties, nulls, zero lengths and what operators leave behind."""

from pyspark.sql import functions as F

from rillflow import scratch
from rillflow.functions import masked as M
from rillflow.functions import scoring as S
from rillflow.operators import batch, prep


def test_dedup_keeps_one_row_per_prompt(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 1, "a"), ("p", 1, "b"), ("q", 2, "c"), (None, 1, "d"), (None, 3, "e")], "prompt string, k int, x string")
    got = prep.dedup_prompts(df, "prompt", "k")
    rows = sorted(((r[0], r[1]) for r in got.collect()), key=str)
    assert rows == [("p", 1), ("q", 2), (None, 1)] and got.columns == df.columns
    again = prep.dedup_prompts(df.repartition(3), "prompt", "k")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    nested = spark.createDataFrame([([("user", "a")], 1), ([("user", "a")], 1), ([("user", "b")], 1)], "prompt array<struct<role:string,content:string>>, k int")
    assert prep.dedup_prompts(nested, "prompt", "k").count() == 2


def test_best_per_conversation_loses_no_conversation(spark):
    rows = [(1, 1, 9.0, "early"), (1, 2, 1.0, "a"), (1, 2, 3.0, "b"), (1, 2, 3.0, "b"), (2, 1, None, "c"), (2, 1, None, "d"), (None, 1, 2.0, "e"), (3, None, 1.0, "f"), (3, 1, None, "g")]
    df = spark.createDataFrame(rows, "conv_id int, turn_id int, score double, x string")
    got = {r["conv_id"]: r["x"] for r in prep.best_per_conversation(df).collect()}
    assert got.keys() == {1, 2, 3, None} and got[1] == "b" and got[2] in "cd" and got[None] == "e" and got[3] == "g"
    assert got == {r["conv_id"]: r["x"] for r in prep.best_per_conversation(df.repartition(4)).collect()}


def test_rewards_of_no_length(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (2, 2), (None, 2), (1, -1)], "n int, total int")
    got = [r[0] for r in df.select(S.place_reward(F.lit(1.5), F.col("n"), F.col("total"))).collect()]
    assert got == [[], [0.0, 0.0], [0.0, 1.5], [0.0, 0.0], []]


def test_states_of_tasks_without_any(spark):
    df = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "task int, n int")
    got = prep.task_states(df, "task", "n", 5, 5, []).collect()
    assert {(r["task"], r["state"], r["env"]) for r in got} == {(0, 0, 0), (0, 1, 1), (2, 0, 2)}


def test_positions_leave_nothing_in_memory_and_tables_only_in_scope(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.range(1000).withColumn("x", F.pmod(F.col("id") * 7919, F.lit(1000)))
    with scratch.scope():
        got = batch.row_index(df, "x")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert [r["row_idx"] for r in got.orderBy("x").collect()] == list(range(1000)) and "map(" not in plan
        total = batch.running_total(df.withColumn("v", F.lit(2.0)), "v", "x")
        assert [r["__upto"] for r in total.orderBy("x").collect()] == [2.0 * i for i in range(1, 1001)]
        inner = scratch.materialise(df, "kept")
        path = inner.scratch_path
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    with scratch.scope():
        with scratch.scope() as kept:
            kept.append(scratch.materialise(df, "outer"))
            scratch.materialise(df, "inner")
        assert kept[0].count() == 1000
    gone = spark._jvm.org.apache.hadoop.fs.Path(kept[0].scratch_path)
    assert not gone.getFileSystem(spark._jsc.hadoopConfiguration()).exists(gone)
    assert batch.row_index(df.limit(0), "x").count() == 0 and batch.running_total(df.limit(0), "x", "id").count() == 0


def test_masked_variance_and_batch_statistics(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 1), (100.0, 0), (5.0, 1)], "v double, mask int")
    mean, var = M.masked_var(df, "v").first()
    assert abs(mean - 3) < 1e-6 and abs(var - 4) < 1e-6
    assert abs(M.masked_var(df, "v", unbiased=False).first()["var"] - 8 / 3) < 1e-6
    for few, unbiased in ((df.limit(1), True), (df.where("mask = 0"), True), (df.where("mask = 0"), False)):
        try:
            M.masked_var(few, "v", unbiased=unbiased).collect()
            raise AssertionError("no error")
        except Exception as e:
            assert "the mask has" in str(e)
    assert tuple(M.batch_stats(df, "v", "mask").first()) == (3.0, 5.0, 1.0, 2.0)
    assert M.batch_stats(df, "v").first()["max"] == 100.0
