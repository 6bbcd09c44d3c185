import pytest
from pyspark.sql import functions as F

from rillflow.operators import batch as B


@pytest.fixture
def abc(spark):
    return spark.createDataFrame([(1, [1, 2], "a"), (2, [3, 4], "b"), (3, [5, 6], "c")], "id long, obs array<int>, labels string").repartition(3)


def labels(df, *order):
    return "".join(r["labels"] for r in df.orderBy(*order).collect())


def test_repeat(abc):
    assert labels(B.repeat(abc, 2), "id", "rep") == "aabbcc"
    assert labels(B.repeat(abc, 2), "rep", "id") == "abcabc"
    assert B.repeat(abc, 0).count() == 0
    times = F.when(F.col("id") == 1, 3).when(F.col("id") == 2, 1).otherwise(0)
    assert labels(B.repeat_rows(abc, times), "id") == "aaab"


def test_unfold_chunks(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], "a"), ([5, 6, 7, 8], "b")], "obs array<int>, labels string")
    got = sorted((r["labels"], r["chunk"], r["obs"]) for r in B.unfold_chunks(df, 2, ["obs"]).collect())
    assert got == [("a", 0, [1, 2]), ("a", 1, [3, 4]), ("b", 0, [5, 6]), ("b", 1, [7, 8])]


def test_take_and_slice(abc):
    assert [r["labels"] for r in B.take(abc, [2, 0, 2, -1], "id").orderBy("out_pos").collect()] == ["c", "a", "c", "c"]
    with pytest.raises(IndexError):
        B.take(abc, [3], "id")
    assert labels(B.slice_rows(abc, "id", -2, None), "id") == "bc"
    assert labels(B.slice_rows(abc, "id", None, None, 2), "id") == "ac"
    assert labels(B.slice_rows(abc, "id", None, None, -2), "id") == "ac"


def test_pad_and_unpad(abc):
    padded = B.pad_to_divisor(abc, 5, "id")
    assert labels(padded, "row_idx") == "abcab" and labels(B.unpad(padded), "id") == "abc"
    assert labels(B.pad_to_divisor(abc, 8, "id"), "row_idx") == "abcabcab"
    assert B.pad_to_divisor(abc, 3, "id").count() == 3


def test_chunks_of_two_kinds(spark):
    df = spark.range(10)
    assert [r["n"] for r in B.chunk(df, 4, "id").groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()] == [3, 3, 3, 1]
    assert [r["n"] for r in B.chunk(df, 4, "id", even=True).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()] == [3, 3, 2, 2]
    assert B.batches(df, 4, "id", drop_last=True).count() == 8


def test_fold_and_unfold_are_inverse(spark):
    df = spark.range(6)
    folded = B.fold(df, 2, "id", ["id"])
    assert sorted(r["id"] for r in B.unfold(folded, ["id"]).collect()) == list(range(6))
    with pytest.raises(ValueError):
        B.fold(df, 4, "id", ["id"])


def test_columns_of_one_name_must_agree(spark):
    a = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "id long, x double")
    b = spark.createDataFrame([(1, 2.0, "p"), (2, float("nan"), "q")], "id long, x double, y string")
    assert sorted(r["y"] for r in B.union_columns(a, b, "id").collect()) == ["p", "q"]
    with pytest.raises(Exception, match="differ"):
        B.union_columns(a, b.withColumn("x", F.lit(0.0)), "id").collect()
    with pytest.raises(ValueError):
        B.concat([a, b])
    with pytest.raises(ValueError):
        B.rename(a, ["x"], ["y", "z"])
    with pytest.raises(KeyError):
        B.select(a, ["nope"])
    with pytest.raises(ValueError):
        B.from_rows(spark, [{"a": 1}, {"b": 2}])


def test_order_does_not_depend_on_partitions(spark):
    df = spark.range(200)
    one = B.row_index(df.repartition(1), F.xxhash64("id", F.lit(1)))
    many = B.row_index(df.repartition(7), F.xxhash64("id", F.lit(1)))
    assert sorted(one.collect()) == sorted(many.collect())
    totals = {r["id"]: r["t"] for r in B.running_total(df.withColumn("v", F.col("id").cast("double")).repartition(5), "v", "id", "t").collect()}
    assert all(totals[i] == i * (i + 1) / 2 for i in range(200))


def test_minibatches_shuffle_every_epoch(spark):
    df = spark.range(8)
    got = B.minibatches(df, 4, 2, "id", seed=3)
    assert got.count() == 16 and got.select("epoch", "batch").distinct().count() == 4
    with pytest.raises(ValueError):
        B.minibatches(df, 3, 1, "id")


def test_ranks_and_fan_out(spark):
    assert {r["count"] for r in B.rank_shards(spark.range(11), 3, "id", 0).groupBy("rank").count().collect()} == {3}
    got = [r["replica"] for r in B.fan_out(spark.range(4), 2, 3, "id").orderBy("id", "rep").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2]
