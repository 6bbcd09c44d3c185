"""Collation, columns of rows, flat names, dispatch by a column of names, and a limited service."""

import pytest
from pyspark.sql import functions as F

from rillflow.operators import advantage, balance, batch, metrics, plugins


def test_collation_pads_to_the_longest_of_a_batch(spark):
    rows = [(1, 0, [1, 2, 3]), (2, 0, [4]), (3, 0, None), (4, 1, [5, 6]), (5, None, [7]), (6, None, [])]
    df = spark.createDataFrame(rows, "id long, b int, x array<int>")
    got = {r["id"]: (r["x"], r["m"]) for r in batch.collate(df, "b", {"x": -1}, mask="m").collect()}
    assert got == {1: ([1, 2, 3], [1, 1, 1]), 2: ([4, -1, -1], [1, 0, 0]), 3: ([-1] * 3, [0] * 3), 4: ([5, 6], [1, 1]), 5: ([7], [1]), 6: ([-1], [0])}
    left = {r["id"]: (r["x"], r["m"]) for r in batch.collate(df, "b", {"x": 0}, left=True, mask="m").collect()}
    assert left[2] == ([0, 0, 4], [0, 0, 1]) and batch.collate(df.where("false"), "b", {"x": 0}).count() == 0


def test_rows_as_columns(spark):
    df = spark.createDataFrame([(1, [(1, "a"), (2, None)]), (2, []), (3, None)], "id long, rows array<struct<n:int,s:string>>")
    assert [tuple(r) for r in batch.to_columns(df, "rows").orderBy("id").collect()] == [(1, [1, 2], ["a", None]), (2, [], []), (3, None, None)]


def test_flat_names(spark):
    df = spark.sql("select 1 as id, named_struct('a', 2, 'b', named_struct('c', array(1, 2), 'd', cast(null as string))) as s, map('k', 1) as m")
    assert {r["name"]: r["value"] for r in metrics.flatten_fields(df, ["id"]).collect()} == {"s/a": "2", "s/b/c": "[1,2]", "s/b/d": None, "m": '{"k":1}'}


def test_estimators_by_a_column(spark):
    rows = [(u, e, [float(u), float(i)], [1, 1]) for u, e in ((1, "grpo"), (2, "rloo")) for i in range(4)]
    df = spark.createDataFrame(rows, "uid long, estimator string, rewards array<double>, mask array<int>")
    got = sorted(tuple(map(str, r)) for r in advantage.compute_by(df, "estimator").collect())
    want = [advantage.compute(df.where(F.col("estimator") == e), e).select(*df.columns, "advantages", "returns") for e in ("grpo", "rloo")]
    assert got == sorted(tuple(map(str, r)) for w in want for r in w.collect())
    assert advantage.compute_by(df.where("false"), "estimator").columns[-2:] == ["advantages", "returns"]
    with pytest.raises(ValueError, match="unknown estimator"):
        advantage.compute_by(df.withColumn("estimator", F.lit(None).cast("string")), "estimator")


def test_a_limited_service_is_asked_in_turn_and_again(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def served(text, truth):
        with open(asked, "a") as f:
            f.write(text + "\n")
        if text == "once" and open(asked).read().split().count("once") < 2:
            raise ConnectionError
        if text == "never":
            e = Exception("gone")
            e.status = 404
            raise e
        return 2.0

    df = spark.createDataFrame([("a", "x", 1, 1), ("once", "x", 1, 1), ("never", "x", 1, 1)], "response string, ground_truth string, response_length int, max_length int")
    got = {r["response"]: r["score"] for r in plugins.reward_managers.get("rate_limited")(df, served, per_minute=600.0, tasks=1).collect()}
    assert got == {"a": 2.0, "once": 2.0, "never": 0.0} and sorted(open(asked).read().split()) == ["a", "never", "once", "once"]


def test_sticky_servers(spark):
    df = spark.range(100).withColumn("s", balance.sticky(F.col("id") % 10, 4))
    assert df.groupBy((F.col("id") % 10).alias("k")).agg(F.count_distinct("s").alias("n")).where("n > 1").count() == 0
    assert {r["s"] for r in df.select("s").distinct().collect()} <= {0, 1, 2, 3}
