"""How the driver's tables play the part of rollouts: frames for Spark, and the same as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.functions.masked import to_arrays


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task sorts or joins at a time.
TASK_ROWS = 250_000


def task_count(df: DataFrame) -> int:
    """How many tasks a table is dealt to: by its rows, and no fewer than there are cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: line items are tokens, orders sequences, customers prompts. The divisors keep sums off the ties of rounding.

    Dealt by sequence over as many tasks as there are rows for, so that a task's memory does not grow with the table; what
    goes by sequence afterwards shuffles nothing again. A task's orders, as many as that deal allows, are looked up in a
    hash table, as each sort would hold a page of 64 MB. Keys are renamed behind the deal: Spark would deal bare exchanges
    anew over spark.sql.shuffle.partitions where those are more.
    """
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = max(task_count(line), task_count(orders))
    line = line.repartition(n, "l_orderkey").withColumnRenamed("l_orderkey", "seq_id")
    orders = orders.repartition(n, "o_orderkey").select(F.col("o_orderkey").alias("seq_id"), F.col("o_custkey").alias("uid"))
    w = Window.partitionBy("seq_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = line.join(orders.hint("shuffle_hash"), "seq_id").withColumn("pos", F.row_number().over(w) - 1)
    return t.select(
        "seq_id", "uid", "pos", (F.col("l_linestatus") == "O").cast("int").alias("mask"),
        (F.col("l_extendedprice") / 97531.0).alias("reward"), (F.col("l_quantity") / 49.0).alias("value"), (-F.col("l_discount") / 0.97).alias("old_lp"),
        (-F.col("l_tax") / 1.03).alias("rollout_lp"), (-(F.col("l_discount") + F.col("l_tax")) / 1.99).alias("log_prob"), ((F.col("l_quantity") - 25.5) / 1.01).alias("advantage"),
    )


TOK = """tok AS (SELECT l_orderkey AS seq_id, o_custkey AS uid,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
 CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS mask, l_extendedprice / 97531.0 AS reward, l_quantity / 49.0 AS value,
 -l_discount / 0.97 AS old_lp, -l_tax / 1.03 AS rollout_lp, -(l_discount + l_tax) / 1.99 AS log_prob, (l_quantity - 25.5) / 1.01 AS advantage
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def sequences(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Array form: seq_id, uid, rewards, values, mask and others of the token columns."""
    columns = ["mask", "reward", "value", *more]
    return to_arrays(tokens(spark, sf_dir), ["seq_id", "uid"], columns).withColumnsRenamed({"reward": "rewards", "value": "values"})


SEQ = TOK + """, seq AS (SELECT seq_id, uid, sum(reward) AS score, sum(mask) AS len, count(*) AS n FROM tok GROUP BY ALL),
grp AS (SELECT uid, avg(score) AS mean, stddev_samp(score) AS std, var_samp(score) AS var, count(*) AS k, sum(score) AS total FROM seq GROUP BY uid)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are scored rollouts: uid, data_source, score, ts, a vote and a parameter version from the properties."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("uid"), F.col("event_type").alias("data_source"), F.col("value").alias("score"), "ts", k.alias("k"))


ROLL = """roll AS (SELECT event_id AS id, user_id AS uid, event_type AS data_source, value AS score, ts,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return g.select("conv_id", F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
