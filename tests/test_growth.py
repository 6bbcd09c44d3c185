"""What grows with the tables is dealt by their rows: tasks, processes and Python steps stay in proportion."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillflow.functions import answers, cases
from rillflow.functions import masked as M
from rillflow.operators import advantage, filters, metrics, offpolicy, search
from rillflow.plans import frames


@pytest.fixture
def conf(spark):
    """Sets a session's settings for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


def test_tokens_are_dealt_by_their_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 50)
    n = frames.table(spark, sf_dir, "lineitem").count() // 50
    t = frames.tokens(spark, sf_dir)
    assert t.rdd.getNumPartitions() >= n
    assert t.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 50 * 10
    assert frames.sequences(spark, sf_dir).rdd.getNumPartitions() >= n  # by sequence, nothing is shuffled again


def test_tokens_hold_one_sort_and_keep_their_deal(spark, sf_dir, conf, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 500)
    n = -(-frames.table(spark, sf_dir, "lineitem").count() // 500)
    conf("spark.sql.shuffle.partitions", str(n + 30))
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = frames.tokens(spark, sf_dir)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Sort [") == 1  # that of the positions
    assert t.rdd.getNumPartitions() == n


def test_orders_count_in_the_deal_of_tokens(spark, tmp_path, monkeypatch):
    line = "l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_linestatus string, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame([(1, 2, 1, 1, 9.0, "O", 1.0, 0.0, 0.0), (1, 1, 1, 1, 9.0, "F", 1.0, 0.0, 0.0)], f"l_orderkey long, {line}").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").union(spark.sql("SELECT 1L, 8L")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(frames, "TASK_ROWS", 20)
    t = frames.tokens(spark, str(tmp_path))
    assert t.rdd.getNumPartitions() == 16  # 301 orders, 2 line items
    assert sorted((x["seq_id"], x["pos"]) for x in t.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3)]  # an order that comes twice: one numbering
    assert {(x["uid"], x["mask"]) for x in t.collect()} == {(1, 0), (1, 1), (8, 0), (8, 1)}


def test_sums_of_ratios_are_joined_without_a_sort(spark, sf_dir, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    for level in ("sequence", "geometric"):
        assert "SortMergeJoin" not in offpolicy.ratios(frames.tokens(spark, sf_dir), level)._jdf.queryExecution().executedPlan().toString()


def test_statistics_of_prompts_are_joined_without_a_sort(spark, sf_dir, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "uid string, seq_id int")
    grouped = advantage.with_group(rows, F.count("*").alias("k"))
    for df in (advantage.compute(frames.sequences(spark, sf_dir), "grpo"), grouped):
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((x["seq_id"], x["k"]) for x in grouped.collect()) == [(1, 2), (2, 2), (3, 1)]


def test_accuracy_band_joins_groups_without_a_sort(spark, conf, monkeypatch):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.createDataFrame([("a", 1, 3, 1), ("a", 0, 3, 2), (None, 0, 3, 3), (None, 1, 3, 4), ("b", 1, 3, 5), ("c", 0, 3, 6)], "uid string, acc int, n int, seq_id int")
    joined, numbered = [], filters.row_index
    monkeypatch.setattr(filters, "row_index", lambda df, *a: (joined.append(df._jdf.queryExecution().executedPlan().toString()), numbered(df, *a))[1])
    got = filters.accuracy_band(rows, "acc", "n", 0.2, 0.8, 10, 1.5).collect()
    assert sorted((x["rank"], x["seq_id"], x["passed"]) for x in got) == [(0, 1, True), (1, 2, True), (2, 3, True), (3, 4, True)]
    assert "SortMergeJoin" not in joined[0]


def test_random_masks_draw_once(spark):
    df = spark.range(300).select("id", M.random_mask(F.col("id"), 10, (0.5, 1.0), 0.9, seed=1).alias("m"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    u = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("1"), F.col("id").cast("string"), F.lit(str(i))).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    seen = set()
    for x in df.select("m", u(1).alias("a"), u(2).alias("b")).collect():
        start, n = int(x["a"] * 0.9 * 10), int((x["b"] * 0.5 + 0.5) * 10)
        assert list(x["m"]) == [int(start <= i < start + n) for i in range(10)]
        seen.add(start + n > 10)
    assert seen == {True, False}


def test_bleu_of_a_batch_is_that_of_its_pairs(monkeypatch):
    r = random.Random(1)
    text = lambda: None if r.random() < 0.05 else " ".join(r.choice("abcd") for _ in range(r.randrange(9)))
    c, d = [text() for _ in range(800)], [text() for _ in range(800)]
    want = [answers.bleu(a or "", b or "") for a, b in zip(c, d)]
    assert 0 in want and max(want) > 0.5
    for chars in (1 << 18, 40, 1):
        monkeypatch.setattr(answers, "BLEU_CHARS", chars)
        assert answers._bleu(pd.Series(c, dtype=object), pd.Series(d, dtype=object)).tolist() == want
    assert not len(answers._bleu(pd.Series([], dtype=object), pd.Series([], dtype=object)))


def test_a_case_costs_no_start_of_an_interpreter():
    run = cases.output_of
    assert run("print(int(input()) + 5)", "3") == "8\n"
    before = cases._Launcher.get().process.pid
    assert [run(f"print({i})", "") for i in range(20)] == [f"{i}\n" for i in range(20)] and cases._Launcher.get().process.pid == before
    assert run("import sys\nprint(1)\nsys.exit(3)", "") is None and run("import sys\nprint(1)\nsys.exit(0)", "") == "1\n"
    assert run("import sys\nfor x in sys.stdin: print(x.strip(), end='|')", "a\nb\né") == "a|b|é|" and len(run("print('x' * 3000000)", "")) == 3000001
    assert run("class A:\n    def __del__(self): print('gone')\na = A()\nimport atexit\natexit.register(print, 'end')\nprint(__name__)", "") == "__main__\nend\ngone\n"
    assert run("import threading, time\nthreading.Thread(target=lambda: (time.sleep(0.2), print('t'))).start()\nprint('m')", "") == "m\nt\n"
    assert run("print(1, flush=True)\nimport time\ntime.sleep(60)", "", seconds=1) is None
    assert run("import os\nos.kill(os.getppid(), 9)", "") is None and run("print(5)", "") == "5\n"  # another launcher


def resampled(x, votes, n, draws):
    """Best, worst and majority of each draw, one by one."""
    at = np.random.RandomState(42).choice(len(x), size=(draws, n), replace=True)
    best, worst, maj = [], [], []
    for row in at:
        own = [votes[i] for i in row]
        best.append(max(x[i] for i in row))
        worst.append(min(x[i] for i in row))
        maj.append(x[max(row, key=lambda i: own.count(votes[i]))])
    return {"best": best, "worst": worst, "maj": maj}


@pytest.mark.parametrize("together", [64, 0])
def test_groups_of_a_size_are_resampled_together(spark, monkeypatch, together):
    monkeypatch.setattr(metrics, "TOGETHER", together)
    r = random.Random(2)
    groups = {(s, u): [(i, r.random(), r.choice([None, 1, 2])) for i in range(n)] for s in ("a", None) for u, n in enumerate([1, 2, 5, 5, 5, 9, 70])}
    rows = [(s, u, i, x, v) for (s, u), own in groups.items() for i, x, v in own]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, u int, i int, x double, v int").repartition(3)
    out = metrics.bootstrap(df, ["s", "u"], "x", "i", vote="v", draws=40)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(x["s"], x["u"], x["n"], x["name"]): (x["mean"], x["std"]) for x in out.collect()}
    want = {}
    for (s, u), own in groups.items():
        k = len(own)
        for n in [m for m in (2, 4, 8, 16, 32, 64) if m < k] + ([k] if k > 1 else []):
            for name, v in resampled([x for _, x, _ in own], [v for _, _, v in own], n, 40).items():
                want[s, u, n, name] = (pytest.approx(np.mean(v)), pytest.approx(np.std(v)))
    assert got == want


def test_documents_are_dealt_by_bytes_and_pairs(spark, monkeypatch):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    docs = spark.createDataFrame([(i % 190, text(r.randrange(30))) for i in range(200)] + [(500, None)], "doc_id long, text string")
    qs = spark.createDataFrame([(i, text(3)) for i in range(12)], "query_id long, text string")
    got = lambda out: sorted((x["query_id"], x["doc_id"], x["rank"], round(x["score"], 9)) for x in out.collect())
    want, dealt = got(search.bm25(docs, qs, 3)), []
    monkeypatch.setattr(search, "COUNT_BYTES", 400)
    monkeypatch.setattr(search, "TASK_PAIRS", 50)
    plain = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *by: (dealt.append(n), plain(self, n, *by))[1])
    assert got(search.bm25(docs, qs, 3)) == want and len(want) == 36
    assert len(dealt) == 2 and min(dealt) > 10
