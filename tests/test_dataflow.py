"""Balancing, filters, preparation, search, files and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow import schemas
from rillflow.operators import balance as Z
from rillflow.operators import filters, plugins, prep, search
from rillflow.sources import io
from rillflow.streaming import events, queues

# ---------------------------------------------------------------- balancing


def spread(lengths, parts):
    sums = [sum(lengths[i] for i in p) for p in parts]
    return max(sums) - min(sums)


@pytest.mark.parametrize("equal", [False, True])
def test_partitions_hold_everything_once_and_are_close(equal):
    r = random.Random(2)
    lengths = [r.randrange(10, 1000) for _ in range(64)]
    parts = Z.balanced(lengths, 8, equal)
    assert sorted(i for p in parts for i in p) == list(range(64)) and all(p == sorted(p) for p in parts)
    assert spread(lengths, parts) <= spread(lengths, Z.balanced(lengths, 8, equal, Z.greedy)) and spread(lengths, parts) < 60
    assert not equal or all(len(p) == 8 for p in parts)


def test_partition_errors():
    for f in (lambda: Z.balanced([1, 2], 3), lambda: Z.balanced([1, 2, 3], 2, True), lambda: Z.greedy([1, 2, 3], 2, True), lambda: Z.micro_batches([9], 5)):
        with pytest.raises(ValueError):
            f()


def test_micro_batches():
    r = random.Random(4)
    lengths = [r.randrange(1, 100) for _ in range(50)]
    parts = Z.micro_batches(lengths, 200)
    assert sorted(i for p in parts for i in p) == list(range(50)) and len(parts) == -(-sum(lengths) // 200)
    assert len(Z.micro_batches(lengths, 200, divisible_by=4)) % 4 == 0 and len(Z.micro_batches(lengths, 10**6, least=3)) == 3
    flat = [i for p in parts for i in p]
    assert [flat[i] for i in Z.inverse(flat)] == list(range(50))


def test_light_sequences_stand_at_both_ends():
    lengths = list(range(1, 17))
    for part in Z.data_parallel(lengths, 2):
        own = [lengths[i] for i in part]
        assert len(own) == 8 and own[len(own) // 2 - 1] >= max(own[0], own[-1])


def test_serpentine_levels_sums(spark):
    df = spark.range(64).withColumn("n", (F.col("id") * 37 % 50 + 1).cast("int"))
    sums = [r["s"] for r in Z.serpentine(df, "n", 4, "id").groupBy("part").agg(F.sum("n").alias("s"), F.count("*").alias("c")).collect()]
    assert max(sums) - min(sums) <= 60


def test_assignment_by_batch(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("b"), "id", (F.col("id") + 1).cast("int").alias("n"))
    out = Z.assign(df, "b", "id", "n", lambda lengths: Z.balanced(lengths, 4))
    assert out.count() == 40 and {r["count"] for r in out.groupBy("b", "part").count().collect()} <= set(range(1, 20))


# ---------------------------------------------------------------- filters


def test_groups_of_one_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 1.0), ("c", 1.0), (None, 0.0)], "uid string, acc double")
    assert sorted(str(r["uid"]) for r in filters.mixed_groups(df, "acc").collect()) == ["None", "b", "b", "c"]
    t = df.where("uid is not null").withColumn("gen_batch", F.lit(0))
    assert {r["uid"] for r in filters.dynamic_sampling(t, "acc", 1).collect()} == {"b"}
    with pytest.raises(ValueError):
        filters.dynamic_sampling(t, "acc", 9, max_batches=1)


def test_accuracy_band_reorders_and_fills_up(spark):
    rows = [(i, "abc"[i // 2], a, 3) for i, a in enumerate([1.0, 1.0, 0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "seq_id int, uid string, acc double, n int")
    got = filters.accuracy_band(df, "acc", "n", 0.2, 0.8, 10, 1.5).orderBy("rank").collect()
    assert [r["seq_id"] for r in got] == [2, 3, 0, 1] and [r["passed"] for r in got] == [True, True, False, False]


# ---------------------------------------------------------------- preparation


def test_prompt_rows_fit_their_schema(spark):
    df = spark.createDataFrame([("q?", "why #### 1,200")], "question string, answer string")
    for variant in ("plain", "tool", "interaction", "agent"):
        row = prep.gsm8k(df, variant)
        r = row.first()
        assert r["reward_model"]["ground_truth"] == "1200" and r["prompt"][-1]["content"].startswith("q? Let's")
        assert ("agent_name" in row.columns) == (variant == "agent") and (variant == "plain" or r["extra_info"]["interaction_kwargs"]["query"] == "q?")
    schemas.validate(prep.gsm8k(df), schemas.PROMPT)
    assert [m["role"] for m in prep.gsm8k(df, "sft").first()["messages"]] == ["user", "assistant"]
    with pytest.raises(schemas.SchemaError):
        schemas.validate(df, schemas.PROMPT)


def test_other_sources(spark):
    m = spark.createDataFrame([("p", "so \\boxed{\\frac{1}{2}}")], "problem string, solution string")
    assert prep.math_rows(m).first()["reward_model"]["ground_truth"] == "\\frac{1}{2}"
    h = spark.createDataFrame([("run", "A man", "he [x] goes", ["one [title] two", "b"], "1"), ("run", "a", "b", ["c"], "")], "activity_label string, ctx_a string, ctx_b string, endings array<string>, label string")
    got = prep.multiple_endings(h).collect()
    assert len(got) == 1 and got[0]["extra_info"]["choices"] == ["one. two", "b"]
    s = spark.createDataFrame([("who?", "nq", ["a", "b"])], "question string, data_source string, golden_answers array<string>")
    r = prep.search_rows(s).first()
    assert r["data_source"] == "searchR1_nq" and r["reward_model"]["ground_truth"] == '{"target":["a","b"]}' and r["prompt"][0]["role"] == "system"
    t = prep.with_tool(prep.gsm8k(spark.createDataFrame([("q", "#### 3")], "question string, answer string")))
    assert t.first()["extra_info"]["tools_kwargs"]["code_interpreter"]["create_kwargs"]["ground_truth"] == "3"
    g = spark.createDataFrame([("p", "a", ["img"])], "problem string, answer string, images array<string>")
    assert prep.geometry_rows(g).first()["images"] == ["img"] and len(prep.geometry_rows(g, True).first()["prompt"]) == 2
    c = spark.createDataFrame([(i, "q", "right", "w1", "w2", "w3") for i in range(30)], "id int, q string, a string, b string, c string, d string")
    rows = prep.shuffled_choices(c, "q", "a", ["b", "c", "d"], "id").collect()
    assert len({r["answer"] for r in rows}) == 4 and all(f"{r['answer']}) right" in r["prompt"] for r in rows)
    assert spark.createDataFrame([('[{"input":"1","output":"2"}]', None)], "a string, b string").select(prep.merged_tests("a", "b")).first()[0] == '{"inputs":["1"],"outputs":["2"]}'
    w = spark.createDataFrame([("x", "p", "s", 1)], "problem_type string, problem string, generated_solution string, k int")
    assert prep.problem_rows(w, "x", ["k"]).count() == 1 and prep.problem_rows(w, "y", ["k"]).count() == 0
    assert prep.collapse(w, ["problem"]).first()["extra"]["k"] == 1


def test_splits_and_firsts(spark):
    df = spark.range(100)
    a, b = prep.hash_split(df, 0.8, "id")
    assert a.count() + b.count() == 100 and 60 < a.count() < 95
    p, q = prep.positional_split(df, 0.75, "id")
    assert p.count() == 75 and q.agg(F.min("id")).first()[0] == 75
    dup = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4)], "k string, i int")
    assert sorted(r["i"] for r in prep.keep_first(dup, ["k"], ["i"]).collect()) == [1, 3, 4]


def test_multi_turn_encoding(spark):
    df = spark.createDataFrame([([("user", [1, 2]), ("assistant", [3, 4, 5])],)], "turns array<struct<role:string,ids:array<bigint>>>")
    r = prep.encode_turns(df, generation_prompt=1).first()
    assert r["input_ids"] == [1, 2, 3, 4, 5] and r["loss_mask"] == [0, 0, 0, 1, 1]
    assert prep.encode_turns(df, length=7).first()["attention_mask"] == [1, 1, 1, 1, 1, 0, 0]


def test_sft_encoding(spark):
    df = spark.createDataFrame([([1, 2], [3, 4])], "p array<bigint>, r array<bigint>")
    r = prep.encode_sft(df, "p", "r", 9, 7, 0).first()
    assert r["input_ids"] == [1, 2, 3, 4, 9, 0, 0] and r["loss_mask"] == [0, 1, 1, 1, 0, 0, 0] and r["position_ids"] == [0, 1, 2, 3, 4, 4, 4]


def test_trajectories_stop_before_a_tool_overflows(spark):
    rows = [("c", 0, "assistant", [1, 2, 3]), ("c", 1, "tool", [4, 5, 6]), ("c", 2, "assistant", [7])]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, ids array<int>")
    r = prep.assemble_trajectory(df, 5).first()
    assert r["response_ids"] == [1, 2, 3] and r["num_turns"] == 2
    r = prep.assemble_trajectory(df, 7).first()
    assert r["response_mask"] == [1, 1, 1, 0, 0, 0, 1] and r["num_turns"] == 4


# ---------------------------------------------------------------- search


@pytest.mark.parametrize("block", [2, 4096])
def test_dense_search(spark, block):
    r = np.random.default_rng(0)
    x, q = r.normal(size=(50, 8)).round(2), r.normal(size=(5, 8)).round(2)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    got = {(s["query_id"], s["rank"]): s["doc_id"] for s in search.dense_topk(docs, queries, 3, block=block).collect()}
    for i in range(5):
        assert [got[i, k + 1] for k in range(3)] == sorted(range(50), key=lambda j: (-(q[i] @ x[j]), j))[:3]
    assert search.dense_topk(docs, queries.limit(0), 3).count() == 0 and search.dense_topk(docs.limit(0), queries, 3).count() == 0


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "h array<array<double>>, m array<int>")
    assert df.select(search.pool("h", "m"), search.pool("h", "m", "cls")).first()[:] == ([2.0, 3.0], [1.0, 2.0])


# ---------------------------------------------------------------- files


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a-b", "in", "secret 12", 0.5, {"x": 1}), (2, "c", "in", "out", 0.9, {"x": 2})], "step long, request_id string, input string, output string, score double, more map<string,int>")
    io.dump_rollouts(df, f"{tmp_path}/dump")
    back = io.read_rollouts(spark, f"{tmp_path}/dump", masks=[r"\d\d"])
    assert {r["output"] for r in back.collect()} == {"secret *", "out"} and back.schema["more"].dataType.simpleString() == "string"
    assert [r["score"] for r in io.view(back).collect()] == [0.9, 0.5]
    assert io.view(back, request="ab", fields=["input"]).count() == 1 and io.view(back, keyword="secret").count() == 1 and io.view(back, step=2).count() == 1
    io.write_parquet(df.select("step", "score"), f"{tmp_path}/p")
    more = io.read_parquet(spark, f"{tmp_path}/p", f"{tmp_path}/p")
    assert more.count() == 4
    io.write_parquet(df.select("step", "input"), f"{tmp_path}/q")
    assert set(io.read_parquet(spark, f"{tmp_path}/p", f"{tmp_path}/q", drifting=True).columns) == {"step", "score", "input"}
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"k": {i}}}' for i in range(10)) + "]")
    assert io.json_to_parquet(spark, f"{tmp_path}/a.json", f"{tmp_path}/split", 0.75, "k") == (7, 3)
    assert spark.read.parquet(f"{tmp_path}/split/train").agg(F.max("k")).first()[0] == 6
    made = []
    for _ in range(2):
        io.cached_rollout(spark, f"{tmp_path}/cache", "e", "p", 4, 2, lambda: made.append(1) or df.select("step"))
    assert made == [1] and io.exists(spark, f"{tmp_path}/cache")
    m = spark.createDataFrame([(1, "a/b/c", 2.0), (1, "d", None)], "step long, metric string, value double")
    assert io.console_lines(m.where("value is not null")).first()["line"] == "step:1 - a/b/c:2.0"
    assert io.titled(m).first()[3:] == ("a", "b/c")
    io.log_metrics(m, f"{tmp_path}/metrics")
    assert spark.read.json(f"{tmp_path}/metrics").count() == 1
    one = spark.createDataFrame([([5],)], "x array<int>")
    assert one.select(io.unwrap_singleton(one, "x")).first()[0] == 5
    assert io.local_cache_path("hdfs://a/b/c.parquet", "/tmp").endswith("/c.parquet")


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from rillflow.plans import registry

    plan = registry.queries()["scan_filtered_columns"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(o_totalprice" in plan and "o_custkey" not in plan.split("ReadSchema")[1]


# ---------------------------------------------------------------- streams


def test_queue_replay(spark):
    log = [("q", i, k) for i, k in enumerate(["get", "put", "put", "put", "get", "put"])]
    df = spark.createDataFrame(log, "queue string, seq long, kind string").repartition(3)
    got = {r["seq"]: r["fate"] for r in queues.drop_oldest(df, 2).collect()}
    assert got == {1: "dropped", 2: "got", 3: "queued", 5: "queued"}
    s = queues.queue_statistics(queues.drop_oldest(df, 2)).first()
    assert (s["produced"], s["consumed"], s["dropped"], s["queued"]) == (4, 1, 1, 2)


def test_queue_stream_equals_its_replay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = ["put", "put", "get", "put", "put", "put", "get", "get", "get", "get", "put"]
    rows = [("q", k, i, f"s{i}") for i, k in enumerate(kinds)]
    schema = "queue string, kind string, seq long, payload string"
    for part in (rows[:4], rows[4:8], rows[8:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = events.stream_parquet(spark, f"{tmp_path}/in", schema, files_per_batch=3)
    query = queues.bounded_queue_stream(stream, 2).writeStream.format("memory").queryName("fates").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["seq"]: r["event"] for r in spark.table("fates").collect()}
    replay = {r["seq"]: r["fate"] for r in queues.drop_oldest(spark.createDataFrame(rows, schema), 2).collect() if r["fate"] != "queued"}
    assert got == replay


def test_windows_are_the_same_for_streams_and_tables(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    typed = spark.read.parquet(f"{tmp_path}/in")
    want = events.tumbling(typed, "ts", "6 hours", ["event_type"], F.count("*").alias("n"))
    stream = events.stream_parquet(spark, f"{tmp_path}/in", typed.schema)
    found = []
    events.run_available(events.tumbling(stream, "ts", "6 hours", ["event_type"], F.count("*").alias("n"), late="1 day"), lambda df, i: found.extend(df.collect()), f"{tmp_path}/c", "update")
    last = {(r["window_start"], r["event_type"]): r["n"] for r in found}
    assert last == {(r["window_start"], r["event_type"]): r["n"] for r in want.collect()}
    with pytest.raises(ValueError):
        events.sessions(typed, "ts", "1 hour", [])


def test_token_bucket(spark):
    rows = [("k", 0.0, 5.0), ("k", 0.0, 5.0), ("k", 0.0, 5.0), ("k", 100.0, 30.0), ("k", 100.0, 1.0)]
    out = queues.token_bucket(spark.createDataFrame(rows, "key string, t double, tokens double"), 1.0, 10.0).orderBy("start").collect()
    assert [r["start"] for r in out[:3]] == [0.0, 0.0, 5.0]
    assert [(r["tokens"], r["start"]) for r in out[3:]] == [(1.0, 100.0), (30.0, 101.0)]
    assert queues.backoff(3) == 8 and queues.backoff(9) == 30.0


def test_versions_and_batches(spark):
    rows = [("s", 0, "sample", 0), ("s", 1, "version", 4), ("s", 2, "sample", 0)]
    df = spark.createDataFrame(rows, "stream string, seq int, kind string, active int").withColumns({"cancelled": F.lit(0), "queued": F.lit(1)})
    assert [r["stale"] for r in queues.version_resets(df).orderBy("seq").collect()] == [1, 5, 6]
    b = queues.full_batches(spark.range(7).withColumn("k", F.lit(0)), 3, "k", ["id"])
    assert b.count() == 6 and queues.staleness_budget(10, 0.5, 2) == 30


def test_dispatch_modes(spark):
    df = spark.range(10).withColumnRenamed("id", "row_idx").withColumn("x", F.col("row_idx") * 2)
    dealt = plugins.dispatchers.get("dp_compute_proto")(df, 4)
    assert dealt.columns == ["row_idx", "x", "is_pad", "worker"] and sorted(r["worker"] for r in dealt.collect()) == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 3
    assert sorted(r["x"] for r in plugins.collect_rows(dealt).collect()) == [2 * i for i in range(10)]
    assert plugins.collect_parts(dealt, ["x"]).count() == 4
    assert {r["worker"] for r in plugins.dispatchers.get("rank_zero")(df, 3).collect()} == {0}
    named = df.withColumn("worker", (F.col("row_idx") % 3).cast("int"))
    assert plugins.dispatchers.get("all_to_all")(named, 3).count() == 10
    with pytest.raises(Exception, match="not among 2"):
        plugins.dispatchers.get("all_to_all")(named, 2).collect()
    with pytest.raises(NotImplementedError):
        plugins.dispatchers.get("direct_rollout_method")(df, 2)


def test_retries_and_limits():
    import threading
    import time

    class Status(Exception):
        def __init__(self, status):
            self.status = status

    calls, waits = [], []

    def failing(*errors):
        left = list(errors)

        def f():
            calls.append(1)
            if left:
                raise left.pop(0)
            return "ok"

        return f

    assert plugins.retried(failing(Status(500), OSError()), sleep=waits.append) == "ok" and len(calls) == 3 and waits == [1.0, 2.0]
    with pytest.raises(Status):
        plugins.retried(failing(Status(404)), sleep=waits.append)
    with pytest.raises(OSError):
        plugins.retried(failing(OSError(), OSError()), attempts=2, sleep=waits.append)
    assert len(calls) == 6
    seen = []

    def aside():
        try:
            plugins.within(0.2, time.sleep, 5)
        except TimeoutError:
            seen.append("late")
        seen.append(plugins.within(2, lambda x: x + 1, 1))
        try:
            with plugins.time_limit(1):
                seen.append("silent")
        except RuntimeError:
            seen.append("refused")

    t = threading.Thread(target=aside)
    t.start()
    t.join(10)
    assert seen == ["late", 2, "refused"]
    with pytest.raises(TimeoutError):
        plugins.within(0.2, time.sleep, 5)


def test_rate_limited_manager(spark):
    df = spark.createDataFrame([("a", "a", 1, 1), ("b", "c", 1, 1), ("x", "x", 1, 2)], "response string, ground_truth string, response_length int, max_length int")

    def score(text, truth):
        if text == "x":
            raise ValueError
        return float(text == truth)

    got = plugins.reward_managers.get("rate_limited")(df, score, per_minute=60_000, tasks=2, attempts=1)
    assert sorted((r["response"], r["rewards"]) for r in got.collect()) == [("a", [1.0]), ("b", [0.0]), ("x", [0.0, 0.0])]


def test_scheduled_samples_run_on_so_many_slots(spark):
    rows = [("s", i, i, 3.0) for i in range(5)] + [("t", 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "stream string, seq int, sample_id int, seconds double")
    plain = sorted(tuple(r) for r in queues.scheduled(df, 2).collect())
    assert plain == [("s", 0, 1, 0.0, 3.0, True), ("s", 1, 1, 0.0, 3.0, True), ("s", 2, 1, 3.0, 6.0, True), ("s", 3, 1, 3.0, 6.0, True), ("s", 4, 1, 6.0, 9.0, True), ("t", 0, 1, 0.0, 1.0, True)]
    cut = sorted(tuple(r) for r in queues.scheduled(df.where("stream = 's' and seq < 3"), 2, stops=[2.0]).collect())
    assert cut == [("s", 0, 1, 0.0, 2.0, False), ("s", 0, 2, 2.0, 5.0, True), ("s", 1, 1, 0.0, 2.0, False), ("s", 1, 2, 2.0, 5.0, True), ("s", 2, 1, 5.0, 8.0, True)]


def test_minibatches_are_dealt_by_themselves():


    lengths = [(i * 37) % 50 + 1 for i in range(70)]
    parts = Z.data_parallel(lengths, 4, minibatch=16)
    assert sorted(i for p in parts for i in p) == list(range(64))
    assert all(sum(a <= i < a + 16 for i in p) == 4 for p in parts for a in range(0, 64, 16))


def test_cached_copies(spark, tmp_path):


    source = f"{tmp_path}/in"
    spark.range(5).coalesce(1).write.parquet(source)
    at = io.cached_copy(spark, source, f"{tmp_path}/cache")
    assert spark.read.parquet(at).count() == 5 and io.cached_copy(spark, source, f"{tmp_path}/cache") == at
    spark.range(50).coalesce(1).write.mode("overwrite").parquet(source)
    assert spark.read.parquet(io.cached_copy(spark, source, f"{tmp_path}/cache", verify=False)).count() == 5
    assert spark.read.parquet(io.cached_copy(spark, source, f"{tmp_path}/cache")).count() == 50
