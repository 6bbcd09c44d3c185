"""Queries over sources and sinks, column algebra, encoders, prepared rows, registries, dispatch and queues that no other query calls."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from rillflow import schemas
from rillflow.functions import masked as M
from rillflow.functions import scoring as S
from rillflow.operators import advantage, balance, losses, metrics, offpolicy, plugins, prep
from rillflow.operators import batch as B
from rillflow.plans.frames import SEQ, TOK, sequences, table, tokens
from rillflow.plans.learning import r
from rillflow.plans.registry import ORACLES, query
from rillflow.plans.tables import ORD, orders
from rillflow.scratch import scratch_dir
from rillflow.sources import io
from rillflow.streaming import queues


def folder(spark, name: str) -> str:
    """A new folder among the scratch tables."""
    import uuid

    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


# ---------------------------------------------------------------- A: sources and sinks


@query("nested_columns", "SELECT o_orderkey AS k, o_custkey AS inner_c, o_totalprice AS only FROM orders")
def nested_columns(spark, d):
    o = orders(spark, d).select("k", F.struct(F.struct(F.col("c").alias("id")).alias("customer")).alias("info"), F.array("p").alias("p"))
    return o.select("k", io.nested(["info", "customer", "id"]).alias("inner_c"), io.unwrap_singleton(o, "p").alias("only"))


@query("parquet_round_trip", "SELECT o_orderkey AS k, o_orderpriority AS s, o_totalprice AS p FROM orders")
def parquet_round_trip(spark, d):
    """Written by priority, copied through a cache, and read back by files of drifting schemas."""
    at = folder(spark, "trip")
    io.make_dirs(spark, at)
    io.write_parquet(orders(spark, d).select("k", "s", "p").where("p < 150000"), f"{at}/a", ["s"])
    io.save(orders(spark, d).select("s", "k", "p", F.lit(1).alias("more")).where("p >= 150000"), f"{at}/b")
    copied = io.cached_copy(spark, f"{at}/a", f"{at}/cache")
    if not io.exists(spark, copied) or io.cached_copy(spark, f"{at}/a", f"{at}/cache") != copied:
        raise FileNotFoundError(copied)
    return io.read_parquet(spark, copied, f"{at}/b", drifting=True).select("k", "s", "p")


@query("rollout_dump", "SELECT CAST(o_orderkey % 5 AS INTEGER) AS step, o_orderkey AS k, replace(replace(o_orderpriority, 'URGENT', '*'), 'LOW', '*') AS output, round(o_totalprice, 2) AS score FROM orders WHERE o_orderkey % 5 = 3 AND o_orderpriority LIKE '%-%'")
def rollout_dump(spark, d):
    at = folder(spark, "dump")
    o = orders(spark, d).select((F.col("k") % 5).alias("step"), F.lit("").alias("input"), F.col("s").alias("output"), F.lit("").alias("gts"), F.col("p").alias("score"), "k")
    io.dump_rollouts(o, at)
    seen = io.view(io.read_rollouts(spark, at, ["URGENT", "LOW"]), step=3, keyword="-", fields=["step", "k", "output", "score"])
    return seen.select("step", "k", "output", r("score", 2).alias("score"))


@query("metric_log", "SELECT r_regionkey AS step, 'val' AS title, 'size/' || r_name AS series, CAST(length(r_name) AS DOUBLE) AS value FROM region")
def metric_log(spark, d):
    at = folder(spark, "metrics")
    m = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("step"), F.concat(F.lit("val/size/"), "r_name").alias("metric"), F.char_length("r_name").cast("double").alias("value"))
    io.log_metrics(schemas.validate(m, schemas.METRICS), at)
    back = spark.read.schema("step long, data map<string, double>").json(at).select("step", F.explode("data").alias("metric", "value"))
    return io.titled(back).select(F.col("step").cast("int").alias("step"), "title", "series", "value")


@query("console_lines", "SELECT r_regionkey AS step, 'step:' || r_regionkey || ' - a:' || CAST(r_regionkey AS DOUBLE) || ' - b:1.5' AS line FROM region")
def console_lines(spark, d):
    t = table(spark, d, "region").select(F.col("r_regionkey").alias("step"), F.explode(F.array(F.struct(F.lit("b").alias("metric"), F.lit(1.5).alias("value")), F.struct(F.lit("a").alias("metric"), F.col("r_regionkey").cast("double").alias("value")))).alias("x"))
    return io.console_lines(t.select("step", "x.metric", "x.value")).select("step", "line")


@query("trajectory_dump", "SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, arg_min(role, turn) AS opens, arg_max(text, turn) AS closes FROM conversations GROUP BY conv_id")
def trajectory_dump(spark, d):
    at = folder(spark, "trajectories")
    io.dump_trajectories(table(spark, d, "conversations"), at)
    back = spark.read.schema("conv_id long, turns array<struct<turn:int,role:string,text:string>>").json(at)
    return back.select("conv_id", F.size("turns").alias("turns"), F.get("turns", F.lit(0))["role"].alias("opens"), F.element_at("turns", -1)["text"].alias("closes"))


@query("loader_resumed", f"WITH {ORD} SELECT k, e AS epoch, i // 50 AS batch FROM ord, (SELECT unnest([0, 1]) AS e) WHERE e > 0 OR i // 50 >= 3")
def loader_resumed(spark, d):
    at = folder(spark, "state")
    io.save_state(spark, at, 0, 3, 7)
    state = io.load_state(spark, at)
    return B.resume(B.minibatches(orders(spark, d), 50, 2, "k"), state["epoch"], state["batch"]).select("k", "epoch", "batch")


# ---------------------------------------------------------------- B: columns


@query("column_algebra", "SELECT o_orderkey AS k, o_totalprice AS ref_p, 7 AS seven, o_totalprice * 2 AS twice, 'none' AS absent FROM orders WHERE o_custkey % 2 = 0")
def column_algebra(spark, d):
    o = B.take_mask(B.assign(orders(spark, d), seven=7, twice=F.col("p") * 2, even=F.col("c") % 2 == 0), "even")
    o = B.prefix(o, "ref_", ["p"])
    return B.select(o, ["k", "ref_p", "seven", "twice"]).withColumn("absent", B.get(o, "missing", "none"))


@query("listed_columns", "SELECT o_custkey AS c, list(o_orderkey ORDER BY o_orderkey)[1] AS first, list(o_totalprice ORDER BY o_orderkey)[-1] AS last, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY o_custkey")
def listed_columns(spark, d):
    g = B.append_lists(orders(spark, d), "c", ["k", "p"], "k")
    return g.select("c", F.get("k", F.lit(0)).alias("first"), F.element_at("p", -1).alias("last"), F.size("k").alias("n"))


@query("rows_to_columns", "SELECT user_id AS u, list(event_id ORDER BY event_id)[1] AS first, list(event_type ORDER BY event_id)[-1] AS last, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY user_id")
def rows_to_columns(spark, d):
    """A user's events as rows of one column, then as columns."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("u")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("rows"))
    c = B.to_columns(e, "rows")
    return c.select("u", F.get("event_id", F.lit(0)).alias("first"), F.element_at("event_type", -1).alias("last"), F.size("value").alias("n"))


@query("padded_batches", """WITH c AS (SELECT conv_id, conv_id // 8 AS batch, list(length(text) ORDER BY turn) AS x FROM conversations GROUP BY conv_id), m AS (SELECT batch, max(len(x)) AS n FROM c GROUP BY batch)
 SELECT conv_id, CAST(n AS INTEGER) AS n, CAST(len(x) AS INTEGER) AS real, CAST(list_sum(x) - (n - len(x)) AS BIGINT) AS total FROM c JOIN m USING (batch)""")
def padded_batches(spark, d):
    """Lengths of turns, eight conversations a batch, filled up with -1."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("l")))).alias("x"))
    c = B.collate(c.select("conv_id", F.expr("conv_id div 8").alias("batch"), F.col("x.l").alias("x")), "batch", {"x": -1}, mask="m")
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, v: t + v)
    return c.select("conv_id", F.size("x").alias("n"), add("m").cast("int").alias("real"), add("x").alias("total"))


@query("generation_batch", "SELECT o_orderkey AS k, o_custkey AS uid, o_totalprice AS p FROM orders")
def generation_batch(spark, d):
    o = orders(spark, d).withColumnRenamed("c", "uid")
    given, kept = B.generation_inputs(o, ["k", "s"])
    B.assert_equal(given.select("uid").where("uid < 5"), orders(spark, d).where("c < 5").select(F.col("c").alias("uid")))
    return B.union_columns(given.select("k", "uid"), o.select("k", *[c for c in kept.columns if c != "uid"]), "k").select("k", "uid", "p")


@query("restored_order", f"WITH {ORD} SELECT k, i AS row_idx FROM ord")
def restored_order(spark, d):
    o = B.row_index(orders(spark, d), "k")
    shuffled = o.repartition(7, B.shuffle_order(o, "k", 3))
    return balance.restore(shuffled).select("k", "row_idx")


@query("validation_batch", f"WITH {ORD} SELECT k, i AS row_idx, CAST(0 AS BIGINT) AS batch FROM ord")
def validation_batch(spark, d):
    return B.whole(orders(spark, d), "k").select("k", "row_idx", "batch")


# ---------------------------------------------------------------- D: masks and encoders


@query("clipped_values", f"WITH {TOK} SELECT seq_id, CAST(pos AS BIGINT) AS pos, round(greatest(least(reward, 0.5), 0.1), 9) AS held FROM tok")
def clipped_values(spark, d):
    return tokens(spark, d).select("seq_id", F.col("pos").cast("long").alias("pos"), r(M.clip("reward", 0.1, 0.5), 9).alias("held"))


@query("tail_and_completion", f"""WITH {TOK}, s AS (SELECT seq_id, list(mask ORDER BY pos) AS m, count(*) AS n FROM tok GROUP BY seq_id)
 SELECT seq_id, CAST(list_sum(m[n - n // 2 + 1 :]) AS BIGINT) AS tail, CAST(2 * CASE WHEN list_position(m, 1) > 0 THEN list_position(m, 1) ELSE n END AS BIGINT) AS complete FROM s WHERE n > 1""")
def tail_and_completion(spark, d):
    """The mask of the last half of a sequence, and steps up to and including the first that completes, each two tokens long."""
    s = sequences(spark, d).where(F.size("mask") > 1)
    half = F.slice("rewards", F.lit(1), F.expr("size(rewards) div 2"))
    done = F.transform("mask", lambda m: m == 1)
    return s.select("seq_id", M.mask_count(M.tail_mask("mask", half)).alias("tail"), M.mask_count(M.completion_mask(done, 2)).alias("complete"))


@query("random_masks", """WITH u AS (SELECT o_orderkey AS k, ('0x' || substr(md5('4:' || o_orderkey || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS a, ('0x' || substr(md5('4:' || o_orderkey || ':2'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS b FROM orders)
 SELECT k, CAST(floor(a * 0.2 * 64) AS BIGINT) AS padding, CAST(floor((b * (0.8 - 0.1) + 0.1) * 64) AS BIGINT) AS n FROM u""")
def random_masks(spark, d):
    m = M.random_mask(F.col("k"), 64, seed=4)
    t = orders(spark, d).select("k", m.alias("m"))
    return t.select("k", (F.array_position("m", 1) - 1).alias("padding"), M.mask_count("m").alias("n"))


@query("packed_values", f"WITH {TOK} SELECT seq_id, CAST(sum(mask) AS INTEGER) AS packed, CAST(64 AS INTEGER) AS padded, round(sum(mask * value), 6) AS total FROM tok GROUP BY seq_id")
def packed_values(spark, d):
    s = sequences(spark, d).withColumn("x", M.unpad("values", "mask"))
    s = s.withColumn("y", M.pad("x", 64, 0.0, left=True))
    return s.select("seq_id", F.size("x").alias("packed"), F.size("y").alias("padded"), r(M.array_sum("y")).alias("total"))


# ---------------------------------------------------------------- F, H, I: metrics, presets, balance


@query("sample_log", f"WITH {ORD} SELECT k FROM ord ORDER BY md5('42:' || k), k LIMIT 16")
def sample_log(spark, d):
    return metrics.log_samples(orders(spark, d), "k", 16).select("k")


@query("config_names", """SELECT n_nationkey AS k, unnest(['of/name', 'of/region/name', 'of/region/no']) AS name, unnest([n_name, r_name, r_regionkey::VARCHAR]) AS value FROM nation JOIN region ON r_regionkey = n_regionkey""")
def config_names(spark, d):
    """Nested settings of every nation as flat names."""
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    region = F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("no"))
    t = n.join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.struct(F.col("n_name").alias("name"), region.alias("region")).alias("of"))
    return metrics.flatten_fields(t, ["k"])


@query("correction_preset", f"""WITH {TOK}, s AS (SELECT seq_id, sum(mask * (old_lp - rollout_lp)) AS d FROM tok GROUP BY seq_id)
 SELECT t.seq_id, CAST(t.pos AS BIGINT) AS pos, round(least(exp(greatest(least(d, 20), -20)), 1.05) * t.mask, 6) AS weight FROM tok t JOIN s USING (seq_id)""")
def correction_preset(spark, d):
    t = offpolicy.preset("seq_is", 1.05).apply(tokens(spark, d))
    return t.select("seq_id", F.col("pos").cast("long").alias("pos"), r("is_weight").alias("weight"))


@query("balance_greedy")
def balance_greedy(spark, d):
    """Orders in batches of 64 dealt greedily to four ranks of equal counts."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).cast("long").alias("len"))
    t = B.batches(lines, 64, "k", drop_last=True)
    return balance.assign(t, "batch", "k", "len", lambda x: balance.greedy(x, 4, equal=True))


@query("balance_minibatches")
def balance_minibatches(spark, d):
    """Orders in batches of 128 dealt to four ranks, each mini-batch of 32 by itself."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).cast("long").alias("len"))
    t = B.batches(lines, 128, "k", drop_last=True)
    return balance.assign(t, "batch", "k", "len", lambda x: balance.data_parallel(x, 4, minibatch=32))


@query("sticky_servers", "WITH f AS (SELECT user_id AS id, min((ts, event_id)) AS x FROM events GROUP BY user_id), s AS (SELECT id, CAST((row_number() OVER (ORDER BY x, id) - 1) % 6 AS INTEGER) AS server FROM f) SELECT event_id, server FROM events JOIN s ON s.id = user_id")
def sticky_servers(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return balance.least_loaded(e, "user_id", ["ts", "event_id"], 6).select("event_id", "server")


# ---------------------------------------------------------------- K: prepared rows


def prompt(df, *more):
    m = F.element_at("prompt", -1)
    return df.select("data_source", m["content"].alias("asked"), F.col("reward_model.ground_truth").alias("truth"), F.size("prompt").alias("turns"), *more)


@query("gsm8k_rows", """SELECT 'openai/gsm8k' AS data_source, item_id || ' Let''s think step by step and output the final answer after "####".' AS asked, CAST(length(text) AS VARCHAR) AS truth, CAST(2 AS INTEGER) AS turns, 'tool_agent' AS agent FROM benchmark""")
def gsm8k_rows(spark, d):
    t = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question"), F.concat("text", F.lit("\n#### "), F.format_number(F.char_length("text"), 0)).alias("answer"))
    return prompt(prep.gsm8k(t, "agent"), F.col("agent_name").alias("agent"))


@query("math_rows", r"SELECT 'math' AS data_source, item_id || ' Let''s think step by step and output the final answer within \boxed{}.' AS asked, '{' || item_id || '}' AS truth, CAST(1 AS INTEGER) AS turns FROM benchmark")
def math_rows(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("problem"), F.concat(F.lit("so \\boxed{1} and \\boxed{{"), F.col("item_id").cast("string"), F.lit("}}.")).alias("solution"))
    return prompt(prep.math_rows(b))


@query("exam_rows", r"SELECT 'aime' AS data_source, text || ' Let''s think step by step and output the final answer within \boxed{}.' AS asked, CAST(length(text) AS VARCHAR) AS truth, CAST(1 AS INTEGER) AS turns, 'test' AS split FROM benchmark WHERE length(text) % 2 = 0")
def exam_rows(spark, d):
    n = F.char_length("text")
    t = table(spark, d, "benchmark").select(F.col("text").alias("question"), F.when(n % 2 == 0, n).alias("answer"))
    return prompt(prep.exam_rows(t, "aime"), F.col("extra_info.split").alias("split"))


@query("multiple_endings", "SELECT 'hellaswag' AS data_source, p_name || ': ' || p_brand || ' ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS asked, CAST(p_size AS VARCHAR) AS truth, CAST(1 AS INTEGER) AS turns FROM part WHERE p_size % 3 > 0")
def multiple_endings(spark, d):
    p = table(spark, d, "part")
    t = p.select(F.col("p_name").alias("activity_label"), F.col("p_brand").alias("ctx_a"), F.lower("p_type").alias("ctx_b"), F.array(F.lit("x"), F.lit("y")).alias("endings"),
                 F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).otherwise("").alias("label"))
    return prompt(prep.multiple_endings(t))


@query("search_prompts", """SELECT 'searchR1_nq' AS data_source, 'Answer the given question. ' || n_name AS asked, '{"target":["' || n_name || '"]}' AS truth, CAST(2 AS INTEGER) AS turns FROM nation""")
def search_prompts(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("question"), F.lit("nq").alias("data_source"), F.array("n_name").alias("golden_answers"))
    return prompt(prep.search_rows(n))


@query("geometry_rows", r"SELECT 'geometry3k' AS data_source, n_name || ' Let''s think step by step and output the final answer within \boxed{}.' AS asked, CAST(n_regionkey AS VARCHAR) AS truth, CAST(1 AS INTEGER) AS turns, CAST(1 AS INTEGER) AS images FROM nation")
def geometry_rows(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("problem"), F.col("n_regionkey").cast("string").alias("answer"), F.array("n_name").alias("images"))
    return prompt(prep.geometry_rows(n), F.size("images").alias("images"))


@query("tool_copies", "SELECT n_name AS question, CAST(n_regionkey AS VARCHAR) AS given, true AS needed FROM nation")
def tool_copies(spark, d):
    n = table(spark, d, "nation")
    rows = prep.rl_row(n, "x", F.col("n_name"), F.col("n_regionkey").cast("string"), "math")
    return prep.with_tool(rows).select(F.col("extra_info.question").alias("question"), F.col("extra_info.tools_kwargs.code_interpreter.create_kwargs.ground_truth").alias("given"), F.col("extra_info.need_tools_kwargs").alias("needed"))


@query("problem_rows", "SELECT o_orderkey AS k, 'P' || o_orderkey AS asked, o_orderpriority AS said FROM orders WHERE o_orderpriority = '1-URGENT'")
def problem_rows(spark, d):
    o = orders(spark, d).select(F.concat(F.lit("P"), F.col("k").cast("string")).alias("problem"), F.col("s").alias("generated_solution"), F.col("s").alias("problem_type"), "k")
    t = prep.problem_rows(o, "1-URGENT", ["k"])
    return t.select(F.col("extra_info.k").alias("k"), F.get("messages", F.lit(0))["content"].alias("asked"), F.get("messages", F.lit(1))["content"].alias("said"))


@query("turn_rows", "SELECT conv_id, CAST(count(*) AS INTEGER) AS n, arg_min(role || ': ' || text, turn) AS opens FROM conversations GROUP BY conv_id")
def turn_rows(spark, d):
    first = F.get("messages", F.lit(0))
    return prep.turn_rows(table(spark, d, "conversations")).select("conv_id", F.size("messages").alias("n"), F.concat(first["role"], F.lit(": "), first["content"]).alias("opens"))


# ---------------------------------------------------------------- M: queues


@query("unconsumed_samples", "SELECT o_orderkey AS sample_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND o_orderkey % 3 <> 1")
def unconsumed_samples(spark, d):
    o = orders(spark, d).select(F.col("k").alias("sample_id"), "p")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("n"))
    taken = o.select("sample_id", F.when(F.col("sample_id") % 3 == 1, "actor").otherwise("critic").alias("task"))
    return queues.consumable([o, lines], taken, "actor").select("sample_id")


@query("queue_until_end", "WITH e AS (SELECT user_id AS q, min(event_id) FILTER (value < 1) AS x FROM events GROUP BY user_id) SELECT event_id AS seq FROM events JOIN e ON q = user_id WHERE value >= 1 AND (x IS NULL OR event_id < x)")
def queue_until_end(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), F.when(F.col("value") >= 1, F.col("event_type")).alias("payload"))
    return queues.until_end(e).select("seq")


@query("one_step_off", "WITH b AS (SELECT DISTINCT o_orderkey // 100 AS batch FROM orders) SELECT batch, greatest(batch - 1, 0) AS generated_with, batch - greatest(batch - 1, 0) AS staleness FROM b")
def one_step_off(spark, d):
    return queues.one_step_off(orders(spark, d).select(F.expr("k div 100").alias("batch")).distinct())


@query("scheduled_samples")
def scheduled_samples(spark, d):
    """Orders of each customer as samples of one stream, on two slots, stopped twice for new parameters."""
    o = orders(spark, d).select(F.col("c").alias("stream"), F.col("k").alias("seq"), F.col("k").alias("sample_id"), (F.col("k") % 7 + 1).alias("seconds"))
    return queues.scheduled(o, 2, stops=[4.0, 9.0])


# ---------------------------------------------------------------- N, C20: registries and dispatch


@query("registered_names", f"""SELECT g.seq_id, g.adv FROM ({ORACLES["adv_grpo"]}) g JOIN orders ON o_orderkey = g.seq_id WHERE o_custkey % 2 = 0
 UNION ALL SELECT l.seq_id, l.adv FROM ({ORACLES["adv_rloo"]}) l JOIN orders ON o_orderkey = l.seq_id WHERE o_custkey % 2 = 1""")
def registered_names(spark, d):
    """Every prompt by the estimator that it names, looked up in the registry."""
    s = sequences(spark, d).withColumn("estimator", F.when(F.col("uid") % 2 == 0, "grpo").otherwise("rloo"))
    return advantage.compute_by(s, "estimator").select("seq_id", r(M.array_sum("advantages"), 5).alias("adv"))


@query("merged_tests", """SELECT doc_id, '{"inputs":["' || doc_id || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"' || n_chars || '"' ELSE '' END || '],"outputs":["a"' || CASE WHEN doc_id % 2 = 0 THEN ',"b"' ELSE '' END || ']}' AS cases FROM documents""")
def merged_tests(spark, d):
    """A public case of every document and a private one of every second."""
    case = lambda c, out: F.concat(F.lit('[{"input":"'), c.cast("string"), F.lit(f'","output":"{out}"}}]'))
    t = table(spark, d, "documents").select("doc_id", case(F.col("doc_id"), "a").alias("public"), F.when(F.col("doc_id") % 2 == 0, case(F.col("n_chars"), "b")).alias("private"))
    return t.select("doc_id", prep.merged_tests("public", "private").alias("cases"))


class Refused(Exception):
    status = 404


def served(text: str, truth: str) -> float:
    """A service that refuses what has no source; such an error is final."""
    if truth == "refused":
        raise Refused
    return float(len(text))


@query("reward_manager_rate_limited", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE * length(event_type) END AS score FROM events")
def reward_manager_rate_limited(spark, d):
    """Events scored by a service of a million calls a minute; a third of them is refused for good and counts 0."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("response"), F.when(F.col("event_id") % 3 == 0, "refused").otherwise("ok").alias("ground_truth"))
    t = e.withColumns({"response_length": F.lit(2), "max_length": F.lit(3)})
    out = plugins.reward_managers.get("rate_limited")(t, served, per_minute=1e9, seconds=30.0)
    return out.select("id", F.get("rewards", F.lit(1)).alias("score"))


@query("dataset_prompts", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 3000 ORDER BY md5('11:' || doc_id), doc_id LIMIT 150")
def dataset_prompts(spark, d):
    made = plugins.datasets.get("prompts")(spark, [f"{d}/documents.parquet"], max_tokens=3000, token_count=lambda df: F.col("n_chars"), max_samples=150, key="doc_id", seed=11)
    return made.select("doc_id", "n_chars")


@query("dataset_generated", "SELECT doc_id, lang FROM documents UNION ALL SELECT -doc_id, lang FROM documents WHERE lang = 'de'")
def dataset_generated(spark, d):
    """The prompts and one more for each, of which those in one language stay."""
    more = lambda df: df.withColumn("doc_id", -F.col("doc_id"))
    made = plugins.datasets.get("generated")(spark, [f"{d}/documents.parquet"], generate=more, keep=F.col("lang") == "de")
    return made.select("doc_id", "lang")


@query("custom_function", "SELECT doc_id, 2.0::DOUBLE * length(lang) AS score FROM documents")
def custom_function(spark, d):
    """A scorer from a Python file that is not part of the package."""
    with tempfile.TemporaryDirectory() as own:
        with open(os.path.join(own, "scorer.py"), "w") as f:
            f.write("def score(text, truth, factor=1.0):\n    return factor * len(truth or '')\n")
        score = plugins.function_from_file(os.path.join(own, "scorer.py"), "score", factor=2.0)
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("response"), F.col("lang").alias("ground_truth"))
    return plugins.scored_by(t, score).select("doc_id", "score")


@query("dispatched_parts", f"WITH {ORD}, p AS (SELECT k, i, n, false AS is_pad FROM ord UNION ALL SELECT k, n + i, n, true FROM ord WHERE i < (7 - n % 7) % 7) SELECT k, is_pad, CAST(i * 7 // ((n + 6) // 7 * 7) AS INTEGER) AS worker FROM p")
def dispatched_parts(spark, d):
    return plugins.dispatchers.get("dp_compute_proto")(orders(spark, d), 7, "k").select("k", "is_pad", "worker")


@query("dispatched_function", f"WITH {ORD}, p AS (SELECT k, i, n FROM ord UNION ALL SELECT k, n + i, n FROM ord WHERE i < (4 - n % 4) % 4) SELECT CAST(i * 4 // ((n + 3) // 4 * 4) AS INTEGER) AS worker, CAST(sum(k) AS BIGINT) AS total FROM p GROUP BY ALL")
def dispatched_function(spark, d):
    def total(pdf):
        return pdf.groupby("worker", as_index=False).agg(total=("k", "sum"))

    return plugins.dispatchers.get("dp_compute_proto_with_func")(orders(spark, d), 4, total, "worker int, total long", order_by="k")


@query("dispatched_copies", "SELECT n_nationkey AS k, w AS worker FROM nation, (SELECT unnest([0, 1, 2]) AS w) WHERE w <> 1")
def dispatched_copies(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return plugins.collect(plugins.dispatchers.get("one_to_all")(n, 3), {0: True, 1: False, 2: True})


@query("reward_manager_collabllm", "SELECT doc_id, least(length(lang) * 0.5, 1.0)::DOUBLE - 1.0::DOUBLE AS score FROM documents")
def reward_manager_collabllm(spark, d):
    measured = F.create_map(F.lit("accuracy"), F.char_length("lang").cast("double"), F.lit("tokens"), F.lit(100.0))
    t = table(spark, d, "documents").select("doc_id", measured.alias("metrics"), F.lit(1).alias("response_length"), F.lit(1).alias("max_length"))
    out = plugins.reward_managers.get("collabllm")(t, weights={"accuracy": 0.5, "tokens": -0.1, "absent": 1.0})
    return out.select("doc_id", F.get("rewards", F.lit(0)).alias("score"))


@query("reward_manager_dapo", "SELECT doc_id, 1.0::DOUBLE + least((64 - doc_id % 100) / 16.0::DOUBLE, 0.0) AS reward, doc_id % 100 > 64 AS overlong FROM documents")
def reward_manager_dapo(spark, d):
    t = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 100).alias("response_length"), F.lit(100).alias("max_length"))
    out = plugins.reward_managers.get("dapo")(t, lambda x: x.withColumn("score", F.lit(1.0)), longest=80, buffer=16)
    return out.select("doc_id", "reward", "overlong")


@query("verified_answers", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM documents")
def verified_answers(spark, d):
    from rillflow.functions import answers

    k = F.col("doc_id") % 3
    said = F.when(k == 0, "so \\boxed{x+1}").when(k == 1, "\\boxed{\\frac{2+2x}{2}}").otherwise("\\boxed{x-1}")
    return table(spark, d, "documents").select("doc_id", answers.verified_udf(said, F.lit("1+x")).alias("score"))


@query("strict_boxes", f"WITH {SEQ} SELECT seq_id, CASE WHEN seq_id % 2 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS format FROM seq")
def strict_boxes(spark, d):
    text = F.when(F.col("seq_id") % 2 == 0, "<think>a</think>\\boxed{1}").otherwise("\\boxed{1}")
    return sequences(spark, d).select("seq_id", S.geometry_score(F.lit(0.0), text).alias("format"))


@query("gathered_rows", "SELECT n_nationkey AS k, CAST(n_regionkey AS INTEGER) AS source, CAST(w AS INTEGER) AS worker FROM nation, range(5) r(w)")
def gathered_rows(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("int").alias("worker"))
    return plugins.all_gather(n, 5).select("k", "source", "worker")


@query("tool_calls_replayed", """WITH c AS (SELECT o_custkey AS conv_id, o_orderkey AS turn, CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM orders),
 x AS (SELECT *, lag(s, 1, 0.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c)
 SELECT conv_id, turn, CASE WHEN s > p THEN 0.0::DOUBLE ELSE -0.05::DOUBLE END AS reward FROM x UNION ALL SELECT conv_id, NULL, arg_max(s, turn) FROM c GROUP BY conv_id""")
def tool_calls_replayed(spark, d):
    given = F.to_json(F.struct(F.when(F.col("k") % 3 == 0, "7").otherwise("8").alias("answer"), F.lit("7").alias("ground_truth")))
    calls = orders(spark, d).select(F.col("c").alias("conv_id"), F.col("k").alias("turn"), given.alias("arguments"))
    return plugins.run_tool(calls, "calc_gsm8k_reward").select("conv_id", "turn", "reward")


@query("merged_maps", "SELECT n_nationkey AS k, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, CAST(2 AS INTEGER) AS n FROM nation")
def merged_maps(spark, d):
    n = table(spark, d, "nation")
    left = F.create_map(F.lit("name"), F.col("n_name"))
    right = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name"))
    t = n.select(F.col("n_nationkey").alias("k"), B.union_maps(left, right).alias("m"))
    return t.select("k", F.element_at("m", "name").alias("name"), F.element_at("m", "region").alias("region"), F.size("m").alias("n"))


@query("preference_metrics", f"""WITH {SEQ} SELECT round(avg(score), 6) AS "reward/score/mean", round(max(score), 6) AS "reward/score/max", round(min(score), 6) AS "reward/score/min", round(avg(score / 2), 6) AS "actor/chosen_logps",
 round(avg(len), 6) AS "response_length/mean", CAST(max(len) AS BIGINT) AS "response_length/max", CAST(min(len) AS BIGINT) AS "response_length/min", round(avg(CASE WHEN len = 4 THEN 1.0 ELSE 0.0 END), 6) AS "response_length/clip_ratio",
 round(avg(n), 6) AS "prompt_length/mean", CAST(max(n) AS BIGINT) AS "prompt_length/max", CAST(min(n) AS BIGINT) AS "prompt_length/min", round(avg(CASE WHEN n = 7 THEN 1.0 ELSE 0.0 END), 6) AS "prompt_length/clip_ratio" FROM seq""")
def preference_metrics(spark, d):
    s = advantage.scored(sequences(spark, d)).select("score", (F.col("score") / 2).alias("chosen_logps"), M.mask_count("mask").alias("response_length"), F.size("rewards").cast("long").alias("prompt_length"))
    out = metrics.preference_metrics(s, 4, 7)
    return out.select(*[r(f"`{c}`").alias(c) for c in out.columns])


@query("dump_with_extras", "SELECT n_nationkey AS sample_id, n_name AS output, length(n_name) AS size FROM nation")
def dump_with_extras(spark, d):
    """Extras that cover all samples are dumped, those of some samples are not."""
    at = folder(spark, "extras")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("sample_id"), F.lit(1).alias("step"), F.col("n_name").alias("output"))
    whole = n.select("sample_id", F.char_length("output").cast("long").alias("size"))
    io.dump_rollouts(n, at, (whole, n.where("sample_id < 3").select("sample_id", F.lit(1).alias("partial"))))
    back = spark.read.json(at)
    return back.select("sample_id", "output", "size") if "partial" not in back.columns else back


@query("choice_rows", r"SELECT 'gpqa-diamond' AS data_source, CAST(1 AS INTEGER) AS turns, true AS right_letter FROM nation")
def choice_rows(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit("Which?").alias("q"), F.concat(F.lit("yes "), "n_name").alias("a"), F.lit("no 1").alias("b"), F.lit("no 2").alias("c"), F.lit("no 3").alias("e"))
    t = prompt(prep.choice_rows(n, "gpqa-diamond", "q", "a", ["b", "c", "e"], "k"))
    right = F.contains("asked", F.concat(F.lit("\n"), "truth", F.lit(". yes "))) & F.contains("asked", F.lit("choice letter"))
    return t.select("data_source", "turns", right.alias("right_letter"))
