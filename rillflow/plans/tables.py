"""Queries over batches, metrics, balancing, filters, preparation and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions import scoring as S
from rillflow.functions.flops import Experts, Latent, Shape, utilisation
from rillflow.operators import batch as B
from rillflow.operators import balance, filters, metrics, prep, search
from rillflow.operators.advantage import scored
from rillflow.plans.frames import ROLL, SEQ, TOK, conversations, rollouts, sequences, table, tokens
from rillflow.plans.learning import r, rounded
from rillflow.plans.registry import query
from rillflow.sources import io

long = lambda c: F.col(c).cast("long")
#: Orders in a total order, numbered from 0.
ORD = "ord AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderpriority AS s, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)"


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"), F.col("o_orderpriority").alias("s"))


# ---------------------------------------------------------------- A: sources, sinks, views


@query("scan_filtered_columns", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def scan_filtered_columns(spark, d):
    o = io.read_parquet(spark, f"{d}/orders.parquet").where("o_totalprice > 300000 and o_orderstatus = 'O'")
    return B.rename(B.select(o, ["o_orderkey", "o_totalprice"]), ["o_orderkey", "o_totalprice"], ["k", "p"])


@query("positional_split", f"WITH {ORD} SELECT k, CASE WHEN i < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM ord")
def positional_split(spark, d):
    a, b = prep.positional_split(orders(spark, d), 0.75, "k")
    return a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test"))).select("k", "split")


@query("corpus_lookup", "SELECT o_custkey AS k, any_value(c_name) AS name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def corpus_lookup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), "c_name")
    return search.lookup(c, orders(spark, d), "c").groupBy(F.col("c").alias("k")).agg(F.first("c_name").alias("name"), F.count(F.lit(1)).alias("n"))


@query("metric_names", "SELECT n_nationkey AS k, regexp_replace(regexp_replace(replace('val//' || n_name || '@' || n_regionkey || ' (x)', '@', '_at_'), '/+', '/', 'g'), '[^/\\w.\\- :]', '_', 'g') AS name FROM nation")
def metric_names(spark, d):
    n = table(spark, d, "nation")
    raw = F.concat(F.lit("val//"), "n_name", F.lit("@"), F.col("n_regionkey").cast("string"), F.lit(" (x)"))
    return n.select(F.col("n_nationkey").alias("k"), metrics.sanitise(raw).alias("name"))


@query("generations_table", f"""WITH {ROLL}, x AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY id) AS rn FROM roll)
 SELECT uid AS step, max(CASE WHEN rn = 1 THEN data_source END) AS output_1, round(max(CASE WHEN rn = 1 THEN score END), 6) AS score_1, round(max(CASE WHEN rn = 2 THEN score END), 6) AS score_2 FROM x GROUP BY uid""")
def generations_table(spark, d):
    from pyspark.sql.window import Window

    e = rollouts(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy("id"))).where("rank <= 2")
    e = e.select(F.col("uid").alias("step"), "rank", F.lit("").alias("input"), F.col("data_source").alias("output"), "score")
    return metrics.generations_wide(e, 2).select("step", "output_1", r("score_1").alias("score_1"), r("score_2").alias("score_2"))


# ---------------------------------------------------------------- B, C: batch algebra


@query("take_rows", f"WITH {ORD}, w AS (SELECT unnest([5, 0, 5, 17]) AS i, unnest([0, 1, 2, 3]) AS out_pos) SELECT w.out_pos, k FROM w JOIN ord ON ord.i = w.i UNION ALL SELECT 4, k FROM ord WHERE i = n - 1")
def take_rows(spark, d):
    return B.take(orders(spark, d), [5, 0, 5, 17, -1], "k").select(F.col("out_pos").cast("int").alias("out_pos"), "k")


@query("slice_rows", f"WITH {ORD} SELECT k, i AS row_idx FROM ord WHERE i >= n - 500 AND i < n - 20 AND (i - (n - 500)) % 7 = 0")
def slice_rows(spark, d):
    return B.slice_rows(orders(spark, d), "k", -500, -20, 7).select("k", "row_idx")


@query("reorder_rows", f"WITH {ORD} SELECT k, n - 1 - i AS out_pos FROM ord")
def reorder_rows(spark, d):
    o = orders(spark, d)
    n = o.count()
    back = spark.range(n).select(F.col("id").alias("row_idx"), (n - 1 - F.col("id")).alias("out_pos"))
    return B.reorder(o, back, "k").select("k", "out_pos")


@query("split_columns", "SELECT o_orderkey AS k, o_totalprice AS popped, o_orderpriority AS kept FROM orders")
def split_columns(spark, d):
    taken, rest = B.pop(orders(spark, d), ["p"], keys=["k"])
    return B.union_columns(B.rename(taken, "p", "popped"), B.rename(rest.drop("c"), "s", "kept"), "k")


@query("concat_and_grow", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders UNION ALL SELECT -o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 50000")
def concat_and_grow(spark, d):
    o = orders(spark, d).select("k", "p")
    return B.grow(o, o.withColumn("k", -F.col("k")), F.col("p") < 50000)


@query("repeat_interleave", f"WITH {ORD} SELECT k, rep, i * 3 + rep AS interleaved, rep * n + i AS tiled FROM ord, (SELECT unnest([0, 1, 2]) AS rep)")
def repeat_interleave(spark, d):
    o = B.row_index(orders(spark, d), "k")
    n = o.count()
    t = B.repeat(o, 3)
    return t.select("k", "rep", (F.col("row_idx") * 3 + F.col("rep")).alias("interleaved"), (F.col("rep") * n + F.col("row_idx")).alias("tiled"))


@query("repeat_by_row", "SELECT o_orderkey AS k, CAST(unnest(range(0, o_orderkey % 4)) AS INTEGER) AS rep FROM orders")
def repeat_by_row(spark, d):
    return B.repeat_rows(orders(spark, d), F.col("k") % 4).select("k", "rep")


@query("unfold_chunks", f"WITH {TOK}, s AS (SELECT seq_id, list(CAST(round(value * 49.0) AS BIGINT) ORDER BY pos) AS x, count(*) // 2 AS h FROM tok GROUP BY seq_id) SELECT seq_id, c AS chunk, CAST(list_sum(x[c * h + 1 : (c + 1) * h]) AS BIGINT) AS total FROM s, (SELECT unnest([0, 1]) AS c) WHERE h > 0")
def unfold_chunks(spark, d):
    s = sequences(spark, d).withColumn("x", F.transform("values", lambda v: F.round(v * 49.0).cast("long"))).where(F.size("x") > 1)
    t = B.unfold_chunks(s.select("seq_id", "x"), 2, ["x"])
    return t.select("seq_id", "chunk", F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("fold_groups", f'WITH {ORD} SELECT i // 5 AS "group", round(sum(p), 2) AS total, min(k) AS first FROM ord GROUP BY i // 5')
def fold_groups(spark, d):
    g = B.fold(orders(spark, d), 5, "k", ["k", "p"])
    return g.select("group", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 2).alias("total"), F.array_min("k").alias("first"))


@query("chunk_rows", f"WITH {ORD} SELECT k, CAST(i // ((n + 6) // 7) AS INTEGER) AS chunk, CAST(ntile(7) OVER (ORDER BY k) - 1 AS INTEGER) AS part FROM ord")
def chunk_rows(spark, d):
    a = B.chunk(orders(spark, d), 7, "k").select("k", "chunk")
    return a.join(B.chunk(orders(spark, d), 7, "k", even=True, name="part").select("k", "part"), "k")


@query("split_batches", f"WITH {ORD} SELECT k, i // 64 AS batch FROM ord WHERE i < n // 64 * 64")
def split_batches(spark, d):
    return B.batches(orders(spark, d), 64, "k", drop_last=True).select("k", "batch")


@query("pad_to_divisor", f"WITH {ORD} SELECT k, i AS row_idx, false AS is_pad FROM ord UNION ALL SELECT k, n + i, true FROM ord WHERE i < (64 - n % 64) % 64")
def pad_to_divisor(spark, d):
    return B.pad_to_divisor(orders(spark, d), 64, "k").select("k", "row_idx", "is_pad")


@query("pad_rows", f"WITH {ORD} SELECT k, count(*) AS copies FROM (SELECT k FROM ord UNION ALL SELECT k FROM ord, range(3) WHERE i = n - 1) GROUP BY k")
def pad_rows(spark, d):
    return B.pad_rows(orders(spark, d), 3, "k", "last").groupBy("k").agg(F.count(F.lit(1)).alias("copies"))


@query("minibatches", f"WITH {ORD} SELECT k, e AS epoch, i // 50 AS batch FROM ord, (SELECT unnest([0, 1]) AS e)")
def minibatches(spark, d):
    return B.minibatches(orders(spark, d), 50, 2, "k").select("k", "epoch", "batch")


@query("curriculum_order", f"WITH {SEQ}, s AS (SELECT o_orderkey AS k, o_custkey AS c, mean FROM orders LEFT JOIN grp ON uid = o_custkey) SELECT k, row_number() OVER (ORDER BY round(mean, 9) NULLS FIRST, k) - 1 AS row_idx FROM s")
def curriculum_order(spark, d):
    stats = scored(sequences(spark, d)).groupBy(F.col("uid").alias("c")).agg(F.round(F.avg("score"), 9).alias("m"))
    return B.curriculum(orders(spark, d).select("k", "c"), stats, "c", F.col("m"), tie=["k"]).select("k", "row_idx")


@query("upsample", "SELECT o_orderpriority AS s, count(*) * CASE WHEN o_orderpriority = '1-URGENT' THEN 4 ELSE 1 END AS n FROM orders GROUP BY o_orderpriority")
def upsample(spark, d):
    o = orders(spark, d)
    return B.upsample([(o.where("s = '1-URGENT'"), 4), (o.where("s <> '1-URGENT'"), 1)]).groupBy("s").agg(F.count(F.lit(1)).alias("n"))


@query("fan_out", f"WITH {ORD}, x AS (SELECT k, rep, ntile(3) OVER (ORDER BY k, rep) - 1 AS replica FROM ord, (SELECT unnest([0, 1]) AS rep)) SELECT k, rep, CAST(replica AS INTEGER) AS replica FROM x")
def fan_out(spark, d):
    return B.fan_out(orders(spark, d), 2, 3, "k").select("k", "rep", "replica")


@query("flatten_trajectories", f"WITH {TOK} SELECT seq_id, uid, pos AS step, round(reward, 6) AS reward FROM tok")
def flatten_trajectories(spark, d):
    t = B.flatten_trajectories(sequences(spark, d).select("seq_id", "uid", "rewards"), ["rewards"])
    return t.select("seq_id", "uid", long("step").alias("step"), r("rewards").alias("reward"))


@query("rank_shards", f"WITH {ORD}, x AS (SELECT k, n, row_number() OVER (ORDER BY md5('3:' || k), k) - 1 AS j FROM ord) SELECT k, CAST(j % 8 AS INTEGER) AS rank FROM x WHERE j < n // 8 * 8")
def rank_shards(spark, d):
    return B.rank_shards(orders(spark, d), 8, "k", 3).select("k", "rank")


@query("seeded_samples", f"WITH {ORD} SELECT k FROM ord ORDER BY md5('5:' || k), k LIMIT 100")
def seeded_samples(spark, d):
    return B.first_samples(orders(spark, d), 100, "k", seed=5).select("k")


# ---------------------------------------------------------------- F: metrics


@query("eval_mean_of_means", f"WITH {ROLL}, p AS (SELECT data_source, uid, avg(score) AS s FROM roll GROUP BY ALL) SELECT data_source, round(avg(s), 6) AS test_score FROM p GROUP BY data_source")
def eval_mean_of_means(spark, d):
    return rounded(metrics.offline_evaluation(rollouts(spark, d), F.col("score")), "data_source")


@query("data_metrics", f"""WITH {TOK}, s AS (SELECT seq_id, sum(reward) AS score, sum(reward - 0.1 * (old_lp - rollout_lp)) AS rew, sum(mask) AS len, count(*) AS plen FROM tok GROUP BY seq_id),
 a AS (SELECT avg(CASE WHEN len > 0 THEN score END) AS sm, max(CASE WHEN len > 0 THEN score END) AS sx, avg(CASE WHEN len > 0 THEN rew END) AS rm, avg(len) AS lm, max(len) AS lx, avg(CASE WHEN len = 9 THEN 1.0 ELSE 0.0 END) AS lc,
 avg(CASE WHEN len > 0 THEN len END) AS nm, avg(CASE WHEN len = 0 THEN 1.0 ELSE 0.0 END) AS ab, avg(plen) AS pm FROM s),
 t AS (SELECT avg(advantage) AS am, max(reward) AS rx, 1 - var_samp(reward - value) / (var_samp(reward) + 1e-5) AS ev FROM tok WHERE mask = 1)
 SELECT round(sm, 6) AS critic_score_mean, round(sx, 6) AS critic_score_max, round(rm, 6) AS critic_rewards_mean, round(lm, 6) AS response_length_mean, CAST(lx AS DOUBLE) AS response_length_max, round(lc, 6) AS response_length_clip_ratio,
 round(nm, 6) AS response_length_non_aborted_mean, round(ab, 6) AS response_aborted_ratio, round(pm, 6) AS prompt_length_mean, round(am, 6) AS critic_advantages_mean, round(rx, 6) AS critic_returns_max, round(ev, 6) AS critic_vf_explained_var FROM a, t""")
def data_metrics(spark, d):
    t = tokens(spark, d)
    s = t.groupBy("seq_id").agg(F.sum("reward").alias("score"), F.sum(F.col("reward") - 0.1 * (F.col("old_lp") - F.col("rollout_lp"))).alias("reward"),
                                F.sum("mask").alias("response_length"), F.count(F.lit(1)).alias("prompt_length"))
    out = rounded(metrics.data_metrics(s, t.withColumn("ret", F.col("reward")), 9, 13))
    return out.select("critic_score_mean", "critic_score_max", "critic_rewards_mean", "response_length_mean", "response_length_max", "response_length_clip_ratio", "response_length_non_aborted_mean",
                      "response_aborted_ratio", "prompt_length_mean", "critic_advantages_mean", "critic_returns_max", "critic_vf_explained_var")


@query("timing_metrics", f"""WITH {ROLL}, {TOK}, t AS (SELECT CASE data_source WHEN 'click' THEN 'gen' ELSE data_source END AS name, sum(score) AS s FROM roll GROUP BY ALL), n AS (SELECT count(*) AS p, sum(mask) AS r FROM tok)
 SELECT name, round(s, 4) AS timing_s, round(CASE WHEN name = 'gen' THEN s * 1000 / r END, 6) AS timing_per_token_ms FROM t, n""")
def timing_metrics(spark, d):
    e = rollouts(spark, d).select(F.when(F.col("data_source") == "click", "gen").otherwise(F.col("data_source")).alias("name"), F.col("score").alias("seconds"))
    n = tokens(spark, d).agg(F.count(F.lit(1)).alias("prompt_tokens"), F.sum("mask").alias("response_tokens"))
    return metrics.timing_metrics(e, n).select("name", r("timing_s", 4).alias("timing_s"), r("timing_per_token_ms").alias("timing_per_token_ms"))


@query("throughput", "SELECT CAST(count(*) AS DOUBLE) AS total_num_tokens, 2.0::DOUBLE AS time_per_step, count(*) / 16.0::DOUBLE AS throughput FROM lineitem")
def throughput(spark, d):
    return metrics.throughput(tokens(spark, d).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")), "n", 2.0, 8)


BEST = f"""{ROLL}, x AS (SELECT data_source, uid, score, row_number() OVER (PARTITION BY data_source, uid ORDER BY score) AS i, count(*) OVER (PARTITION BY data_source, uid) AS s FROM roll),
 g AS (SELECT unnest([2, 4, 8, 16, 32, 64, 128]) AS p), y AS (SELECT x.*, p AS n FROM x JOIN g ON p < s UNION ALL SELECT x.*, s FROM x WHERE s > 1),
 m AS (SELECT data_source, uid, n, any_value(s) AS s, sum(score * (pow(i::DOUBLE / s, n) - pow((i - 1)::DOUBLE / s, n))) AS b, sum(score * (pow((s - i + 1)::DOUBLE / s, n) - pow((s - i)::DOUBLE / s, n))) AS w FROM y GROUP BY ALL)"""


@query("validation_best_worst_at_n", f"WITH {BEST} SELECT data_source, CAST(n AS BIGINT) AS n, round(avg(b), 5) AS best, round(avg(w), 5) AS worst, count(*) AS prompts FROM m GROUP BY data_source, n")
def validation_best_worst_at_n(spark, d):
    b = metrics.best_worst(rollouts(spark, d), ["data_source", "uid"], "score")
    return b.groupBy("data_source", long("n").alias("n")).agg(r(F.avg("best_mean"), 5).alias("best"), r(F.avg("worst_mean"), 5).alias("worst"), F.count(F.lit(1)).alias("prompts"))


@query("validation_mean_std", f"""WITH {ROLL}, p AS (SELECT data_source, uid, avg(score) AS m, stddev_pop(score) AS s, count(*) AS n FROM roll GROUP BY ALL)
 SELECT data_source, 'mean@' || n AS metric, round(avg(m), 6) AS value FROM p GROUP BY data_source, n UNION ALL SELECT data_source, 'std@' || n, round(avg(s), 6) FROM p WHERE n > 1 GROUP BY data_source, n""")
def validation_mean_std(spark, d):
    v = metrics.validation_metrics(rollouts(spark, d).withColumnRenamed("score", "reward"), ["reward"])
    return v.where("metric like 'mean@%' or metric like 'std@%'").select("data_source", "metric", r("value").alias("value"))


@query("validation_routing", f"""WITH {ROLL}, p AS (SELECT data_source, uid, avg(score) AS m, count(*) AS n FROM roll GROUP BY ALL), x AS (SELECT data_source, n, avg(m) AS v, max(n) OVER (PARTITION BY data_source) AS top FROM p GROUP BY data_source, n)
 SELECT CASE WHEN n = top THEN 'val-core/' ELSE 'val-aux/' END || data_source || '/reward/mean@' || n AS name, round(v, 6) AS value FROM x""")
def validation_routing(spark, d):
    v = metrics.validation_metrics(rollouts(spark, d).withColumnRenamed("score", "reward"), ["reward"]).where("metric like 'mean@%'")
    return metrics.route_validation(v).select("name", r("value").alias("value"))


@query("bootstrap_metrics")
def bootstrap_metrics(spark, d):
    return rounded(metrics.bootstrap(rollouts(spark, d), ["data_source", "uid"], "score", "id", vote="k"), "data_source", "uid", "n", "name")


@query("majority_vote", f"""WITH {ROLL}, v AS (SELECT uid, data_source, k, count(*) AS c, min(id) AS f, arg_min(score, id) AS s FROM roll GROUP BY ALL)
 SELECT uid, data_source, k, round(s, 6) AS score, c AS votes FROM (SELECT *, row_number() OVER (PARTITION BY uid, data_source ORDER BY c DESC, f) AS rn FROM v) WHERE rn = 1""")
def majority_vote(spark, d):
    m = metrics.majority(rollouts(spark, d), ["uid", "data_source"], "k", "score", "id")
    return m.select("uid", "data_source", "k", r("score").alias("score"), "votes")


METRIC = "x AS (SELECT user_id % 20 AS step, 'm/' || event_type || CASE user_id % 4 WHEN 0 THEN '/max' WHEN 1 THEN '/min' WHEN 2 THEN '/sum' ELSE '/mean' END AS metric, avg(value) AS value FROM events GROUP BY ALL)"


def long_metrics(spark, d):
    tail = F.when(F.col("uid") % 4 == 0, "/max").when(F.col("uid") % 4 == 1, "/min").when(F.col("uid") % 4 == 2, "/sum").otherwise("/mean")
    e = rollouts(spark, d).select((F.col("uid") % 20).alias("step"), F.concat(F.lit("m/"), "data_source", tail).alias("metric"), "score")
    return e.groupBy("step", "metric").agg(F.avg("score").alias("value"))


@query("reduce_metrics", f"WITH {METRIC} SELECT metric, round(CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM x GROUP BY metric")
def reduce_metrics(spark, d):
    return rounded(metrics.reduce_metrics(long_metrics(spark, d)), "metric")


@query("metrics_aggregator", f"""WITH {METRIC} SELECT metric, CASE WHEN contains(metric, 'mean') THEN 'avg' WHEN contains(metric, 'max') THEN 'max' WHEN contains(metric, 'min') THEN 'min' ELSE 'sum' END AS rule,
 round(CASE WHEN contains(metric, 'mean') THEN avg(value) WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE sum(value) END, 6) AS value FROM x GROUP BY metric""")
def metrics_aggregator(spark, d):
    return rounded(metrics.aggregate_steps(long_metrics(spark, d)), "metric", "rule")


@query("agent_performance", f"""WITH {SEQ}, x AS (SELECT seq_id, score AS g, len / 10.0 AS t, n, len FROM seq) SELECT round(avg(g), 6) AS agent_loop_generate_sequences_mean, round(max(t), 6) AS agent_loop_tool_calls_max,
 round(arg_max(g, g + t), 6) AS agent_loop_slowest_generate_sequences, CAST(arg_max(n, g + t) AS DOUBLE) AS agent_loop_slowest_prompt_length FROM x""")
def agent_performance(spark, d):
    s = scored(sequences(spark, d))
    n = F.aggregate("mask", F.lit(0), lambda a, m: a + m)
    t = s.select(F.col("score").alias("generate"), (n / 10).alias("tool"), F.size("mask").alias("prompt_length"), n.alias("response_length"))
    out = rounded(metrics.agent_performance(t))
    return out.select("agent_loop_generate_sequences_mean", "agent_loop_tool_calls_max", "agent_loop_slowest_generate_sequences", "agent_loop_slowest_prompt_length")


@query("assembly_stats", f"""WITH {ROLL} SELECT round(avg(score), 6) AS avg, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99,
 sum(CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END)::DOUBLE AS partial_count, max(k % 3)::DOUBLE AS max_partial_span, count(DISTINCT k + k % 3)::DOUBLE AS version_diversity FROM roll""")
def assembly_stats(spark, d):
    e = rollouts(spark, d).select(F.col("score").alias("processing_time"), F.col("k").alias("version_start"), (F.col("k") + F.col("k") % 3).alias("version_end"))
    return rounded(metrics.assembly_stats(e)).select("avg", "p50", "p95", "p99", "partial_count", "max_partial_span", "version_diversity")


@query("debug_metrics", f"WITH {TOK}, x AS (SELECT exp(rollout_lp) AS p, exp(old_lp) AS q FROM tok WHERE mask = 1) SELECT 1.0::DOUBLE AS valid, round(max(abs(p - q)), 6) AS diff_max, round(avg(abs(p - q)), 6) AS diff_mean, round(stddev_samp(abs(p - q)), 6) AS diff_std, round(corr(p, q), 6) AS pearson_corr FROM x")
def debug_metrics(spark, d):
    return rounded(metrics.debug_metrics(tokens(spark, d)))


@query("token_differences", f"WITH {TOK} SELECT seq_id, CAST(sum(CASE WHEN mask = 1 AND round(old_lp, 2) <> round(rollout_lp, 2) THEN 1 ELSE 0 END) AS BIGINT) AS diff FROM tok GROUP BY seq_id")
def token_differences(spark, d):
    s = sequences(spark, d, "old_lp", "rollout_lp")
    s = s.withColumns({c: F.transform(c, lambda x: F.round(x, 2)) for c in ("old_lp", "rollout_lp")})
    return s.select("seq_id", metrics.token_differences("old_lp", "rollout_lp", "mask").alias("diff"))


@query("timing_reduce", f"WITH {ROLL} SELECT data_source AS name, round(avg(score), 6) AS mean, CAST(count(*) AS INTEGER) AS n, round(quantile_cont(score, 0.5), 6) AS p50 FROM roll GROUP BY data_source")
def timing_reduce(spark, d):
    t = metrics.reduce_timing(rollouts(spark, d).select(F.col("data_source").alias("name"), F.col("score").alias("seconds")))
    return t.select("name", r("mean").alias("mean"), F.col("n").cast("int").alias("n"), r("p50").alias("p50"))


@query("timing_tail", f"WITH {ROLL}, c AS (SELECT quantile_cont(score, 0.9) AS q FROM roll) SELECT round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(CASE WHEN score > q THEN 1.0 ELSE 0.0 END), 6) AS tail_ratio FROM roll, c")
def timing_tail(spark, d):
    return rounded(metrics.tail_ratio(rollouts(spark, d), "score"))


#: Weights a token meets, worked out by hand for the three shapes of the query.
SHAPES = {
    "dense": (Shape(hidden=64, layers=4, vocab=1000, heads=8, kv_heads=2, mlp=256), "6.0 * (4 * (64 * 8 * 20 + 64 * 256 * 3) + 2 * 1000 * 64) * n + 12.0 * 8 * 8 * 4 * n * n"),
    "experts": (Shape(hidden=64, layers=4, vocab=1000, heads=8, kv_heads=2, mlp=256, experts=Experts(16, 2, 32)), "6.0 * (4 * (64 * 8 * 20 + 64 * (16 + 3 * 32 * 2)) + 2 * 1000 * 64) * n + 12.0 * 8 * 8 * 4 * n * n"),
    "sliding": (Shape(hidden=64, layers=6, vocab=1000, heads=8, kv_heads=2, mlp=256, window=3), "6.0 * (6 * (64 * 8 * 20 + 64 * 256 * 3) + 2 * 1000 * 64) * n + 12.0 * 8 * 8 * (n * n + 5 * n * least(n, 3))"),
    "latent": (Shape(hidden=64, layers=4, vocab=1000, heads=8, kv_heads=8, mlp=256, experts=Experts(16, 2, 32, shared=1, dense_layers=1), latent=Latent(24, 16, 8, 4, 8)),
               "6.0 * (4 * (24 * (64 + 96) + 64 * 20 + 8 * 16 * 16 + 64 * 64) + 64 * 256 * 3 + 3 * 64 * (16 + 3 * 32 * 3) + 2 * 1000 * 64) * n + 12.0 * 8 * 12 * 4 * n * n"),
}


@query("flops_estimate", f"WITH {TOK}, s AS (SELECT uid % 10 AS step, seq_id, count(*)::DOUBLE AS n FROM tok GROUP BY ALL) " + " UNION ALL ".join(
    f"SELECT step, '{k}' AS shape, round(sum({sql}) / 2.5 / 1e12, 9) AS tflops FROM s GROUP BY step" for k, (_, sql) in SHAPES.items()))
def flops_estimate(spark, d):
    s = tokens(spark, d).groupBy((F.col("uid") % 10).alias("step"), "seq_id").agg(F.count(F.lit(1)).alias("length")).withColumn("seconds", F.lit(2.5))
    parts = [utilisation(s, shape, "length", "seconds", "H100", ["step"]).select("step", F.lit(k).alias("shape"), r("tflops", 9).alias("tflops")) for k, (shape, _) in SHAPES.items()]
    return B.concat(parts)


@query("pair_accuracy", f"""WITH {SEQ}, x AS (SELECT *, (seq_id % 3) / 2.0 AS acc FROM seq), p AS (SELECT a.uid, sum(CASE WHEN (a.score > b.score) = (a.acc > b.acc) THEN abs(a.acc - b.acc) ELSE 0 END) AS u, sum(abs(a.acc - b.acc)) AS v FROM x a JOIN x b ON a.uid = b.uid AND a.seq_id < b.seq_id GROUP BY a.uid),
 g AS (SELECT DISTINCT uid FROM x) SELECT round(avg(coalesce(CASE WHEN v = 0 THEN NULL ELSE u / v END, 0.5)), 6) AS accuracy FROM g LEFT JOIN p USING (uid)""")
def pair_accuracy(spark, d):
    s = scored(sequences(spark, d)).select("uid", "seq_id", "score", ((F.col("seq_id") % 3) / 2).alias("acc"))
    return rounded(metrics.pair_accuracy(s, "score", "acc", order="seq_id"))


@query("conversation_reward", f"""WITH {ROLL}, g AS (SELECT uid, data_source, least(greatest(sum(score / 100) * CASE data_source WHEN 'click' THEN 0.5 ELSE -0.2 END / count(*), -1), 1) AS p FROM roll WHERE data_source IN ('click', 'view') GROUP BY uid, data_source)
 SELECT uid, round(sum(p), 6) AS reward FROM g GROUP BY uid""")
def conversation_reward(spark, d):
    e = rollouts(spark, d).select("uid", F.col("data_source").alias("metric"), (F.col("score") / 100).alias("value"))
    return rounded(metrics.conversation_reward(e, {"click": 0.5, "view": -0.2}, ["uid"]), "uid")


@query("staleness_counts", f"WITH {ROLL} SELECT CAST(sum(CASE WHEN 50 - k >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS stale_samples, count(*) AS samples FROM roll")
def staleness_counts(spark, d):
    return metrics.stale_counts(rollouts(spark, d), "k", 50)


@query("trajectory_index", """WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, event_type AS t FROM events), b AS (SELECT *, CASE WHEN t = lag(t) OVER (ORDER BY i) THEN 0 ELSE 1 END AS f FROM e),
 g AS (SELECT *, sum(f) OVER (ORDER BY i) AS run FROM b) SELECT i, t, CAST(row_number() OVER (PARTITION BY run ORDER BY i) - 1 AS INTEGER) AS rollout_n FROM g""")
def trajectory_index(spark, d):
    e = B.row_index(table(spark, d, "events").select("ts", "event_id", F.col("event_type").alias("t")), ["ts", "event_id"], "i")
    return metrics.trajectory_index(e, "t", "i").select("i", "t", "rollout_n")


# ---------------------------------------------------------------- I: balancing


@query("workload_stats", f"WITH {TOK}, s AS (SELECT seq_id, count(*) AS n FROM tok GROUP BY seq_id), p AS (SELECT seq_id % 8 AS part, sum(24576 * n + n * n) AS w FROM s GROUP BY ALL) SELECT CAST(min(w) AS BIGINT) AS lo, CAST(max(w) AS BIGINT) AS hi, CAST(sum(w) AS BIGINT) AS total FROM p")
def workload_stats(spark, d):
    s = tokens(spark, d).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    p = s.groupBy((F.col("seq_id") % 8).alias("part")).agg(F.sum(balance.workload(F.col("n"))).alias("w"))
    return p.agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.sum("w").alias("total"))


@query("serpentine_balance", f"""WITH {TOK}, s AS (SELECT seq_id, count(*) AS n FROM tok GROUP BY seq_id), o AS (SELECT *, (row_number() OVER (ORDER BY 24576 * n + n * n DESC, seq_id) - 1) % 16 AS m FROM s)
 SELECT seq_id, CAST(CASE WHEN m < 8 THEN m ELSE 15 - m END AS INTEGER) AS part FROM o""")
def serpentine_balance(spark, d):
    s = tokens(spark, d).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    return balance.serpentine(s, "n", 8, "seq_id").select("seq_id", "part")


@query("imbalance", f"""WITH {TOK}, s AS (SELECT seq_id, count(*) AS n, seq_id % 4 AS a, (seq_id // 4) % 4 AS b FROM tok GROUP BY seq_id), x AS (SELECT sum(n) AS t FROM s GROUP BY a), y AS (SELECT sum(n) AS t FROM s GROUP BY b)
 SELECT CAST(min(x.t) AS DOUBLE) AS min, CAST(max(x.t) AS DOUBLE) AS max, CAST(max(x.t) - min(x.t) AS DOUBLE) AS minmax_diff, round(avg(x.t), 6) AS mean, CAST(min(y.t) AS DOUBLE) AS balanced_min, CAST(max(y.t) AS DOUBLE) AS balanced_max FROM x, y""")
def imbalance(spark, d):
    s = tokens(spark, d).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    s = s.withColumns({"a": F.col("seq_id") % 4, "b": F.expr("(seq_id div 4) % 4")})
    return rounded(metrics.imbalance(s, "n", "a", "b"))


@query("karmarkar_karp")
def karmarkar_karp(spark, d):
    s = tokens(spark, d).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.expr("seq_id div 1000"))
    return balance.assign(s, "batch", "seq_id", "n", lambda lengths: balance.balanced(lengths, 8))


@query("micro_batches")
def micro_batches(spark, d):
    s = tokens(spark, d).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.expr("seq_id div 500"))
    return balance.assign(s, "batch", "seq_id", "n", lambda lengths: balance.micro_batches(lengths, 200))


# ---------------------------------------------------------------- L: filters


@query("dapo_filter", f"WITH {SEQ}, v AS (SELECT uid, count(*) AS k, max(seq_id % 2) - min(seq_id % 2) AS s FROM seq GROUP BY uid) SELECT seq_id, uid FROM seq WHERE uid IN (SELECT uid FROM v WHERE s > 0 OR k = 1)")
def dapo_filter(spark, d):
    s = sequences(spark, d).select("seq_id", "uid").withColumn("acc", F.col("seq_id") % 2)
    return filters.mixed_groups(s, "acc").select("seq_id", "uid")


@query("dapo_sampling", f"""WITH {SEQ}, g AS (SELECT uid, min(seq_id // 1000) AS b FROM seq GROUP BY uid HAVING count(*) = 1 OR max(seq_id % 2) > min(seq_id % 2)), k AS (SELECT uid FROM g ORDER BY b, uid LIMIT 200) SELECT seq_id, uid FROM seq WHERE uid IN (SELECT uid FROM k)""")
def dapo_sampling(spark, d):
    s = sequences(spark, d).select("seq_id", "uid").withColumns({"acc": F.col("seq_id") % 2, "gen_batch": F.expr("seq_id div 1000")})
    return filters.dynamic_sampling(s, "acc", 200).select("seq_id", "uid")


@query("prime_filter", f"""WITH {SEQ}, g AS (SELECT uid, avg(seq_id % 2) BETWEEN 0.2 AND 0.8 AND max(n) < 9 AS ok, min(seq_id) AS f FROM seq GROUP BY uid), x AS (SELECT seq_id, ok, row_number() OVER (ORDER BY ok DESC, f, seq_id) - 1 AS rk FROM seq JOIN g USING (uid))
 SELECT seq_id, ok AS passed, rk AS rank FROM x WHERE rk < (SELECT count(*) // 2 FROM seq)""")
def prime_filter(spark, d):
    s = sequences(spark, d).select("seq_id", "uid", F.size("mask").alias("n")).withColumn("acc", F.col("seq_id") % 2)
    return filters.accuracy_band(s, "acc", "n", 0.2, 0.8, 10, 2).select("seq_id", "passed", "rank")


@query("aborted_and_overlong", f"WITH {SEQ} SELECT seq_id, CAST(len AS BIGINT) AS len FROM seq WHERE len > 0 AND n <= 6")
def aborted_and_overlong(spark, d):
    s = sequences(spark, d).select("seq_id", F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("len"), F.size("mask").alias("n"))
    return filters.within_length(s, F.col("n"), 6).where(filters.not_aborted("len")).select("seq_id", "len")


@query("sample_groups", f"WITH {TOK}, g AS (SELECT uid FROM (SELECT DISTINCT uid FROM tok) ORDER BY md5('1:' || uid), uid LIMIT 50) SELECT DISTINCT seq_id, uid FROM tok SEMI JOIN g USING (uid)")
def sample_groups(spark, d):
    return filters.sample_groups(sequences(spark, d).select("seq_id", "uid"), "uid", 50, 1)


@query("string_date_range", "SELECT o_orderkey AS k FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1995-03-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1995-09-01'")
def string_date_range(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return o.where(filters.date_range("day", "1995-03-01", "1995-09-01")).select("k")


# ---------------------------------------------------------------- K: preparation


@query("rl_prompt_rows", """SELECT item_id AS k, 'bench' AS data_source, text || ' Let''s think step by step and output the final answer within \\boxed{}.' AS question, CAST(length(text) AS VARCHAR) AS truth, 'user' AS role FROM benchmark""")
def rl_prompt_rows(spark, d):
    b = table(spark, d, "benchmark")
    t = prep.rl_row(b, "bench", F.concat("text", F.lit(prep.MATH_SUFFIX)), F.char_length("text").cast("string"), "math", index=F.col("item_id"))
    return t.select(F.col("extra_info.index").alias("k"), "data_source", F.get("prompt", F.lit(0))["content"].alias("question"), F.col("reward_model.ground_truth").alias("truth"), F.get("prompt", F.lit(0))["role"].alias("role"))


@query("preference_rows", "SELECT doc_id AS k, text AS prompt, lang AS response FROM documents UNION ALL SELECT doc_id, text, source FROM documents")
def preference_rows(spark, d):
    p = table(spark, d, "documents").select(F.col("text").alias("prompt"), F.col("lang").alias("chosen"), F.col("source").alias("rejected"), "doc_id")
    both = p.select("doc_id", "prompt", F.explode(F.array("chosen", "rejected")).alias("response"))
    return both.select(F.col("doc_id").alias("k"), "prompt", "response") if prep.preferences(p)["sft"].columns == ["prompt", "response"] else None


@query("role_remap", "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'gpt' WHEN 'user' THEN 'human' ELSE role END AS raw, role, text AS content FROM conversations")
def role_remap(spark, d):
    c = conversations(spark, d)
    back = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "assistant", "gpt").when(m["role"] == "user", "human").otherwise(m["role"]).alias("from"), m["content"].alias("value")))
    t = c.withColumn("raw", back).withColumn("messages", prep.remap_roles("raw"))
    t = t.select("conv_id", F.posexplode(F.arrays_zip("raw", "messages")).alias("turn", "x"))
    return t.select("conv_id", long("turn").alias("turn"), F.col("x.raw.from").alias("raw"), F.col("x.messages.role").alias("role"), F.col("x.messages.content").alias("content"))


@query("dedup_keep_first", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_keep_first(spark, d):
    return prep.dedup_prompts(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "text")


@query("best_per_conversation", "SELECT conv_id, turn, score FROM (SELECT conv_id, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, length(text) DESC) AS rn FROM conversations) WHERE rn = 1")
def best_per_conversation(spark, d):
    c = table(spark, d, "conversations").withColumn("score", F.char_length("text").cast("long"))
    return prep.best_per_conversation(c, turn="turn").select("conv_id", "turn", "score")


@query("keep_first_by_order", "SELECT o_custkey AS c, arg_min(o_orderkey, o_orderkey) AS k FROM orders GROUP BY o_custkey")
def keep_first_by_order(spark, d):
    return prep.keep_first(orders(spark, d), ["c"], ["k"]).select("c", "k")


@query("task_states", """WITH s AS (SELECT CAST(t AS INTEGER) AS task, CAST(s AS INTEGER) AS state, t * 50 + s AS env FROM range(10) a(t), range(50) b(s)),
 r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('0:' || task || ':' || state), state) AS r FROM s)
 SELECT task, state, env, CASE WHEN task = 9 THEN 'test_ood' WHEN r <= 40 THEN 'train' ELSE 'test' END AS split FROM r WHERE (task = 9 AND r <= 10) OR (task <> 9 AND r <= 50)""")
def task_states(spark, d):
    t = spark.createDataFrame([(i, 50) for i in range(10)], "task int, n int")
    return prep.task_states(t, "task", "n", 40, 10, [9])


@query("hash_split", "SELECT o_orderkey AS k, CASE WHEN ('0x' || substr(md5('0:' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.9 THEN 'train' ELSE 'test' END AS split FROM orders")
def hash_split(spark, d):
    a, b = prep.hash_split(orders(spark, d).select("k"), 0.9, "k")
    return a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test")))


TURN_IDS = "SELECT conv_id, turn, role, list_transform(range(1, length(text) % 9 + 1), lambda x: x * 10 + turn) AS ids FROM conversations"


def turn_ids(spark, d):
    c = table(spark, d, "conversations")
    n = (F.char_length("text") % 9).cast("long")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))), lambda x: x * 10 + F.col("turn"))).otherwise(F.array().cast("array<bigint>"))
    return c.select("conv_id", "turn", "role", ids.alias("ids"))


@query("trajectory_assembly", f"""WITH t AS ({TURN_IDS}), u AS (SELECT *, len(ids) AS n, sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM t),
 k AS (SELECT *, min(CASE WHEN upto - n < 20 AND (role = 'assistant' OR upto <= 20) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ok FROM u), f AS (SELECT * FROM k WHERE ok = 1)
 SELECT conv_id, CAST(least(sum(n), 20) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n - greatest(upto - 20, 0) ELSE 0 END) AS BIGINT) AS model_tokens, CAST(count(*) + 1 AS INTEGER) AS num_turns FROM f GROUP BY conv_id""")
def trajectory_assembly(spark, d):
    t = prep.assemble_trajectory(turn_ids(spark, d), 20)
    return t.select("conv_id", F.size("response_ids").cast("long").alias("tokens"), F.aggregate("response_mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("model_tokens"), "num_turns")


@query("sft_messages", f"WITH t AS ({TURN_IDS}) SELECT conv_id, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN greatest(len(ids) - 2, 0) ELSE 0 END) AS BIGINT) AS trained FROM t GROUP BY conv_id")
def sft_messages(spark, d):
    t = turn_ids(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "ids"))).alias("turns"))
    e = prep.encode_turns(t, generation_prompt=2)
    return e.select("conv_id", F.size("input_ids").cast("long").alias("tokens"), F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("trained"))


@query("sft_encoding", f"WITH {TOK}, s AS (SELECT seq_id, count(*) AS n FROM tok GROUP BY seq_id) SELECT seq_id, CAST(least(n + 3, 10) AS BIGINT) AS tokens, CAST(greatest(least(n + 3, 10) - 2, 0) AS BIGINT) AS trained, 10::BIGINT AS length FROM s")
def sft_encoding(spark, d):
    s = sequences(spark, d).select("seq_id", F.transform("values", lambda v: F.round(v * 49.0).cast("long")).alias("response"), F.array(F.lit(7).cast("long"), F.lit(8).cast("long")).alias("prompt"))
    e = prep.encode_sft(s, "prompt", "response", 2, 10, 0, side="right")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, m: a + m)
    return e.select("seq_id", total("attention_mask").alias("tokens"), total("loss_mask").alias("trained"), F.size("input_ids").cast("long").alias("length"))


@query("rm_pairs", f"WITH {TOK}, s AS (SELECT seq_id, count(*) AS n FROM tok GROUP BY seq_id) SELECT seq_id, side, CAST(least(2 + CASE side WHEN 0 THEN n ELSE 1 END + 1, 8) AS BIGINT) AS tokens FROM s, (SELECT unnest([0, 1]) AS side)")
def rm_pairs(spark, d):
    ids = F.transform("values", lambda v: F.round(v * 49.0).cast("long"))
    s = sequences(spark, d).select("seq_id", F.array(F.lit(7).cast("long"), F.lit(8).cast("long")).alias("prompt"), ids.alias("chosen"), F.slice(ids, 1, 1).alias("rejected"))
    e = prep.encode_pairs(s, 8, 2)
    return e.select("seq_id", "side", F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("tokens"))


@query("last_turn_per_conversation", "SELECT conv_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_turn_per_conversation(spark, d):
    return prep.last_assistant(table(spark, d, "conversations"))


@query("tool_step_rewards", f"WITH {ROLL} SELECT id, CASE WHEN score > coalesce(lag(score) OVER (PARTITION BY uid ORDER BY id), 0) THEN 0.0::DOUBLE ELSE -0.05::DOUBLE END AS tool_reward FROM roll")
def tool_step_rewards(spark, d):
    return prep.tool_step_rewards(rollouts(spark, d), "uid", "id").select("id", "tool_reward")


# ---------------------------------------------------------------- O: search


@query("retrieval_topk", """WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, list_inner_product(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q, embeddings)
 SELECT q AS query_id, vec_id AS doc_id, round(s, 5) AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rn FROM s) WHERE rn <= 5""")
def retrieval_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.dense_topk(e.select(F.col("vec_id").alias("doc_id"), "embedding"), q, 5).select("query_id", "doc_id", r("score", 5).alias("score"), "rank")


BM = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM documents), tot AS (SELECT count(*) AS n, avg(len(t)) AS al FROM w),
 qt AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark),
 tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * l / al))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), tot GROUP BY ALL)"""


@query("bm25_topk", f"WITH {BM} SELECT item_id, doc_id, round(score, 5) AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM s) WHERE rn <= 3")
def bm25_topk(spark, d):
    q = table(spark, d, "benchmark")
    return search.bm25(table(spark, d, "documents"), q, 3, query_id="item_id").select("item_id", "doc_id", r("score", 5).alias("score"), "rank")


@query("passages", """WITH t AS (SELECT doc_id // 3 AS g, list(text ORDER BY doc_id) AS x FROM documents GROUP BY ALL),
 p AS (SELECT g, list_transform(range(1, len(x) + 1), lambda i: 'Doc ' || i || ' (Title: ' || split_part(x[i], chr(10), 1) || ')' || chr(10) || CASE WHEN contains(x[i], chr(10)) THEN substr(x[i], instr(x[i], chr(10)) + 1) ELSE '' END) AS d FROM t)
 SELECT g, trim(array_to_string(d, chr(10) || chr(10))) AS passages FROM p""")
def passages(spark, d):
    t = table(spark, d, "documents").groupBy(F.expr("doc_id div 3").alias("g"))
    t = t.agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    return t.select("g", search.passages(F.col("x.text")).alias("passages"))
