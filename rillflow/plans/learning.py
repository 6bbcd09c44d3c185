"""Queries over token numerics, advantages, losses and off-policy correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions import masked as M
from rillflow.operators import advantage as A
from rillflow.operators import losses as L
from rillflow.operators import offpolicy as O
from rillflow.plans.frames import ROLL, SEQ, TOK, rollouts, sequences, tokens
from rillflow.plans.registry import ORACLES, query


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df, *keys: str, digits: int = 6):
    """Keys as they are, all other columns as rounded doubles; slashes in names become underscores."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[r(F.col(f"`{c}`").cast("double"), digits).alias(c.replace("/", "_")) for c in rest])


# ---------------------------------------------------------------- D: masked numerics


@query("masked_sums", f"""WITH {TOK} SELECT seq_id, round(sum(CASE WHEN mask <> 0 THEN reward ELSE 0 END), 6) AS msum,
 round(sum(CASE WHEN mask <> 0 THEN reward ELSE 0 END) / (sum(mask) + 1e-8), 6) AS mmean, CAST(sum(mask) AS BIGINT) AS n FROM tok GROUP BY seq_id""")
def masked_sums(spark, d):
    s = sequences(spark, d)
    return s.select("seq_id", r(M.masked_sum("rewards", "mask")).alias("msum"), r(M.masked_mean("rewards", "mask")).alias("mmean"), M.mask_count("mask").alias("n"))


WHITE = """m AS (SELECT sum(mask * {v}) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM tok),
 v AS (SELECT sum(mask * ({v} - mu) * ({v} - mu)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM tok, m)"""


@query("masked_variance", f"WITH {TOK}, {WHITE.format(v='value')} SELECT round(mu, 8) AS mean, round(var, 8) AS var FROM m, v")
def masked_variance(spark, d):
    return M.masked_var(tokens(spark, d), "value").select(r("mean", 8).alias("mean"), r("var", 8).alias("var"))


@query("masked_whiten", f"WITH {TOK}, {WHITE.format(v='value')} SELECT seq_id, pos, round((value - mu) / sqrt(var + 1e-8), 6) AS white FROM tok, m, v")
def masked_whiten(spark, d):
    return M.whiten(tokens(spark, d), "value", out="white").select("seq_id", F.col("pos").cast("long").alias("pos"), r("white").alias("white"))


@query("distributed_stats", f"WITH {TOK} SELECT round(avg(reward), 8) AS mean, max(reward) AS max, min(reward) AS min, round(stddev_samp(reward), 8) AS std, round(sum(reward * mask) / sum(mask), 8) AS masked_mean FROM tok")
def distributed_stats(spark, d):
    t = tokens(spark, d)
    masked = M.batch_stats(t, "reward", "mask").select(r("mean", 8).alias("masked_mean"))
    return M.batch_stats(t, "reward").select(r("mean", 8).alias("mean"), "max", "min", r("std", 8).alias("std")).crossJoin(masked)


@query("entropy_and_logprob", f"""WITH {TOK}, l AS (SELECT seq_id, log(10) AS one, ln(sum(exp(value * 4))) AS lse, sum(exp(value * 4) * value * 4) / sum(exp(value * 4)) AS e,
 max(CASE WHEN pos = 0 THEN value * 4 END) AS first FROM tok GROUP BY seq_id) SELECT seq_id, round(lse - e, 6) AS entropy, round(first - lse, 6) AS logprob FROM l""")
def entropy_and_logprob(spark, d):
    s = sequences(spark, d).withColumn("logits", F.transform("values", lambda x: x * 4))
    return s.select("seq_id", r(M.entropy_from_logits("logits")).alias("entropy"), r(M.logprob_from_logits("logits", F.lit(0))).alias("logprob"))


@query("masks_and_positions", f"""WITH {TOK}, c AS (SELECT *, sum(mask) OVER (PARTITION BY seq_id ORDER BY pos) AS upto, max(1 - mask) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM tok)
 SELECT seq_id, CAST(sum(greatest(upto - 1, 0)) AS BIGINT) AS position_sum, CAST(sum(CASE WHEN coalesce(over, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS response_length FROM c GROUP BY seq_id""")
def masks_and_positions(spark, d):
    """Position ids of the mask, and the length up to and including the first end token (here: the first 0)."""
    s = sequences(spark, d)
    return s.select("seq_id", F.aggregate(M.position_ids("mask"), F.lit(0).cast("long"), lambda a, x: a + x).alias("position_sum"),
                    M.mask_count(M.response_mask("mask", 0)).alias("response_length"))


@query("truncate_and_pad", f"""WITH {TOK}, c AS (SELECT seq_id, pos, count(*) OVER (PARTITION BY seq_id) AS n, CAST(round(value * 49.0) AS BIGINT) AS id FROM tok)
 SELECT seq_id, CAST(sum(CASE WHEN pos >= n - 5 THEN id ELSE 0 END) AS BIGINT) AS kept_left, CAST(sum(CASE WHEN pos < 5 THEN id ELSE 0 END) AS BIGINT) AS kept_right,
 CAST(sum(CASE WHEN n <= 5 OR pos < 2 OR pos >= n - 3 THEN id ELSE 0 END) AS BIGINT) AS kept_middle, CAST(greatest(any_value(n), 8) AS BIGINT) AS padded FROM c GROUP BY seq_id""")
def truncate_and_pad(spark, d):
    s = sequences(spark, d).withColumn("ids", F.transform("values", lambda x: F.round(x * 49.0).cast("long")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("seq_id", *[total(M.truncate("ids", 5, side)).alias(f"kept_{side}") for side in ("left", "right", "middle")],
                    F.size(M.pad("ids", 8, F.lit(0).cast("long"))).cast("long").alias("padded"))


@query("reward_on_last_token", f"""WITH {TOK}, c AS (SELECT seq_id, max(CASE WHEN mask = 1 THEN pos END) AS last FROM tok GROUP BY seq_id), s AS (SELECT seq_id, sum(reward) AS score FROM tok GROUP BY seq_id)
 SELECT t.seq_id, t.pos, round(CASE WHEN t.pos = c.last THEN s.score ELSE 0 END, 6) AS placed FROM tok t JOIN c USING (seq_id) JOIN s USING (seq_id)""")
def reward_on_last_token(spark, d):
    s = A.scored(sequences(spark, d)).withColumn("placed", M.place_last("score", "mask"))
    return M.to_long(s, ["seq_id"], ["placed"]).select("seq_id", F.col("pos").cast("long").alias("pos"), r("placed").alias("placed"))


# ---------------------------------------------------------------- E: advantages


def by_sequence(name: str, sql_value: str, more: str = "", **options):
    """An estimator whose advantage is one value per sequence: its sum over the mask."""
    sql = f"WITH {SEQ}{more} SELECT seq_id, round({sql_value} * len, 5) AS adv FROM seq JOIN grp USING (uid)" + (" , extra" if more else "")

    def put(estimator: str):
        @query(name, sql)
        def run(spark, d):
            out = A.compute(sequences(spark, d), estimator, **options)
            return out.select("seq_id", r(M.array_sum("advantages"), 5).alias("adv"))

    return put


by_sequence("adv_grpo", "CASE WHEN k = 1 THEN score / (1 + 1e-6) ELSE (score - mean) / (std + 1e-6) END")("grpo")
by_sequence("adv_grpo_nostd", "CASE WHEN k = 1 THEN score ELSE score - mean END", by_std=False)("grpo")
by_sequence("adv_grpo_vectorized", "CASE WHEN k = 1 THEN score / (1 + 1e-6) ELSE (score - mean) / (sqrt(greatest(var, 1e-6)) + 1e-6) END")("grpo_vectorized")
by_sequence("adv_rloo", "CASE WHEN k = 1 THEN score ELSE k / (k - 1) * (score - mean) END")("rloo")
by_sequence("adv_rloo_vectorized", "CASE WHEN k = 1 THEN 0 ELSE (k * score - total) / (k - 1) END")("rloo_vectorized")
by_sequence("adv_gpg", "a * (score - CASE WHEN k = 1 THEN 0 ELSE mean END)", ", extra AS (SELECT count(*) / greatest(sum(CASE WHEN score <> 0 THEN 1 ELSE 0 END), 1) AS a FROM seq)")("gpg")
by_sequence("adv_sppo_softmean", "(score - base)", ", extra AS (SELECT ln(avg(exp(score))) AS base FROM seq)")("sppo_softmean")

@query("adv_reinforce_pp_baseline", f"""WITH {SEQ}, val AS (SELECT seq_id, len, score - CASE WHEN k = 1 THEN 0 ELSE mean END AS v FROM seq JOIN grp USING (uid)),
 m AS (SELECT sum(v * len) / (sum(len) + 1e-8) AS mu, sum(len) AS t FROM val),
 w AS (SELECT sum((v - mu) * (v - mu) * len) / (any_value(t) + 1e-8) * any_value(t) / (any_value(t) - 1) AS var FROM val, m)
 SELECT seq_id, round((v - mu) / sqrt(var + 1e-8) * len, 5) AS adv FROM val, m, w""")
def adv_reinforce_pp_baseline(spark, d):
    return A.compute(sequences(spark, d), "reinforce_plus_plus_baseline").select("seq_id", r(M.array_sum("advantages"), 5).alias("adv"))


@query("adv_opo", f"""WITH {SEQ}, b AS (SELECT uid, sum(len * score) / nullif(sum(len), 0) AS base FROM seq GROUP BY uid)
 SELECT seq_id, round((score - CASE WHEN k = 1 THEN 0 ELSE base END) * len, 5) AS adv FROM seq JOIN grp USING (uid) JOIN b USING (uid)""")
def adv_opo(spark, d):
    return A.compute(sequences(spark, d), "opo").select("seq_id", r(M.array_sum("advantages"), 5).alias("adv"))


@query("adv_grpo_passk", f"""WITH {SEQ}, rk AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, seq_id) AS rn, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, seq_id) AS nxt FROM seq)
 SELECT seq_id, round(CASE WHEN rn = 1 THEN (score - nxt) / (std + 1e-6) ELSE 0 END * len, 5) AS adv FROM rk JOIN grp USING (uid) WHERE k > 1""")
def adv_grpo_passk(spark, d):
    s = A.with_group(sequences(spark, d), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return A.compute(s, "grpo_passk").select("seq_id", r(M.array_sum("advantages"), 5).alias("adv"))


GAE = f"""WITH RECURSIVE {TOK}, o AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos DESC) AS k FROM tok),
 g AS (SELECT seq_id, k, pos, mask, value, CASE WHEN mask = 1 THEN reward - value ELSE 0 END AS a, CASE WHEN mask = 1 THEN value ELSE 0 END AS nv FROM o WHERE k = 1
 UNION ALL SELECT o.seq_id, o.k, o.pos, o.mask, o.value, CASE WHEN o.mask = 1 THEN o.reward + 0.9 * g.nv - o.value + 0.9 * 0.95 * g.a ELSE g.a END,
 CASE WHEN o.mask = 1 THEN o.value ELSE g.nv END FROM g JOIN o ON o.seq_id = g.seq_id AND o.k = g.k + 1)"""


@query("adv_gae", GAE + """, m AS (SELECT sum(mask * a) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM g),
 v AS (SELECT sum(mask * (a - mu) * (a - mu)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM g, m)
 SELECT seq_id, pos, round((a - mu) / sqrt(var + 1e-8) * mask, 5) AS adv, round(a + value, 6) AS ret FROM g, m, v""")
def adv_gae(spark, d):
    out = A.compute(sequences(spark, d), "gae", gamma=0.9, lam=0.95)
    t = M.to_long(out, ["seq_id"], ["advantages", "returns"])
    return t.select("seq_id", F.col("pos").cast("long").alias("pos"), r("advantages", 5).alias("adv"), r("returns").alias("ret"))


@query("adv_reinforce_pp", f"""WITH RECURSIVE {TOK}, o AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos DESC) AS k FROM tok),
 g AS (SELECT seq_id, k, pos, mask, reward AS ret FROM o WHERE k = 1
 UNION ALL SELECT o.seq_id, o.k, o.pos, o.mask, o.reward + 0.9 * g.ret * g.mask FROM g JOIN o ON o.seq_id = g.seq_id AND o.k = g.k + 1),
 m AS (SELECT sum(mask * ret) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM g),
 v AS (SELECT sum(mask * (ret - mu) * (ret - mu)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM g, m)
 SELECT seq_id, pos, round((ret - mu) / sqrt(var + 1e-8) * mask, 5) AS adv, round(ret, 6) AS ret FROM g, m, v""")
def adv_reinforce_pp(spark, d):
    out = A.compute(sequences(spark, d), "reinforce_plus_plus", gamma=0.9)
    t = M.to_long(out, ["seq_id"], ["advantages", "returns"])
    return t.select("seq_id", F.col("pos").cast("long").alias("pos"), r("advantages", 5).alias("adv"), r("returns").alias("ret"))


@query("adv_remax", f"""WITH {TOK}, s AS (SELECT *, sum(reward * mask) OVER (PARTITION BY seq_id ORDER BY pos DESC) AS g FROM tok)
 SELECT seq_id, pos, round(g - 0.25 * mask, 6) AS adv, round(g, 6) AS ret FROM s""")
def adv_remax(spark, d):
    out = A.compute(sequences(spark, d).withColumn("reward_baseline", F.lit(0.25)), "remax")
    t = M.to_long(out, ["seq_id"], ["advantages", "returns"])
    return t.select("seq_id", F.col("pos").cast("long").alias("pos"), r("advantages").alias("adv"), r("returns").alias("ret"))


@query("adv_prime_rloo", f"""WITH {TOK}, e AS (SELECT *, CASE WHEN pos = max(CASE WHEN mask = 1 THEN pos END) OVER (PARTITION BY seq_id) THEN 1 ELSE 0 END AS fin FROM tok),
 q AS (SELECT seq_id, uid, sum(mask * reward) / greatest(sum(mask), 1) AS m, CASE WHEN sum(fin) > 0 THEN seq_id % 2 ELSE 0 END AS acc FROM e GROUP BY seq_id, uid), g AS (SELECT uid, sum(m) AS s, sum(acc) AS a, count(*) AS n FROM q GROUP BY uid),
 x AS (SELECT t.seq_id, t.pos, t.mask, CASE WHEN n > 1 THEN reward * n / (n - 1) - s / (n - 1) ELSE reward END + 0.5 * fin * CASE WHEN n > 1 THEN (seq_id % 2) * n / (n - 1) - a / (n - 1) ELSE seq_id % 2 END AS v FROM e t JOIN g USING (uid))
 SELECT seq_id, pos, round(sum(v * mask) OVER (PARTITION BY seq_id ORDER BY pos DESC), 6) AS ret FROM x""")
def adv_prime_rloo(spark, d):
    s = sequences(spark, d)
    s = s.withColumn("at", M.place_last(F.lit(1.0), "mask")).withColumn("acc", M.place_last(F.col("seq_id") % 2, "mask"))
    out = A.compute(s, "prime_rloo", streams=(("rewards", 1.0), ("acc", 0.5, "at")), whitened=False)
    return M.to_long(out, ["seq_id"], ["returns"]).select("seq_id", F.col("pos").cast("long").alias("pos"), r("returns").alias("ret"))


@query("dpo_preferred", f"""WITH {SEQ}, p AS (SELECT *, seq_id // 2 AS pair, row_number() OVER (PARTITION BY seq_id // 2 ORDER BY score DESC, seq_id) AS rn FROM seq) SELECT seq_id, pair, rn = 1 AS chosen FROM p""")
def dpo_preferred(spark, d):
    s = sequences(spark, d).withColumn("pair", F.expr("seq_id div 2"))
    return A.preferred(s, "pair", "seq_id").select("seq_id", "pair", "chosen")


@query("reward_minus_kl", f"WITH {TOK} SELECT seq_id, pos, round(reward - 0.1 * (old_lp - rollout_lp), 6) AS reward FROM tok")
def reward_minus_kl(spark, d):
    s = sequences(spark, d, "old_lp", "rollout_lp").withColumn("out", A.reward_minus_kl("rewards", "old_lp", "rollout_lp", 0.1))
    return M.to_long(s, ["seq_id"], ["out"]).select("seq_id", F.col("pos").cast("long").alias("pos"), r("out").alias("reward"))


@query("kl_penalty_reward", f"""WITH {TOK}, s AS (SELECT seq_id, sum(mask * (old_lp - rollout_lp)) / (sum(mask) + 1e-8) AS kl, sum(reward - 0.05 * mask * (old_lp - rollout_lp)) AS rew FROM tok GROUP BY seq_id)
 SELECT round(avg(kl), 8) AS kl, round(sum(rew) / count(*), 6) AS reward FROM s""")
def kl_penalty_reward(spark, d):
    s = sequences(spark, d, "old_lp", "rollout_lp").withColumnsRenamed({"rewards": "scores", "rollout_lp": "ref_lp"})
    out, kl = A.apply_kl_penalty(s, 0.05)
    return out.agg(r(F.avg("kl"), 8).alias("kl"), r(F.avg(M.array_sum("rewards"))).alias("reward"))


@query("kl_controller_trace", f"""WITH RECURSIVE {ROLL}, o AS (SELECT uid, least(greatest((abs(score) / 100) / 0.1 - 1, -0.2), 0.2) * 16 / 10000 AS f, row_number() OVER (PARTITION BY uid ORDER BY id) AS k FROM roll),
 c AS (SELECT uid, 1 AS k, 0.2::DOUBLE * (1 + f) AS v FROM o WHERE k = 1 UNION ALL SELECT o.uid, o.k, c.v * (1 + o.f) FROM c JOIN o ON o.uid = c.uid AND o.k = c.k + 1)
 SELECT uid, round(arg_max(v, k), 6) AS kl_coefficient FROM c GROUP BY uid""")
def kl_controller_trace(spark, d):
    e = rollouts(spark, d).select("uid", "id", (F.abs("score") / 100).alias("kl"), F.lit(16).alias("n"))
    return rounded(A.adaptive_kl_trace(e, "uid", "id", 0.2, 0.1, 10000), "uid")


@query("pf_ppo_resample", f"""WITH {SEQ}, w AS (SELECT seq_id, score, pow(abs(score), 2) + 1e-8 AS w FROM seq), c AS (SELECT *, sum(w) OVER (ORDER BY seq_id) AS upto FROM w), t AS (SELECT max(upto) AS total FROM c),
 u AS (SELECT i AS draw, ('0x' || substr(md5('7:' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * total AS u FROM range(2000) r(i), t)
 SELECT seq_id, round(score, 6) AS score, draw FROM u JOIN c ON u >= upto - w AND u < upto""")
def pf_ppo_resample(spark, d):
    s = A.scored(sequences(spark, d)).select("seq_id", "score")
    return A.resample(s, A.pf_ppo_weights(s, "pow", 2.0), 2000, 7, "seq_id").select("seq_id", r("score").alias("score"), "draw")


# ---------------------------------------------------------------- G: losses


def loss_query(name: str, sql: str, run):
    @query(name, sql)
    def f(spark, d):
        return rounded(run(tokens(spark, d)))


LR = "least(greatest(log_prob - old_lp, -20), 20)"
R = f"exp({LR})"
CLIP = "greatest(least({r}, {hi}), {lo})"
N = "(sum(mask) + 1e-8)"
CR = CLIP.format(r=R, hi=1.2, lo=0.8)

loss_query("loss_modes", f"""WITH {TOK}, s AS (SELECT seq_id, sum(mask * reward) AS s, sum(mask) AS n, count(*) AS t FROM tok GROUP BY seq_id)
 SELECT round((SELECT sum(s) / sum(n) FROM s), 6) AS token_mean, round((SELECT avg(s) FROM s WHERE n > 0), 6) AS seq_sum,
 round((SELECT avg(s / (n + 1e-8)) FROM s WHERE n > 0), 6) AS seq_mean, round((SELECT sum(s) / max(t) FROM s), 6) AS seq_norm""",
           lambda t: L.aggregate_loss(t, "reward", "token-mean").withColumnRenamed("loss", "token_mean")
           .crossJoin(L.aggregate_loss(t, "reward", "seq-mean-token-sum").withColumnRenamed("loss", "seq_sum"))
           .crossJoin(L.aggregate_loss(t, "reward", "seq-mean-token-mean").withColumnRenamed("loss", "seq_mean"))
           .crossJoin(L.aggregate_loss(t, "reward", "seq-mean-token-sum-norm").withColumnRenamed("loss", "seq_norm")))

loss_query("loss_ppo_vanilla", f"""WITH {TOK}, x AS (SELECT *, {R} AS r, -advantage * {R} AS l1, -advantage * {CR} AS l2, -advantage * 3.0 AS l3 FROM tok),
 y AS (SELECT *, greatest(l1, l2) AS hi FROM x)
 SELECT round(sum(mask * CASE WHEN advantage < 0 THEN least(l3, hi) ELSE hi END) / sum(mask), 6) AS loss, round(sum(mask * CASE WHEN l2 > l1 THEN 1 ELSE 0 END) / {N}, 6) AS pg_clipfrac,
 round(sum(mask * -{LR}) / {N}, 6) AS ppo_kl, round(sum(mask * CASE WHEN hi > l3 AND advantage < 0 THEN 1 ELSE 0 END) / {N}, 6) AS pg_clipfrac_lower FROM y""", L.vanilla)

SEQ_LOSS = "SELECT seq_id, sum(mask * l) AS s, sum(mask) AS n FROM y GROUP BY seq_id"
loss_query("loss_gspo", f"""WITH {TOK}, q AS (SELECT seq_id, exp(least(sum(mask * (log_prob - old_lp)) / greatest(sum(mask), 1), 10)) AS r FROM tok GROUP BY seq_id),
 x AS (SELECT t.*, -advantage * r AS l1, -advantage * {CLIP.format(r='r', hi='1.0004', lo='0.9997')} AS l2 FROM tok t JOIN q USING (seq_id)), y AS (SELECT *, greatest(l1, l2) AS l FROM x), z AS ({SEQ_LOSS})
 SELECT round((SELECT avg(s / (n + 1e-8)) FROM z WHERE n > 0), 6) AS loss, round(sum(mask * CASE WHEN l2 > l1 THEN 1 ELSE 0 END) / {N}, 6) AS pg_clipfrac, round(sum(mask * (old_lp - log_prob)) / {N}, 6) AS ppo_kl FROM y""", L.gspo)
loss_query("loss_sapo", f"""WITH {TOK}, x AS (SELECT *, {R} AS r, CASE WHEN advantage > 0 THEN 1.0 ELSE 1.05 END AS tau FROM tok), y AS (SELECT *, -4.0 / tau / (1 + exp(-tau * (r - 1))) * advantage AS l FROM x), z AS ({SEQ_LOSS})
 SELECT round((SELECT avg(s / (n + 1e-8)) FROM z WHERE n > 0), 6) AS loss, round(sum(mask * -{LR}) / {N}, 6) AS ppo_kl FROM y""", L.sapo)
loss_query("loss_gpg", f"WITH {TOK} SELECT round(sum(mask * -log_prob * advantage) / sum(mask), 6) AS loss FROM tok", L.gpg)
loss_query("loss_cispo", f"""WITH {TOK} SELECT round(sum(mask * -{CR} * advantage * log_prob) / sum(mask), 6) AS loss, round(sum(mask * CASE WHEN {R} <> {CR} THEN 1 ELSE 0 END) / {N}, 6) AS pg_clipfrac,
 round(sum(mask * -{LR}) / {N}, 6) AS ppo_kl FROM tok""", L.cispo)
loss_query("loss_geo_mean", f"""WITH {TOK}, x AS (SELECT *, log_prob - old_lp AS d, least(greatest(log_prob - old_lp, -0.02), 0.02) AS c, sign(advantage) AS g FROM tok),
 q AS (SELECT seq_id, exp(sum(mask * g * least(g * d, g * c)) / {N}) AS r, sum(mask * advantage) / {N} AS a FROM x GROUP BY seq_id)
 SELECT round((SELECT avg(-a * r) FROM q), 6) AS loss, round(sum(mask * CASE WHEN d <> c AND advantage > 0 THEN 1 ELSE 0 END) / {N}, 6) AS pg_clipfrac, round(sum(mask * -d) / {N}, 6) AS ppo_kl,
 round(sum(mask * CASE WHEN d <> c AND advantage < 0 THEN 1 ELSE 0 END) / {N}, 6) AS pg_clipfrac_lower FROM x""", lambda t: L.geo_mean(t, low=0.02, high=0.02))
COV = f"""WITH {TOK}, mm AS (SELECT avg(advantage) AS ma, avg(log_prob) AS ml, count(*) AS n FROM tok WHERE mask = 1),
 c AS (SELECT t.*, round((advantage - ma) * (log_prob - ml), 9) AS cov, n FROM tok t, mm)"""
loss_query("loss_kl_cov", COV + f""", k AS (SELECT *, CASE WHEN mask = 1 THEN row_number() OVER (PARTITION BY mask ORDER BY cov DESC, seq_id, pos) END AS rn FROM c)
 SELECT round(sum(mask * (-advantage * exp(log_prob - old_lp) + CASE WHEN rn <= greatest(1, floor(n * 0.01)) THEN abs(log_prob - old_lp) ELSE 0 END)) / sum(mask), 6) AS loss,
 round(sum(mask * abs(log_prob - old_lp)) / {N}, 6) AS ppo_kl FROM k""", lambda t: L.kl_cov(t, ratio=0.01))
loss_query("loss_clip_cov", f"""WITH {TOK}, m AS (SELECT avg(advantage) AS ma, avg(log_prob) AS ml, count(*) AS n FROM tok WHERE mask <> 0),
 x AS (SELECT seq_id, pos, mask, n, (advantage - ma) * (log_prob - ml) AS cov, -advantage * exp(log_prob - old_lp) AS l1, -advantage * greatest(least(exp(log_prob - old_lp), 1.2), 0.8) AS l2 FROM tok, m),
 o AS (SELECT seq_id, pos, n, row_number() OVER (ORDER BY md5('0:' || seq_id || ':' || pos), seq_id, pos) AS j FROM x WHERE mask <> 0 AND NOT l2 > l1 AND cov > 0.1 AND cov < 0.5),
 c AS (SELECT seq_id, pos FROM o WHERE j <= greatest(1, floor(n * 0.01))), y AS (SELECT x.*, CASE WHEN c.pos IS NULL THEN 1.0 ELSE 0.0 END AS stay FROM x LEFT JOIN c ON c.seq_id = x.seq_id AND c.pos = x.pos)
 SELECT round(sum(mask * greatest(l1, l2) * stay) / sum(mask), 6) AS loss, round(sum(mask * (1 - stay)) / {N}, 6) AS pg_clipfrac FROM y""", lambda t: L.clip_cov(t, ratio=0.01, bounds=(0.1, 0.5)))
loss_query("loss_reinforce", f"""WITH {TOK}, s AS (SELECT seq_id, sum(mask * -advantage * log_prob) AS s, sum(mask) AS n FROM tok GROUP BY seq_id)
 SELECT round((SELECT avg(s) FROM s WHERE n > 0), 6) AS loss, round(sum(mask * (rollout_lp - log_prob)) / {N}, 6) AS ppo_kl FROM tok""", L.reinforce)
loss_query("loss_bypass", f"""WITH {TOK}, x AS (SELECT *, exp(least(greatest(log_prob - rollout_lp, -20), 20)) AS r FROM tok), y AS (SELECT *, -advantage * r AS l1, -advantage * greatest(least(r, 1.2), 0.8) AS l2, -advantage * 3.0 AS l3 FROM x)
 SELECT round(sum(mask * CASE WHEN advantage < 0 THEN least(l3, greatest(l1, l2)) ELSE greatest(l1, l2) END) / sum(mask), 6) AS loss, round(sum(mask * CASE WHEN l2 > l1 THEN 1 ELSE 0 END) / {N}, 6) AS pg_clipfrac,
 round(sum(mask * (rollout_lp - log_prob)) / {N}, 6) AS ppo_kl, round(sum(mask * CASE WHEN greatest(l1, l2) > l3 AND advantage < 0 THEN 1 ELSE 0 END) / {N}, 6) AS pg_clipfrac_lower FROM y""", L.bypass_mode)
loss_query("loss_value", f"""WITH {TOK}, x AS (SELECT mask, value + 0.3 * reward AS vp, value, reward AS ret FROM tok), y AS (SELECT mask, pow(vp - ret, 2) AS l1, pow(greatest(least(vp, value + 0.05), value - 0.05) - ret, 2) AS l2 FROM x)
 SELECT round(sum(mask * 0.5 * greatest(l1, l2)) / sum(mask), 6) AS loss, round(sum(mask * CASE WHEN l2 > l1 THEN 1 ELSE 0 END) / {N}, 6) AS vf_clipfrac FROM y""",
           lambda t: L.value_loss(t.withColumns({"vpred": F.col("value") + 0.3 * F.col("reward"), "ret": F.col("reward")}), clip=0.05))
loss_query("loss_sft", f"WITH {TOK} SELECT round(sum(mask * -log_prob) / sum(mask), 6) AS loss FROM tok", L.sft_loss)
loss_query("loss_ppo_composite", f"""WITH {TOK}, y AS (SELECT *, -advantage * {R} AS l1, -advantage * {CR} AS l2, -advantage * 3.0 AS l3, least(greatest(rollout_lp - log_prob, -20), 20) AS kd FROM tok),
 z AS (SELECT sum(mask * CASE WHEN advantage < 0 THEN least(l3, greatest(l1, l2)) ELSE greatest(l1, l2) END) / sum(mask) AS p, sum(mask * value) / sum(mask) AS e, sum(mask * least(greatest(exp(kd) - kd - 1, -10), 10)) / sum(mask) AS k FROM y)
 SELECT round(p - 0.01 * e + 0.1 * k, 6) AS total_loss FROM z""",
           lambda t: L.ppo_loss(t.withColumns({"entropy": F.col("value"), "ref_lp": F.col("rollout_lp")}), entropy_coefficient=0.01, kl_coefficient=0.1).select("total_loss"))
loss_query("kl_estimators", f"""WITH {TOK}, x AS (SELECT mask, old_lp - rollout_lp AS d FROM tok) SELECT round(sum(mask * d) / {N}, 6) AS kl, round(sum(mask * abs(d)) / {N}, 6) AS abs, round(sum(mask * 0.5 * d * d) / {N}, 6) AS mse,
 round(sum(mask * (exp(-d) + d - 1)) / {N}, 6) AS low_var_kl FROM x""",
           lambda t: t.withColumns({k: L.kl_estimate(F.col("old_lp"), F.col("rollout_lp"), k) for k in ("kl", "abs", "mse", "low_var_kl")}).agg(*[F.round(M.m_mean(k), 6).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")]))

DPO = f"""WITH {SEQ}, p AS (SELECT uid, max(score) AS pc, min(score) AS pr, avg(score) AS rc, stddev_pop(score) AS rr FROM seq GROUP BY uid)"""


@query("loss_online_dpo", DPO + """, h AS (SELECT (pc - pr) - (rc - rr) AS h FROM p) SELECT round(avg(ln(1 + exp(-0.1 * h)) * 0.9 + ln(1 + exp(0.1 * h)) * 0.1), 6) AS sigmoid, round(avg((h - 5) * (h - 5)), 5) AS ipo FROM h""")
def loss_online_dpo(spark, d):
    s = A.scored(sequences(spark, d)).groupBy("uid").agg(F.max("score").alias("policy_chosen"), F.min("score").alias("policy_rejected"), F.avg("score").alias("ref_chosen"), F.stddev_pop("score").alias("ref_rejected"))
    return s.agg(r(F.avg(L.online_dpo_loss(0.1, 0.1))).alias("sigmoid"), r(F.avg(L.online_dpo_loss(0.1, kind="ipo")), 5).alias("ipo"))


@query("loss_ce_and_detached_dpo", f"""WITH {SEQ}, x AS (SELECT *, CASE WHEN seq_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS acc FROM seq),
 o AS (SELECT a.seq_id, avg(CASE WHEN (a.acc > 0 AND b.acc < a.acc) OR (a.acc <= 0 AND b.acc > a.acc) THEN b.score END) AS other FROM x a JOIN x b USING (uid) GROUP BY a.seq_id)
 SELECT round((SELECT avg(acc * ln(1 + exp(-0.05 * score)) + (1 - acc) * ln(1 + exp(0.05 * score))) FROM x), 6) AS ce,
 round((SELECT avg(ln(1 + exp(-(0.05 * score - 0.05 * coalesce(other, 0)) * CASE WHEN acc > 0 THEN 1 ELSE -1 END))) FROM x JOIN o USING (seq_id)), 6) AS detached""")
def loss_ce_and_detached_dpo(spark, d):
    s = A.scored(sequences(spark, d)).withColumn("acc", F.when(F.col("seq_id") % 3 == 0, 1.0).otherwise(0.0)).withColumn("q", F.col("score"))
    return L.ce_dpo_loss(s).select(r("loss").alias("ce")).crossJoin(L.detached_dpo_loss(s).select(r("loss").alias("detached")))


loss_query("loss_sppo", f"""WITH {TOK}, q AS (SELECT seq_id, sum(mask * (log_prob - old_lp)) AS r, max(reward) AS w, sum(mask) AS n FROM tok GROUP BY seq_id)
 SELECT round(sum((r - w) * (r - w)) / (count(*) + 1e-8), 6) AS loss FROM q WHERE n > 0""", L.sppo_loss)
loss_query("loss_flowrl", f"""WITH {TOK}, q AS (SELECT seq_id, sum(mask * log_prob) / {N} AS p, sum(mask * rollout_lp) / {N} AS f, sum(mask * reward) / {N} AS w, max(value) AS z, sum(mask * (log_prob - old_lp)) AS s FROM tok GROUP BY seq_id)
 SELECT round(avg(least(exp(s), 10) * pow(z + p - 15 * w - f, 2)), 5) AS loss FROM q""", lambda t: L.flowrl_loss(t.withColumns({"ref_lp": F.col("rollout_lp"), "log_z": F.col("value")})).select(F.round("loss", 5).alias("loss")))


@query("distill_topk_kl", f"WITH {TOK} SELECT seq_id, round(sum(exp(old_lp) * (old_lp - ln(exp(rollout_lp) + 1e-20))), 6) AS kl FROM tok GROUP BY seq_id")
def distill_topk_kl(spark, d):
    return sequences(spark, d, "old_lp", "rollout_lp").select("seq_id", r(L.topk_kl("old_lp", "rollout_lp")).alias("kl"))


# ---------------------------------------------------------------- H: off-policy


SUMS = f"""WITH {TOK}, s AS (SELECT seq_id, sum(mask * (old_lp - rollout_lp)) AS s, sum(mask) AS n FROM tok GROUP BY seq_id)"""


@query("is_weights_token", f"WITH {TOK} SELECT seq_id, pos, round(least(exp(old_lp - rollout_lp) * mask, 1.05), 6) AS w FROM tok")
def is_weights_token(spark, d):
    return O.importance_weights(tokens(spark, d), "token", 1.05).select("seq_id", F.col("pos").cast("long").alias("pos"), r("is_weight").alias("w"))


@query("is_weights_sequence_normalized", SUMS + """, w AS (SELECT t.seq_id, t.pos, t.mask, n, least(exp(least(greatest(s, -20), 20)) * mask, 1.05) AS w FROM tok t JOIN s USING (seq_id)),
 q AS (SELECT seq_id, sum(w * mask) / (sum(mask) + 1e-8) AS m, sum(mask) AS k FROM w GROUP BY seq_id), a AS (SELECT sum(CASE WHEN k > 0 THEN m ELSE 0 END) / sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS mean FROM q)
 SELECT seq_id, pos, round(w / mean, 6) AS w FROM w, a""")
def is_weights_sequence_normalized(spark, d):
    return O.importance_weights(tokens(spark, d), "sequence", 1.05, normalize=True).select("seq_id", F.col("pos").cast("long").alias("pos"), r("is_weight").alias("w"))


def rejection_query(level: str, ratio: str):
    @query(f"rs_mask_{level}", SUMS + f", x AS (SELECT t.seq_id, t.pos, t.mask, exp(least(greatest({ratio}, -20), 20)) AS w FROM tok t JOIN s USING (seq_id)) SELECT seq_id, pos, CAST(mask * CASE WHEN round(w, 9) >= 0.97 AND round(w, 9) <= 1.02 THEN 1 ELSE 0 END AS INTEGER) AS kept FROM x")
    def run(spark, d):
        got = O.rejection(tokens(spark, d), level, 1.02 + 1e-10, 0.97 - 1e-10)
        return got.select("seq_id", F.col("pos").cast("long").alias("pos"), F.col("new_mask").cast("int").alias("kept"))


rejection_query("token", "old_lp - rollout_lp")
rejection_query("sequence", "s")
rejection_query("geometric", "s / (n + 1e-8)")


@query("token_veto", f"WITH {TOK} SELECT seq_id, CAST(max(CASE WHEN mask = 1 AND round(old_lp - rollout_lp, 9) < -0.0501 THEN 1 ELSE 0 END) AS INTEGER) AS vetoed FROM tok GROUP BY seq_id")
def token_veto(spark, d):
    import math

    return O.veto(tokens(spark, d), math.exp(-0.0501)).groupBy("seq_id").agg(F.max("vetoed").alias("vetoed"))


@query("offpolicy_diagnostics", f"""WITH {TOK}, q AS (SELECT seq_id, sum(mask * old_lp) / {N} AS o, sum(mask * rollout_lp) / {N} AS r, sum(mask * (old_lp - rollout_lp)) AS s FROM tok GROUP BY seq_id),
 t AS (SELECT sum(mask * (rollout_lp - old_lp)) / {N} AS kl, sum(mask * (exp(old_lp - rollout_lp) - (old_lp - rollout_lp) - 1)) / {N} AS k3, sum(mask * exp(2 * (old_lp - rollout_lp))) / {N} - 1 AS c2 FROM tok)
 SELECT round(avg(exp(-o)), 6) AS training_ppl, round(avg(-o), 6) AS training_log_ppl, round(avg(exp(-r)), 6) AS rollout_ppl, round(avg(-r), 6) AS rollout_log_ppl, round(avg(r - o), 6) AS log_ppl_diff,
 round(avg(abs(r - o)), 6) AS log_ppl_abs_diff, round(max(r - o), 6) AS log_ppl_diff_max, round(min(r - o), 6) AS log_ppl_diff_min, round(avg(exp(r - o)), 6) AS ppl_ratio, round(avg(exp(2 * s)) - 1, 6) AS chi2_seq,
 round(any_value(kl), 6) AS kl, round(any_value(k3), 6) AS k3_kl, round(any_value(c2), 6) AS chi2_token FROM q, t""")
def offpolicy_diagnostics(spark, d):
    return rounded(O.diagnostics(tokens(spark, d)))


@query("is_metrics_sequence", SUMS + f""", x AS (SELECT t.mask, t.seq_id, s, exp(s) * mask AS w FROM tok t JOIN s USING (seq_id)), y AS (SELECT *, greatest(least(w, 1.05), 1 / 1.05) AS c FROM x),
 q AS (SELECT seq_id, sum(mask * w) / {N} AS m, any_value(s) AS lr FROM y GROUP BY seq_id), t AS (SELECT sum(mask * w) / {N} AS mean, sum(mask * c) / {N} AS cm, sum(mask * c * c) / {N} AS cq FROM y)
 SELECT round(any_value(mean), 6) AS mean, round(exp(max(lr)), 6) AS max, round(exp(min(lr)), 6) AS min, round(sqrt(greatest(any_value(cq) - any_value(cm) * any_value(cm), 0)), 5) AS std,
 round(1 / (any_value(cq) / pow(any_value(cm) + 1e-8, 2)), 6) AS eff_sample_size, round(avg(CASE WHEN lr > ln(1.05) THEN 1.0 ELSE 0.0 END), 6) AS fraction_high, round(avg(CASE WHEN lr < -ln(1.05) THEN 1.0 ELSE 0.0 END), 6) AS fraction_low,
 round(avg(m), 6) AS seq_mean, round(stddev_samp(m), 6) AS seq_std, round(max(m), 6) AS seq_max, round(min(m), 6) AS seq_min, round(max(abs(m - 1)), 6) AS seq_max_deviation,
 round(avg(CASE WHEN m > 1.05 THEN 1.0 ELSE 0.0 END), 6) AS seq_fraction_high, round(avg(CASE WHEN m < 1 / 1.05 THEN 1.0 ELSE 0.0 END), 6) AS seq_fraction_low FROM q, t""")
def is_metrics_sequence(spark, d):
    out = rounded(O.ratio_metrics(tokens(spark, d), "sequence", 1.05))
    return out.withColumn("std", F.round("std", 5))


@query("offpolicy_correction", SUMS + """, x AS (SELECT t.*, exp(s) AS w, max(CASE WHEN mask = 1 AND old_lp - rollout_lp < ln(0.93) THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id) AS v FROM tok t JOIN s USING (seq_id))
 SELECT CAST(sum(mask) AS BIGINT) AS before, CAST(sum(mask * CASE WHEN w >= 1 / 1.2 AND w <= 1.2 THEN 1 ELSE 0 END * (1 - v)) AS BIGINT) AS after, round(sum(least(exp(old_lp - rollout_lp) * mask, 1.03)), 4) AS weights FROM x""")
def offpolicy_correction(spark, d):
    t = O.correct(tokens(spark, d), is_level="token", is_threshold=1.03, rs_level="sequence", rs_upper=1.2, veto_threshold=0.93)
    return t.agg(F.sum("old_mask").cast("long").alias("before"), F.sum("mask").cast("long").alias("after"), r(F.sum("is_weight"), 4).alias("weights"))


def metric_ctes(k: str, ratio: str, weight: str, upper: float, low: float, token: bool) -> str:
    """Common table expressions that end in ``m_k``, one row of the metrics of a ratio."""
    share = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"
    top, bottom, high, under = ("t_max", "t_min", "t_high", "t_low") if token else ("s_max", "s_min", "s_high", "s_low")
    return f"""x_{k} AS (SELECT t.seq_id, t.mask, exp({ratio}) * {weight} AS w, {ratio} AS lr FROM tok t JOIN s USING (seq_id)), y_{k} AS (SELECT *, greatest(least(w, {upper}), {low}) AS c FROM x_{k}),
 q_{k} AS (SELECT seq_id, sum(mask * w) / {N} AS m, any_value(lr) AS lr FROM y_{k} GROUP BY seq_id),
 t_{k} AS (SELECT sum(mask * w) / {N} AS mean, sum(mask * c) / {N} AS cm, sum(mask * c * c) / {N} AS cq, max(CASE WHEN mask <> 0 THEN w END) AS t_max, min(CASE WHEN mask <> 0 THEN w END) AS t_min,
  sum(CASE WHEN mask <> 0 AND w > {upper} THEN 1.0 ELSE 0.0 END) / {N} AS t_high, sum(CASE WHEN mask <> 0 AND w < {low} THEN 1.0 ELSE 0.0 END) / {N} AS t_low FROM y_{k}),
 u_{k} AS (SELECT avg(m) AS seq_mean, stddev_samp(m) AS seq_std, max(m) AS seq_max, min(m) AS seq_min, max(abs(m - 1)) AS seq_max_deviation, {share(f"m > {upper}")} AS seq_fraction_high, {share(f"m < {low}")} AS seq_fraction_low,
  exp(least(max(lr), 20)) AS s_max, exp(min(lr)) AS s_min, {share(f"lr > ln({upper})")} AS s_high, {share(f"lr < ln({low})")} AS s_low FROM q_{k}),
 m_{k} AS (SELECT round(mean, 6) AS mean, round({top}, 6) AS max, round({bottom}, 6) AS min, round(round(sqrt(greatest(cq - cm * cm, 0)), 6), 5) AS std, round(1 / (cq / pow(cm + 1e-8, 2)), 6) AS eff_sample_size, round({high}, 6) AS fraction_high, round({under}, 6) AS fraction_low,
  round(seq_mean, 6) AS seq_mean, round(seq_std, 6) AS seq_std, round(seq_max, 6) AS seq_max, round(seq_min, 6) AS seq_min, round(seq_max_deviation, 6) AS seq_max_deviation, round(seq_fraction_high, 6) AS seq_fraction_high, round(seq_fraction_low, 6) AS seq_fraction_low FROM t_{k}, u_{k})"""


RATIO_NAMES = "mean max min std eff_sample_size fraction_high fraction_low seq_mean seq_std seq_max seq_min seq_max_deviation seq_fraction_high seq_fraction_low".split()
DIAGNOSED = "training_ppl training_log_ppl rollout_ppl rollout_log_ppl log_ppl_diff log_ppl_abs_diff log_ppl_diff_max log_ppl_diff_min ppl_ratio chi2_seq kl k3_kl chi2_token".split()


@query("is_metrics_token", f"{SUMS}, {metric_ctes('a', '(old_lp - rollout_lp)', 'mask', 1.05, '(1 / 1.05)', True)} SELECT * FROM m_a")
def is_metrics_token(spark, d):
    return rounded(O.ratio_metrics(tokens(spark, d), "token", 1.05)).withColumn("std", F.round("std", 5))


@query("correction_metrics", f"""{SUMS}, {metric_ctes('a', '(old_lp - rollout_lp)', 'mask', 1.05, '(1 / 1.05)', True)}, {metric_ctes('b', '(s / (n + 1e-8))', '1', 1.02, 0.98, False)},
 d AS ({ORACLES['offpolicy_diagnostics']}), g AS (SELECT seq_id, mask, CASE WHEN w >= 0.98 AND w <= 1.02 THEN 0.0 ELSE 1.0 END AS gone FROM x_b), h AS (SELECT seq_id, max(gone) AS any_gone FROM g GROUP BY seq_id),
 v AS (SELECT seq_id, mask, CASE WHEN old_lp - rollout_lp < ln(0.93) THEN 1.0 ELSE 0.0 END AS bad FROM tok), z AS (SELECT seq_id, CASE WHEN sum(mask * bad) > 0 THEN 1.0 ELSE 0.0 END AS b FROM v GROUP BY seq_id)
 SELECT {', '.join(f'd.{c} AS rollout_corr_{c}' for c in DIAGNOSED)}, {', '.join(f'm_a.{c} AS rollout_corr_rollout_is_{c}' for c in RATIO_NAMES)}, {', '.join(f'm_b.{c} AS rollout_corr_rollout_rs_{c}' for c in RATIO_NAMES)},
 (SELECT round(sum(mask * gone) / {N}, 6) FROM g) AS rollout_corr_rollout_rs_masked_fraction, (SELECT round(avg(any_gone), 6) FROM h) AS rollout_corr_rollout_rs_seq_masked_fraction,
 (SELECT round(avg(b), 6) FROM z) AS rollout_corr_rollout_is_veto_fraction, (SELECT round(sum(mask * bad) / {N}, 6) FROM v) AS rollout_corr_rollout_is_catastrophic_token_fraction FROM d, m_a, m_b""")
def correction_metrics(spark, d):
    out = rounded(O.correction_metrics(tokens(spark, d), "token", 1.05, "geometric", 1.02, 0.98, 0.93))
    return out.withColumns({c: F.round(c, 5) for c in out.columns if c.endswith("_std") and "seq" not in c})


@query("adv_gae_long", ORACLES["adv_gae"])
def adv_gae_long(spark, d):
    out = A.gae_tokens(tokens(spark, d), gamma=0.9, lam=0.95)
    return out.select("seq_id", F.col("pos").cast("long").alias("pos"), r("advantages", 5).alias("adv"), r("returns").alias("ret"))


@query("adv_reinforce_pp_long", ORACLES["adv_reinforce_pp"])
def adv_reinforce_pp_long(spark, d):
    out = A.reinforce_plus_plus_tokens(tokens(spark, d), gamma=0.9)
    return out.select("seq_id", F.col("pos").cast("long").alias("pos"), r("advantages", 5).alias("adv"), r("returns").alias("ret"))


@query("adv_remax_long", ORACLES["adv_remax"])
def adv_remax_long(spark, d):
    out = A.remax_tokens(tokens(spark, d).withColumn("reward_baseline", F.lit(0.25)))
    return out.select("seq_id", F.col("pos").cast("long").alias("pos"), r("advantages").alias("adv"), r("returns").alias("ret"))
