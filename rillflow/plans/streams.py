"""Queries over queues, versions, rate limits and event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.plans.frames import ROLL, rollouts, table
from rillflow.plans.learning import r, rounded
from rillflow.plans.registry import query
from rillflow.streaming import events, queues


@query("queue_drop_oldest", f"WITH {ROLL} SELECT id, uid FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, id DESC) AS n FROM roll) WHERE n <= 10")
def queue_drop_oldest(spark, d):
    return queues.newest(rollouts(spark, d), 10, "uid", ["ts", "id"]).select("id", "uid")


@query("queue_fates", f"""WITH RECURSIVE {ROLL}, e AS (SELECT uid AS queue, id, k % 3 = 0 AS get, row_number() OVER (PARTITION BY uid ORDER BY id) AS n FROM roll),
 w AS (SELECT queue, n, get, 0 AS held FROM e WHERE n = 1 UNION ALL SELECT e.queue, e.n, e.get, CASE WHEN w.get THEN greatest(w.held - 1, 0) ELSE least(w.held + 1, 5) END FROM w JOIN e ON e.queue = w.queue AND e.n = w.n + 1)
 SELECT queue, count(*) FILTER (NOT get) AS produced, count(*) FILTER (get AND held > 0) AS consumed, count(*) FILTER (NOT get AND held = 5) AS dropped,
 count(*) FILTER (NOT get) - count(*) FILTER (get AND held > 0) - count(*) FILTER (NOT get AND held = 5) AS queued FROM w GROUP BY queue HAVING count(*) FILTER (NOT get) > 0""")
def queue_fates(spark, d):
    log = rollouts(spark, d).select(F.col("uid").alias("queue"), F.col("id").alias("seq"), F.when(F.col("k") % 3 == 0, "get").otherwise("put").alias("kind"))
    return queues.queue_statistics(queues.drop_oldest(log, 5))


@query("staleness_admission", f"WITH {ROLL} SELECT id, row_number() OVER (PARTITION BY k ORDER BY id) <= 60 AS admitted FROM roll")
def staleness_admission(spark, d):
    return queues.admitted(rollouts(spark, d), queues.staleness_budget(20, 0.5, 2), "k", ["id"]).select("id", "admitted")


@query("version_resets", """WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS v FROM events), x AS (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM e)
 SELECT event_id AS id, CAST(sum(CASE WHEN v = 1 THEN 3 ELSE 1 END) OVER (PARTITION BY user_id, epoch ORDER BY event_id) AS BIGINT) AS stale FROM x""")
def version_resets(spark, d):
    e = rollouts(spark, d).select("id", F.col("uid").alias("stream"), F.when(F.col("data_source") == "purchase", "version").otherwise("sample").alias("kind"), F.lit(1).alias("active"), F.lit(0).alias("cancelled"), F.lit(2).alias("queued"))
    return queues.version_resets(e, ["id"]).select("id", "stale")


@query("sample_lifecycle", f"WITH {ROLL} SELECT uid, CAST(sum(CASE WHEN data_source = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS runs, arg_max(CASE data_source WHEN 'click' THEN 'active' WHEN 'view' THEN 'cancelled' ELSE 'done' END, id) AS state FROM roll GROUP BY uid")
def sample_lifecycle(spark, d):
    state = F.when(F.col("data_source") == "click", "active").when(F.col("data_source") == "view", "cancelled").otherwise("done")
    return queues.lifecycle(rollouts(spark, d).withColumn("state", state), "uid", "id").select("uid", "runs", "state")


@query("full_batches", f"WITH {ROLL}, x AS (SELECT id, uid, (row_number() OVER (PARTITION BY uid ORDER BY id) - 1) // 16 AS batch FROM roll) SELECT id, batch FROM (SELECT *, count(*) OVER (PARTITION BY uid, batch) AS c FROM x) WHERE c = 16")
def full_batches(spark, d):
    return queues.full_batches(rollouts(spark, d), 16, "uid", ["id"]).select("id", "batch")


@query("flush_windows", f"WITH {ROLL} SELECT uid // 10 AS flush, data_source, round(avg(score), 6) AS value FROM roll GROUP BY ALL")
def flush_windows(spark, d):
    f = queues.flush_windows(rollouts(spark, d), 10, "uid")
    return f.groupBy("flush", "data_source").agg(r(F.avg("score")).alias("value"))


#: Seconds of the first day, and a divisor that keeps times off the ties of rounding.
EPOCH, UNIT = 1_704_067_200, 0.97


@query("token_bucket", f"""WITH RECURSIVE {ROLL}, e AS (SELECT uid AS key, (epoch_us(ts) / 1e6 - {EPOCH}) / {UNIT} AS t, abs(score) AS tokens FROM roll),
 o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, tokens) AS n FROM e),
 a AS (SELECT key, n, t, tokens, t AS start, 50.0 - tokens AS level FROM o WHERE n = 1
 UNION ALL SELECT key, n, t, tokens, CASE WHEN full_ < need THEN now_ + (need - full_) / 0.01 ELSE now_ END, CASE WHEN full_ < need THEN need ELSE full_ END - tokens
 FROM (SELECT *, least(tokens, 50.0) AS need, least(50.0, level + (now_ - start) * 0.01) AS full_ FROM (SELECT o.*, a.start, a.level, greatest(o.t, a.start) AS now_ FROM a JOIN o ON o.key = a.key AND o.n = a.n + 1)))
 SELECT key, round(t, 3) AS t, round(tokens, 3) AS tokens, round(start, 3) AS start FROM a""")
def token_bucket(spark, d):
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - EPOCH) / UNIT
    e = rollouts(spark, d).select(F.col("uid").alias("key"), t.alias("t"), F.abs("score").alias("tokens"))
    return rounded(queues.token_bucket(e, 0.01, 50.0), "key", digits=3)


@query("field_readiness", f"WITH {ROLL} SELECT id, round(score, 6) AS score, k FROM roll WHERE id % 2 = 0 AND id % 3 = 0")
def field_readiness(spark, d):
    e = rollouts(spark, d)
    parts = [e.where("id % 2 = 0").select(F.col("id").alias("sample_id"), "score"), e.where("id % 3 = 0").select(F.col("id").alias("sample_id"), "k")]
    return queues.ready(parts).select(F.col("sample_id").alias("id"), r("score").alias("score"), "k")


@query("tumbling_events", "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def tumbling_events(spark, d):
    w = events.tumbling(table(spark, d, "events"), "ts", "6 hours", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return w.select(F.to_timestamp_ntz(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).alias("window_start"), "event_type", "n", r("v", 4).alias("v"))


@query("sliding_events", "WITH s AS (SELECT unnest([0, 1, 2, 3]) AS k) SELECT time_bucket(INTERVAL '1 hours', ts) - k * INTERVAL '1 hours' AS window_start, count(*) AS n FROM events, s GROUP BY ALL")
def sliding_events(spark, d):
    w = events.sliding(table(spark, d, "events"), "ts", "4 hours", "1 hour", [], F.count(F.lit(1)).alias("n"))
    return w.select(F.to_timestamp_ntz(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).alias("window_start"), "n")


@query("session_events", """WITH x AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '12 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS f FROM events),
 s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, count(*) AS n, round(sum(value), 4) AS v FROM s GROUP BY user_id, g""")
def session_events(spark, d):
    s = events.sessions(table(spark, d, "events"), "ts", "12 hours", ["user_id"], F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return s.select("user_id", "n", r("v", 4).alias("v"))
