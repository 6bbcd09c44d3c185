import math

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow.operators import losses as L
from rillflow.operators import offpolicy as O
from rillflow.plans import registry


@pytest.fixture
def tokens(spark):
    rows = []
    for s in range(6):
        for p in range(4):
            lp = -0.5 - 0.1 * ((s * 7 + p * 3) % 5)
            rows.append((s, p, int(not (s == 5 or (s + p) % 4 == 3)), lp, lp - 0.3 + 0.1 * ((s + 2 * p) % 7), lp + 0.05 * (s % 3) - 0.05, float((s % 3) - 1)))
    return spark.createDataFrame(rows, "seq_id int, pos int, mask int, old_lp double, log_prob double, rollout_lp double, advantage double")


def test_sequences_without_tokens_count_in_no_mean_of_sequences(tokens):
    t = tokens.withColumn("l", F.lit(1.0))
    assert L.aggregate_loss(t, "l", "seq-mean-token-mean").first()[0] == pytest.approx(1.0)
    n = t.where("mask = 1").count()
    assert L.aggregate_loss(t, "l", "seq-mean-token-sum").first()[0] == pytest.approx(n / 5)
    assert L.aggregate_loss(t, "l", "seq-mean-token-sum-norm").first()[0] == pytest.approx(n / 4)
    assert L.aggregate_loss(t, "l", "token-mean", dp_size=2, batch_tokens=n).first()[0] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        L.aggregate_loss(t, "l", "mean")


def test_every_registered_loss_gives_a_number(tokens):
    for name in L.names():
        loss = L.get(name)(tokens).first()["loss"]
        assert loss is not None and math.isfinite(loss), name
    with pytest.raises(ValueError):
        L.get("none")


def test_covariances_equal_to_9_digits_tie(spark, tmp_path):
    # Of the two greatest covariances the second is greater by the last digit of 0.1 + 0.02; the query's SQL rounds, and takes the first order.
    items = [(1, 1.0, 0.06, 0.06), (2, 1.0, 0.1, 0.02), *[(k, 25.0 + k, 0.01, 0.01 * (k % 3)) for k in range(3, 11)]]
    rows = [(k, 1, 1, 1, 9.0, "O", q, d, t) for k, q, d, t in items]
    line = "l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_linestatus string, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, f"l_orderkey long, {line}").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 11).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert [tuple(x) for x in registry.queries()["loss_kl_cov"](spark, str(tmp_path)).collect()] == c.execute(registry.oracle_sql()["loss_kl_cov"]).fetchall()


def test_a_later_loss_replaces_an_earlier_one():
    before = L.get("gpg")
    L.register("gpg")(len)
    assert L.get("gpg") is len
    L.register("gpg")(before)


def test_geo_mean_ignores_the_mode_and_uses_weights(tokens):
    plain = L.geo_mean(tokens).first()["loss"]
    assert L.geo_mean(tokens.withColumn("is_weight", F.lit(2.0))).first()["loss"] == pytest.approx(2 * plain)


def test_importance_weights_scale_the_loss(tokens):
    for name in ("vanilla", "gspo", "sapo", "gpg", "cispo", "reinforce"):
        plain = L.get(name)(tokens).first()["loss"]
        assert L.get(name)(tokens.withColumn("is_weight", F.lit(3.0))).first()["loss"] == pytest.approx(3 * plain), name


def test_kl_estimates(spark):
    df = spark.createDataFrame([(-1.0, -1.5)], "a double, b double")
    got = df.select(*[L.kl_estimate(F.col("a"), F.col("b"), k).alias(k) for k in ("k1", "abs", "k2", "k3", "k3+")]).first()
    assert list(got) == pytest.approx([0.5, 0.5, 0.125, math.exp(-0.5) + 0.5 - 1, math.exp(-0.5) + 0.5 - 1])
    with pytest.raises(NotImplementedError):
        L.kl_estimate(F.col("a"), F.col("b"), "full")


def test_log_sigmoid_does_not_overflow(spark):
    got = [r[0] for r in spark.createDataFrame([(1000.0,), (-1000.0,), (0.0,)], "x double").select(L.log_sigmoid(F.col("x"))).collect()]
    assert got == pytest.approx([0.0, -1000.0, -math.log(2)])


def test_best_of_n_weights(spark):
    df = spark.createDataFrame([("u", 1.0, 1.0, 1.0), ("u", 2.0, 2.0, 0.0)], "uid string, score double, q double, acc double")
    rm = L.detached_dpo_loss(df, 1.0, "bon_rm").first()[0]
    a, b = math.log1p(math.exp(-(1.0 - 2.0))), math.log1p(math.exp(2.0 - 1.0))
    assert rm == pytest.approx(2 * 0.5 * a + 2 * 1.0 * b)
    assert L.detached_dpo_loss(df, 1.0, "bon_acc").first()[0] == pytest.approx(2 * 1.0 * a + 2 * 0.5 * b)


def test_sequence_logprobs_ignore_labels(spark):
    df = spark.createDataFrame([([-1.0, -2.0, -3.0], [-100, 4, 5])], "lp array<double>, y array<int>")
    assert df.select(L.sequence_logprob("lp", "y"), L.sequence_logprob("lp", "y", True)).first()[:] == (-5.0, -2.5)


def test_weights_never_exceed_the_threshold(tokens):
    for level in ("token", "sequence"):
        w = O.importance_weights(tokens, level, 1.02)
        assert w.where("is_weight > 1.02 or (mask = 0 and is_weight <> 0)").count() == 0
    mean = O.importance_weights(tokens, "token", 2.0, normalize=True).where("mask = 1").agg(F.avg("is_weight")).first()[0]
    assert mean == pytest.approx(1.0)
    for bad in (("geometric", 2.0), ("token", 0.0)):
        with pytest.raises(ValueError):
            O.importance_weights(tokens, *bad)


def test_veto_reads_the_mask_as_it_was(tokens):
    t = O.correct(tokens, rs_level="token", rs_upper=1.0001, rs_lower=0.9999, veto_threshold=0.96)
    bad = {r[0] for r in tokens.where("mask = 1 and old_lp - rollout_lp < ln(0.96)").select("seq_id").distinct().collect()}
    kept = {r[0] for r in t.where("mask = 1").select("seq_id").distinct().collect()}
    assert bad and not bad & kept
    with pytest.raises(ValueError):
        O.correct(tokens, rs_level="token")


def test_presets(tokens):
    for name in ("token_is", "seq_is", "seq_is_rs", "geo_rs", "geo_rs_seq_is", "disabled"):
        assert O.preset(name).apply(tokens).count() == tokens.count()
    assert O.bypass(tokens).where("old_lp <> rollout_lp").count() == 0
    m = O.correction_metrics(tokens, "token", 2.0, "token", 2.0, None, 1e-4)
    assert m.columns[0].startswith("rollout_corr/") and "rollout_corr/rollout_rs_masked_fraction" in m.columns
