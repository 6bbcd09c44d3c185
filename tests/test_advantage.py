"""Groups of one, ties, epsilons and the registry."""

import pytest
from pyspark.sql import functions as F

from rillflow.functions import masked as M
from rillflow.operators import advantage as A


def frame(spark, rows):
    return spark.createDataFrame([(i, u, [float(s), 0.0], [1, 1]) for i, (u, s) in enumerate(rows)], "seq_id long, uid string, rewards array<double>, mask array<int>")


def run(spark, name, rows, **options):
    out = A.compute(frame(spark, rows), name, **options).orderBy("seq_id").collect()
    return [r["advantages"][0] for r in out]


def test_groups_of_one_differ_by_estimator(spark):
    one = [("a", 3.0)]
    assert run(spark, "grpo", one) == pytest.approx([3.0 / (1 + 1e-6)])
    assert run(spark, "rloo", one) == [3.0]
    assert run(spark, "rloo_vectorized", one) == [0.0]
    assert run(spark, "opo", one) == [3.0]
    assert run(spark, "gpg", one) == [3.0]
    with pytest.raises(Exception, match="two rollouts"):
        run(spark, "grpo_passk", one)


def test_pass_at_k_rewards_the_lead_of_the_best_alone(spark):
    rows = [("a", 1.0), ("a", 5.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)]
    got = run(spark, "grpo_passk", rows)
    assert got == pytest.approx([0, 2 / (2 + 1e-6), 0, 0, 0])


def test_constant_groups_are_zero(spark):
    rows = [("a", 2.0), ("a", 2.0)]
    for name in ("grpo", "grpo_vectorized", "rloo", "rloo_vectorized"):
        assert run(spark, name, rows) == pytest.approx([0.0, 0.0])


def test_rloo_and_its_vectorized_form_agree_on_larger_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 1.0), ("b", 4.0)]
    assert run(spark, "rloo", rows) == pytest.approx(run(spark, "rloo_vectorized", rows))


def test_null_prompts_are_one_group(spark):
    assert run(spark, "rloo_vectorized", [(None, 1.0), (None, 3.0)]) == pytest.approx([-2.0, 2.0])


def test_registry(spark):
    assert {"gae", "grpo", "grpo_passk", "rloo", "opo", "remax", "gpg", "prime_rloo"} <= set(A.names())
    with pytest.raises(ValueError, match="registered already"):
        A.register("grpo")(lambda df: df)
    assert A.register("grpo")(A.get("grpo")) is A.get("grpo")
    with pytest.raises(ValueError, match="unknown estimator"):
        A.get("none")


def test_kl_controllers():
    fixed, adaptive = A.kl_controller("fixed", 0.1), A.kl_controller("adaptive", 0.1, 0.05, 100)
    fixed.update(1, 10)
    adaptive.update(1, 10)
    assert fixed.value == 0.1 and adaptive.value == pytest.approx(0.1 * 1.02)
    with pytest.raises(ValueError):
        A.kl_controller("other", 1)


def test_resampling_follows_the_weights(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0)], "seq_id long, score double")
    out = A.resample(df, A.pf_ppo_weights(df, "pow", 1.0), 4000, 1, "seq_id")
    counts = {r["seq_id"]: r["count"] for r in out.groupBy("seq_id").count().collect()}
    assert sum(counts.values()) == 4000 and abs(counts[1] / 4000 - 0.75) < 0.03 and 2 not in counts
    assert out.select("draw").distinct().count() == 4000


def test_preferred_takes_the_first_of_a_tie(spark):
    df = frame(spark, [("a", 1.0), ("a", 1.0)]).withColumn("pair", F.lit(1))
    assert [r["chosen"] for r in A.preferred(df, "pair", "seq_id").orderBy("seq_id").collect()] == [True, False]


def test_whitened_advantages_have_no_mean(spark):
    out = A.compute(frame(spark, [("a", 1.0), ("a", 2.0), ("b", 5.0)]).withColumn("values", F.col("rewards")), "gae", gamma=0.9, lam=0.9)
    assert out.select(F.sum(M.array_sum("advantages"))).first()[0] == pytest.approx(0, abs=1e-6)
