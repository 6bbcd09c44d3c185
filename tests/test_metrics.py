import pytest
from pyspark.sql import functions as F

from rillflow.operators import metrics as X


def test_aborted_samples_leave_scores_but_not_lengths(spark):
    s = spark.createDataFrame([(1.0, 1.0, 2, 2), (9.0, 9.0, 0, 2)], "score double, reward double, response_length int, prompt_length int")
    t = spark.createDataFrame([(0.1, 1.1, 1.0, 1), (0.3, 1.5, 1.2, 1), (9.0, 9.0, 9.0, 0)], "advantage double, ret double, value double, mask int")
    got = X.data_metrics(s, t, 2, 2).first().asDict()
    assert got["critic/score/mean"] == 1.0 and got["response_length/mean"] == 1.0 and got["response/aborted_ratio"] == 0.5
    assert got["critic/advantages/mean"] == pytest.approx(0.2) and got["response_length_non_aborted/mean"] == 2.0
    assert not [c for c in X.data_metrics(s, t, 2, 2, critic=False).columns if "values" in c]
    with pytest.raises(Exception, match="aborted"):
        X.data_metrics(s.where("response_length = 0"), t, 2, 2).collect()


def test_reduce_by_name(spark):
    rows = [("loss/max_mean", 1.0), ("loss/max_mean", 3.0), ("x/min", 1.0), ("x/min", 3.0), ("x/mean", 1.0), ("x/mean", 3.0)]
    got = {r["metric"]: r["value"] for r in X.reduce_metrics(spark.createDataFrame(rows, "metric string, value double")).collect()}
    assert got == {"loss/max_mean": 3.0, "x/min": 1.0, "x/mean": 2.0}


def test_weighted_average_is_out_of_reach_by_name(spark):
    df = spark.createDataFrame([("a/weighted_avg",), ("training/global_step",), ("timing_s/gen",), ("n/total",), ("other",)], "metric string")
    got = [r[0] for r in df.select(X.aggregation_rule(F.col("metric"))).collect()]
    assert got == ["avg", "last", "time_sum", "sum", "avg"]


def test_majority_takes_the_first_seen_of_a_tie(spark):
    rows = [(1, "A", 0.9, 0), (1, "B", 0.8, 1), (1, "A", 0.7, 2), (2, "B", 0.8, 0), (2, "A", 0.9, 1)]
    got = {r["u"]: (r["p"], r["v"]) for r in X.majority(spark.createDataFrame(rows, "u int, p string, v double, i int"), ["u"], "p", "v", "i").collect()}
    assert got == {1: ("A", 0.9), 2: ("B", 0.8)}


def test_closed_form_is_the_limit_of_the_bootstrap(spark):
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate([1, 2, 3, 4, 5])], "k string, i int, x double")
    exact = {r["n"]: r for r in X.best_worst(df, ["k"], "x").collect()}
    drawn = {(r["n"], r["name"]): r for r in X.bootstrap(df, ["k"], "x", "i", draws=4000).collect()}
    assert set(exact) == {2, 4, 5}
    for n in exact:
        for name in ("best", "worst"):
            assert exact[n][f"{name}_mean"] == pytest.approx(drawn[n, name]["mean"], abs=0.06)
            assert exact[n][f"{name}_std"] == pytest.approx(drawn[n, name]["std"], abs=0.06)


def test_validation(spark):
    rows = [("s1", "p1", 0.8), ("s1", "p1", 0.9), ("s2", "p2", 0.7)]
    got = {(r["data_source"], r["metric"]): r["value"] for r in X.validation_metrics(spark.createDataFrame(rows, "data_source string, uid string, score double"), ["score"]).collect()}
    assert got["s1", "mean@2"] == pytest.approx(0.85) and got["s1", "std@2"] == pytest.approx(0.05)
    assert got["s2", "mean@1"] == 0.7 and ("s2", "std@1") not in got
    assert got["s1", "best@2/mean"] == pytest.approx(0.9 * 0.75 + 0.8 * 0.25)


def test_throughput_and_timing(spark):
    s = spark.createDataFrame([(100,), (200,), (300,)], "n int")
    assert X.throughput(s, "n", 2.0, 1).first()["throughput"] == 300 and X.throughput(s, "n", 2.0, 2).first()["throughput"] == 150
    t = spark.createDataFrame([("gen", 0.5), ("ref", 0.3), ("other", 1.0)], "name string, seconds double")
    totals = spark.createDataFrame([(6, 6)], "prompt_tokens int, response_tokens int")
    got = {r["name"]: r["timing_per_token_ms"] for r in X.timing_metrics(t, totals).collect()}
    assert got["gen"] == pytest.approx(500 / 6) and got["ref"] == pytest.approx(300 / 12) and got["other"] is None


def test_pairs_without_a_difference_count_a_half(spark):
    rows = [("a", 0, 1.0, 1), ("a", 1, 0.5, 0), ("b", 0, 1.0, 1), ("b", 1, 2.0, 1), ("c", 0, 1.0, 0)]
    df = spark.createDataFrame(rows, "uid string, idx int, s double, acc int")
    assert X.pair_accuracy(df, "s", "acc").first()[0] == pytest.approx((1 + 0.5 + 0.5) / 3)


def test_names_devices_and_config(spark):
    assert X.flatten_config({"a": {"b": 1, "c": [2, 3]}, "d": None}) == {"a/b": 1, "a/c/0": 2, "a/c/1": 3, "d": None}
    assert X.device_tflops("NVIDIA H100 80GB") == 989 and X.device_tflops("NVIDIA L40S") == 362.05 and X.device_tflops("abacus") == float("inf")
    got = spark.createDataFrame([("val//x@1 %",)], "m string").select(X.sanitise(F.col("m"))).first()[0]
    assert got == "val/x_at_1 _"


def test_special_metrics(spark):
    row = {"global_seqlen/max": 9.0, "global_seqlen/min": 4.0, "timing_s/gen": 1.0, "timing_s/step": 4.0, "perf/total_num_tokens": 8.0, "perf/time_per_step": 2.0, "perf/devices": 2.0}
    got = X.recomputed(spark.createDataFrame([row])).first().asDict()
    assert got["global_seqlen/minmax_diff"] == 5.0 and got["trainer/idle_ratio"] == 0.25 and got["perf/throughput"] == 2.0


def test_trajectory_index_counts_neighbours(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate("aabba")], "i long, x string")
    assert [r["rollout_n"] for r in X.trajectory_index(df, "x", "i").orderBy("i").collect()] == [0, 1, 0, 1, 0]


def test_bootstrap_metrics_cover_all_prompts_with_a_thousand_draws(spark, sf_dir, tmp_path):
    import numpy as np

    from rillflow.plans import registry
    from rillflow.plans.frames import rollouts

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.selectExpr("* except (user_id)", "user_id + 15 as user_id").write.parquet(f"{tmp_path}/events.parquet")
    sf_dir, groups = str(tmp_path), {}
    for e in rollouts(spark, sf_dir).orderBy("id").collect():
        groups.setdefault((e["data_source"], e["uid"]), []).append((e["score"], e["k"]))
    got = {}
    for g in registry.queries()["bootstrap_metrics"](spark, sf_dir).collect():
        got.setdefault((g["data_source"], g["uid"]), {})[g["n"], g["name"]] = (g["mean"], g["std"])
    assert set(got) == {key for key, v in groups.items() if len(v) > 1} and {uid < 20 for _, uid in got} == {True, False}
    for key in sorted(got)[:3] + sorted(got)[-3:]:
        scores, votes = zip(*groups[key])
        for n in {n for n, _ in got[key]}:
            rng, picks = np.random.RandomState(42), {"best": [], "worst": [], "maj": []}
            for _ in range(1000):
                at = [int(i) for i in rng.choice(len(scores), size=n, replace=True)]
                drawn = [votes[i] for i in at]
                picks["best"].append(max(scores[i] for i in at))
                picks["worst"].append(min(scores[i] for i in at))
                picks["maj"].append(scores[at[drawn.index(max(dict.fromkeys(drawn), key=drawn.count))]])
            for name, v in picks.items():
                assert got[key][n, name] == pytest.approx((np.mean(v), np.std(v)), abs=2e-6)
