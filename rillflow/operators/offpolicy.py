"""Off-policy correction between the policy that is trained (``old_lp``) and the one that rolled out (``rollout_lp``).

Long form. Sequence statistics are aggregates by ``seq_id`` joined back; batch statistics are one broadcast row.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import masked as M

#: Log-ratios beyond it are clamped before the exponential.
BOUND = 20.0
LEVELS = {"is": ("token", "sequence"), "rs": ("token", "sequence", "geometric")}


def check(level: str, kind: str, threshold: float) -> None:
    if level not in LEVELS[kind]:
        raise ValueError(f"unknown level {level!r}")
    if threshold is None or threshold <= 0:
        raise ValueError("the threshold must be over 0")


def ratios(df: DataFrame, level: str, seq: str = "seq_id") -> DataFrame:
    """With ``log_ratio`` of the level (token, sum or mean of the sequence) and ``weight``, its clamped exponential."""
    t = df.withColumn("log_ratio", F.col("old_lp") - F.col("rollout_lp"))
    if level != "token":
        n = F.sum("mask") + M.EPS if level == "geometric" else F.lit(1.0)
        sums = t.groupBy(seq).agg((M.m_sum("log_ratio") / n).alias("__s"))
        t = t.drop("log_ratio").join(sums.hint("shuffle_hash"), seq).withColumnRenamed("__s", "log_ratio")
    return t.withColumn("weight", F.exp(M.clip("log_ratio", -BOUND, BOUND)))


def importance_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, normalize: bool = False, seq: str = "seq_id") -> DataFrame:
    """With ``is_weight``: exp of the log-ratio, 0 under the mask, ``threshold`` at most; ``normalize`` divides by the batch's mean."""
    check(level, "is", threshold)
    t = ratios(df, level, seq).withColumn("is_weight", F.least(F.col("weight") * F.col("mask"), F.lit(float(threshold)))).drop("weight", "log_ratio")
    if not normalize:
        return t
    if level == "token":
        t = M.with_totals(t, M.m_mean("is_weight").alias("__mean"))
    else:
        rows = t.groupBy(seq).agg((M.m_sum("is_weight") / (F.sum("mask") + M.EPS)).alias("w"), (F.sum("mask") > 0).cast("int").alias("k"))
        mean = rows.agg((F.sum(F.col("w") * F.col("k")) / F.greatest(F.sum("k").cast("double"), F.lit(M.EPS))).alias("__mean"))
        t = t.crossJoin(F.broadcast(mean))
    return t.withColumn("is_weight", F.when(F.col("__mean") > M.EPS, F.col("is_weight") / F.col("__mean")).otherwise(F.col("is_weight"))).drop("__mean")


def rejection(df: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None, seq: str = "seq_id") -> DataFrame:
    """With ``kept``: 1 where the ratio of the level lies within [lower, upper] (1 / upper by default), and ``new_mask``."""
    check(level, "rs", upper)
    low = lower if lower is not None else 1 / upper
    t = ratios(df, level, seq)
    t = t.withColumn("kept", ((F.col("weight") >= low) & (F.col("weight") <= upper)).cast("int")).drop("weight", "log_ratio")
    return t.withColumn("new_mask", F.col("mask") * F.col("kept"))


def veto(df: DataFrame, threshold: float, seq: str = "seq_id") -> DataFrame:
    """With ``vetoed``: whether any token of the mask has a log-ratio under ln(threshold)."""
    if threshold <= 0:
        raise ValueError("the threshold must be over 0")
    bad = (F.col("old_lp") - F.col("rollout_lp") < log(threshold)) & (F.col("mask") != 0)
    return df.join(df.groupBy(seq).agg(F.max(bad.cast("int")).alias("vetoed")), seq)


def ratio_metrics(df: DataFrame, level: str, upper: float, lower: float | None = None, zero_masked: bool = True, seq: str = "seq_id") -> DataFrame:
    """One row: mean, max, min, std, eff_sample_size, shares beyond the thresholds, and the same per sequence.

    ``zero_masked``: weights count as 0 under the mask (importance weights), else as they are (rejection).
    Deviation and sample size use weights clamped to [lower, upper]; extremes of sequence levels come from
    log-ratios, clamped above only.
    """
    low = lower if lower is not None else 1 / upper
    t = ratios(df, level, seq)
    t = t.withColumn("w", F.col("weight") * F.col("mask") if zero_masked else F.col("weight"))
    t = t.withColumn("c", F.greatest(F.least("w", F.lit(float(upper))), F.lit(float(low)))).withColumn("c2", F.col("c") * F.col("c"))
    rows = t.groupBy(seq).agg((M.m_sum("w") / (F.sum("mask") + M.EPS)).alias("m"), F.first("log_ratio").alias("lr"))
    inside = F.col("mask") != 0
    tokens = t.agg(
        M.m_mean("w").alias("mean"), M.m_mean("c").alias("cm"), M.m_mean("c2").alias("cq"), F.sum("mask").alias("n"),
        F.max(F.when(inside, F.col("w"))).alias("t_max"), F.min(F.when(inside, F.col("w"))).alias("t_min"),
        (F.sum(F.when(inside & (F.col("w") > upper), 1.0).otherwise(0.0)) / (F.sum("mask") + M.EPS)).alias("t_high"),
        (F.sum(F.when(inside & (F.col("w") < low), 1.0).otherwise(0.0)) / (F.sum("mask") + M.EPS)).alias("t_low"),
    )
    share = lambda c: F.avg(c.cast("double"))
    seqs = rows.agg(
        F.avg("m").alias("seq_mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("seq_std"), F.max("m").alias("seq_max"), F.min("m").alias("seq_min"),
        F.max(F.abs(F.col("m") - 1)).alias("seq_max_deviation"), share(F.col("m") > upper).alias("seq_fraction_high"),
        share(F.col("m") < low).alias("seq_fraction_low"), F.exp(F.least(F.max("lr"), F.lit(BOUND))).alias("s_max"), F.exp(F.min("lr")).alias("s_min"),
        share(F.col("lr") > log(upper)).alias("s_high"), share(F.col("lr") < log(low)).alias("s_low"),
    )
    k = "t" if level == "token" else "s"
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("cq") - F.col("cm") * F.col("cm"), F.lit(0.0)))).otherwise(F.lit(0.0))
    size = F.try_divide(F.lit(1.0), F.col("cq") / F.pow(F.col("cm") + M.EPS, 2.0))
    per_seq = [c for c in seqs.columns if c.startswith("seq_")]
    return tokens.crossJoin(seqs).select(
        "mean", F.col(f"{k}_max").alias("max"), F.col(f"{k}_min").alias("min"), std.alias("std"), size.alias("eff_sample_size"),
        F.col(f"{k}_high").alias("fraction_high"), F.col(f"{k}_low").alias("fraction_low"), *per_seq,
    )


def diagnostics(df: DataFrame, seq: str = "seq_id") -> DataFrame:
    """One row: perplexities of both policies, KL estimates, their differences by sequence, and chi-squared divergences."""
    t = df.withColumn("lr", F.col("old_lp") - F.col("rollout_lp"))
    t = t.withColumns({"k3": F.exp("lr") - F.col("lr") - 1, "r2": F.exp(2 * M.clip("lr", -BOUND, BOUND)), "kl": -F.col("lr")})
    n = F.sum("mask") + M.EPS
    rows = t.groupBy(seq).agg((M.m_sum("old_lp") / n).alias("o"), (M.m_sum("rollout_lp") / n).alias("r"), M.m_sum("lr").alias("s"))
    d = F.col("r") - F.col("o")
    seqs = rows.agg(
        F.avg(F.exp(-F.col("o"))).alias("training_ppl"), F.avg(-F.col("o")).alias("training_log_ppl"),
        F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(-F.col("r")).alias("rollout_log_ppl"),
        F.avg(d).alias("log_ppl_diff"), F.avg(F.abs(d)).alias("log_ppl_abs_diff"), F.max(d).alias("log_ppl_diff_max"), F.min(d).alias("log_ppl_diff_min"),
        F.avg(F.exp(d)).alias("ppl_ratio"), (F.avg(F.exp(2 * M.clip("s", -BOUND, BOUND))) - 1).alias("chi2_seq"),
    )
    tokens = t.agg(M.m_mean("kl").alias("kl"), M.m_mean("k3").alias("k3_kl"), (M.m_mean("r2") - 1).alias("chi2_token"))
    return seqs.crossJoin(tokens)


def correct(df: DataFrame, is_level: str | None = None, is_threshold: float = 2.0, normalize: bool = False, rs_level: str | None = None,
            rs_upper: float | None = None, rs_lower: float | None = None, veto_threshold: float | None = None, seq: str = "seq_id") -> DataFrame:
    """Weights, rejection and veto in one: ``is_weight`` from the original mask, ``mask`` as rejection and veto leave it, ``old_mask``."""
    t = df.withColumn("old_mask", F.col("mask"))
    if is_level:
        t = importance_weights(t, is_level, is_threshold, normalize, seq)
    rest = F.lit(1)
    if veto_threshold is not None:
        t = veto(t, veto_threshold, seq)
        rest = 1 - F.col("vetoed")
    if rs_level:
        if rs_upper is None:
            raise ValueError("rejection needs its upper threshold")
        t = rejection(t, rs_level, rs_upper, rs_lower, seq)
        rest = rest * F.col("kept")
    return t.withColumn("mask", F.col("old_mask") * rest).drop("vetoed", "kept", "new_mask")


def correction_metrics(df: DataFrame, is_level: str | None = None, is_threshold: float = 2.0, rs_level: str | None = None, rs_upper: float | None = None,
                       rs_lower: float | None = None, veto_threshold: float | None = None, seq: str = "seq_id") -> DataFrame:
    """One row of all metrics, with the prefixes ``rollout_corr/rollout_is_``, ``rollout_corr/rollout_rs_`` and ``rollout_corr/``."""
    out = diagnostics(df, seq)
    if is_level:
        m = ratio_metrics(df, is_level, is_threshold, seq=seq)
        out = out.crossJoin(m.select(*[F.col(c).alias(f"rollout_is_{c}") for c in m.columns]))
    if rs_level:
        m = ratio_metrics(df, rs_level, rs_upper, rs_lower, zero_masked=False, seq=seq)
        out = out.crossJoin(m.select(*[F.col(c).alias(f"rollout_rs_{c}") for c in m.columns]))
        t = rejection(df, rs_level, rs_upper, rs_lower, seq).withColumn("gone", 1 - F.col("kept"))
        rows = t.groupBy(seq).agg((M.m_sum("gone") > 0 if rs_level == "token" else F.max("gone") > 0).cast("double").alias("g"))
        out = out.crossJoin(t.agg(M.m_mean("gone").alias("rollout_rs_masked_fraction"))).crossJoin(rows.agg(F.avg("g").alias("rollout_rs_seq_masked_fraction")))
    if veto_threshold is not None:
        bad = (F.col("old_lp") - F.col("rollout_lp") < log(veto_threshold)).cast("double")
        t = df.withColumn("bad", bad)
        rows = t.groupBy(seq).agg((M.m_sum("bad") > 0).cast("double").alias("b"))
        out = out.crossJoin(rows.agg(F.avg("b").alias("rollout_is_veto_fraction"))).crossJoin(t.agg(M.m_mean("bad").alias("rollout_is_catastrophic_token_fraction")))
    return out.select(*[F.col(c).alias(f"rollout_corr/{c}") for c in out.columns])


def bypass(df: DataFrame) -> DataFrame:
    """Old log-probabilities are those of the rollout."""
    return df.withColumn("old_lp", F.col("rollout_lp"))


@dataclass(frozen=True)
class Correction:
    """Options of :func:`correct` under a name."""

    is_level: str | None = None
    is_threshold: float = 2.0
    normalize: bool = False
    rs_level: str | None = None
    rs_upper: float | None = None
    rs_lower: float | None = None
    veto_threshold: float | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        return correct(df, **vars(self))


def preset(name: str, threshold: float = 2.0, veto_threshold: float | None = 1e-4) -> Correction:
    """``token_is``, ``seq_is``, ``seq_is_rs``, ``geo_rs``, ``geo_rs_seq_is`` or ``disabled``."""
    found = {
        "token_is": Correction(is_level="token", is_threshold=threshold),
        "seq_is": Correction(is_level="sequence", is_threshold=threshold),
        "seq_is_rs": Correction(is_level="sequence", is_threshold=threshold, rs_level="sequence", rs_upper=threshold),
        "geo_rs": Correction(rs_level="geometric", rs_upper=1.001, rs_lower=0.999, veto_threshold=veto_threshold),
        "geo_rs_seq_is": Correction(is_level="sequence", is_threshold=threshold, rs_level="geometric", rs_upper=1.001, rs_lower=0.999, veto_threshold=veto_threshold),
        "disabled": Correction(),
    }
    if name not in found:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(found)}")
    return found[name]
