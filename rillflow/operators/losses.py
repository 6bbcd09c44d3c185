"""Forward values of policy, value and preference losses, as expressions over tokens and aggregates over sequences.

Long form: one row per token with ``seq_id``, ``mask``, ``old_lp``, ``log_prob``, ``advantage`` and what a loss names besides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import masked as M
from rillflow.functions import seeded
from rillflow.operators import order

_losses: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Register a policy loss; a later one under the same name replaces it."""

    def put(f):
        _losses[name] = f
        return f

    return put


def get(name: str) -> Callable[..., DataFrame]:
    if name not in _losses:
        raise ValueError(f"unknown policy loss {name!r}; there are {', '.join(sorted(_losses))}")
    return _losses[name]


def names() -> list[str]:
    return sorted(_losses)


MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")


def aggregate_loss(df: DataFrame, loss: str, mode: str = "token-mean", seq: str = "seq_id", mask: str = "mask", norm: float | None = None,
                   dp_size: int = 1, global_batch: int | None = None, batch_tokens: int | None = None, also: dict[str, str] | None = None) -> DataFrame:
    """One row with ``loss``: token losses over the mask, averaged as ``mode`` says, and the masked means ``also`` (name to column), all in one pass.

    Sequences without any token of the mask don't count among sequences; without any token at all the loss is null. ``norm`` replaces the greatest sequence length in
    ``seq-mean-token-sum-norm``; ``global_batch`` and ``batch_tokens`` replace what this frame counts, and ``dp_size``
    scales for a mean over workers.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    also = also or {}
    if mode == "token-mean":
        n = F.lit(float(batch_tokens)) if batch_tokens else F.sum(mask).cast("double")
        return df.agg((F.try_divide(M.m_sum(loss, mask), n) * dp_size).alias("loss"), *[M.m_mean(c, mask).alias(k) for k, c in also.items()])
    own = [M.m_sum(c, mask).alias(f"__{k}") for k, c in also.items()]
    rows = df.groupBy(seq).agg(M.m_sum(loss, mask).alias("s"), F.sum(mask).alias("n"), F.count(F.lit(1)).alias("t"), *own)
    some = F.col("n") > 0
    means = [(F.sum(f"__{k}") / (F.sum("n") + M.double(M.EPS))).alias(k) for k in also]
    count = F.lit(float(global_batch)) if global_batch else F.count_if(some).cast("double")
    if mode == "seq-mean-token-sum":
        value = F.sum(F.when(some, F.col("s"))) / count * dp_size
    elif mode == "seq-mean-token-mean":
        value = F.sum(F.when(some, F.col("s") / (F.col("n") + M.EPS))) / count * dp_size
    else:
        value = F.sum("s") / (F.lit(float(norm)) if norm else F.max("t").cast("double"))
    return rows.agg(value.alias("loss"), *means)


def log_ratio(bound: float = 20.0) -> Column:
    return M.clip(F.col("log_prob") - F.col("old_lp"), -bound, bound)


def weighted(df: DataFrame, column: str) -> Column:
    """The loss times importance weights, where the frame has them."""
    return F.col(column) * F.col("is_weight") if "is_weight" in df.columns else F.col(column)


def clipped(ratio: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low))


@register("vanilla")
def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0, mode: str = "token-mean", **agg) -> DataFrame:
    """Dual-clip PPO: loss, share of clipped tokens, share of tokens at the lower clip, mean KL."""
    a, r = F.col("advantage"), F.exp(log_ratio())
    first, second = -a * r, -a * clipped(r, low, high)
    upper = F.greatest(first, second)
    third = -a * dual
    lower = F.least(third, upper)
    t = df.withColumns(
        {
            "__l": F.when(a < 0, lower).otherwise(upper),
            "__clip": (second > first).cast("double"),
            "__low": F.when((upper > third) & (a < 0), 1.0).otherwise(0.0),
            "__kl": -log_ratio(),
        }
    )
    t = t.withColumn("__l", weighted(t, "__l"))
    return aggregate_loss(t, "__l", mode, also={"pg_clipfrac": "__clip", "ppo_kl": "__kl", "pg_clipfrac_lower": "__low"}, **agg)


def with_sequence(df: DataFrame, *aggregates: Column, seq: str = "seq_id") -> DataFrame:
    return df.join(df.groupBy(seq).agg(*aggregates), seq)


@register("gspo")
def gspo(df: DataFrame, low: float = 0.0003, high: float = 0.0004, **agg) -> DataFrame:
    """One ratio per sequence: the exponential of its mean log-ratio, at most e**10; averaged by sequences."""
    t = df.withColumn("__d", F.col("log_prob") - F.col("old_lp"))
    t = with_sequence(t, (M.m_sum("__d") / F.greatest(F.sum("mask"), F.lit(1).cast("long"))).alias("__s"))
    a, r = F.col("advantage"), F.exp(F.least(F.col("__s"), F.lit(10.0)))
    first, second = -a * r, -a * clipped(r, low, high)
    t = t.withColumns({"__l": F.greatest(first, second), "__clip": (second > first).cast("double"), "__kl": -F.col("__d")})
    t = t.withColumn("__l", weighted(t, "__l"))
    return aggregate_loss(t, "__l", "seq-mean-token-mean", also={"pg_clipfrac": "__clip", "ppo_kl": "__kl"}, **agg)


@register("sapo")
def sapo(df: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05, **agg) -> DataFrame:
    """A smooth gate (4 / tau) sigmoid(tau (r - 1)) in place of the clip; averaged by sequences."""
    tau = F.when(F.col("advantage") > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
    gate = 4.0 / tau / (1 + F.exp(-tau * (F.exp(log_ratio()) - 1)))
    t = df.withColumns({"__l": -gate * F.col("advantage"), "__kl": -log_ratio()})
    t = t.withColumn("__l", weighted(t, "__l"))
    return aggregate_loss(t, "__l", "seq-mean-token-mean", also={"ppo_kl": "__kl"}, **agg)


@register("gpg")
def gpg(df: DataFrame, mode: str = "token-mean", **agg) -> DataFrame:
    """-log-probability times advantage."""
    t = df.withColumn("__l", -F.col("log_prob") * F.col("advantage"))
    return aggregate_loss(t.withColumn("__l", weighted(t, "__l")), "__l", mode, **agg)


@register("cispo")
def cispo(df: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "token-mean", **agg) -> DataFrame:
    """Log-probabilities weighted by advantage and the clipped ratio."""
    r = F.exp(log_ratio())
    c = clipped(r, low, high)
    t = df.withColumns({"__l": -c * F.col("advantage") * F.col("log_prob"), "__clip": (r != c).cast("double"), "__kl": -log_ratio()})
    t = t.withColumn("__l", weighted(t, "__l"))
    return aggregate_loss(t, "__l", mode, also={"pg_clipfrac": "__clip", "ppo_kl": "__kl"}, **agg)


@register("geo_mean")
def geo_mean(df: DataFrame, low: float = 0.2, high: float = 0.2, **agg) -> DataFrame:
    """The geometric mean of ratios clamped by the sign of the advantage, per sequence; the mean over sequences, in every mode."""
    sign, d = F.signum("advantage"), F.col("log_prob") - F.col("old_lp")
    inside = M.clip(d, -low, high)
    held = sign * F.least(sign * d, sign * inside)
    t = df.withColumns(
        {
            "__h": held,
            "__kl": -d,
            "__up": ((d != inside) & (F.col("advantage") > 0)).cast("double"),
            "__low": ((d != inside) & (F.col("advantage") < 0)).cast("double"),
            "__w": F.log(F.col("is_weight") + 1e-10) if "is_weight" in df.columns else F.lit(0.0),
        }
    )
    n = F.sum("mask") + M.EPS
    also = {"pg_clipfrac": "__up", "ppo_kl": "__kl", "pg_clipfrac_lower": "__low"}
    rows = t.groupBy("seq_id").agg(
        F.exp(M.m_sum("__h") / n).alias("r"), (M.m_sum("advantage") / n).alias("a"), F.exp(M.m_sum("__w") / n).alias("w"), F.sum("mask").alias("n"),
        *[M.m_sum(c).alias(k) for k, c in also.items()],
    )
    means = [(F.sum(k) / (F.sum("n") + M.double(M.EPS))).alias(k) for k in also]
    return rows.agg(F.avg(-F.col("a") * F.col("r") * F.col("w")).alias("loss"), *means)


def covariance(df: DataFrame) -> DataFrame:
    """With ``cov``, (advantage - its masked mean) (log-probability - its masked mean), and ``__n``, the number of tokens of the mask."""
    t = M.with_totals(df, m_avg("advantage").alias("__ma"), m_avg("log_prob").alias("__ml"), F.coalesce(F.sum("mask"), F.lit(0)).cast("long").alias("__n"))
    return t.withColumn("cov", (F.col("advantage") - F.col("__ma")) * (F.col("log_prob") - F.col("__ml"))).drop("__ma", "__ml")


def m_avg(v: str, m: str = "mask") -> Column:
    return F.avg(F.when(F.col(m) != 0, F.col(v)))


def chosen(ratio: float) -> Column:
    """How many tokens: a share of those of the mask, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.col("__n") * F.lit(float(ratio))))


def read(df: DataFrame, tie: tuple[str, ...], agg: dict) -> DataFrame:
    """The columns that a loss by covariance reads, so that no others are written."""
    needed = {agg.get("seq", "seq_id"), agg.get("mask", "mask"), "mask", "old_lp", "log_prob", "advantage", *tie}
    return df.select(*[c for c in df.columns if c in needed])


@register("kl_cov")
def kl_cov(df: DataFrame, ratio: float = 0.0002, coefficient: float = 1.0, mode: str = "token-mean", tie: tuple[str, ...] = ("seq_id", "pos"), **agg) -> DataFrame:
    """A KL term on the tokens of greatest covariance, max(1, int(n ratio)) of the n tokens of the mask; those equal to 9 digits by ``tie``."""
    t = covariance(read(df, tie, agg))
    t = order.flag_first(t, -F.round("cov", 9), chosen(ratio), [F.col(c) for c in tie], "__top", F.col("mask") != 0, ["__n"])
    plain = -F.col("advantage") * F.exp(F.col("log_prob") - F.col("old_lp"))
    t = t.withColumn("__l", F.when(F.col("__top"), plain + coefficient * F.abs(F.col("log_prob") - F.col("old_lp"))).otherwise(plain))
    t = t.withColumn("__abs", F.abs(F.col("log_prob") - F.col("old_lp")))
    return aggregate_loss(t, "__l", mode, also={"ppo_kl": "__abs"}, **agg)


@register("clip_cov")
def clip_cov(df: DataFrame, ratio: float = 0.0002, bounds: tuple[float, float] = (1.0, 5.0), low: float = 0.2, high: float = 0.2,
             mode: str = "token-mean", seed: int = 0, tie: tuple[str, ...] = ("seq_id", "pos"), **agg) -> DataFrame:
    """PPO in which random tokens of covariance within ``bounds``, not clipped already, lose their gradient; seeded by their key."""
    t = covariance(read(df, tie, agg))
    a, r = F.col("advantage"), F.exp(F.col("log_prob") - F.col("old_lp"))
    first, second = -a * r, -a * clipped(r, low, high)
    t = t.withColumns({"__l": F.greatest(first, second), "__by": second > first})
    open_ = (F.col("mask") != 0) & ~F.col("__by") & (F.col("cov") > bounds[0]) & (F.col("cov") < bounds[1])
    key = seeded.order(seed, *tie)
    t = order.flag_first(t, seeded.unit(seed, *tie), chosen(ratio), [key, *map(F.col, tie)], "__out", open_, ["__n"])
    t = t.withColumn("__keep", F.when(F.col("__out"), 0.0).otherwise(1.0))
    t = t.withColumns({"__l": F.col("__l") * F.col("__keep"), "__clip": (F.col("__keep") == 0).cast("double")})
    return aggregate_loss(t, "__l", mode, also={"pg_clipfrac": "__clip"}, **agg)


@register("reinforce")
def reinforce(df: DataFrame, mode: str = "seq-mean-token-sum", **agg) -> DataFrame:
    """-log-probability times advantage, with importance weights where there are any, and the mean KL to the rollout policy."""
    t = df.withColumn("__l", -F.col("advantage") * F.col("log_prob"))
    t = t.withColumn("__l", weighted(t, "__l")).withColumn("__kl", F.col("rollout_lp") - F.col("log_prob"))
    return aggregate_loss(t, "__l", mode, also={"ppo_kl": "__kl"}, **agg)


@register("bypass_mode")
def bypass_mode(df: DataFrame, kind: str = "ppo_clip", correction: dict | None = None, **agg) -> DataFrame:
    """Old log-probabilities are the rollout's: weights and rejection against the current policy, then ``reinforce`` or ``ppo_clip``."""
    from rillflow.operators import offpolicy

    t = df.withColumn("old_lp", F.col("rollout_lp"))
    if correction:
        c = offpolicy.correct(t.withColumn("old_lp", F.col("log_prob")), **correction)
        t = c.withColumn("old_lp", F.col("rollout_lp"))
    if kind == "reinforce":
        return reinforce(t, **agg)
    if kind != "ppo_clip":
        raise ValueError(f"unknown kind {kind!r}")
    # The ratio to the rollout policy already holds the importance weight.
    return vanilla(t.drop("is_weight"), **agg)


def kl_estimate(logprob: Column, ref: Column, kind: str) -> Column:
    """k1 (``kl``), ``abs``, k2 (``mse``), k3 (``low_var_kl``); a trailing + keeps the forward value of its base."""
    d = logprob - ref
    base = kind.removesuffix("+")
    if base in ("kl", "k1"):
        return d
    if base == "abs":
        return F.abs(d)
    if base in ("mse", "k2"):
        return 0.5 * d * d
    if base in ("low_var_kl", "k3"):
        k = M.clip(ref - logprob, -20, 20)
        return M.clip(F.exp(k) - k - 1, -10, 10)
    if base == "full":
        raise NotImplementedError("the full KL needs all logits")
    raise ValueError(f"unknown estimator {kind!r}")


def entropy_loss(df: DataFrame, entropy: str = "entropy", mode: str = "token-mean", **agg) -> DataFrame:
    return aggregate_loss(df, entropy, mode, **agg)


def value_loss(df: DataFrame, clip: float = 0.5, mode: str = "token-mean", **agg) -> DataFrame:
    """Half the greater of the squared errors of predictions and of predictions clipped around the old values."""
    held = F.greatest(F.least(F.col("vpred"), F.col("value") + clip), F.col("value") - clip)
    first, second = F.pow(F.col("vpred") - F.col("ret"), 2.0), F.pow(held - F.col("ret"), 2.0)
    t = df.withColumns({"__l": 0.5 * F.greatest(first, second), "__clip": (second > first).cast("double")})
    return aggregate_loss(t, "__l", mode, also={"vf_clipfrac": "__clip"}, **agg)


def sft_loss(df: DataFrame, batch_tokens: int | None = None, dp_size: int = 1) -> DataFrame:
    """Negative log-likelihood over the tokens of the mask."""
    return aggregate_loss(df.withColumn("__l", -F.col("log_prob")), "__l", "token-mean", batch_tokens=batch_tokens, dp_size=dp_size)


def ppo_loss(df: DataFrame, policy: str = "vanilla", entropy_coefficient: float = 0.0, kl_coefficient: float = 0.0, kl: str = "low_var_kl", mode: str = "token-mean") -> DataFrame:
    """Policy loss less the entropy bonus plus the KL term (columns ``entropy`` and ``ref_lp`` where their coefficients are not 0)."""
    total = get(policy)(df, mode=mode) if policy not in ("gspo", "sapo", "geo_mean") else get(policy)(df)
    out = F.col("loss")
    if entropy_coefficient:
        total = total.crossJoin(entropy_loss(df, mode=mode).withColumnRenamed("loss", "entropy_loss"))
        out = out - entropy_coefficient * F.col("entropy_loss")
    if kl_coefficient:
        t = df.withColumn("__k", kl_estimate(F.col("log_prob"), F.col("ref_lp"), kl))
        total = total.crossJoin(aggregate_loss(t, "__k", mode).withColumnRenamed("loss", "kl_loss"))
        out = out + kl_coefficient * F.col("kl_loss")
    return total.withColumn("total_loss", out)


def log_sigmoid(x: Column) -> Column:
    """-ln(1 + exp(-x)), without overflow."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def online_dpo_loss(beta: float = 0.1, smoothing: float = 0.0, kind: str = "sigmoid", reference_free: bool = False) -> Column:
    """Per pair, over ``policy_chosen``, ``policy_rejected``, ``ref_chosen`` and ``ref_rejected`` log-probabilities."""
    ref = F.lit(0.0) if reference_free else F.col("ref_chosen") - F.col("ref_rejected")
    h = F.col("policy_chosen") - F.col("policy_rejected") - ref
    if kind == "sigmoid":
        return -log_sigmoid(beta * h) * (1 - smoothing) - log_sigmoid(-beta * h) * smoothing
    if kind == "ipo":
        return F.pow(h - 1 / (2 * beta), 2.0)
    raise ValueError(f"unknown loss {kind!r}")


def sequence_logprob(logprobs, labels, average: bool = False) -> Column:
    """Sum (or mean) of log-probabilities where the label is not -100."""
    keep = F.transform(F.col(labels), lambda x: (x != -100).cast("int"))
    total = M.masked_sum(logprobs, keep)
    return total / M.mask_count(keep) if average else total


def ce_dpo_loss(df: DataFrame, beta: float = 0.05) -> DataFrame:
    """Binary cross-entropy of sigmoid(beta sum of token scores) against ``acc``."""
    z = beta * F.col("score")
    return df.agg(F.avg(-(F.col("acc") * log_sigmoid(z) + (1 - F.col("acc")) * log_sigmoid(-z))).alias("loss"))


def detached_dpo_loss(df: DataFrame, beta: float = 0.05, best_of_n: str = "none", group: str = "uid") -> DataFrame:
    """Each rollout's ``score`` against the mean ``q`` of those of its prompt with a lower ``acc`` (a higher one, for an ``acc`` of 0), held fixed.

    Pairs are never formed: a prompt has one row per distinct ``acc`` (and ``q``) from which running sums come.
    ``best_of_n`` (``bon_acc``, ``bon_rm``) weighs a rollout by n times its chance of being the best of n, and sums up.
    """
    from pyspark.sql.window import Window

    sides = df.groupBy(F.col(group).alias("__g"), F.col("acc").alias("__a")).agg(F.sum("q").alias("__q"), F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__g").orderBy("__a")
    below, above, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("__g")
    sides = sides.select(
        "__g", "__a",
        F.try_divide(F.sum("__q").over(below), F.sum("__c").over(below)).alias("__lower"),
        F.try_divide(F.sum("__q").over(above), F.sum("__c").over(above)).alias("__higher"),
        (F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("__c").over(whole)).alias("__upto"),
        F.sum("__c").over(whole).alias("__n"),
    )
    t = df.join(sides, F.col(group).eqNullSafe(F.col("__g")) & F.col("acc").eqNullSafe(F.col("__a")))
    right = F.col("acc") > 0
    other = F.coalesce(F.when(right, F.col("__lower")).otherwise(F.col("__higher")), F.lit(0.0))
    loss = -log_sigmoid(beta * (F.col("score") - other) * F.when(right, 1.0).otherwise(-1.0))
    if best_of_n == "none":
        return t.agg(F.avg(loss).alias("loss"))
    if best_of_n not in ("bon_acc", "bon_rm"):
        raise ValueError(f"unknown mode {best_of_n!r}")
    if best_of_n == "bon_rm":
        ranks = df.groupBy(F.col(group).alias("__h"), F.col("score").alias("__s")).agg(F.count(F.lit(1)).alias("__k"))
        v = Window.partitionBy("__h").orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
        ranks = ranks.select("__h", "__s", F.sum("__k").over(v).alias("__r"))
        t = t.join(ranks, F.col(group).eqNullSafe(F.col("__h")) & (F.col("score") == F.col("__s")))
        t = t.withColumn("__upto", F.col("__r") / F.col("__n"))
    n = F.col("__n").cast("double")
    return t.agg(F.sum(loss * n * F.pow("__upto", n - 1)).alias("loss"))


def sppo_loss(df: DataFrame, eta: float = 1.0) -> DataFrame:
    """Squares of (sequence log-ratio - eta reward), averaged over sequences that have a token."""
    t = df.withColumn("__d", F.col("log_prob") - F.col("old_lp"))
    rows = t.groupBy("seq_id").agg(M.m_sum("__d").alias("r"), F.max("reward").alias("w"), (F.sum("mask") > 0).cast("int").alias("mask"))
    rows = rows.withColumn("l", F.pow(F.col("r") - eta * F.col("w"), 2.0))
    return rows.agg(M.m_mean("l").alias("loss"))


def flowrl_loss(df: DataFrame, coefficient: float = 15.0, bound: float = 10.0) -> DataFrame:
    """Trajectory balance: squares of log Z + mean log p - coefficient mean reward - mean log p_ref, weighted by the ratio, ``bound`` at most."""
    t = df.withColumn("__d", F.col("log_prob") - F.col("old_lp"))
    n = F.sum("mask") + M.EPS
    rows = t.groupBy("seq_id").agg(
        (M.m_sum("log_prob") / n).alias("p"), (M.m_sum("ref_lp") / n).alias("ref"), (M.m_sum("reward") / n).alias("w"),
        F.max("log_z").alias("z"), M.m_sum("__d").alias("d"),
    )
    delta = F.col("z") + F.col("p") - coefficient * F.col("w") - F.col("ref")
    return rows.agg(F.avg(F.least(F.exp("d"), F.lit(bound)) * delta * delta).alias("loss"))


def topk_kl(teacher, student) -> Column:
    """Sum over the teacher's top tokens of p (log p - log(q + 1e-20)), both given as arrays of log-probabilities."""
    return M.array_sum(F.zip_with(teacher, student, lambda t, s: F.exp(t) * (t - F.log(F.exp(s) + F.lit(1e-20)))))
