"""Advantage and return estimators: a registry of functions from sequences to sequences with ``advantages`` and ``returns``.

Input rows are sequences: ``uid`` (the prompt), ``rewards`` and ``mask`` arrays, and what an estimator
names besides. Group statistics are aggregates joined back by ``uid``: partial sums before the shuffle,
and a join that adaptive execution splits if one prompt has very many rollouts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import masked as M
from rillflow.functions import seeded
from rillflow.operators import scans

Estimator = Callable[..., DataFrame]
_estimators: dict[str, Estimator] = {}


def register(name: str) -> Callable[[Estimator], Estimator]:
    """Register an estimator; another function under a taken name raises."""

    def put(f: Estimator) -> Estimator:
        if _estimators.get(name, f) is not f:
            raise ValueError(f"estimator {name!r} is registered already")
        _estimators[name] = f
        return f

    return put


def get(name: str) -> Estimator:
    if name not in _estimators:
        raise ValueError(f"unknown estimator {name!r}; there are {', '.join(sorted(_estimators))}")
    return _estimators[name]


def names() -> list[str]:
    return sorted(_estimators)


def compute(df: DataFrame, estimator: str, **options) -> DataFrame:
    return get(estimator)(df, **options)


def compute_by(df: DataFrame, estimator: str, **options) -> DataFrame:
    """Each row by the estimator that the column ``estimator`` names: (all columns, advantages, returns).

    Estimators are as many as are registered, so that the plan is a union of that many at most; a name that is not registered raises.
    """
    asked = sorted(r[0] or "null" for r in df.select(estimator).distinct().collect())
    parts = [get(n)(df.where(F.coalesce(F.col(estimator), F.lit("null")) == n), **options.get(n, {})).select(*df.columns, "advantages", "returns") for n in asked]
    out = parts[0] if parts else df.withColumns({"advantages": F.array().cast("array<double>"), "returns": F.array().cast("array<double>")})
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scored(df: DataFrame) -> DataFrame:
    """With ``score``, the sum of the rewards."""
    return df.withColumn("score", M.array_sum("rewards"))


def with_group(df: DataFrame, *aggregates: Column, key: str = "uid") -> DataFrame:
    """With aggregates of the rows of the same key; null keys are one group."""
    stats = df.groupBy(F.col(key).alias("__key")).agg(*aggregates)
    return df.join(stats.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def size() -> Column:
    return F.count(F.lit(1)).alias("__n")


def mean_score() -> Column:
    return F.avg("score").alias("__mean")


def std_score() -> Column:
    return F.stddev_samp("score").alias("__std")


def over_tokens(df: DataFrame, value: Column) -> DataFrame:
    """The sequence's value at every token that the mask keeps, as advantages and as returns."""
    spread = F.transform("mask", lambda m: F.col("__value") * m)
    out = df.withColumn("__value", value).withColumns({"advantages": spread, "returns": spread})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@register("grpo")
def grpo(df: DataFrame, by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """(score - mean) / (sample std + eps) within the prompt; a lone rollout has mean 0 and std 1."""
    g = with_group(scored(df), size(), mean_score(), std_score())
    lone = F.col("__n") == 1
    mean = F.when(lone, 0.0).otherwise(F.col("__mean"))
    std = F.when(lone, 1.0).otherwise(F.col("__std"))
    centred = F.col("score") - mean
    return over_tokens(g, centred / (std + eps) if by_std else centred)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """As ``grpo`` with the root of max(variance, eps) as the deviation."""
    g = with_group(scored(df), size(), mean_score(), F.var_samp("score").alias("__var"))
    lone = F.col("__n") == 1
    std = F.when(lone, 1.0).otherwise(F.sqrt(F.greatest(F.col("__var"), F.lit(eps))))
    centred = F.col("score") - F.when(lone, 0.0).otherwise(F.col("__mean"))
    return over_tokens(g, centred / (std + eps) if by_std else centred)


@register("grpo_passk")
def grpo_passk(df: DataFrame, by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """Only the best rollout of a prompt counts, by its lead over the second; a tie leads by nothing. Lone rollouts raise."""
    top = with_group(scored(df), size(), std_score(), F.max("score").alias("__top"))
    first = F.col("score") == F.col("__top")
    both = with_group(top, F.sum(first.cast("int")).alias("__firsts"), F.max(F.when(~first, F.col("score"))).alias("__second"))
    lead = F.when(first & (F.col("__firsts") == 1), F.col("__top") - F.col("__second")).otherwise(0.0)
    value = lead / (F.col("__std") + eps) if by_std else lead
    alone = F.raise_error(F.lit("a prompt needs two rollouts at least")).cast("double")
    return over_tokens(both, F.when(F.col("__n") < 2, alone).otherwise(value))


@register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """n / (n - 1) times the score less the mean; a lone rollout keeps its score."""
    g = with_group(scored(df), size(), mean_score())
    n = F.col("__n").cast("double")
    return over_tokens(g, F.when(n > 1, n / F.greatest(n - 1, F.lit(1.0)) * (F.col("score") - F.col("__mean"))).otherwise(F.col("score")))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """(n score - sum) / max(n - 1, 1), and 0 for a lone rollout."""
    g = with_group(scored(df), size(), F.sum("score").alias("__sum"))
    n = F.col("__n").cast("double")
    return over_tokens(g, F.when(n > 1, (n * F.col("score") - F.col("__sum")) / F.greatest(n - 1, F.lit(1.0))).otherwise(0.0))


@register("opo")
def opo(df: DataFrame) -> DataFrame:
    """Score less the mean of scores weighted by response length; a lone rollout has baseline 0."""
    with_len = scored(df).withColumn("__len", M.mask_count("mask").cast("double"))
    g = with_group(with_len, size(), F.sum(F.col("__len") * F.col("score")).alias("__ls"), F.sum("__len").alias("__ll"))
    base = F.when(F.col("__n") == 1, 0.0).otherwise(F.try_divide("__ls", "__ll"))
    return over_tokens(g, F.col("score") - base)


@register("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha (score - mean) / f_norm, alpha being rows over rows of other scores than 0 (1 at least)."""
    g = with_group(scored(df), size(), mean_score())
    g = M.with_totals(g, F.count(F.lit(1)).alias("__rows"), F.sum((F.col("score") != 0).cast("int")).alias("__nonzero"))
    alpha = F.col("__rows") / F.greatest(F.col("__nonzero"), F.lit(1).cast("long")).cast("double")
    mean = F.when(F.col("__n") == 1, 0.0).otherwise(F.col("__mean"))
    return over_tokens(g, alpha * (F.col("score") - mean) / f_norm)


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame, seq: str = "seq_id") -> DataFrame:
    """Score less the prompt's mean (0 for a lone rollout), at every token, then whitened over the batch's tokens.

    The batch-wide moments come from one row per sequence: its value and its number of tokens.
    """
    g = with_group(scored(df), size(), mean_score()).withColumn("__len", M.mask_count("mask").cast("double"))
    g = g.withColumn("__v", F.col("score") - F.when(F.col("__n") == 1, 0.0).otherwise(F.col("__mean")))
    total = F.sum("__len").alias("__t")
    g = M.with_totals(g, total, (F.sum(F.col("__v") * F.col("__len")) / (F.sum("__len") + M.EPS)).alias("__mu"))
    g = M.with_totals(g, (F.sum(F.pow(F.col("__v") - F.col("__mu"), 2.0) * F.col("__len")) / (F.sum("__len") + M.EPS)).alias("__var"))
    return over_tokens(g, (F.col("__v") - F.col("__mu")) / F.sqrt(F.col("__var") * F.col("__t") / (F.col("__t") - 1) + M.EPS))


def whiten_arrays(df: DataFrame, column: str) -> DataFrame:
    """The array column whitened over all masked tokens of all rows, and zeroed under the mask."""
    sums = df.select(
        M.masked_sum(column, "mask").alias("s"), M.masked_sum(F.transform(column, lambda x: x * x), "mask").alias("q"), M.mask_count("mask").cast("double").alias("n")
    )
    # Centred second moment in a second pass, as sums of squares would cancel.
    mean = sums.agg((F.sum("s") / (F.sum("n") + M.EPS)).alias("__mu"), F.sum("n").alias("__t"))
    g = df.crossJoin(F.broadcast(mean))
    g = g.withColumn("__sq", M.masked_sum(F.transform(column, lambda x: F.pow(x - F.col("__mu"), 2.0)), "mask"))
    g = M.with_totals(g, F.sum("__sq").alias("__ss"))
    var = F.col("__ss") / (F.col("__t") + M.EPS) * F.col("__t") / (F.col("__t") - 1)
    white = F.zip_with(column, "mask", lambda x, m: (x - F.col("__mu")) / F.sqrt(F.col("__var") + M.EPS) * m)
    return g.withColumn("__var", var).withColumn(column, white).drop("__mu", "__t", "__sq", "__ss", "__var")


@register("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Generalised advantage estimation; returns are advantages before whitening plus values."""
    raw = df.withColumn("advantages", M.gae("rewards", "values", "mask", gamma, lam))
    raw = raw.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v))
    return whiten_arrays(raw, "advantages")


@register("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted returns that masked tokens cut off, whitened into advantages."""
    raw = df.withColumn("returns", M.discounted_returns("rewards", "mask", gamma))
    return whiten_arrays(raw.withColumn("advantages", F.col("returns")), "advantages")


@register("remax")
def remax(df: DataFrame, baseline: str = "reward_baseline") -> DataFrame:
    """Sums of the masked rewards to come, less the baseline of the greedy rollout."""
    returns = M.reverse_cumsum(M.masked_values("rewards", "mask"))
    out = df.withColumn("returns", returns)
    return out.withColumn("advantages", F.zip_with("returns", "mask", lambda g, m: g - F.col(baseline) * m))


def leave_one_out(column: str, scale: str, base: str, weight: float) -> Column:
    return F.transform(column, lambda x: (x * F.col(scale) - F.col(base)) * weight)


@register("prime_rloo")
def prime_rloo(df: DataFrame, streams: tuple[tuple, ...] = (("rewards", 1.0),), whitened: bool = True) -> DataFrame:
    """Leave-one-out baselines on masked means per sequence, for several streams (column, weight[, mask column]) of token rewards.

    Where a stream's own mask (the response's by default) is on, its rewards are scaled by n / (n - 1) and lose the sum of the
    means over n - 1; elsewhere they are 0. Streams are summed up with their weights; returns are what is still to come,
    advantages the whitened returns. Lone rollouts have no others and keep their rewards.
    """
    g, parts = df, []
    for i, (column, weight, *own) in enumerate(streams):
        mask = own[0] if own else "mask"
        count = F.greatest(M.mask_count(mask), F.lit(1).cast("long"))
        g = g.withColumn(f"__m{i}", M.masked_sum(column, mask) / count)
        g = with_group(g, F.sum(f"__m{i}").alias(f"__s{i}"), F.count(F.lit(1)).alias(f"__n{i}"))
        n = F.col(f"__n{i}").cast("double")
        scale = F.when(n > 1, n / F.greatest(n - 1, F.lit(1.0))).otherwise(1.0)
        base = F.when(n > 1, F.col(f"__s{i}") / F.greatest(n - 1, F.lit(1.0))).otherwise(0.0)
        g = g.withColumns({f"__k{i}": scale, f"__b{i}": base})
        parts.append(M.masked_values(leave_one_out(column, f"__k{i}", f"__b{i}", weight), mask))
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    g = g.withColumn("returns", M.reverse_cumsum(M.masked_values(total, "mask")))
    g = g.withColumn("advantages", F.col("returns"))
    g = g.drop(*[c for c in g.columns if c.startswith("__")])
    return whiten_arrays(g, "advantages") if whitened else g


@register("sppo_softmean")
def sppo_softmean(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """Score less the soft mean (logsumexp(beta score) - ln n) / beta of the whole batch; beta 0 is the mean."""
    s = scored(df)
    if beta == 0:
        g = M.with_totals(s, F.avg("score").alias("__base"))
    else:
        g = M.with_totals(s, F.max(F.col("score") * beta).alias("__top"))
        g = M.with_totals(g, ((F.max("__top") + F.log(F.sum(F.exp(F.col("score") * beta - F.col("__top")))) - F.log(F.count(F.lit(1)).cast("double"))) / beta).alias("__base"))
    return over_tokens(g, F.col("score") - F.col("__base"))


def preferred(df: DataFrame, pair: str, order: str) -> DataFrame:
    """With ``chosen``: the row of the greatest score of its pair; of a tie, the first by ``order``."""
    s = scored(df)
    best = s.groupBy(F.col(pair).alias("__p")).agg(F.max_by(F.col(order), F.struct(F.col("score"), -F.col(order))).alias("__best"))
    return s.join(best, F.col(pair).eqNullSafe(F.col("__p"))).withColumn("chosen", F.col(order) == F.col("__best")).drop("__p", "__best")


def reward_minus_kl(score: str, old: str, ref: str, ratio: float) -> Column:
    """Token scores less ratio (old - ref)."""
    kl = F.zip_with(old, ref, lambda a, b: a - b)
    return F.zip_with(score, kl, lambda s, k: s - k * ratio)


class FixedKl:
    """A coefficient that stays."""

    def __init__(self, value: float):
        self.value = value

    def update(self, kl: float, n: int) -> None:
        pass


class AdaptiveKl:
    """A coefficient that is multiplied by 1 + clip(kl / target - 1, -0.2, 0.2) n / horizon."""

    def __init__(self, value: float, target: float, horizon: int):
        self.value, self.target, self.horizon = value, target, horizon

    def update(self, kl: float, n: int) -> None:
        self.value *= 1 + min(max(kl / self.target - 1, -0.2), 0.2) * n / self.horizon


def kl_controller(kind: str, value: float, target: float = 0.1, horizon: int = 10_000):
    if kind == "fixed":
        return FixedKl(value)
    if kind == "adaptive":
        if horizon <= 0:
            raise ValueError("the horizon must be over 0")
        return AdaptiveKl(value, target, horizon)
    raise ValueError(f"unknown controller {kind!r}")


def adaptive_kl_trace(df: DataFrame, key: str, order: str, value: float, target: float, horizon: int) -> DataFrame:
    """The coefficient after all updates (columns ``kl``, ``n``) of each key, in the order of ``order``."""
    steps = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "kl", "n"))).alias("x"))
    turn = lambda v, x: v * (1 + M.clip(x["kl"] / target - 1, -0.2, 0.2) * x["n"] / horizon)
    return steps.select(key, F.aggregate("x", M.double(value), turn).alias("kl_coefficient"))


def apply_kl_penalty(df: DataFrame, coefficient: float, penalty: str = "kl") -> tuple[DataFrame, Column]:
    """(rewards = scores - coefficient KL, the batch's KL: the mean over sequences of masked means)."""
    from rillflow.operators.losses import kl_estimate

    kld = F.zip_with("old_lp", "ref_lp", lambda a, b: kl_estimate(a, b, penalty))
    out = df.withColumn("__kl", M.masked_values(kld, "mask"))
    out = out.withColumn("rewards", F.zip_with("scores", "__kl", lambda s, k: s - k * coefficient))
    return out.withColumn("kl", M.masked_mean("__kl", "mask")).drop("__kl"), F.avg("kl").alias("reward_kl_penalty")


def resample(df: DataFrame, weight: Column, draws: int, seed: int, order: str) -> DataFrame:
    """``draws`` rows with replacement, with chances that go with ``weight`` + 1e-8: column ``draw`` from 0.

    Cumulative weights are cut into as many bins as there are draws, so that each draw is an equi-join
    with the rows of its bin and a comparison, never a join of all with all.
    """
    from rillflow.operators.batch import running_total

    w = running_total(df.withColumn("__w", weight + 1e-8), "__w", [order])
    total = w.agg(F.max("__upto").alias("__all"))
    w = w.crossJoin(F.broadcast(total)).withColumn("__low", (F.col("__upto") - F.col("__w")) / F.col("__all")).withColumn("__high", F.col("__upto") / F.col("__all"))
    bins = F.sequence(F.floor(F.col("__low") * draws), F.least(F.floor(F.col("__high") * draws), F.lit(draws - 1)))
    w = w.withColumn("__bin", F.explode(bins))
    spark = df.sparkSession
    d = spark.range(draws).select(F.col("id").alias("draw"), seeded.unit(seed, "id").alias("__u")).withColumn("__bin", F.floor(F.col("__u") * draws))
    hit = (F.col("__u") >= F.col("__low")) & (F.col("__u") < F.col("__high"))
    return w.join(d, "__bin").where(hit).drop("__bin", "__u", "__low", "__high", "__all", "__upto", "__w")


def pf_ppo_weights(df: DataFrame, method: str = "pow", power: float = 2.0) -> Column:
    """Chances of rows by their scores: ``pow``, ``max_min`` (only the extremes) or ``max_random`` (0.4 for the best, 0.1 for others)."""
    s = F.abs(F.col("score"))
    if method == "pow":
        return F.pow(s, F.lit(power))
    if method == "max_min":
        return ((F.col("score") == F.col("__max")) | (F.col("score") == F.col("__min"))).cast("double")
    if method == "max_random":
        return F.when(F.col("score") == F.col("__max"), 0.4).otherwise(0.1)
    raise ValueError(f"unknown method {method!r}")


# ---------------------------------------------------------------- long form: sequences of any length


def _whitened(df: DataFrame, value: str) -> DataFrame:
    return M.whiten(df, value, out="advantages").withColumn("advantages", F.col("advantages") * F.col("mask"))


def gae_tokens(df: DataFrame, gamma: float = 1.0, lam: float = 1.0, key: str = "seq_id", at: str = "pos") -> DataFrame:
    """Long form of ``gae``: a row per token (``reward``, ``value``, ``mask``) gets ``advantages`` and ``returns``.

    From the right, (next value, advantage) goes through an affine map per token of the mask and unchanged through
    the others, so that no sequence has to fit one array or one task.
    """
    on = F.col("mask") != 0
    numbers = [0.0, 0.0, gamma, gamma * lam]
    maps = [F.when(on, M.double(x)) for x in numbers] + [F.when(on, F.col("value")), F.when(on, F.col("reward") - F.col("value"))]
    raw = scans.scan(df, [key], [F.col(at).desc()], scans.Affine(2), maps, [0.0, 0.0], ["__next", "__a"]).drop("__next")
    return _whitened(raw.withColumn("returns", F.col("__a") + F.col("value")), "__a").drop("__a")


def reinforce_plus_plus_tokens(df: DataFrame, gamma: float = 1.0, key: str = "seq_id", at: str = "pos") -> DataFrame:
    """Long form of ``reinforce_plus_plus``: discounted returns that masked tokens cut off, whitened into advantages."""
    keep = F.col("mask").cast("double")
    to_come = scans.scan(df, [key], [F.col(at).desc()], scans.Affine(), [keep * gamma, keep * F.col("reward")], [0.0], ["__later"], before=True)
    return _whitened(to_come.withColumn("returns", F.col("reward") + M.double(gamma) * F.col("__later")).drop("__later"), "returns")


def to_come(df: DataFrame, value: Column, out: str = "returns", key: str = "seq_id", at: str = "pos") -> DataFrame:
    """Long form of sums of each token's value and all that follow in its sequence."""
    return scans.running_sums(df, [key], [F.col(at).desc()], {out: value})


def remax_tokens(df: DataFrame, baseline: str = "reward_baseline", key: str = "seq_id", at: str = "pos") -> DataFrame:
    """Long form of ``remax``."""
    out = to_come(df, F.when(F.col("mask") != 0, F.col("reward") * F.col("mask")), key=key, at=at)
    return out.withColumn("advantages", F.col("returns") - F.col(baseline) * F.col("mask"))


def prime_rloo_tokens(df: DataFrame, column: str = "reward", weight: float = 1.0, whitened: bool = True, key: str = "seq_id", at: str = "pos", uid: str = "uid") -> DataFrame:
    """Long form of ``prime_rloo`` for one stream of token rewards: leave-one-out baselines on masked means per sequence."""
    own = df.groupBy(F.col(uid).alias("__u"), F.col(key).alias("__k")).agg((M.m_sum(column) / F.greatest(F.sum("mask"), F.lit(1))).alias("__m"))
    stats = own.groupBy("__u").agg(F.sum("__m").alias("__s"), F.count(F.lit(1)).cast("double").alias("__n"))
    g = df.join(stats, F.col(uid).eqNullSafe(F.col("__u"))).drop("__u")
    some, others = F.col("__n") > 1, F.greatest(F.col("__n") - 1, F.lit(1.0))
    scaled = (F.col(column) * F.when(some, F.col("__n") / others).otherwise(1.0) - F.when(some, F.col("__s") / others).otherwise(0.0)) * weight
    out = to_come(g, F.when(F.col("mask") != 0, scaled * F.col("mask")), key=key, at=at).drop("__s", "__n")
    return _whitened(out, "returns") if whitened else out.withColumn("advantages", F.col("returns"))
