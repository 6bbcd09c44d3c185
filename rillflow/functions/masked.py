"""Masked token numerics: array kernels without shuffles, and batch-wide statistics in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import seeded

EPS = 1e-8


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double(x: float) -> Column:
    return F.lit(float(x))


# ---------------------------------------------------------------- arrays: one row is one sequence


def masked_values(v, m) -> Column:
    """Values where the mask is not 0, 0 elsewhere: what lies under the mask, NaN too, never counts."""
    return F.zip_with(_col(v), _col(m), lambda x, k: F.when(k != 0, x * k).otherwise(double(0)))


def array_sum(v) -> Column:
    return F.aggregate(_col(v), double(0), lambda a, x: a + x)


def masked_sum(v, m) -> Column:
    return array_sum(masked_values(v, m))


def mask_count(m) -> Column:
    return F.aggregate(_col(m), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def masked_mean(v, m) -> Column:
    """Sum over the mask divided by its count plus 1e-8."""
    return masked_sum(v, m) / (mask_count(m) + double(EPS))


def clip(x, low, high) -> Column:
    """Clamp; NaN stays NaN."""
    x = _col(x)
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.least(x, double(high)), double(low)))


def logsumexp(logits) -> Column:
    top = F.array_max(_col(logits))
    return top + F.log(F.aggregate(_col(logits), double(0), lambda a, x: a + F.exp(x - top)))


def entropy_from_logits(logits) -> Column:
    """logsumexp minus the mean of logits under their own softmax."""
    lse = logsumexp(logits)
    return lse - F.aggregate(_col(logits), double(0), lambda a, x: a + F.exp(x - lse) * x)


def logprob_from_logits(logits, label, temperature: float = 1.0) -> Column:
    """Log-probability of the label (0-based) under the softmax of ``logits / temperature``."""
    scaled = F.transform(_col(logits), lambda x: x / double(temperature))
    return F.get(scaled, _col(label)) - logsumexp(scaled)


def response_mask(tokens, eos: int | list[int]) -> Column:
    """1 up to and including the first end token, 0 after it; all 1 where there is none."""
    ends = eos if isinstance(eos, list) else [eos]
    at = [F.nullif(F.array_position(_col(tokens), e), F.lit(0)) for e in ends]
    first = F.coalesce(F.least(*at) if len(at) > 1 else at[0], F.size(_col(tokens)).cast("long"))
    return F.transform(_col(tokens), lambda x, i: (i < first).cast("int"))


def tail_mask(attention, response) -> Column:
    """The last entries of the attention mask, as many as the response has."""
    n = F.size(_col(response))
    return F.when(n > 0, F.slice(_col(attention), -F.greatest(n, F.lit(1)), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def position_ids(mask) -> Column:
    """Running count of the mask minus one, at least 0."""
    return F.transform(
        F.sequence(F.lit(1), F.size(_col(mask))), lambda i: F.greatest(mask_count(F.slice(_col(mask), 1, i)) - 1, F.lit(0).cast("long"))
    )


def reverse_cumsum(v) -> Column:
    """Sums of each value and all that follow."""
    return reverse_scan(v, lambda carry, x: carry + x)


def reverse_scan(v, step) -> Column:
    """Fold from the right, keeping every intermediate value, in the order of the input. Quadratic only in the copying of the output."""
    start = F.struct(double(0).alias("c"), F.array().cast("array<double>").alias("o"))

    def turn(a: Column, x: Column) -> Column:
        c = step(a["c"], x)
        return F.struct(c.alias("c"), F.concat(F.array(c), a["o"]).alias("o"))

    return F.aggregate(F.reverse(_col(v)), start, turn, lambda a: a["o"])


def discounted_returns(rewards, mask, gamma: float = 1.0) -> Column:
    """G = r + gamma G', set to 0 behind a masked token once it is written."""
    start = F.struct(double(0).alias("c"), F.array().cast("array<double>").alias("o"))

    def turn(a: Column, x: Column) -> Column:
        g = x["r"] + double(gamma) * a["c"]
        return F.struct((g * x["m"]).alias("c"), F.concat(F.array(g), a["o"]).alias("o"))

    pairs = F.zip_with(_col(rewards), _col(mask), lambda r, m: F.struct(r.alias("r"), m.alias("m")))
    return F.aggregate(F.reverse(pairs), start, turn, lambda a: a["o"])


def gae(rewards, values, mask, gamma: float = 1.0, lam: float = 1.0) -> Column:
    """Generalised advantages before whitening; next value and advantage pass masked tokens unchanged."""
    zero = F.struct(double(0).alias("v"), double(0).alias("a"), F.array().cast("array<double>").alias("o"))

    def turn(s: Column, x: Column) -> Column:
        a = x["r"] + double(gamma) * s["v"] - x["v"] + double(gamma * lam) * s["a"]
        nv = F.when(x["m"] != 0, x["v"]).otherwise(s["v"])
        na = F.when(x["m"] != 0, a).otherwise(s["a"])
        return F.struct(nv.alias("v"), na.alias("a"), F.concat(F.array(na), s["o"]).alias("o"))

    both = F.zip_with(_col(rewards), _col(values), lambda r, v: F.struct(r.alias("r"), v.alias("v")))
    rows = F.zip_with(both, _col(mask), lambda rv, m: F.struct(rv["r"].alias("r"), rv["v"].alias("v"), m.alias("m")))
    return F.aggregate(F.reverse(rows), zero, turn, lambda s: s["o"])


def pad(v, length: int, value, left: bool = False) -> Column:
    """Filled up to ``length`` with ``value``; longer arrays stay."""
    fill = F.array_repeat(value if isinstance(value, Column) else F.lit(value), F.greatest(F.lit(length) - F.size(_col(v)), F.lit(0)))
    return F.concat(fill, _col(v)) if left else F.concat(_col(v), fill)


def unpad(v, mask) -> Column:
    """The values whose mask is not 0."""
    return F.filter(_col(v), lambda x, i: F.get(_col(mask), i) != 0)


def truncate(v, length: int, side: str = "error") -> Column:
    """At most ``length`` entries: ``left`` keeps the tail, ``right`` the head, ``middle`` both ends, ``error`` raises."""
    v, n = _col(v), F.size(_col(v))
    half = length // 2
    short = {
        "left": lambda: F.slice(v, F.greatest(n - length + 1, F.lit(1)), length),
        "right": lambda: F.slice(v, 1, length),
        "middle": lambda: F.concat(F.slice(v, 1, half), F.slice(v, F.greatest(n - (length - half) + 1, F.lit(1)), length - half)),
        "error": lambda: F.raise_error(F.concat(F.lit("longer than "), F.lit(str(length)), F.lit(": "), n.cast("string"))).cast("array<bigint>"),
    }
    if side not in short:
        raise ValueError(f"unknown side {side!r}")
    return F.when(n <= length, v).otherwise(short[side]())


def place_last(score, mask) -> Column:
    """Zeros, with ``score`` at the last place whose mask is 1; all zeros where there is none."""
    n = F.size(_col(mask))
    back = F.array_position(F.reverse(_col(mask)), 1)
    return F.transform(_col(mask), lambda m, i: F.when((back > 0) & (i == n - back), _col(score).cast("double")).otherwise(double(0)))


def completion_mask(complete, repeat: int = 1) -> Column:
    """1 through the first true entry, all 1 without one; each entry ``repeat`` times."""
    first = F.nullif(F.array_position(_col(complete), True), F.lit(0))
    ones = F.transform(_col(complete), lambda c, i: (i < F.coalesce(first, F.size(_col(complete)).cast("long"))).cast("int"))
    return F.flatten(F.transform(ones, lambda x: F.array_repeat(x, repeat)))


def random_mask(key: Column, length: int, valid: tuple[float, float] = (0.1, 0.8), left: float = 0.2, seed: int = 0) -> Column:
    """A mask with random padding on both sides, for tests: the share of valid places within ``valid``, at most ``left`` of it before them."""
    u = lambda i: seeded.unit(seed, key, F.lit(i))
    start = F.floor(u(1) * left * length)
    n = F.floor((u(2) * (valid[1] - valid[0]) + valid[0]) * length)
    # A lambda would draw both numbers at every place.
    before, ones = F.least(start, F.lit(length)), F.least(n, length - F.least(start, F.lit(length)))
    parts = [F.array_repeat(F.lit(value), F.greatest(k, F.lit(0)).cast("int")) for value, k in ((0, before), (1, ones), (0, length - before - ones))]
    return F.concat(*parts)


# ---------------------------------------------------------------- long form: one row is one token


def with_totals(df: DataFrame, *aggregates: Column) -> DataFrame:
    """``df`` with the given aggregates of all its rows: one broadcast row, no window over everything."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


def to_long(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """One row per place of the (equally long) arrays: keys, ``pos`` from 0, and their entries."""
    zipped = F.arrays_zip(*arrays)
    return df.select(*keys, F.posexplode(zipped).alias("pos", "x")).select(*keys, "pos", *[F.col(f"x.{a}").alias(a) for a in arrays])


def to_arrays(df: DataFrame, keys: list[str], columns: list[str], order: str = "pos") -> DataFrame:
    """The inverse: entries of each key in the order of ``order``."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("x"))
    return rows.select(*keys, *[F.col(f"x.{c}").alias(c) for c in columns])


def m_sum(v: str, m: str = "mask") -> Column:
    return F.sum(F.when(F.col(m) != 0, F.col(v) * F.col(m)).otherwise(double(0)))


def m_mean(v: str, m: str = "mask") -> Column:
    return m_sum(v, m) / (F.sum(m) + double(EPS))


def masked_var(df: DataFrame, value: str, mask: str = "mask", unbiased: bool = True) -> DataFrame:
    """One row (mean, var): the masked mean, and the variance about it over the mask's places, by n - 1 where ``unbiased``.

    Raises at run time where the mask has no place, or with ``unbiased`` fewer than two.
    """
    centred = with_totals(df, m_mean(value, mask).alias("__mean"), F.sum(mask).alias("__n"))
    centred = centred.withColumn("__sq", F.pow(F.col(value) - F.col("__mean"), 2.0))
    found = centred.agg(F.first("__mean").alias("mean"), m_mean("__sq", mask).alias("var"), F.first("__n").cast("double").alias("n"))
    least = 1 if unbiased else 0
    n = F.when(F.col("n") > least, F.col("n")).otherwise(F.raise_error(F.lit(f"the mask has {least} places or fewer")).cast("double"))
    return found.select("mean", (F.col("var") * n / (n - 1) if unbiased else F.when(n > 0, F.col("var"))).alias("var"))


def batch_stats(df: DataFrame, value: str, mask: str | None = None) -> DataFrame:
    """One row (mean, max, min, std): of all values, or of those under the mask; the deviation by n - 1. Partial results meet once."""
    v = F.col(value) if mask is None else F.when(F.col(mask) != 0, F.col(value))
    return df.agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_samp(v).alias("std"))


def whiten(df: DataFrame, value: str, mask: str = "mask", shift_mean: bool = True, out: str | None = None) -> DataFrame:
    """Values less the masked mean, over the root of the masked sample variance plus 1e-8; all places, masked or not.

    Raises at run time where the mask has fewer than two places.
    """
    with_mean = with_totals(df, m_mean(value, mask).alias("__mean"), F.sum(mask).alias("__n"))
    centred = with_mean.withColumn("__sq", F.pow(F.col(value) - F.col("__mean"), 2.0))
    full = with_totals(centred, m_mean("__sq", mask).alias("__var"))
    n = F.when(F.col("__n") > 1, F.col("__n").cast("double")).otherwise(F.raise_error(F.lit("the mask has fewer than two places")).cast("double"))
    scaled = (F.col(value) - F.col("__mean")) / F.sqrt(F.col("__var") * n / (n - 1) + double(EPS))
    if not shift_mean:
        scaled = scaled + F.col("__mean")
    return full.withColumn(out or value, scaled).drop("__mean", "__n", "__sq", "__var")
