"""Metrics as aggregates: wide one-row frames, and long frames of (metric, value)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rillflow.functions import masked as M
from rillflow.functions import seeded
from rillflow.operators import order, scans
from rillflow.operators.batch import MOST, index_within
from rillflow.session import ship


def long(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Columns besides ``keys`` as rows (metric, value)."""
    rest = [c for c in df.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in rest])
    return df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.metric", "x.value")


def wide(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot("metric", names).agg(F.first("value"))


def stats(column: str, name: str, when: Column | None = None) -> list[Column]:
    c = F.when(when, F.col(column)) if when is not None else F.col(column)
    return [F.avg(c).alias(f"{name}/mean"), F.max(c).alias(f"{name}/max"), F.min(c).alias(f"{name}/min")]


def data_metrics(seqs: DataFrame, tokens: DataFrame, max_response: int, max_prompt: int, critic: bool = True) -> DataFrame:
    """One row. ``seqs``: score, reward, response_length, prompt_length[, num_turns, tool_call_counts]; ``tokens``: advantage, ret, value, mask.

    Scores and rewards leave out aborted sequences (response length 0), response lengths are given with
    and without them. A batch of aborted sequences only raises.
    """
    alive = F.col("response_length") != 0
    share = lambda c: F.avg(c.cast("double"))
    own = [
        *stats("score", "critic/score", alive), *stats("reward", "critic/rewards", alive),
        *stats("response_length", "response_length"), share(F.col("response_length") == max_response).alias("response_length/clip_ratio"),
        *stats("response_length", "response_length_non_aborted", alive),
        F.avg(F.when(alive, (F.col("response_length") == max_response).cast("double"))).alias("response_length_non_aborted/clip_ratio"),
        share(~alive).alias("response/aborted_ratio"),
        *stats("prompt_length", "prompt_length"), share(F.col("prompt_length") == max_prompt).alias("prompt_length/clip_ratio"),
    ]
    for c in ("num_turns", "tool_call_counts"):
        if c in seqs.columns:
            own += stats(c, c)
    s = seqs.agg(*own, F.sum(alive.cast("int")).alias("__alive"))
    none = F.raise_error(F.lit("all samples are aborted")).cast("double")
    s = s.withColumn("critic/score/mean", F.when(F.coalesce("__alive", F.lit(0)) == 0, none).otherwise(F.col("`critic/score/mean`"))).drop("__alive")
    on = F.col("mask") != 0
    token = [*stats("advantage", "critic/advantages", on), *stats("ret", "critic/returns", on)]
    if critic:
        lost = F.var_samp(F.when(on, F.col("ret") - F.col("value")))
        token += [*stats("value", "critic/values", on), (1 - lost / (F.var_samp(F.when(on, F.col("ret"))) + 1e-5)).alias("critic/vf_explained_var")]
    return s.crossJoin(tokens.agg(*token))


def preference_metrics(seqs: DataFrame, max_response: int, max_prompt: int) -> DataFrame:
    """One row for a batch of preference pairs: what there is of ``score``, ``reward``, ``dpo_logits``, ``chosen_logps`` and ``rejected_logps``, and lengths."""
    own = [m for c, name in (("score", "reward/score"), ("reward", "reward/rewards")) if c in seqs.columns for m in stats(c, name)]
    own += [F.avg(c).alias(f"actor/{c}") for c in ("dpo_logits", "chosen_logps", "rejected_logps") if c in seqs.columns]
    for c, most in (("response_length", max_response), ("prompt_length", max_prompt)):
        own += [*stats(c, c), F.avg((F.col(c) == most).cast("double")).alias(f"{c}/clip_ratio")]
    return seqs.agg(*own)


def timing_metrics(timings: DataFrame, totals: DataFrame) -> DataFrame:
    """(name, seconds) with per-token milliseconds: ``gen`` over response tokens, other stages over all tokens."""
    summed = timings.groupBy("name").agg(F.sum("seconds").alias("seconds"))
    t = summed.crossJoin(F.broadcast(totals.select("prompt_tokens", "response_tokens")))
    over = F.when(F.col("name") == "gen", F.col("response_tokens")).otherwise(F.col("prompt_tokens") + F.col("response_tokens"))
    per = F.when(F.col("name").isin("gen", "ref", "values", "adv", "update_critic", "update_actor"), F.try_divide(F.col("seconds") * 1000, over))
    return t.select("name", F.col("seconds").alias("timing_s"), per.alias("timing_per_token_ms"))


def throughput(seqs: DataFrame, tokens: str, step_seconds: float, devices: int) -> DataFrame:
    total = seqs.agg(F.sum(tokens).cast("double").alias("total_num_tokens"))
    return total.select("total_num_tokens", F.lit(step_seconds).alias("time_per_step"), (F.col("total_num_tokens") / (step_seconds * devices)).alias("throughput"))


def majority(df: DataFrame, keys: list[str], vote: str, value: str, order: str) -> DataFrame:
    """(keys, value, votes): the value of the first row of the most frequent vote; of tied votes, the one seen first."""
    votes = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("__at"), F.min_by(value, order).alias(value))
    best = F.max_by(F.struct(F.col(vote), F.col(value), F.col("votes")), F.struct("votes", -F.col("__at"))).alias("x")
    return votes.groupBy(*keys).agg(best).select(*keys, f"x.{vote}", f"x.{value}", "x.votes")


def sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n; none for a single sample."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.pow(F.lit(2), i).cast("int")), lambda p: p < n)
    return F.when(n > 1, F.concat(powers, F.array(n.cast("int")))).otherwise(F.array().cast("array<int>"))


def best_worst(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key and n: mean and deviation of the best and worst of n draws with replacement, in closed form.

    Of N sorted samples the i-th is the best with chance (i/N)**n - ((i-1)/N)**n, and alike for the worst;
    it is what the average over ever more bootstrap draws tends to.
    """
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("x"))
    g = g.withColumn("samples", F.size("x")).withColumn("n", F.explode(sizes(F.col("samples"))))
    size, n = F.col("samples").cast("double"), F.col("n").cast("double")

    def moment(power: int, best: bool) -> Column:
        def term(x: Column, i: Column) -> Column:
            at = i.cast("double")
            up = F.pow((at + 1) / size, n) - F.pow(at / size, n)
            down = F.pow((size - at) / size, n) - F.pow((size - at - 1) / size, n)
            return (x if power == 1 else x * x) * (up if best else down)

        return M.array_sum(F.transform("x", term))

    def deviation(best: bool) -> Column:
        return F.sqrt(F.greatest(moment(2, best) - F.pow(moment(1, best), 2.0), F.lit(0.0)))

    return g.select(
        *keys, "samples", "n", moment(1, True).alias("best_mean"), deviation(True).alias("best_std"),
        moment(1, False).alias("worst_mean"), deviation(False).alias("worst_std"),
    )


#: Greatest group that is resampled together with others of its size, and cells of such a block.
TOGETHER, BLOCK_CELLS = 64, 1 << 20


def bootstrap(df: DataFrame, keys: list[str], value: str, order: str, vote: str | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """The same by resampling, seeded alike for each key: (keys, n, name, mean, std) for best, worst and, with ``vote``, maj.

    One group is the samples of one prompt and variable: a handful. Groups of one size draw alike, so that those of a batch
    are resampled together.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    known: dict[tuple[int, int], np.ndarray] = {}

    def drawn(total: int, n: int):
        """Blocks of draws by row; those of small groups are kept."""
        if (total, n) in known:
            yield known[total, n]
            return
        rng, block = np.random.RandomState(seed), max(1, (1 << 20) // total)
        if draws <= block and total <= TOGETHER:
            known[total, n] = rng.choice(total, size=(draws, n), replace=True)
            yield known[total, n]
            return
        for a in range(0, draws, block):
            yield rng.choice(total, size=(min(block, draws - a), n), replace=True)

    def one(x: np.ndarray, codes: np.ndarray | None, n: int) -> dict[str, np.ndarray]:
        found = {"best": [], "worst": [], **({"maj": []} if vote else {})}
        total, kinds = len(x), int(codes.max()) + 1 if vote else 0
        for at in drawn(total, n):
            found["best"].append(x[at].max(axis=1))
            found["worst"].append(x[at].min(axis=1))
            if vote:  # the first draw of the vote with most draws, of equals the one drawn first
                row = np.arange(len(at))
                cell = codes[at] + row[:, None] * kinds
                counts = np.bincount(cell.ravel(), minlength=len(at) * kinds)
                found["maj"].append(x[at[row, counts[cell].argmax(axis=1)]])
        return {name: np.concatenate(v)[None] for name, v in found.items()}

    def many(x: np.ndarray, codes: np.ndarray | None, n: int) -> dict[str, np.ndarray]:
        """Of groups of one size, a row each, with their draws side by side."""
        (at,) = drawn(x.shape[1], n)
        best, worst = x[:, at[:, 0]], x[:, at[:, 0]]
        for j in range(1, n):
            y = x[:, at[:, j]]
            np.maximum(best, y, out=best)
            np.minimum(worst, y, out=worst)
        found = {"best": best, "worst": worst}
        if vote:
            c = [codes[:, at[:, j]] for j in range(n)]
            top, place = np.zeros(best.shape, np.int8), np.zeros(best.shape, np.int8)
            for j in range(n):
                times = np.zeros(best.shape, np.int8)
                for k in range(n):
                    times += c[k] == c[j]
                np.copyto(place, np.int8(j), where=times > top)
                np.maximum(top, times, out=top)
            found["maj"] = np.take_along_axis(x, at[np.arange(draws), place], 1)
        return found

    def resampled(x: np.ndarray, codes: np.ndarray | None) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
        total = x.shape[1]
        for n in [2**k for k in range(1, 20) if 2**k < total] + [total] if total > 1 else []:
            found = many(x, codes, n) if total <= TOGETHER and draws * total <= 1 << 20 else one(x[0], codes[0] if vote else None, n)
            for name, v in found.items():
                yield n, name, v.mean(axis=1), v.std(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            start = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            inner = lists.flatten().flatten()
            values = inner[1].to_numpy(zero_copy_only=False)
            votes = pd.factorize(inner[2].to_pandas(), use_na_sentinel=False)[0] if vote else None
            for total in np.unique(size):
                own = np.flatnonzero(size == total)
                step = max(1, BLOCK_CELLS // max(draws, int(total))) if total <= TOGETHER else 1
                for a in range(0, len(own), step):
                    part = own[a : a + step]
                    cells = start[part][:, None] + np.arange(total)
                    codes = None
                    if vote:  # numbered anew within a group, so that they are small
                        rank = pd.factorize((np.arange(len(part))[:, None] * (int(votes.max()) + 1) + votes[cells]).ravel())[0].reshape(cells.shape)
                        codes = (rank - rank.min(axis=1, keepdims=True)).astype(np.int8 if total <= TOGETHER else np.int64)
                    names = [batch.column(i).take(pa.array(part)) for i in range(len(keys))]
                    for n, name, mean, std in resampled(values[cells], codes):
                        cols = [pa.array(np.full(len(part), n, np.int32)), pa.array([name] * len(part)), pa.array(mean), pa.array(std)]
                        yield pa.RecordBatch.from_arrays([*names, *cols], names=[*keys, "n", "name", "mean", "std"])

    ship()
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    # The order first, its nulls at the end; then what has been one sort of it.
    row = F.struct(F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("at")).alias("o"), F.col(value).cast("double").alias("x"), *([F.col(vote).alias("v")] if vote else []))
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return g.mapInArrow(run, f"{kinds}, n int, name string, mean double, std double")


def validation_metrics(df: DataFrame, variables: list[str], source: str = "data_source", uid: str = "uid") -> DataFrame:
    """(source, variable, metric, value): mean@N, std@N, best@n and worst@n by prompt, then averaged over the prompts of a source."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    rows = df.select(source, uid, F.explode(pairs).alias("x")).select(source, uid, "x.variable", "x.value")
    keys = [source, uid, "variable"]
    plain = rows.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))
    names = F.array(
        F.struct(F.concat(F.lit("mean@"), F.col("n").cast("string")).alias("metric"), F.col("mean").alias("value")),
        F.struct(F.concat(F.lit("std@"), F.col("n").cast("string")).alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("value")),
    )
    a = plain.select(*keys, F.explode(names).alias("x")).select(*keys, "x.metric", "x.value").where("value is not null")
    bw = best_worst(rows, keys, "value")
    n = F.col("n").cast("string")
    four = F.array(*[F.struct(F.concat(F.lit(k + "@"), n, F.lit("/" + s)).alias("metric"), F.col(f"{k}_{s}").alias("value")) for k in ("best", "worst") for s in ("mean", "std")])
    b = bw.select(*keys, F.explode(four).alias("x")).select(*keys, "x.metric", "x.value")
    return a.unionByName(b).groupBy(source, "variable", "metric").agg(F.avg("value").alias("value"))


def route_validation(df: DataFrame, source: str = "data_source") -> DataFrame:
    """With ``name``: val-core/ for mean, best and maj of the core variable (``acc`` if the source has it, else ``reward``) at the greatest n, val-aux/ for the rest."""
    at = F.regexp_extract("metric", "@([0-9]+)", 1).cast("int")
    per = df.groupBy(F.col(source).alias("__s")).agg(F.max((F.col("variable") == "acc").cast("int")).alias("__acc"))
    top = df.groupBy(F.col(source).alias("__t"), F.col("variable").alias("__v")).agg(F.max(at).alias("__top"))
    t = df.join(per, F.col(source) == F.col("__s")).join(top, (F.col(source) == F.col("__t")) & (F.col("variable") == F.col("__v")))
    core = F.col("variable") == F.when(F.col("__acc") == 1, "acc").otherwise("reward")
    core = core & F.col("metric").rlike("^(mean|maj|best)") & (at == F.col("__top"))
    section = F.when(core, "val-core").otherwise("val-aux")
    return t.withColumn("name", F.concat_ws("/", section, source, "variable", "metric")).drop("__s", "__acc", "__t", "__v", "__top")


def reduce_metrics(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Long metrics to one value per name: the greatest if the name contains "max", else the smallest if it contains "min", else the mean."""
    g = df.groupBy(*keys, "metric").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("avg"))
    value = F.when(F.contains("metric", F.lit("max")), F.col("hi")).when(F.contains("metric", F.lit("min")), F.col("lo")).otherwise(F.col("avg"))
    return g.select(*keys, "metric", value.alias("value"))


def offline_evaluation(df: DataFrame, score: Column, source: str = "data_source", prompt: str = "uid") -> DataFrame:
    """Mean over prompts of a prompt's mean score, by source."""
    per = df.groupBy(source, prompt).agg(F.avg(score).alias("__s"))
    return per.groupBy(source).agg(F.avg("__s").alias("test_score"))


def agent_performance(df: DataFrame) -> DataFrame:
    """Generation and tool times, and the slowest sample with its lengths: columns generate, tool, prompt_length, response_length."""
    slow = F.struct(F.col("generate") + F.col("tool"), F.col("generate"), F.col("tool"), F.col("prompt_length"), F.col("response_length"))
    row = df.agg(*stats("generate", "agent_loop/generate_sequences"), *stats("tool", "agent_loop/tool_calls"), F.max(slow).alias("x"))
    fields = {"generate_sequences": "generate", "tool_calls": "tool", "prompt_length": "prompt_length", "response_length": "response_length"}
    keep = [F.col(f"`{c}`") for c in row.columns if c != "x"]
    return row.select(*keep, *[F.col(f"x.{c}").alias(f"agent_loop/slowest/{k}") for k, c in fields.items()])


def assembly_stats(df: DataFrame, seconds: str = "processing_time", start: str = "version_start", end: str = "version_end") -> DataFrame:
    """Times with exact interpolated percentiles, partial rollouts (whose version changed), their greatest span, and distinct versions.

    Percentiles come from :func:`order.quantiles`, so that no task holds the distinct times.
    """
    span = F.col(end) - F.col(start)
    p = order.quantiles(df, seconds, {f"p{q}": q / 100 for q in (50, 95, 99)})
    return df.agg(
        F.avg(seconds).alias("avg"), F.max(seconds).alias("max"), F.min(seconds).alias("min"),
        F.sum((span > 0).cast("long")).alias("partial_count"), F.avg((span > 0).cast("double")).alias("partial_ratio"),
        F.max(span).alias("max_partial_span"), F.count_distinct(end).alias("version_diversity"),
    ).crossJoin(F.broadcast(p))


#: Metrics whose rule doesn't follow from their name (fixed values).
RULES = {
    "time_sum": ("perf/time_per_step",),
    "min": ("timing_s/agent_loop/tool_calls/min",),
    "avg": ("timing_s/agent_loop/tool_calls/mean",),
    "max": ("timing_s/agent_loop/tool_calls/max",),
    "last": (
        "fully_async/count/total_generated_samples",
        "fully_async/count/stale_samples_processed",
        "fully_async/count/stale_trajectory_processed",
        "fully_async/count/current_param_version",
        "fully_async/count/dropped_stale_samples",
        "training/global_step",
    ),
}


def aggregation_rule(name: Column, rules: dict[str, tuple[str, ...]] = RULES) -> Column:
    """time_sum, min, avg, max, last, sum or weighted_avg: from the table, else the first keyword that the name contains; avg without one.

    "avg" is looked for before "weighted_avg", which a name alone therefore never gives.
    """
    out = None
    for rule, names in rules.items():
        out = F.when(name.isin(*names), rule) if out is None else out.when(name.isin(*names), rule)
    low = F.lower(name)
    has = lambda *words: low.rlike("|".join(words))
    for words, rule in ((("timing_s/",), "time_sum"), (("mean", "avg", "average"), "avg"), (("max", "maximum"), "max"), (("min", "minimum"), "min"),
                        (("sum", "total"), "sum"), (("weighted_avg",), "weighted_avg")):
        out = F.when(has(*words), rule) if out is None else out.when(has(*words), rule)
    return out.otherwise("avg")


def aggregate_steps(df: DataFrame, rules: dict[str, tuple[str, ...]] = RULES, weight: str = "samples") -> DataFrame:
    """Long metrics of several steps (step, metric, value[, samples]) to one value each, by :func:`aggregation_rule`."""
    w = F.col(weight) if weight in df.columns else F.lit(1)
    g = df.groupBy("metric").agg(
        F.sum("value").alias("s"), F.avg("value").alias("a"), F.max("value").alias("hi"), F.min("value").alias("lo"),
        F.max_by("value", "step").alias("last"), (F.sum(F.col("value") * w) / F.sum(w)).alias("wa"),
    )
    rule = aggregation_rule(F.col("metric"), rules)
    g = g.withColumn("rule", rule)
    value = (
        F.when(F.col("rule").isin("sum", "time_sum"), F.col("s")).when(F.col("rule") == "max", F.col("hi")).when(F.col("rule") == "min", F.col("lo"))
        .when(F.col("rule") == "last", F.col("last")).when(F.col("rule") == "weighted_avg", F.col("wa")).otherwise(F.col("a"))
    )
    return g.select("metric", "rule", value.alias("value"))


def recomputed(df: DataFrame) -> DataFrame:
    """Aggregated metrics (wide, one row) with what follows from others: differences of extremes, throughput, idle ratio."""
    out = df
    if {"global_seqlen/max", "global_seqlen/min"} <= set(df.columns):
        out = out.withColumn("global_seqlen/minmax_diff", F.col("`global_seqlen/max`") - F.col("`global_seqlen/min`"))
    have = set(df.columns)
    if {"perf/total_num_tokens", "perf/time_per_step", "perf/devices"} <= have:
        out = out.withColumn("perf/throughput", F.try_divide("`perf/total_num_tokens`", F.col("`perf/time_per_step`") * F.col("`perf/devices`")))
    if {"timing_s/gen", "timing_s/step"} <= have:
        out = out.withColumn("trainer/idle_ratio", F.try_divide("`timing_s/gen`", "`timing_s/step`"))
    return out


def debug_metrics(df: DataFrame, a: str = "rollout_lp", b: str = "old_lp", mask: str = "mask") -> DataFrame:
    """Differences of probabilities (max, mean, std) and their correlation, over the mask; ``valid`` is 0 without a token."""
    t = df.where(F.col(mask) != 0).select(F.exp(a).alias("p"), F.exp(b).alias("q"))
    d = F.abs(F.col("p") - F.col("q"))
    return t.agg(
        (F.count(F.lit(1)) > 0).cast("int").alias("valid"), F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"),
        F.stddev_samp(d).alias("diff_std"), F.corr("p", "q").alias("pearson_corr"),
    )


def token_differences(a: str, b: str, mask: str) -> Column:
    """Places of the mask at which two token arrays differ."""
    pairs = F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return M.mask_count(F.zip_with(pairs, mask, lambda d, m: F.when(m != 0, d).otherwise(0)))


def reduce_timing(df: DataFrame) -> DataFrame:
    """(name, mean, n, min, p50, max) of the seconds of all ranks; :func:`gathered_timing` has the values themselves."""
    sums = df.groupBy("name").agg(F.avg("seconds").alias("mean"), F.count("seconds").alias("n"), F.min("seconds").alias("min"), F.max("seconds").alias("max"))
    half = order.quantiles(df, "seconds", {"p50": 0.5}, ["name"]).withColumnRenamed("name", "__name")
    return sums.join(half, F.col("name").eqNullSafe(F.col("__name")), "left").select("name", "mean", "n", "min", "p50", "max")


def gathered_timing(df: DataFrame) -> DataFrame:
    """(name, place, seconds): every value of every rank, ascending within the name, as rows: a name of any size is no one task's."""
    return index_within(df.select("name", "seconds"), ["name"], ["seconds"], "place")


def tail_ratio(df: DataFrame, seconds: str = "seconds", top: float = 0.1) -> DataFrame:
    """The extremes of the workers' times, and the share of workers beyond the exact quantile 1 - ``top``."""
    t = df.crossJoin(F.broadcast(order.quantiles(df, seconds, {"__cut": 1 - top})))
    return t.agg(F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.avg((F.col(seconds) > F.col("__cut")).cast("double")).alias("tail_ratio"))


def imbalance(df: DataFrame, length: str, before: str, after: str) -> DataFrame:
    """Sums of lengths per partition, as dealt (``before``) and balanced (``after``): extremes, their difference and the mean."""
    a = df.groupBy(before).agg(F.sum(length).alias("s")).agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"), F.avg("s").alias("mean"))
    b = df.groupBy(after).agg(F.sum(length).alias("s")).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"))
    return a.crossJoin(b)


#: Peak tera-operations a second of bf16 by device name (fixed values).
DEVICE_TFLOPS = {"CPU": 0.448, "GB200": 2500, "B200": 2250, "MI300X": 1336, "H100": 989, "H800": 989, "H200": 989, "A100": 312, "A800": 312,
                 "L40S": 362.05, "L40": 181.05, "A40": 149.7, "L20": 119.5, "H20": 148, "910B": 354, "Ascend910": 354, "RTX 3070 Ti": 21.75}


def device_tflops(name: str) -> float:
    """Of the first known name, in descending order of names, that the device's name contains; infinite for unknown devices."""
    return next((float(v) for k, v in sorted(DEVICE_TFLOPS.items(), reverse=True) if k.lower() in name.lower()), float("inf"))


def pair_accuracy(df: DataFrame, score: str, acc: str, uid: str = "uid", order: str = "idx") -> DataFrame:
    """Mean over prompts of how often scores order pairs as ``acc`` does, weighted by the difference in ``acc``; 0.5 where none differ.

    No pair is formed. Rows of a prompt get a rank by ``acc``; two of them part at the highest bit in which their ranks differ.
    Among rows that agree in the bits above, in the order of scores (then of ``order``), each with a 1 there counts the
    earlier ones with a 0 and their sum: a row per bit of the ranks, n log n in all. A prompt with very many rows goes through
    a composed scan, others through a window. Pairs with a null score count as not in order, rows with a null ``acc`` not at all.
    """
    rows = df.select(F.col(uid).alias("u"), F.col(order).alias("i"), F.col(score).alias("s"), F.col(acc).cast("double").alias("a")).where("a is not null and u is not null")
    ranked = index_within(rows, ["u"], ["a", "i"], "r")
    n = rows.groupBy(F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.join(n, F.col("u") == F.col("v")).drop("v")
    bits = F.length(F.bin(F.greatest(F.col("n") - 1, F.lit(1))))
    level = ranked.where("s is not null and n > 1").withColumn("b", F.explode(F.sequence(F.lit(0), bits - 1)))
    level = level.select("u", "b", F.expr("shiftright(r, b + 1)").alias("g"), "s", "i", "a", "n", (F.expr("shiftright(r, b)") % 2 == 1).alias("up"))
    low = {"c": F.when(~F.col("up"), 1.0).otherwise(0.0), "t": F.when(~F.col("up"), F.col("a")).otherwise(0.0)}
    w = Window.partitionBy("u", "b", "g").orderBy("s", "i").rowsBetween(Window.unboundedPreceding, 0)
    below = level.where(F.col("n") <= MOST).withColumns({c: F.sum(v).over(w) for c, v in low.items()})
    hot = level.where(F.col("n") > MOST)
    if not n.where(F.col("n") > MOST).isEmpty():
        below = below.unionByName(scans.running_sums(hot, ["u", "b", "g"], ["s", "i"], low))
    same = below.where("up").groupBy(F.col("u").alias("v")).agg(F.sum(F.col("a") * F.col("c") - F.col("t")).alias("x"))
    gaps = ranked.groupBy("u").agg(F.sum((2 * F.col("r") + 1 - F.col("n")) * F.col("a")).alias("y"))
    found = gaps.join(same, F.col("u") == F.col("v"), "left").select("u", F.coalesce("x", F.lit(0.0)).alias("x"), "y")
    everyone = df.select(F.col(uid).alias("u")).distinct().join(found, "u", "left")
    return everyone.agg(F.avg(F.when(F.col("y") > 0, F.col("x") / F.col("y")).otherwise(0.5)).alias("accuracy"))


def absolute_accuracy(df: DataFrame, score: str, acc: str) -> DataFrame:
    return df.agg(F.avg((F.signum(score) == F.signum(F.col(acc) * 2 - 1)).cast("double")).alias("accuracy"))


def conversation_reward(df: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """Sum over metrics of weight times the mean over repeats, each clamped to [-1, 1]."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    g = df.where(F.col("metric").isin(*weights)).groupBy(*keys, "metric").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    part = M.clip(F.col("s") * F.element_at(w, F.col("metric")) / F.col("n"), -1, 1)
    return g.groupBy(*keys).agg(F.sum(part).alias("reward"))


def stale_counts(df: DataFrame, version: str, current: int) -> DataFrame:
    old = (F.lit(current) - F.col(version)) >= 1
    return df.agg(F.sum(old.cast("long")).alias("stale_samples"), F.count(F.lit(1)).alias("samples"))


def log_samples(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows in a seeded random order of their key, for a table of generations."""
    return df.orderBy(seeded.order(seed, key), key).limit(k)


def generations_wide(df: DataFrame, k: int) -> DataFrame:
    """One row per step with k samples side by side: ``input_1``, ``output_1``, ``score_1``, ..."""
    g = df.groupBy("step").agg(F.sort_array(F.collect_list(F.struct("rank", "input", "output", "score"))).alias("x"))
    return g.select("step", *[F.get("x", F.lit(i))[c].alias(f"{c}_{i + 1}") for i in range(k) for c in ("input", "output", "score")])


def trajectory_index(df: DataFrame, index: str, order: str) -> DataFrame:
    """With ``rollout_n``: a row's place among the neighbours of equal ``index`` (a change of value starts anew).

    ``order`` is a dense row number; a run is found by the difference of two row numbers, without a global window.
    """
    runs = index_within(df, [index], [order], "__i").withColumn("__run", F.col(order) - F.col("__i")).drop("__i")
    return index_within(runs, [index, "__run"], [order], "rollout_n").withColumn("rollout_n", F.col("rollout_n").cast("int")).drop("__run")


def sanitise(name: Column) -> Column:
    """Metric names for stores with few characters: ``@`` spelled out, slashes collapsed, all else that is odd to ``_``."""
    s = F.regexp_replace(F.replace(name, F.lit("@"), F.lit("_at_")), "/+", "/")
    return F.regexp_replace(s, "[^/\\w.\\- :]", "_")


def flatten_fields(df: DataFrame, keys: list[str], sep: str = "/") -> DataFrame:
    """(keys, name, value) of every other field, however deep: names of structs joined by ``sep``, values as text; arrays and maps are values."""
    found = []

    def walk(column: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(column[f.name], f.dataType, f"{name}{sep}{f.name}" if name else f.name)
        else:
            nested = isinstance(kind, (T.ArrayType, T.MapType))
            found.append(F.struct(F.lit(name).alias("name"), (F.to_json(column) if nested else column.cast("string")).alias("value")))

    for f in df.schema.fields:
        if f.name not in keys:
            walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select(*keys, F.explode(F.array(*found)).alias("x")).select(*keys, "x.name", "x.value")


def flatten_config(config: dict, sep: str = "/") -> dict[str, object]:
    """Nested dictionaries and lists to ``a/b/0`` names."""
    out: dict[str, object] = {}

    def walk(x, path: str) -> None:
        items: Iterator = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, (list, tuple)) else iter(())
        empty = True
        for k, v in items:
            empty = False
            walk(v, f"{path}{sep}{k}" if path else str(k))
        if empty and path:
            out[path] = x

    walk(config, "")
    return out
