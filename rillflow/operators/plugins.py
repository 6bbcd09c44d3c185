"""Registries of user code: reward managers, datasets, samplers, tool parsers, dispatch of work to partitions."""

from __future__ import annotations

import importlib.util
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions import masked as M
from rillflow.functions import scoring as S
from rillflow.functions import seeded as seeds
from rillflow.session import ship
from rillflow.streaming import queues


class Registry:
    """Names to functions. ``strict``: a taken name raises unless it is the same function."""

    def __init__(self, kind: str, strict: bool = True):
        self.kind, self.strict, self.items = kind, strict, {}

    def register(self, name: str):
        def put(f):
            if self.strict and self.items.get(name, f) is not f:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.items[name] = f
            return f

        return put

    def get(self, name: str):
        if name not in self.items:
            raise ValueError(f"unknown {self.kind} {name!r}; there are {', '.join(sorted(self.items))}")
        return self.items[name]


reward_managers, datasets, samplers, parsers, dispatchers = (
    Registry("reward manager"), Registry("dataset", False), Registry("sampler", False), Registry("tool parser"), Registry("dispatch mode"),
)


@reward_managers.register("naive")
def naive(df: DataFrame, score: Callable[[DataFrame], DataFrame] = S.default_score, **options) -> DataFrame:
    """``rewards``: the score at the last valid token; ``rm_score`` wins where there is one. Aborted responses get zeros."""
    scored = score(df)
    final = S.given_or("rm_score", F.col("score")) if "rm_score" in df.columns else F.col("score")
    return scored.withColumn("score", final).withColumn("rewards", S.place_reward("score", "response_length", F.col("max_length")))


#: All rows are scored by one function of the frame, which is how ``naive`` works.
reward_managers.register("batch")(naive)


@reward_managers.register("dapo")
def dapo(df: DataFrame, score: Callable[[DataFrame], DataFrame] = S.default_score, longest: int | None = None, buffer: int = 0, factor: float = 1.0) -> DataFrame:
    """With the penalty for overlong responses; no penalty where no buffer is given."""
    scored = score(df).withColumn("__d", S.dapo_reward("score", "response_length", longest, buffer, factor))
    out = scored.withColumns({"reward": F.col("__d.reward"), "overlong_reward": F.col("__d.overlong_reward"), "overlong": F.col("__d.overlong")})
    return out.withColumn("rewards", S.place_reward("reward", "response_length", F.col("max_length"))).drop("__d")


@reward_managers.register("prime")
def prime(df: DataFrame, score: Callable[[str, str], float], seconds: float = 300.0, **options) -> DataFrame:
    """A Python scorer per row in Arrow batches; a row that raises or takes too long counts 0.0 and stops no other."""
    ship()
    @F.pandas_udf("double")
    def scored(text: pd.Series, truth: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(text, truth):
            try:
                out.append(float(within(seconds, score, t, g)))
            except Exception:
                out.append(0.0)
        return pd.Series(out, dtype=float)

    return naive(df, lambda d: d.withColumn("score", scored("response", "ground_truth")))


@reward_managers.register("rate_limited")
def rate_limited(df: DataFrame, score: Callable[[str, str], float], per_minute: float = 600.0, tasks: int = 8, seconds: float = 300.0, attempts: int = 3, **options) -> DataFrame:
    """A Python scorer of an outside service: ``tasks`` tasks share ``per_minute`` calls, each call in its turn, with time limit and retries.

    A row that fails for good counts 0.0. Errors with a ``status`` of 400 to 499 are not tried again.
    """
    ship()
    gap = 60.0 * tasks / per_minute

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        due = time.monotonic()

        def call(t, g) -> float:
            nonlocal due
            time.sleep(max(0.0, due - time.monotonic()))
            due = max(due, time.monotonic()) + gap
            return float(within(seconds, score, t, g))

        for pdf in frames:
            out = []
            for t, g in zip(pdf["response"], pdf["ground_truth"]):
                try:
                    out.append(retried(call, t, g, attempts=attempts))
                except Exception:
                    out.append(0.0)
            yield pdf.assign(score=out)

    rows = df.drop("score").repartition(tasks)
    scored = rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return naive(scored, lambda d: d)


@reward_managers.register("collabllm")
def collabllm(df: DataFrame, score=None, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """``score`` of a conversation from its metrics, a map of name to value: each times its weight and clamped to [-1, 1], summed; metrics that are missing or null count 0."""
    own = weights or {}
    parts = [M.clip(F.coalesce(F.try_element_at("metrics", F.lit(k)).cast("double"), F.lit(0.0)) * float(v), -1, 1) for k, v in own.items()]
    return naive(df, lambda d: d.withColumn("score", reduce(lambda a, b: a + b, parts, F.lit(0.0))))


def within(seconds: float, f: Callable, *args):
    """``f(*args)``, or TimeoutError after so many seconds: by a signal in the main thread, elsewhere by leaving a daemon thread behind."""
    if threading.current_thread() is threading.main_thread():
        with time_limit(seconds):
            return f(*args)
    found: list = []

    def call() -> None:
        try:
            found.append((True, f(*args)))
        except BaseException as e:
            found.append((False, e))

    t = threading.Thread(target=call, daemon=True)
    t.start()
    t.join(seconds)
    if not found:
        raise TimeoutError(f"{seconds} s")
    if not found[0][0]:
        raise found[0][1]
    return found[0][1]


def retried(f: Callable, *args, attempts: int = 3, wait: Callable[[int], float] = queues.backoff, sleep: Callable[[float], None] | None = None):
    """``f(*args)``, tried again after :func:`rillflow.streaming.queues.backoff` where it raises; errors with ``status`` 400 to 499 are final."""
    import time

    for turn in range(attempts):
        try:
            return f(*args)
        except Exception as e:
            status = getattr(e, "status", None)
            if turn == attempts - 1 or (isinstance(status, int) and 400 <= status < 500):
                raise
            (sleep or time.sleep)(wait(turn))


@contextmanager
def time_limit(seconds: float):
    """Raises TimeoutError after so many seconds. Signals reach the main thread only, so elsewhere it raises RuntimeError at once; see :func:`within`."""
    if threading.current_thread() is not threading.main_thread():
        raise RuntimeError("time_limit works in the main thread only")

    def stop(*_):
        raise TimeoutError(f"{seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def function_from_file(path: str, name: str, **fixed) -> Callable:
    """A function of a Python file, with some arguments fixed."""
    spec = importlib.util.spec_from_file_location("rillflow_custom", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    found = getattr(module, name)
    return (lambda *a, **k: found(*a, **(k | fixed))) if fixed else found


def scored_by(df: DataFrame, f: Callable[[str, str], float]) -> DataFrame:
    """With ``score`` by any Python function of response and truth."""
    ship()
    @F.pandas_udf("double")
    def udf(text: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([float(f(t, g)) for t, g in zip(text, truth)], dtype=float)

    return df.withColumn("score", udf("response", "ground_truth"))


@datasets.register("prompts")
def prompts(spark, paths: list[str], max_tokens: int | None = None, token_count: Callable[[DataFrame], Column] | None = None, max_samples: int = -1, key: str | None = None, seed: int | None = None) -> DataFrame:
    """Prompt rows of several files, without overlong ones, and at most so many of them."""
    from rillflow.operators import batch as B
    from rillflow.operators import filters

    df = spark.read.parquet(*paths)
    if max_tokens is not None and token_count is not None:
        df = filters.within_length(df, token_count(df), max_tokens)
    return B.first_samples(df, max_samples, key or df.columns[0], seed) if max_samples >= 0 else df


@datasets.register("generated")
def generated(spark, paths: list[str], generate: Callable[[DataFrame], DataFrame], keep: Column | None = None, **options) -> DataFrame:
    """The prompts with what ``generate`` makes of them (a frame of the same columns), of that what passes ``keep``."""
    from rillflow.operators import batch as B

    df = prompts(spark, paths, **options)
    return B.grow(df, generate(df), keep if keep is not None else F.lit(True))


@samplers.register("sequential")
def sequential(key: str, **_) -> list[Column]:
    return [F.col(key)]


@samplers.register("random")
def seeded(key: str, seed: int = 0, **_) -> list[Column]:
    return [seeds.order(seed, key), F.col(key)]


parsers.register("hermes")(lambda text: S.tool_calls(text))
parsers.register("channel")(lambda text: S.channel_calls(text))


class Tool:
    """What a model can call: a state per instance, made by ``create``, changed by ``execute``, rated by ``reward``."""

    def create(self, instance) -> dict:
        return {}

    def execute(self, state: dict, arguments: dict) -> tuple[str, float]:
        """(response, reward of the step)."""
        return "", 0.0

    def reward(self, state: dict) -> float:
        return 0.0

    def release(self, state: dict) -> None:
        """When an instance has ended."""


tools = Registry("tool")


@tools.register("calc_gsm8k_reward")
class Gsm8kTool(Tool):
    """Rates submitted answers; a step costs 0.05 unless its answer is better than the one before."""

    def create(self, instance) -> dict:
        return {"score": 0.0}

    def execute(self, state: dict, arguments: dict) -> tuple[str, float]:
        score = float(str(arguments.get("answer", "")).strip() == str(arguments.get("ground_truth", "")).strip())
        step, state["score"] = 0.0 if score > state["score"] else -0.05, score
        return f"Current parsed answer: {arguments.get('answer', '')} with score {score}", step

    def reward(self, state: dict) -> float:
        return state["score"]


def run_tool(df: DataFrame, name: str, instance: str = "conv_id", order: str = "turn", arguments: str = "arguments") -> DataFrame:
    """(instance, order, response, reward) of each call, arguments as JSON, in order within an instance; and at its end (instance, null, null, the tool's own reward).

    Calls whose arguments are no JSON object get an error as response and 0. An instance is replayed by one task, in batches.
    """
    import json

    kind = tools.get(name)
    tool = kind() if isinstance(kind, type) else kind

    def step(key, held: dict, row: tuple) -> list[tuple]:
        at, text = row
        if "state" not in held:
            held["state"] = tool.create(key)
        try:
            given = json.loads(text)
            response, reward = tool.execute(held["state"], given) if isinstance(given, dict) else ("error: arguments are no object", 0.0)
        except (TypeError, ValueError):
            response, reward = "error: arguments are no JSON", 0.0
        return [(key, at, response, float(reward))]

    def finish(key, held: dict) -> list[tuple]:
        if "state" not in held:
            return []
        reward = float(tool.reward(held["state"]))
        tool.release(held["state"])
        return [(key, None, None, reward)]

    kinds = f"{instance} {df.schema[instance].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, response string, reward double"
    return queues.replay(df, instance, [order], [order, arguments], kinds, dict, step, finish)


@dispatchers.register("one_to_all")
def one_to_all(df: DataFrame, n: int, **_) -> DataFrame:
    """Every worker gets every row."""
    return df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


@dispatchers.register("dp_compute")
def dp_compute(df: DataFrame, n: int, order_by="row_idx", **_) -> DataFrame:
    """Contiguous equal parts, one per worker."""
    from rillflow.operators.batch import chunk

    return chunk(df, n, order_by, name="worker")


@dispatchers.register("nd_compute")
def nd_compute(df: DataFrame, n: int, ranks: dict[int, int], order_by="row_idx", **_) -> DataFrame:
    """Parts by data-parallel rank, the same for all workers of a rank: ``ranks`` is worker to rank."""
    pairs = df.sparkSession.createDataFrame([(w, r) for w, r in ranks.items()], "worker int, rank int")
    return dp_compute(df, n, order_by).withColumnRenamed("worker", "rank").join(F.broadcast(pairs), "rank")


@dispatchers.register("rank_zero")
def rank_zero(df: DataFrame, n: int, **_) -> DataFrame:
    """The first worker gets every row."""
    return df.withColumn("worker", F.lit(0))


@dispatchers.register("all_to_all")
def all_to_all(df: DataFrame, n: int, **_) -> DataFrame:
    """Rows name their worker already; one that is not there raises."""
    named = F.when(F.col("worker").between(0, n - 1), F.col("worker")).otherwise(F.raise_error(F.lit(f"a worker is not among {n}")).cast("int"))
    return df.withColumn("worker", named)


@dispatchers.register("dp_compute_proto")
def dp_compute_proto(df: DataFrame, n: int, order_by="row_idx", **_) -> DataFrame:
    """Contiguous equal parts of any number of rows: rows of the head fill the last part up, marked ``is_pad``."""
    from rillflow.operators.batch import pad_to_divisor

    padded = pad_to_divisor(df.drop("row_idx") if order_by != "row_idx" else df.withColumnRenamed("row_idx", "__order"), n, "__order" if order_by == "row_idx" else order_by)
    total = F.broadcast(padded.agg(F.count(F.lit(1)).alias("__total")))
    dealt = padded.crossJoin(total).withColumn("worker", F.expr(f"row_idx * {n} div __total").cast("int")).drop("__total")
    return dealt.drop("row_idx").withColumnRenamed("__order", "row_idx") if order_by == "row_idx" else dealt


#: What comes back is kept per worker instead of joined, see :func:`collect_parts`.
dispatchers.register("dp_compute_metric")(dp_compute_proto)


@dispatchers.register("dp_compute_proto_with_func")
def dp_compute_proto_with_func(df: DataFrame, n: int, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order_by="row_idx", **_) -> DataFrame:
    """:func:`dp_compute_proto`, and each worker's part (padding too) through ``f``; a part has to fit a task."""
    ship()
    return dp_compute_proto(df, n, order_by).groupBy("worker").applyInPandas(f, schema)


@dispatchers.register("direct_rollout_method")
def direct_rollout_method(df: DataFrame, n: int, **_) -> DataFrame:
    raise NotImplementedError("rollout methods are called directly, not dispatched")


def all_gather(df: DataFrame, n: int) -> DataFrame:
    """Rows of all workers for every worker: ``worker`` has them, ``source`` is where each comes from."""
    return one_to_all(df.withColumnRenamed("worker", "source"), n)


def collect_rows(df: DataFrame) -> DataFrame:
    """Results of all workers as one table, without padding."""
    return (df.where(~F.col("is_pad")).drop("is_pad") if "is_pad" in df.columns else df).drop("worker")


def collect_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per worker with the lists of its results, for metrics. A part has to fit a task."""
    return df.groupBy("worker").agg(*[F.collect_list(c).alias(c) for c in columns])


def collect(df: DataFrame, keep: dict[int, bool]) -> DataFrame:
    """Of results of several workers, those of workers that are to report."""
    return df.where(F.col("worker").isin(*[w for w, k in keep.items() if k]))
