"""Scans against loops in plain Python; one key with most rows goes over many partitions."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import masked as M
from rillflow.operators import advantage as A
from rillflow.operators import scans
from rillflow.streaming import queues


@pytest.fixture(scope="module")
def tokens(spark):
    """One sequence of 4,000 tokens among short ones, over 8 range partitions."""
    r = random.Random(3)
    sizes = {1: 4000, None: 3, **{i: r.randint(1, 40) for i in range(2, 60)}}
    rows = [(s, p, s % 7 if s else None, int(r.random() < 0.8), r.gauss(0, 1), r.gauss(0, 1)) for s, n in sizes.items() for p in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "seq_id long, pos int, uid long, mask int, reward double, value double").repartition(6)


@pytest.fixture
def many(spark):
    """As many range partitions as rows allow: adaptive execution must not merge them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def sequences(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["seq_id"] is not None, r["seq_id"], r["pos"])):
        out.setdefault(r["seq_id"], []).append(r)
    return out


def gae(rows, gamma, lam):
    v = a = 0.0
    for r in reversed(rows):
        if r["mask"]:
            a = r["reward"] + gamma * v - r["value"] + gamma * lam * a
            v = r["value"]
        yield a


def whitened(pairs):
    x = np.array([p[0] for p in pairs if p[1]])
    return (x.mean(), np.sqrt(x.var(ddof=1) + 1e-8))


def test_gae_of_long_and_short_sequences(tokens, many):
    out = A.gae_tokens(tokens, 0.99, 0.95).collect()
    got = sequences(out)
    raw = {s: list(gae(rows, 0.99, 0.95))[::-1] for s, rows in got.items()}
    mu, sd = whitened([(a, r["mask"]) for s, rows in got.items() for a, r in zip(raw[s], rows)])
    assert len(out) == tokens.count()
    for s, rows in got.items():
        for a, r in zip(raw[s], rows):
            assert r["returns"] == pytest.approx(a + r["value"], abs=1e-9)
            assert r["advantages"] == pytest.approx((a - mu) / sd * r["mask"], abs=1e-6)


def test_long_and_array_forms_agree(tokens, many):
    short = tokens.where("seq_id < 20 or seq_id is null").withColumn("reward_baseline", F.lit(0.5))
    arrays = M.to_arrays(short.drop("reward_baseline"), ["seq_id", "uid"], ["mask", "reward", "value"]).withColumnsRenamed({"reward": "rewards", "value": "values"})
    pairs = {
        "gae": (A.gae_tokens(short, 0.9, 0.8), {"gamma": 0.9, "lam": 0.8}), "reinforce_plus_plus": (A.reinforce_plus_plus_tokens(short, 0.9), {"gamma": 0.9}),
        "remax": (A.remax_tokens(short), {}), "prime_rloo": (A.prime_rloo_tokens(short), {}),
    }
    for name, (out, options) in pairs.items():
        whole = A.compute(arrays.withColumn("reward_baseline", F.lit(0.5)), name, **options)
        want = {(r["seq_id"], r["pos"]): r for r in M.to_long(whole, ["seq_id"], ["advantages", "returns"]).collect()}
        rows = out.collect()
        assert len(rows) == len(want)
        for r in rows:
            w = want[r["seq_id"], r["pos"]]
            assert r["returns"] == pytest.approx(w["returns"], abs=1e-9) and r["advantages"] == pytest.approx(w["advantages"], abs=1e-6), name


@pytest.mark.parametrize("before", [False, True])
def test_running_sums_by_key(tokens, many, before):
    out = scans.running_sums(tokens, ["seq_id"], ["pos"], {"a": F.col("reward"), "n": F.lit(1)}, before).collect()
    for rows in sequences(out).values():
        a = 0.0
        for n, r in enumerate(rows):
            if before:
                assert r["n"] == n and r["a"] == pytest.approx(a, abs=1e-9)
            a += r["reward"]
            if not before:
                assert r["n"] == n + 1 and r["a"] == pytest.approx(a, abs=1e-9)


def bucket(rows, rate, capacity):
    level, clock, out = capacity, None, []
    for t, n in rows:
        now = t if clock is None else max(t, clock)
        level = min(capacity, level + (now - (now if clock is None else clock)) * rate)
        need = min(n, capacity)
        if level < need:
            now, level = now + (need - level) / rate, need
        level, clock = level - n, now
        out.append(now)
    return out


def test_token_bucket_with_a_hot_key(spark, many):
    r = random.Random(8)
    rows = [("hot" if i % 3 else r.choice(["a", "b", None]), r.random() * 500, r.choice([0.0, 1.0, 5.0, 30.0]) + r.random()) for i in range(3000)]
    rows += [("a", None, 1.0), ("b", 1.0, None)]
    out = queues.token_bucket(spark.createDataFrame(rows, "key string, t double, tokens double").repartition(5), 2.0, 20.0).collect()
    assert len(out) == len(rows)
    for key in ("hot", "a", "b", None):
        own = sorted((x["t"], x["tokens"], x["start"]) for x in out if x["key"] == key and x["t"] is not None and x["tokens"] is not None)
        assert [s for *_, s in own] == pytest.approx(bucket([x[:2] for x in own], 2.0, 20.0), abs=1e-6)
    assert [x["start"] for x in out if x["t"] is None or x["tokens"] is None] == [None, None]


def test_queues_with_a_hot_one(spark, many):
    r = random.Random(5)
    rows = [("hot" if i % 3 else r.choice(["a", "b", None]), i, r.choice(["put", "put", "get"] if (i // 400) % 2 else ["put", "get", "get", None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "queue string, seq long, kind string").repartition(5)
    for capacity in (1, 7):
        want = set()
        held = {}
        for q, i, kind in rows:
            own = held.setdefault(q, deque())
            if kind == "put":
                if len(own) == capacity:
                    want.add((q, own.popleft(), "dropped"))
                own.append(i)
            elif own:
                want.add((q, own.popleft(), "got"))
        want |= {(q, i, "queued") for q, own in held.items() for i in own}
        got = [tuple(x) for x in queues.drop_oldest(df, capacity).collect()]
        assert len(got) == len(want) and set(got) == want
    with pytest.raises(ValueError):
        queues.drop_oldest(df, 0)


def test_no_rows_and_one_row(spark):
    none = spark.createDataFrame([], "key string, t double, tokens double")
    assert queues.token_bucket(none, 1.0, 2.0).collect() == []
    assert queues.drop_oldest(spark.createDataFrame([], "queue string, seq long, kind string"), 2).collect() == []
    one = spark.createDataFrame([("a", 3.0, 9.0)], "key string, t double, tokens double")
    assert [x["start"] for x in queues.token_bucket(one, 1.0, 2.0).collect()] == [3.0]


@pytest.mark.parametrize("kind", [scans.Affine(2), scans.MaxPlus(2), scans.Clamp()])
@pytest.mark.parametrize("n", [1, 5, 127, 128, 129, 1000])
def test_prefixes_compose_row_by_row(kind, n):
    r = np.random.default_rng(n)
    maps = r.normal(size=(n, len(kind.identity)))
    if isinstance(kind, scans.Clamp):
        maps[:, 1:] = np.sort(maps[:, 1:], 1)
    first = r.random(n) < 0.02
    got, at = scans.prefixes(kind, maps, first), np.array(kind.identity)
    for i in range(n):
        at = maps[i] if first[i] else kind.compose(maps[i][None], at[None])[0]
        assert np.allclose(got[i], at)


def test_a_hot_key_runs_in_many_tasks(tokens, many, monkeypatch):
    written, plain = [], scans.materialise
    monkeypatch.setattr(scans, "materialise", lambda df, label: written.append(plain(df, label)) or written[-1])
    scans.running_sums(tokens, ["seq_id"], ["pos"], {"a": F.col("reward")})
    assert written[0].where("seq_id = 1").select("__q").distinct().count() >= 8
