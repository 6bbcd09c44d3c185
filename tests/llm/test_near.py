"""MinHash near-dedup against components of all exact links."""

import re

import pytest
from pyspark.sql import functions as F

from rillflow.llm import near_dedup

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UP, LOW)))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, num=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets:
        if s and i is not None:
            by.setdefault(s, set()).add(i)
    distinct = [(min(v), s, v) for s, v in by.items()]
    index = {}
    for k, (_, s, v) in enumerate(distinct):
        near = set()
        for x in s:
            near.update(index.get(x, ()))
            index.setdefault(x, []).append(k)
        for j in near:
            t = distinct[j][1]
            both = len(s & t)
            if 100 * both >= num * (len(s) + len(t) - both):
                lo, hi = sorted((find(distinct[j][0]), find(min(v))))
                parent[hi] = lo
    for i, s in sets:  # an id with several texts is one document
        if s and i is not None:
            lo, hi = sorted((find(i), find(min(by[s]))))
            parent[hi] = lo
    root = lambda i, s: i if i is None else find(i)
    return sorted(((i, len(s), root(i, s), root(i, s) == i) for i, s in sets), key=str)


def run(df, **options):
    return sorted((tuple(r) for r in near_dedup.near_duplicates(df, **options).collect()), key=str)


def test_corner_cases(docs, rows, empty):
    assert run(docs) == brute([(r[0], r[1]) for r in rows])
    assert run(empty) == []
    kept = near_dedup.drop_near_duplicates(docs.withColumn("n", F.lit("own")))
    assert kept.columns == docs.columns + ["n"] and {r[0] for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, None, 9, 10, 11}
    assert sorted(r["text"][:8] for r in kept.where("doc_id = 7").collect()) == ["the same"]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("options", [{}, {"block": 8, "text_block": 8}, {"block": 50, "block_bytes": 20_000}, {"block": 3, "most": 7, "text_block": 2}])
def test_group_of_near_copies_of_which_few_are_near_each_other(spark, options):
    """Copies of one text with 1 to 9 words changed, in short chains: hubs alone don't find all links."""
    import random

    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        text = list(base if i % 4 or not rows else rows[r.randrange(len(rows))][1].split())
        for j in r.sample(range(150), r.randrange(1, 10) if i % 4 else 1):
            text[j] = f"x{r.randrange(10**6)}"
        rows.append((1000 + (i * 37) % 120, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = near_dedup.Plan(**options)
    assert run(df, plan=plan) == brute(rows)


def test_large_bucket_of_long_texts_that_are_hardly_near(spark):
    """Long texts of one template, most of them just under the threshold: all in shared buckets, few linked."""
    import random

    r = random.Random(8)
    base = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(60):
        text = list(base)
        for j in r.sample(range(4000), 30 + 5 * (i % 12)):
            text[j] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 1 < sum(r[3] for r in want) < 60
    assert run(df, plan=near_dedup.Plan(block=16, text_block=16, block_bytes=200_000)) == want


def measured(similarity, pairs, plan=near_dedup.PRODUCTION, union=200, seed=0):
    """How many pairs of sets of exactly this similarity share no bucket, and how many fail the signature test."""
    import numpy as np

    k = plan.bands * plan.rows
    mult = (near_dedup.W.constants(7, k) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (near_dedup.W.constants(8, k) >> np.uint64(32)).astype(np.uint32)
    both = round(similarity * union)
    one = (union - both) // 2
    r, apart, unlike = np.random.default_rng(seed), 0, 0
    for _ in range(pairs):
        x = r.integers(0, 2**63, union, dtype=np.uint64)
        a, b = (near_dedup.minima(s, mult, add) for s in (x[: both + one], np.concatenate([x[:both], x[both + one :]])))
        same = a == b
        apart += not same.reshape(plan.bands, plan.rows).all(axis=1).any()
        unlike += (a[: plan.n_sign].astype(np.uint16) == b[: plan.n_sign].astype(np.uint16)).sum() < plan.least_agree
    return apart, unlike


def test_pairs_at_the_threshold_share_a_bucket_and_agree():
    for similarity in (0.85, 0.87):
        assert measured(similarity, 4000) == (0, 0)
    assert measured(0.8, 4000, near_dedup.DROPPING) == (0, 0)
    assert measured(0.5, 200)[1] == 200  # and others don't


def test_ids_of_any_type(spark, rows):
    named = [(None if r[0] is None else f"id{r[0]}", r[1]) for r in rows]
    df = spark.createDataFrame(named, "doc_id string, text string")
    out = near_dedup.near_duplicates(df)
    assert out.schema["component_id"].dataType.simpleString() == "string"
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(named)
    kept = near_dedup.drop_near_duplicates(df)
    assert {r[0] for r in kept.collect()} == {f"id{i}" for i in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11)} | {None}
    whole = df.selectExpr("cast(substring(doc_id, 3) as int) as doc_id", "text")
    assert run(whole) == brute([(None if i is None else int(i[2:]), t) for i, t in named])


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(10, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["id"]: r["root"] for r in near_dedup.components(df).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {i: 100 for i in range(100, 140)}


def test_ids_with_several_texts(spark):
    """Every text that goes has a copy, or a near one, that stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (3, a), (5, b), (9, b), (9, c), (9, c), (None, a), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute(rows)
    assert {r[0]: r[2] for r in run(df)} == {5: 3, 3: 3, 9: 3, None: None, 7: 7}
    kept = near_dedup.drop_near_duplicates(df, plan=near_dedup.PRODUCTION).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(3, a), (5, b), (9, c), (9, c), (0, a), (7, ""), (7, "")])


def test_one_id_for_most_rows(spark):
    import random

    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = [w if r.random() < 0.995 else f"x{r.randrange(10**6)}" for w in base] if i % 2 else [f"y{r.randrange(10**6)}" for _ in range(60)]
        rows.append((1 if i % 3 else 100 + i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df) == brute(rows)
    kept = [(x["doc_id"], shingles(x["text"])) for x in near_dedup.drop_near_duplicates(df, plan=near_dedup.PRODUCTION).collect()]
    alike = lambda s, t: 100 * len(s & t) >= 85 * len(s | t)
    near = {i: {j for j, (_, t) in enumerate(rows) if alike(shingles(rows[i][1]), shingles(t))} for i in range(len(rows))}
    reach = {}
    for i in range(len(rows)):
        if i not in reach:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            reach |= dict.fromkeys(seen, min(seen))
    groups = {}
    for i, root in reach.items():
        groups.setdefault(root, []).append(i)
    got = {(d, s) for d, s in kept}
    for members in groups.values():
        assert sum((rows[i][0], shingles(rows[i][1])) in got for i in members) == 1
