"""The manifest against a tree built row by row in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def others(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        first = at // fanout * fanout
        out.append((nodes[first:at], nodes[at + 1 : first + fanout]))
        at //= fanout
    return out


def changed(row):
    if row[0] is None or row[3] is None or zlib.crc32(str(row[0]).encode()) % 7:
        return row
    return (*row[:3], row[3] + 1, row[4])


def brute(rows, fanout):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(parts, key=lambda n: (n is not None, (n or "").encode()))
    parts = {n: sorted(parts[n], key=lambda x: x[:3]) for n in names}
    trees = {n: tree([x[2] for x in parts[n]], fanout) for n in names}
    top = tree([trees[n][-1][0] for n in names], fanout)
    out = []
    for place, n in enumerate(names):
        for at, (*_, own, row) in enumerate(parts[n]):
            path = others(trees[n], at, fanout) + others(top, place, fanout)
            folded = leaf(changed(row))
            for left, right in path:
                folded = digest("".join([*left, folded, *right]))
            proof = digest("".join("".join([*left, *right]) for left, right in path))
            out.append((row[0], own, trees[n][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def run(df, fanout=2, block=manifest.BLOCK):
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(marked, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    own = manifest.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    out = manifest.verify(manifest.manifest(df, FIELDS, fanout=fanout, block=block, found=own), "found", fanout)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("p"), "folded_root", "verified")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def made(n, seed=1):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    return [(pick(None, *range(60)), pick(None, "a", "ü"), pick(None, "", "en", "en", "é", "zz"), pick(None, 3, 5), pick(None, "", "x y", "\n")) for _ in range(n)]


@pytest.mark.parametrize("fanout, block, n", [(2, 1024, 50), (2, 4, 300), (3, 9, 200), (4, 4, 77), (2, 2, 1)])
def test_equals_a_plain_tree(spark, fanout, block, n):
    rows = made(n)
    got = run(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout, block)
    assert plain(got.collect()) == plain(brute(rows, fanout))


def test_odd_rows(spark, docs, rows, empty):
    own = [(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    assert plain(run(docs).collect()) == plain(brute(own, 2))
    assert run(empty).collect() == []


def test_equal_rows_and_one_hot_part(spark):
    """A third of the rows are one row, and all share a part; blocks of 16 leaves make several rounds."""
    rows = [(7, "s", "en", 1, "same")] * 200 + [(i, "s", "en", i, f"text {i}") for i in range(400)]
    got = run(spark.createDataFrame(rows, SCHEMA).repartition(5), block=16)
    assert plain(got.collect()) == plain(brute(rows, 2))


def test_ids_and_parts_of_other_types_and_clashing_names(spark):
    df = spark.createDataFrame([("b", 2, "x", "own"), ("a", 10, "y", "own"), ("a", None, None, "own")], "id string, pos int, root string, proof string")
    out = manifest.verify(manifest.manifest(df, ["id", "root"], part_col="pos", id_col="id")).collect()
    assert all(r["verified"] for r in out) and {(r["id"], r["part"]) for r in out} == {("b", "2"), ("a", "10"), ("a", None)}
    assert len({r["root"] for r in out}) == 1 and {r["n_tops"] for r in out} == {3}


def test_a_changed_sibling_is_noticed(spark):
    proofs = manifest.manifest(spark.createDataFrame(made(40), SCHEMA), FIELDS)
    broken = proofs.where("length(proof) > 0").withColumn("proof", F.concat(F.lit("0"), F.expr("substring(proof, 2)")))
    wrong = manifest.verify(broken)
    assert wrong.where("verified").count() <= 4  # where the first digit was a 0 already


def test_siblings_of_a_matrix():
    digests = np.frombuffer("".join(digest(str(i)) for i in range(11)).encode(), np.uint8).reshape(-1, manifest.HEX)
    levels = manifest.hash_levels(digests, 3, 3)
    assert [len(x) for x in levels] == [11, 4, 2, 1]
    found, there = manifest.siblings(levels, 3)
    for i in range(11):
        want = "".join("".join([*a, *b]) for a, b in others(tree([digest(str(j)) for j in range(11)], 3), i, 3))
        assert found[i][there[i]].tobytes().decode() == want


def test_no_single_task_and_no_join_of_everything(spark, sf_dir):
    from rillflow.llm import queries

    df = queries.op13_merkle_manifest(spark, sf_dir)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
