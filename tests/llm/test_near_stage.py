"""The pipeline's near_dedup stage against all exact links at a similarity of 0.8 or more."""

import corpus_pipeline
from tests.llm.test_near import shingles


def kept_at(rows, num, den):
    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            both = len(s & t)
            if s and both and den * both >= num * (len(s) + len(t) - both):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i for i in root if find(i) == i}


def test_stage_drops_near_copies_from_four_fifths_on(spark):
    """Texts of 200 shingles and copies with 3 to 5 words changed: similarity 0.86, 0.82, 0.80 and 0.78."""
    rows = []
    for g, changed in enumerate((3, 4, 4, 5)):
        base = [f"w{g}x{i}" for i in range(204)]
        copy = [f"y{w}" if i % 20 == 10 and i // 20 < changed else w for i, w in enumerate(base)]
        if g == 2:  # 178 of 222 shingles
            copy[-2] = "z"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert got == kept_at(rows, 4, 5)
    assert kept_at(rows, 4, 5) < kept_at(rows, 85, 100)


def test_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == kept_at(rows, 4, 5)
    assert len(kept_at(rows, 85, 100)) > len(got)
