"""The pipeline's stages, each against brute force on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from rillflow.llm.common import materialise
from tests.llm.test_native import brute_hits, sf_rows
from tests.llm.test_near import brute


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for name in ("toxicity", "near_dedup", "decontamination", "mixing"):
        before, docs = docs, materialise(stages[name](spark, docs, sf_dir), name)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        kept[name] = docs
        if name == "near_dedup":
            rows = brute([(r["doc_id"], r["text"]) for r in before.collect()], num=80)
            assert ids(docs) == {i for i, _, _, keep in rows if keep}
        if name == "decontamination":
            rows = [tuple(r) for r in before.collect()]
            hits = brute_hits(rows, sf_rows(spark, sf_dir, "benchmark"))
            assert ids(docs) == {r[0] for r in hits if r[2] == 0}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stays = ids(kept["toxicity"])
    assert sum(labels[i] == 0 and i not in stays for i in labels) <= 2
    texts = {r["doc_id"]: tuple(r) for r in kept["decontamination"].collect()}
    assert all(tuple(r) == texts[r["doc_id"]] for r in kept["mixing"].collect())
    out = stages["sharding"](spark, docs, sf_dir)
    sizes = Counter(r["shard"] for r in out.collect())
    assert sum(sizes.values()) == docs.count() and max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1


def test_corner_cases(spark, docs, empty, sf_dir):
    for table, n in ((docs, 1), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            assert out.columns[: len(table.columns)] == table.columns and out.count() >= (n if name != "mixing" else 0)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 50


def test_odd_and_clashing_columns(spark, docs, sf_dir):
    names = ["shard", "slot", "copy", "score", "id", "row", "n_words", "kept", "odd name: 1", "a.b"]
    wide = docs
    for n in names:
        wide = wide.withColumn(n, docs["doc_id"])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns if name != "sharding" else set(out.columns) == set(wide.columns)
        assert out.count() >= (name != "mixing")
