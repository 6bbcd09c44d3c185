"""Ids of other types and columns named like the operators' own, for every operator and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillflow.llm import alignment, chat, decontaminate, html_extract, line_dedup, manifest, mixing, near_dedup, quality_model, quality_rules, sharding, token_counts, toxicity
from rillflow.llm.queries import BYTE_LEVEL, PIECES, VOCABULARY

#: What operators call their own columns, in the open and inside.
NAMES = (
    "id rate copy place shard slot score predicted held_out n h1 h2 bands sign rep root bucket band hub size u v text_crc hits items n_words n_tokens n_lines n_dropped "
    "w_hash w_width w_words w_set count row page html url key part total y label kept n_shingles component_id base_failed word_chars law size_ x e p i j side"
).split()
KEPT = {"shard", "slot", "copy", "n_lines", "n_dropped", "kept", "base_failed", "n_words", "word_chars"}  # replaced or added by some operator


@pytest.fixture(scope="module")
def wide(docs):
    out = docs
    for n in NAMES:
        out = out.withColumn(n, F.lit("own"))
    return out.withColumn("odd name: 1", F.lit("own")).withColumn("a.b", F.lit("own"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (6, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("a", "tied"), (None, "one line one line last"), ("b", None)], "item_id string, text string")


def operators(labels, bench):
    """Name to (function of the documents, whether it keeps their columns)."""
    return {
        "shard": (lambda d: sharding.shard(d, 3), True),
        "replicate": (lambda d: mixing.replicate(d, epochs=3.0), True),
        "mix": (lambda d: mixing.mix(d, epochs=3.0), True),
        "mixture_places": (lambda d: mixing.mixture_places(d, epochs=3.0), False),
        "count_tokens": (lambda d: token_counts.count_tokens(d, VOCABULARY), False),
        "extract": (lambda d: html_extract.extract(d, d.columns, html_col="text"), True),
        "line_dedup": (lambda d: line_dedup.drop_repeated_lines(d, 2, report=True), True),
        "toxicity": (lambda d: toxicity.score(d, toxicity.fit(d, labels), [f for f in d.columns if f != "text"]), True),
        "drop_toxic": (lambda d: toxicity.drop_toxic(d, labels, threshold=2.0), True),
        "near_duplicates": (lambda d: near_dedup.near_duplicates(d), False),
        "drop_near_duplicates": (lambda d: near_dedup.drop_near_duplicates(d), True),
        "quality": (lambda d: quality_model.score(d, quality_model.fit(d, labels)), False),
        "apply_rules": (lambda d: quality_rules.apply_rules(d), True),
        "keep_quality": (lambda d: quality_rules.keep_quality(d), True),
        "contamination": (lambda d: decontaminate.contamination(d, bench), False),
        "contamination_shuffled": (lambda d: decontaminate.contamination(d, bench, max_broadcast_bytes=0), False),
        "drop_contaminated": (lambda d: decontaminate.drop_contaminated(d, bench), True),
        "format_conversations": (lambda d: chat.format_conversations(d, conv_col="source", turn_col="doc_id", role_col="source"), False),
        "alignment": (lambda d: alignment.alignment(d, BYTE_LEVEL, PIECES), False),
        "manifest": (lambda d: manifest.verify(manifest.manifest(d, ["doc_id", "text"], part_col="source")), False),
        "remove_spans": (lambda d: decontaminate.remove_spans(d, bench), True),
    }


OPERATORS = sorted(operators(None, None))


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name(wide, docs, labels, bench, name):
    f, keeps = operators(labels, bench)[name]
    out = f(wide)
    plain = f(docs)
    assert out.count() == plain.count()
    if keeps:
        mine = [c for c in wide.columns if c not in docs.columns and c not in KEPT and c in out.columns and not (name == "toxicity" and c == "score")]
        assert len(mine) >= len(NAMES) - len(KEPT) - 1
        for row in out.select(*[F.col(f"`{c}`") for c in mine]).distinct().collect():
            assert set(row) == {"own"}


@pytest.mark.parametrize("name, kind", [*[(n, "string") for n in OPERATORS], ("near_duplicates", "decimal(10,0)"), ("line_dedup", "date"), ("shard", "int")])
def test_ids_of_any_type(docs, labels, bench, name, kind):
    of = lambda c: F.concat(F.lit("x"), c.cast("string")) if kind == "string" else F.date_add(F.lit("2020-01-01").cast("date"), c.cast("int")) if kind == "date" else c.cast(kind)
    f, _ = operators(labels.withColumn("doc_id", of(F.col("doc_id"))), bench)[name]
    table = docs.withColumn("doc_id", of(F.col("doc_id")))
    out = f(table)
    assert out.count() >= (name != "keep_quality")
    if "doc_id" in out.columns:
        assert out.schema["doc_id"].dataType == table.schema["doc_id"].dataType


def test_pipeline_keeps_columns_of_any_name(spark, wide, sf_dir):
    docs = wide
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert set(docs.columns) == set(wide.columns)
    assert all(r["rate"] == "own" and r["a.b"] == "own" for r in docs.select("rate", "`a.b`").collect())


def test_documents_of_a_single_very_long_text(spark, labels, bench):
    """1 MB of words, and 1 MB without white space."""
    rows = [(1, "word " * 200_000, "a"), (2, "x" * 1_000_000, "a"), (3, "\n" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1)
    for name, (f, _) in operators(labels, bench).items():
        assert f(df).count() >= (1 if name not in ("keep_quality",) else 0), name
