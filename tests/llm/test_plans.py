"""Plans of the queries: native ones run no Python, none joins everything with everything, scans read what they need."""

import re

import pytest

from rillflow.llm import queries


def plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_interleaved_shards", "op2_poisson_mixture", "op5_line_dedup", "op9_quality_rules", "op10_decontamination"])
def test_native_plans(spark, sf_dir, name):
    text = plan(queries.queries()[name](spark, sf_dir))
    assert not re.search("Python|Pandas|Arrow(?!ow)", text) and not re.search("CartesianProduct|NestedLoop", text)


def test_rules_and_counts_never_shuffle(spark, sf_dir):
    for name in ("op3_token_counts", "op4_html_extraction", "op9_quality_rules"):
        assert "Exchange" not in plan(queries.queries()[name](spark, sf_dir))


def test_scans_read_two_columns_of_documents(spark, sf_dir):
    text = plan(queries.op9_quality_rules(spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)
    assert schema and {c.split(":")[0] for c in schema[1].split(",")} == {"doc_id", "text"}


def test_scratch_follows_the_setting(spark, tmp_path, monkeypatch):
    from rillflow import scratch
    from rillflow.llm import common

    plain = spark.conf.get
    monkeypatch.setattr(spark.conf, "get", lambda key, default=None: str(tmp_path) if key == "spark.checkpoint.dir" else plain(key, default))
    monkeypatch.setattr(scratch, "_scratch", {})
    t = common.materialise(spark.range(5), "five")
    assert t.scratch_path.startswith(str(tmp_path)) and t.count() == 5
    common.discard(t)
    assert not list(tmp_path.glob("*/five*"))
