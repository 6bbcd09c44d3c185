"""Classifiers: accuracy on rows that were held out, and the corner cases."""

import numpy as np
from pyspark.sql import functions as F

from rillflow.llm import quality_model, toxicity


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def judged(spark, sf_dir, run, label):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = run(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    assert out.where("not (score between 0 and 1)").count() == 0
    got = out.where("held_out").join(labels, "doc_id").select(label, "score", "predicted").toPandas()
    return got[label].to_numpy(), got["score"].to_numpy(), got["predicted"].to_numpy()


def test_toxicity_held_out(spark):
    y, s, p = judged(spark, "/root/testdata/sf0.1", toxicity.toxicity, "toxic")
    assert auc(y, s) > 0.97 and (p == y).mean() > 0.97 and p[y == 1].mean() > 0.85


def test_quality_held_out(spark):
    y, s, p = judged(spark, "/root/testdata/sf0.1", quality_model.quality, "quality")
    assert auc(y, s) > 0.97 and (p == y).mean() > 0.95


def test_corner_cases(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (9, None, None), (None, 1, 1), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for run in (toxicity.toxicity, quality_model.quality):
        assert run(docs, labels).count() == docs.count()
        assert run(docs, labels.limit(0)).where("score <> 0").count() == 0
        assert run(empty, labels).count() == 0
        # Neither other columns nor the order of rows matter.
        a = run(docs, labels).orderBy("doc_id", "score").collect()
        b = run(docs.repartition(5).withColumn("score", F.lit("own")), labels).orderBy("doc_id", "score").collect()
        assert a == b
    out = toxicity.drop_toxic(docs.withColumn("score", F.lit("own")), labels, threshold=2.0)
    assert out.columns == [*docs.columns, "score"] and out.count() == docs.count()


def test_toxicity_fits_on_up_to_16000_rows(spark):
    from rillflow.llm.labelled import fit_rows

    labels = spark.range(25000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    docs = labels.selectExpr("doc_id", "'text' as text")
    assert fit_rows(docs, labels, "toxic", toxicity.Ftrl().max_rows).count() == 16000


def codes_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return sorted(set(toxicity.features(data, np.array([0, len(data)]))[0].tolist()))


def test_features_are_words_runs_and_skips():
    import re

    text = "One two, THREE four; one two three: five-six É"
    w = [x.lower() if x.isascii() else x for x in re.findall(r"[A-Za-z0-9]+|É", text)]
    grams = {(x,) for x in w} | {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    grams |= {(gap, w[i], w[i + gap]) for gap in (1, 2, 3) for i in range(len(w) - gap)}
    assert len(codes_of(text)) == len(grams)
    assert codes_of("a b c") == codes_of("A, b;\nC") != codes_of("a c b")


def plain_ftrl(rows, o):
    """Scores' weights by the rule as it is written, one coordinate after another."""
    from math import exp, sqrt

    z, n, zb, nb = {}, {}, 0.0, 0.0

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= o.l1 else -(v - (o.l1 if v > 0 else -o.l1)) / ((o.beta + sqrt(n[i])) / o.alpha + o.l2)

    def value(i):
        return 1.0 if i < toxicity.RUNS else o.run_value

    for _ in range(o.epochs):
        for codes, y in rows:
            bias = -zb / ((o.beta + sqrt(nb)) / o.alpha)
            p = 1 / (1 + exp(-max(-35, min(35, sum(weight(i) * value(i) for i in codes) + bias))))
            e = (p - y) * (o.toxic_weight if y else 1.0)
            for i in codes:
                old, w, g = n.get(i, 0.0), weight(i), e * value(i)
                z[i] = z.get(i, 0.0) + g - (sqrt(old + g * g) - sqrt(old)) / o.alpha * w
                n[i] = old + g * g
            zb, nb = zb + e - (sqrt(nb + e * e) - sqrt(nb)) / o.alpha * bias, nb + e * e
    bias = -zb / ((o.beta + sqrt(nb)) / o.alpha)
    return lambda codes: 1 / (1 + exp(-max(-35, min(35, sum(weight(i) * value(i) for i in codes if i in n) + bias))))


def test_learner_and_scores_equal_plain_ftrl(spark, sf_dir):
    from rillflow.llm.labelled import fit_rows

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    for o in (toxicity.Ftrl(), toxicity.Ftrl(alpha=0.5, l1=0.5, l2=1.0, epochs=2)):
        rows = sorted(fit_rows(docs, labels, "toxic", o.max_rows).collect())
        score = plain_ftrl([(codes_of(r["text"]), r["y"]) for r in rows], o)
        got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels, o).collect()}
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        assert len(got) == len(texts) and all(abs(got[i] - score(codes_of(t))) < 1e-9 for i, t in texts.items())


def test_additive_scores_equal_plain_sums(spark, sf_dir):
    from bisect import bisect_right
    from math import exp

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit(docs, labels)
    bias, edges, tables, coarse, pairs, pair_tables = model
    stops = quality_model._stops()
    got = {r["doc_id"]: r["score"] for r in quality_model.score(docs, model).collect()}
    for r in docs.collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        x = quality_model.features(data, np.array([0, len(data)]), stops)[0]
        total = bias + sum(t[bisect_right(e.tolist(), v)] for e, t, v in zip(edges, tables, x))
        rough = [bisect_right(e.tolist(), v) for e, v in zip(coarse, x)]
        total += sum(t[rough[a] * (len(coarse[b]) + 1) + rough[b]] for (a, b), t in zip(pairs, pair_tables))
        assert abs(got[r["doc_id"]] - 1 / (1 + exp(-max(-35, min(35, total))))) < 1e-9


def test_boosted_tables_fit_a_step_and_a_pair():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells it alone
    model = quality_model.fit_tables(x, y)
    assert ((quality_model.add_up(x, model) >= 0.5) == y).mean() > 0.97 and model[4][0] == (0, 1)
    step = quality_model.fit_tables(x, (x[:, 2] > 0.3).astype(float))
    assert ((quality_model.add_up(x, step) >= 0.5) == (x[:, 2] > 0.3)).mean() > 0.97


def test_fit_set_is_bounded_in_rows_and_bytes(spark):
    from rillflow.llm.labelled import fit_rows

    labels = spark.range(1, 40).selectExpr("id as doc_id", "1 as toxic").unionByName(spark.createDataFrame([(3, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int"))
    docs = spark.range(0, 40 * 50).selectExpr("id % 40 as doc_id", "repeat('word ', cast(id div 40 as int)) as text")
    docs = docs.unionByName(spark.createDataFrame([(7, None)], "doc_id long, text string"))
    rows = fit_rows(docs, labels, "toxic", 2).collect()
    assert len(rows) == 2
    rows = fit_rows(docs.withColumn("text", F.lit("12345678")), labels, "toxic", 30, max_bytes=100).collect()
    assert len(rows) == 12
    every = fit_rows(docs, labels, "toxic", 1000).collect()
    assert len(every) == len({r["place"] for r in every}) and all(r["text"] == "" for r in every)
