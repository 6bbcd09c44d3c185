"""Operators without Python, against brute force in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rillflow.llm import decontaminate, line_dedup, mixing, quality_rules, queries, sharding

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
lower = lambda t: t.translate(str.maketrans(UP, LOW))
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def sf_rows(spark, sf_dir, name="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


def brute_lines(rows, least):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    bad = {k for k, v in seen.items() if len(k) >= 1 and len(v) >= least}
    out = []
    for i, t, *_ in rows:
        x = (t or "").split("\n")
        kept = [y for y in x if key(y) not in bad]
        out.append((i, len(x), len(x) - len(kept), sha("\n".join(kept))))
    return Counter(out)


def run_lines(df, least):
    out = line_dedup.drop_repeated_lines(df, min_docs=least, report=True)
    assert {c for c in out.columns} == {*df.columns, "n_lines", "n_dropped"}
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256))
    return Counter(tuple(r) for r in got.collect())


def test_line_dedup(docs, rows, empty, spark, sf_dir):
    for least in (1, 2, 3):
        assert run_lines(docs, least) == brute_lines(rows, least)
    assert run_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), 10) == brute_lines(sf_rows(spark, sf_dir), 10)
    assert run_lines(empty, 2) == Counter()


def brute_rules(text):
    text = text or ""
    w = re.findall(WORD, text)
    spans = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {s for s, n in Counter(spans).items() if n > 1}
    hit = {j for i, s in enumerate(spans) if s in twice for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def test_quality_rules(docs, rows, empty, spark, sf_dir):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df, data in ((docs, rows), (spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_rows(spark, sf_dir)), (empty, [])):
        out = quality_rules.apply_rules(df)
        got = Counter(tuple(r) for r in out.select("doc_id", *names).collect())
        assert got == Counter((r[0], *brute_rules(r[1])) for r in data)
        assert out.where("base_failed and kept").count() == 0
    assert quality_rules.keep_quality(docs.withColumn("n_words", F.lit("mine"))).columns == docs.columns + ["n_words"]


def test_quality_rules_spare_clean_documents(spark, sf_dir):
    judged = quality_rules.apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = judged.join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert clean.count() > 20 and clean.where("not kept").count() == 0
    assert judged.join(labels, "doc_id").where("quality = 0 and kept").count() <= 2


def brute_hits(docs, items, width=10):
    token = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(token, lower(t or ""))
        k = min(width, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    out = []
    for i, t, *_ in docs:
        w = re.findall(token, lower(t or ""))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)))))
    return Counter(out)


def run_hits(docs, items, **options):
    found = decontaminate.contamination(docs, items, **options)
    got = found.select("doc_id", "n_words", F.size("hits"), F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256))
    return Counter(tuple(r) for r in got.collect())


def test_decontamination(docs, rows, empty, spark, sf_dir):
    items = [(1, "Beta GAMMA, delta"), (10, "tied"), (2, None), (3, "..."), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa alpha"), (12, "É a"), (13, "same id another text of a few more words here and on")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert run_hits(docs, bench) == brute_hits(rows, items)
    assert run_hits(docs, bench, max_broadcast_bytes=0) == brute_hits(rows, items)
    assert run_hits(docs, bench.limit(0)) == brute_hits(rows, [])
    assert run_hits(empty, bench) == Counter()
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert run_hits(*whole) == brute_hits(sf_rows(spark, sf_dir), sf_rows(spark, sf_dir, "benchmark"))
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {3, 4, 5, 6, 10, 11, None}


def test_a_passage_in_every_item_and_a_third_of_the_documents(spark):
    """The broadcast holds its windows once; documents meet the items as one set."""
    passage = " ".join(f"p{i}" for i in range(14))
    items = [(f"i{k}", f"own{k} words{k} {passage} end{k}") for k in range(120)] + [(None, passage), ("short", "p1 p2 p3")]
    rows = [(f"d{k}", (f"start{k} {passage} then x{k} " * (1 + k % 3)) if k % 3 == 0 else f"nothing here {k}", None) for k in range(90)] + [(None, None, None), ("d0", None, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    for options in ({}, {"max_broadcast_bytes": 0}):
        assert run_hits(df, bench, **options) == brute_hits(rows, named)
    windows, sets = decontaminate.benchmark_windows(bench)
    assert windows.count() == windows.select("w_words").distinct().count() and decontaminate.broadcast_bytes(windows) < 500 * windows.count()
    assert sets.agg(F.sum(F.size("items"))).first()[0] < 500


def test_remove_spans(spark):
    df = spark.createDataFrame([(1, "Keep this. ALPHA beta, gamma! and this"), (2, None), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r[0]: r[1] for r in decontaminate.remove_spans(df, bench).collect()}
    assert got == {1: "Keep this. and this", 2: None, 3: "nothing"}


def test_shards(docs, rows, empty, spark, sf_dir):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, n, k in ((docs, len(rows), 3), (whole, 200, 7), (docs, len(rows), 40)):
        out = sharding.shard(df, k)
        assert out.columns == df.columns + ["shard", "slot"]
        got = [(r["shard"], r["slot"]) for r in out.collect()]
        sizes = Counter(s for s, _ in got)
        assert len(got) == n == len(set(got)) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(k)) <= 1
        assert all(slot < sizes[s] for s, slot in got)
        assert sorted(got) == sorted((r["shard"], r["slot"]) for r in sharding.shard(df.repartition(5), k).collect())
    assert sharding.shard(empty, 4).count() == 0
    mixture = Counter((r["shard"], r["source"]) for r in sharding.shard(whole, 4).collect())
    for source, n in Counter(r["source"] for r in whole.collect()).items():
        assert all(abs(mixture[s, source] - n / 4) < 2 for s in range(4))


def test_shard_query_matches_plain_python(spark, sf_dir):
    data = sf_rows(spark, sf_dir)
    by = defaultdict(list)
    for i, t, lang, source, n in data:
        by["n" if source is None else "s" + source].append((hashlib.md5(f"shard:{i}".encode()).hexdigest(), i))
    order = sorted(((2 * r + 1) / (2 * len(v)), k, h, i) for k, v in by.items() for r, (h, i) in enumerate(sorted(v)))
    n = len(order)
    shard = {i: p * 40 // n for p, (*_, i) in enumerate(order)}
    slot = {i: p - -(-(p * 40 // n) * n // 40) for p, (*_, i) in enumerate(order)}
    texts = {i: (t or "").encode() for i, t, *_ in data}
    got = {tuple(r) for r in queries.op1_interleaved_shards(spark, sf_dir).collect()}
    assert got == {(i, len(x) + 16, zlib.crc32(x), "rows", shard[i], slot[i], None) for i, x in texts.items()}


def test_poisson_mixture(docs, empty, spark, sf_dir):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = {"src0": 3.0, "src1": 1.0}
    out = mixing.replicate(whole, weights=weights, epochs=40.0)
    by = Counter(r["source"] for r in out.collect())
    assert set(by) == {"src0", "src1"} and abs(by["src0"] / sum(by.values()) - 0.75) < 0.02 and abs(sum(by.values()) - 8000) < 400
    # The draw of a document is the inverse of the distribution at its hash.
    rates = {r["__part"]: r["__rate"] for r in mixing.rates(whole, temperature=0.5).collect()}
    got = Counter(r["doc_id"] for r in mixing.replicate(whole, temperature=0.5, epochs=1.0).collect())
    from math import exp

    for r in whole.collect():
        u = int(hashlib.md5(f"mix:{r['doc_id']}:1".encode()).hexdigest()[:13], 16) / 2**52
        mean, k, c, p = rates["s" + r["source"]], 0, 0.0, 0.0
        p = c = exp(-mean)
        while c <= u:
            k, p = k + 1, p * mean / (k + 1)
            c += p
        assert got[r["doc_id"]] == k
    salted = mixing.replicate(whole, max_broadcast_sources=0)
    assert Counter(r["doc_id"] for r in salted.collect()) == got
    places = [r["place"] for r in mixing.mixture_places(whole).collect()]
    assert sorted(places) == list(range(len(places)))
    assert mixing.mix(docs, epochs=3.0).columns == docs.columns
    assert mixing.mix(docs.withColumn("copy", F.lit("x")), epochs=3.0).where("copy <> 'x'").count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixture_places(empty).count() == 0


def test_lists_of_items_are_put_together_once_for_documents_that_share_them(spark):
    """A passage that every item and most documents hold: one union, however many documents."""
    passage = " ".join(f"p{i}" for i in range(12))
    bench = spark.createDataFrame([(f"i{k}", f"{passage} own{k} " + " ".join(f"q{k}x{j}" for j in range(10))) for k in range(40)], "item_id string, text string")
    rows = [(i, f"a b {passage} c{i}") for i in range(200)] + [(1000, " ".join(f"q7x{j}" for j in range(10))), (1001, "nothing"), (1002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r["items"] for r in decontaminate.contamination(docs, bench).collect()}
    assert whole[0] == sorted(f"i{k}" for k in range(40)) and whole[1000] == ["i7"] and whole[1001] == whole[1002] == []
    short = decontaminate.contamination(docs, bench, lists=False)
    for r in short.collect():
        want = whole[r["doc_id"]]
        assert r["n_items"] == len(want) and r["items_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    text = short._jdf.queryExecution().executedPlan().toString()
    assert "flatten" not in text and "collect_list" not in text
