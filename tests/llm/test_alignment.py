"""The alignment against offsets of whole texts, with the two public tokenizers."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rillflow.llm import alignment
from rillflow.llm.queries import BYTE_LEVEL, PIECES

ODD = [
    "a", " ", "  ", " a", "a ", "a  b", "a   b c", "x\ny", "x \n y", "\n\n x", "tab\tand nbsp x   y", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll I'd",
    "déjà vu naïve", "日本語 テキスト です", "emoji 😀😀 👩‍👩‍👧 x", "zero\x00byte", "\x1c x \x1f", "a▁b", "café", "1234567890 12 345", "!!!??? ...", "ﬁ Å Å ½", "​ x   y", "﻿bom", "ẞ İ ı", "a" * 3000,
    "ab " * 700, "x" + " " * 300 + "y", "한국어 　 全角", "\\n \\ // <turn", "🂡" * 40,
]


@pytest.fixture(scope="module")
def own():
    with open(BYTE_LEVEL, "rb") as f, open(PIECES, "rb") as g:
        return alignment.Aligner(f.read(), g.read())


def links(own, text):
    """(n_a, n_b, groups text, Counter of id pairs) from the offsets of the whole text's tokens; None without tokens."""
    if not text:
        return None
    a, b, whole = own.a.encode([text])[0], own.b.encode([text])[0], (" " + text).encode()
    if b"".join(own.a.bytes[i] for i in a) != whole or b"".join(own.b.bytes[i] for i in b) != whole:
        return None
    ends = []
    for ids, table in ((a, own.a.bytes), (b, own.b.bytes)):
        at, out = 0, []
        for i in ids:
            at += len(table[i])
            out.append(at)
        ends.append(out)
    both, groups, count = sorted(set(ends[0]) & set(ends[1])), [], Counter()
    i = j = 0
    for end in both:
        ga = [x for x, e in zip(a[i:], ends[0][i:]) if e <= end]
        gb = [x for x, e in zip(b[j:], ends[1][j:]) if e <= end]
        i, j = i + len(ga), j + len(gb)
        groups.append((ga, gb))
        count.update((x, y) for x in ga for y in gb)
    return len(a), len(b), len(groups), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), count


def brute(own, rows):
    found = [(i, links(own, t)) for i, t in rows]
    held = Counter(p for _, x in found if x for p in x[4])
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(k for p, k in x[4].items() if held[p] == most[p[0]])
        out.append((i, x[0], x[1], x[2], sum(x[4].values()), best, sum(k * held[p] for p, k in x[4].items()), hashlib.sha256(x[3].encode()).hexdigest()))
    return out


def run(df, **more):
    out = alignment.alignment(df, BYTE_LEVEL, PIECES, **more)
    return sorted((tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def mixed(n, seed=2):
    r = random.Random(seed)
    letters = "abcdeéß日 \n\t  .,'1🙂"
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1 << 18, 50, 0])
def test_equals_offsets_of_whole_texts(spark, own, rows, most):
    texts = [(i, t) for i, t in enumerate([*ODD, *mixed(150), None, "", *ODD[:5]])] + [(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 9000]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert run(df, max_pairs=most) == sorted(brute(own, texts), key=repr)


def test_segments_encode_as_whole_texts_do(own):
    for text in [*ODD, *mixed(2000, 5)]:
        found = own.slice([text])[0]
        want = links(own, text)
        assert (found is None) == (want is None), text
        if want:
            assert ";".join(f.text for f in found) == want[3], text


def test_empty_table(spark, empty):
    assert run(empty) == []


def test_many_pairs_come_in_parts(own, monkeypatch):
    """Groups too wide to keep their pairs, and documents whose pairs come in several rows."""
    monkeypatch.setattr(alignment, "WIDE", 80)
    monkeypatch.setattr(alignment, "PAIRS", 40)
    own.kept, own.older, own.held = {}, {}, 0
    for text in ["x" * 500 + "abc" * 50 + " déjà vu", "日本語のテキスト" * 20, *mixed(50, 9)]:
        parts = list(own.pairs_of(own.slice([text])[0]))
        got = {int(p): int(t) for pairs, times in parts for p, t in zip(pairs, times)}
        assert len(got) == sum(len(p) for p, _ in parts)
        assert got == {a * own.wide + b: n for (a, b), n in links(own, text)[4].items()}
    own.kept, own.older, own.held = {}, {}, 0


def test_documents_in_several_rows(spark, own, monkeypatch):
    texts = [(i, t) for i, t in enumerate(["日本語のテキスト" * 30 + " déjà vu and more words", *mixed(40, 3)])]
    found = alignment.align(spark.createDataFrame(texts, "doc_id long, text string"), BYTE_LEVEL, PIECES, groups=True)
    got = {r["id"]: r["groups"] for r in found.where("head").collect()}
    assert got == {i: links(own, t)[3] if links(own, t) else "" for i, t in texts}


def test_memory_is_let_go_without_a_trace(own, monkeypatch):
    texts = mixed(300, 11)
    first = [[f.text for f in x] if x else None for x in own.slice(texts)]
    monkeypatch.setattr(alignment, "KEEP_BYTES", 0)
    for _ in range(3):
        assert [[f.text for f in x] if x else None for x in own.slice(texts)] == first
    own.slice(["other words"])
    own.slice(["more words"])
    assert len(own.kept) + len(own.older) < 8


def test_transducer_by_hand():
    m = alignment.Transducer([b"ab", b"c", b"abcd"], [b"a", b"bc", b"d", b"abc"])
    assert m.groups([0, 1, 0, 1], [0, 1, 3]) == [(2, 2), (4, 3)]
    assert m.groups([2, 0, 1], [3, 2, 0, 1]) == [(1, 2), (3, 4)]
    with pytest.raises(ValueError):
        m.groups([0], [2])


def test_ids_of_any_type_and_columns_of_any_name(spark, own):
    df = spark.createDataFrame([("x", "one two", "own", "own"), (None, "one", "own", "own")], "doc_id string, text string, pair string, row string")
    assert {r[0] for r in run(df)} == {"x", None}
    out = alignment.alignment(df.withColumn("row", F.lit(3)), BYTE_LEVEL, PIECES, id_col="row")
    assert out.columns[0] == "row" and out.count() == 2


def test_few_pairs_join_by_pair_and_nothing_meets_everything(spark, sf_dir):
    df = alignment.alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTE_LEVEL, PIECES, max_pairs=100)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "CartesianProduct" not in text and "NestedLoop" not in text and "SinglePartition" not in text
