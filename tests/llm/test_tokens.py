"""Token counts against greedy longest match that builds its pieces."""

import random
import re

from rillflow.llm import token_counts
from rillflow.llm.queries import VOCABULARY


def greedy(word, pieces, longest):
    at, n = 0, 0
    while at < len(word):
        for k in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + k] in pieces:
                break
        else:
            return 1
        at, n = at + k, n + 1
    return n


def brute(text, pieces, longest):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return len(words), sum(greedy(b" " + w, pieces, longest) for w in words)


def run(df, vocabulary):
    return sorted((tuple(r) for r in token_counts.count_tokens(df, vocabulary).collect()), key=str)


def check(df, rows, vocabulary):
    pieces = set(token_counts.load_pieces(vocabulary) if isinstance(vocabulary, str) else vocabulary)
    longest = max(map(len, pieces), default=0)
    assert run(df, vocabulary) == sorted(((r[0], *brute(r[1], pieces, longest)) for r in rows), key=str)


def test_public_vocabulary(spark, sf_dir, docs, rows, empty):
    check(docs, rows, VOCABULARY)
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(whole, whole.collect(), VOCABULARY)
    assert run(empty, VOCABULARY) == []


def test_small_vocabularies_with_unknown_words(spark):
    r = random.Random(5)
    for _ in range(6):
        pieces = [b" "] * r.randrange(2) + [bytes(r.choice(b" abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 25))]
        rows = [(i, " ".join("".join(r.choice("abcA") for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(6)))) for i in range(60)]
        check(spark.createDataFrame(rows, "doc_id long, text string"), rows, pieces)


def test_words_of_a_whole_text(spark):
    """1 MB without white space, and many long words together: counted right, in time that goes with the length."""
    import time

    r = random.Random(6)
    letters = "etaoinshrdluabcdefghijklmnopqrstuvwxyz0123456789é漢"
    pieces = set(token_counts.load_pieces(VOCABULARY))
    longest = max(map(len, pieces))
    for words in ([1_000_000], [30_000] * 12 + [3] * 500, [400] * 200, [7] * 30):
        text = " ".join("".join(r.choices(letters, k=k)) for k in words)
        data = token_counts.np.frombuffer(text.encode(), token_counts.np.uint8)
        found = token_counts.W.find(data, token_counts.np.array([0, len(data)]))
        automaton = token_counts.Automaton(pieces)
        automaton.plain()
        began = time.time()
        got = automaton.count(data, found.starts, found.ends)
        assert time.time() - began < 3
        assert got.tolist() == [greedy(b" " + w.encode(), pieces, longest) for w in text.split()]
