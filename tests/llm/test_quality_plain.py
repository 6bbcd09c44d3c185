"""The quality model's features, trees and boosting against loops in plain Python."""

import math
import re

import numpy as np
import pytest

from rillflow.llm import quality_model as Q
from rillflow.llm.quality_rules import STOP_WORDS


def plain_features(text):
    data = text.encode()
    fold = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, chars = len(words), max(len(data), 1)
    count = lambda chosen: sum(data.count(c.encode()) for c in chosen)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / max(n, 1)
    spread = math.sqrt(max(sum(s * s for s in sizes) / max(n, 1) - mean**2, 0)) / max(mean, 1)
    plain = [fold(w) for w in re.split(rb"[^0-9A-Za-z\x80-\xff]+", data) if w]
    stops = {w.encode() for w in STOP_WORDS}
    lines = [fold(x) for x in data.split(b"\n") if x]
    triples = [tuple(fold(w) for w in words[i : i + 3]) for i in range(n - 2)]
    return [
        math.log1p(n), mean, count("#*$%&|<>@^~=+_\\{}[]") / max(n, 1), sum(65 <= c <= 90 for c in data) / chars, sum(48 <= c <= 57 for c in data) / chars,
        count(".,;:!?'\"()-") / max(n, 1), count("|") / max(n, 1), count("!") / max(n, 1), len({fold(w) for w in words}) / max(n, 1),
        sum(w in stops for w in plain) / max(len(plain), 1), 1 - len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)),
        sum(c > 127 for c in data) / chars, max(sizes, default=0), 1 - len(set(triples)) / max(len(triples), 1), spread,
    ]


def test_features(spark, sf_dir, rows):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [r[1] or "" for r in rows] + ["", " ", "\n\n", "THE the The\nTHE THE THE\nthe the the", "a|b !! $5 é É\x0bx\x1cy", "a b c a b c a b c d"]
    raw = [t.encode() for t in texts]
    got = Q.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), Q._stops())
    assert got.shape == (len(texts), len(Q.NAMES))
    for t, row in zip(texts, got):
        assert np.allclose(row, plain_features(t), rtol=1e-9, atol=1e-9), t[:60]


def plain_tree(g, h, shrink):
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + shrink)

    def best(a, b):
        gains = [(value(a, c) + value(c, b) - value(a, b), -c) for c in range(a + 1, b)]
        return max(gains) if gains else (0.0, 0)

    first = -best(0, len(g))[1]
    if not first:
        return [0.0] * len(g)
    (left, lc), (right, rc) = best(0, first), best(first, len(g))
    cuts = sorted({0, first, len(g), -lc if left >= right else -rc})
    return [sum(g[a:b]) / (sum(h[a:b]) + shrink) for a, b in zip(cuts, cuts[1:]) for _ in range(a, b)]


@pytest.mark.parametrize("n", [1, 2, 3, 12, 40])
def test_trees(n):
    r = np.random.default_rng(n)
    for _ in range(30):
        g, h = r.normal(size=n), r.random(n) + 0.01
        assert np.allclose(Q._tree(g, h, 2.0), plain_tree(g.tolist(), h.tolist(), 2.0))


def test_boosting():
    """Cyclic turns over features, then over the pairs of greatest gain, cell by cell."""
    r = np.random.default_rng(4)
    x = r.random((300, 4)).round(2)
    y = ((x[:, 0] > 0.4) ^ (x[:, 2] > 0.6)).astype(float)
    o = Q.Gam(bins=7, coarse=3, turns=3, pair_turns=2, n_pairs=2)
    bias, edges, tables, coarse, pairs, pair_tables = Q.fit_tables(x, y, o)
    at = lambda e, v: sum(v >= t for t in e)
    total, mine = [bias] * 300, [[0.0] * len(t) for t in tables]
    p = lambda: [1 / (1 + math.exp(-t)) for t in total]
    assert bias == pytest.approx(math.log(y.mean() / (1 - y.mean())))
    for _ in range(o.turns):
        for j in range(4):
            own = [at(edges[j], v) for v in x[:, j]]
            g, h, now = [0.0] * len(tables[j]), [0.0] * len(tables[j]), p()
            for i, c in enumerate(own):
                g[c] += y[i] - now[i]
                h[c] += now[i] * (1 - now[i])
            step = [o.rate * v for v in plain_tree(g, h, o.shrink)]
            mine[j] = [a + b for a, b in zip(mine[j], step)]
            total = [t + step[c] for t, c in zip(total, own)]
    for a, b in zip(mine, tables):
        assert np.allclose(a, b)

    def cells(a, b):
        return [at(coarse[a], u) * (len(coarse[b]) + 1) + at(coarse[b], v) for u, v in zip(x[:, a], x[:, b])]

    def sums(a, b):
        size, now = (len(coarse[a]) + 1) * (len(coarse[b]) + 1), p()
        g, h = [0.0] * size, [0.0] * size
        for i, c in enumerate(cells(a, b)):
            g[c] += y[i] - now[i]
            h[c] += now[i] * (1 - now[i])
        return g, h

    gains = sorted(((sum(g * g / (h + o.shrink) for g, h in zip(*sums(a, b))), a, b) for a in range(4) for b in range(a + 1, 4)), reverse=True)
    assert pairs == [(a, b) for _, a, b in gains[:2]] and pairs[0] == (0, 2)
    grown = [[0.0] * len(t) for t in pair_tables]
    for _ in range(o.pair_turns):
        for k, (a, b) in enumerate(pairs):
            step = [o.rate * g / (h + o.shrink) for g, h in zip(*sums(a, b))]
            grown[k] = [u + v for u, v in zip(grown[k], step)]
            total = [t + step[c] for t, c in zip(total, cells(a, b))]
    for a, b in zip(grown, pair_tables):
        assert np.allclose(a, b)
