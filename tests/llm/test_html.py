"""Extraction: exact messages, accuracy on pages not trained on, and the pages' articles."""

import html
import itertools
import re

import numpy as np

from rillflow.llm import html_extract, html_pages, html_tree


def article(page):
    """The blocks of pages whose content is one article of headings and paragraphs."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = html_extract.extract(pages, ["page_id", "url"]).toPandas().set_index("page_id")["text"]
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert len(out) == len(want) and sum(out[k] == v for k, v in want.items()) >= 0.99 * len(want)


def test_labelled_pages_not_trained_on():
    pages = html_pages.labelled(150, seed=77)
    forest = html_extract.Forest([t for t, _ in pages])
    p, _, _ = html_extract.beliefs(forest, *html_extract.trained())
    y = np.array([v for _, labels in pages for v in labels])
    runs = forest.kind == 1
    assert ((p >= 0.5) == y)[runs].mean() > 0.98


def test_messages_equal_enumeration():
    tree = html_tree.read("<body><div class=nav><p>a b</p></div><article><h1>t</h1><p>one two three</p></article></body>")
    forest = html_extract.Forest([tree, html_tree.read("<p>x")])
    rng = np.random.default_rng(0)
    w, pairs = rng.normal(size=html_extract.N_FEATURES), rng.normal(size=(2, 2, 2))
    p, joint, log_z = html_extract.beliefs(forest, w, pairs)
    n = len(forest.parent)
    z, ones = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        y = np.array(y)
        s = forest.score(w) @ y + sum(pairs[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0)
        z += np.exp(s)
        ones += np.exp(s) * y
    assert np.allclose(p, ones / z) and np.isclose(log_z, np.log(z))
    assert np.allclose(joint[1:][forest.parent[1:] >= 0].sum(axis=(1, 2)), 1)


def test_features_times_weights_and_sums_agree():
    forest = html_extract.Forest([t for t, _ in html_pages.labelled(20, seed=5)])
    rng = np.random.default_rng(1)
    dense = np.stack([forest.score(e) for e in np.eye(html_extract.N_FEATURES)], 1)
    w, p = rng.normal(size=html_extract.N_FEATURES), rng.random(len(forest.parent))
    assert np.allclose(dense @ w, forest.score(w)) and np.allclose(dense.T @ p, forest.total(p))


LINES = ["A heading of the page", "The first paragraph tells what happened in the town and who was there to see it happen.", "The second one goes on for a while and says, in some more words, what came of it.",
         "The third is shorter, but still a sentence.", "At the end there is one more paragraph that closes the story for good."]
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'
WRAPS = ["", "<div>", '<div class="mw-parser-output">', '<section class="zq-91">', '<div id="kolumne">', '<div class="css-1x2y3z">', '<div class="artikeltext__absatz">', "<section>", "<main>", "<article>"]


def wrapped(inner, start):
    tag = re.match(r"<(\w+)", start)
    return start + inner + (f"</{tag[1]}>" if tag else "")


def test_articles_under_names_and_in_layouts_that_no_training_page_has():
    for n in (5, 3, 2):
        inner = f"<h1>{LINES[0]}</h1>" + "".join(f"<p>{x}</p>" for x in LINES[1:n])
        for start in WRAPS:
            for menu in (f"<nav>{MENU}</nav>", f'<div class="menu">{MENU}</div>', ""):
                page = f"<html><head><title>t</title></head><body>{menu}{wrapped(inner, start)}<footer><p>Copyright 2020 by us. All rights reserved.</p></footer></body></html>"
                assert html_extract.main_texts([page], html_extract.trained()) == ["\n\n".join(LINES[:n])], (n, start, menu)


def test_pages_of_paragraphs_or_text_alone():
    model, want = html_extract.trained(), "\n\n".join(LINES[1:3])
    pages = [f"<p>{LINES[1]}</p><p>{LINES[2]}</p>", f"<body><p>{LINES[1]}</p><p>{LINES[2]}</p></body>", f"<html><body><div>{LINES[1]}</div><div>{LINES[2]}</div></body></html>"]
    assert html_extract.main_texts(pages, model) == [want] * 3
    assert html_extract.main_texts([LINES[1], f"<p>{LINES[1]}</p>", f"<body>{LINES[1]}</body>"], model) == [LINES[1]] * 3


def test_memory_of_a_long_page():
    import tracemalloc

    page = "<html><body>" + "<div class=post><p>some words of a long page</p></div>" * 60_000 + "</body></html>"
    tracemalloc.start()
    html_extract.main_texts([page], html_extract.trained())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 34 * len(page)  # 30 MB of such a page take 1 GB


def test_reader():
    blocks = lambda page: [t for t in html_tree.read(page).text if t]
    assert blocks("<p>a &amp;&nbsp;b<br>c<p>d <b>e\n\n f</b>") == ["a & b c", "d e f"]
    assert blocks('<script>var t="</p><p>x";</script><style>p{}</style><!-- <p>no</p> -->y') == ["y"]
    assert blocks("<ul><li>one<li>two</ul>three") == ["one", "two", "three"]
    assert blocks("<div title='a>b'>x</div></div></p>y<table><tr><td>1<td>2<tr><td>3</table>") == ["x", "y", "1", "2", "3"]
    assert blocks(None) == blocks("") == blocks("<div></div>") == []
    assert len(blocks("<div>" * 5000 + "deep" + "</div>" * 5000)) == 1


def test_tags_with_broken_quotes_are_no_text():
    blocks = lambda page: [t for t in html_tree.read(page).text if t]
    assert blocks('<div class="x>hello</div>') == ["hello"]
    assert blocks("<p title=it's>one</p><p>two</p>") == ["one", "two"]
    # Browsers read on to the next quote of the kind.
    assert blocks('<div class="x>gone</div><p class="y">two</p>') == ["two"]
    assert blocks("<p a='1' b=\"2\" c = 3 d/>x<br/>y<p hidden>z") == ["x y", "z"]
    assert blocks("1 < 2 <3 << 4 </ >5<!-->6<!--->7<!x>8<?y>9<") == ["1 < 2 <3 << 4 56789<"]
    assert blocks("a<script src='x>'>no</script >b<svg/>c<svg><text>no</text></svg>d<style>p{") == ["abcd"]
    assert blocks("a<p") == blocks("a<!-- b") == blocks("a<p class='") == blocks("a</p") == ["a"]
    tree = html_tree.read('<DIV data-class=no CLASS="Side Bar" id=X hidden><p>t')
    assert tree.names[1] == "class=side bar id=x hidden="


def test_no_markup_is_left_whatever_the_page():
    import random

    r = random.Random(4)
    parts = [">", "</", "<b", "/>", "p", "div", " class=", '"', "'", "=", " ", "<!--", "-->", "<p>", "</div>", "<script>", "</script>", "Z", "\n", "<a href="]
    for _ in range(3000):
        page = "".join(r.choices(parts, k=r.randrange(1, 40)))
        text = " ".join(html_tree.read(page).text)
        assert not re.search(r"<(?:/?(?:p|div|script|a)[\s/>]|!)", text), page


def test_time_goes_with_the_length_of_the_page():
    import time

    pages = ["<p title=\"x>word " * 60_000, "<p title='x>" * 80_000, "<!-- a <p> " * 90_000, "<script> x " * 90_000, "<div>" * 100_000 + "<li>a" * 100_000, "<" * 1_000_000, "</p <b " * 150_000]
    for page in pages:
        began = time.time()
        html_tree.read(page)
        assert time.time() - began < 10 * len(page) / 1e6, page[:20]


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([("k", "own", "<article><h1>Some title</h1>" + "<p>A text that is long enough to be kept here.</p>" * 3 + "</article>", 1)], "page_id string, text string, html string, __html int")
    out = html_extract.extract(df, ["page_id", "text", "__html"])
    assert out.columns == ["page_id", "__html", "text"] and out.first()["text"].startswith("Some title\n\nA text")


def test_corner_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some words that are long enough to be text.</p></article>" * 2), (3, "u", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
    out = html_extract.extract(df, ["page_id", "url", "html"])
    got = out.collect()
    assert out.columns == ["page_id", "url", "html", "text"] and len(got) == 5
    assert [r["text"] for r in got if r["html"] in (None, "")] == ["", "", ""]
    assert html_extract.extract(df.limit(0), ["page_id"]).count() == 0
