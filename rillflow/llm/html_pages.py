"""Labelled pages to train the extraction on: made from a seed, with the layouts the web has.

A page is an article between menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, in tags or in ``div`` elements whose class or id names them, with invented words of random
syllables throughout, so that only structure and names tell content from the rest. Some articles have no
element of their own but stand in the body beside the rest, some have names of random syllables, some are a
block or two, and some pages are paragraphs or plain text alone.
"""

from __future__ import annotations

import random

from rillflow.llm.html_tree import Tree, read

MARK = "\u2060"  # stands at the end of each content run of a labelled page; no page has it otherwise
NAMES = {
    "nav": "nav navbar menu main-menu site-nav navigation breadcrumb breadcrumbs topbar links pagination tabs toc".split(),
    "header": "header site-header masthead page-header banner-top branding logo top head".split(),
    "footer": "footer site-footer foot bottom colophon copyright legal page-footer footer-links".split(),
    "aside": "sidebar side aside widget related recommended more-stories rail right-col popular trending widget-area".split(),
    "ad": "ad ads advert advertisement sponsored promo promoted sponsor banner adsense ad-slot commercial".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall disclaimer cookie-banner message".split(),
    "form": "form search newsletter subscribe signup login search-form contact-form".split(),
    "comments": "comments comment comment-list replies discussion responses reader-comments disqus comment-body".split(),
    "share": "share social share-buttons tags meta byline-links toolbar".split(),
    "content": "content post entry article article-body post-content entry-content story main story-body text page-content body".split(),
    "plain": "row col container wrapper inner box wrap grid section block c1 x7".split(),
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "bcdfghlmnprstvz"
        self.parts = [self.r.choice(letters) + self.r.choice("aeiouéöñ") + self.r.choice(["", "n", "r", "s", "t"]) for _ in range(60)]

    def words(self, a: int, b: int) -> str:
        out = " ".join("".join(self.r.choices(self.parts, k=self.r.randint(1, 4))) for _ in range(self.r.randint(a, b)))
        return out.capitalize() + self.r.choice([".", ".", "", "?", " &amp; so."])

    def named(self, kind: str, tags: list[str]) -> tuple[str, str]:
        tag = self.r.choice(tags)
        if tag == "div" or tag == "section" or self.r.random() < 0.3:
            how = self.r.choice(["class", "class", "id"])
            name = self.r.choice(NAMES[kind]) + self.r.choice(["", "", "", " " + self.r.choice(NAMES["plain"])])
            return f'<{tag} {how}="{name}">', f"</{tag}>"
        return f"<{tag}>", f"</{tag}>"

    def unknown(self) -> str:
        """A name that says nothing."""
        return self.r.choice(["-", "_", ""]).join("".join(self.r.choices(self.parts, k=2)) for _ in range(self.r.randint(1, 2)))

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def block(self, text: str, mark: str) -> str:
        tag = self.r.choices(["p", "h2", "blockquote", "pre", "ul", "div", "table", "open"], [12, 2, 1, 0.5, 1, 1, 0.4, 2])[0]
        inline = f"<b>{text}</b>" if self.r.random() < 0.1 else text
        if self.r.random() < 0.15:
            inline += f' <a href="/x">{self.words(1, 3)}</a> {self.words(1, 4)}'
        inline += mark
        if tag == "ul":
            return f"<ul><li>{inline}</li><li>{self.words(2, 12)}{mark}</li></ul>"
        if tag == "table":
            return f"<table><tr><td>{inline}</td><td>{self.words(1, 5)}{mark}</td></tr></table>"
        if tag == "open":
            return f"<p><b>{inline}<br>"
        return f"<{tag}>{inline}</{tag}>"

    def junk(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            a, b = self.named("nav", ["nav", "div"])
            return a + self.links(r.randint(2, 8)) + b
        if kind == "header":
            a, b = self.named("header", ["header", "div"])
            return a + r.choice([f"<p>{self.words(1, 8)}</p>", self.words(1, 6), self.links(3), f"<h1>{self.words(1, 4)}</h1>"]) + b
        if kind == "footer":
            a, b = self.named("footer", ["footer", "div"])
            return a + r.choice([f"&copy; {self.words(2, 20)}", f"<p>{self.words(3, 40)}</p>", self.links(4)]) + b
        if kind == "aside":
            a, b = self.named("aside", ["aside", "div"])
            return a + f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(4), f"<p>{self.words(5, 60)}</p>"]) + b
        if kind == "form":
            a, b = self.named("form", ["form", "div"])
            return a + f"<label>{self.words(1, 3)}</label><input name=q><p>{self.words(2, 15)}</p><button>{self.words(1, 2)}</button>" + b
        if kind == "comments":
            a, b = self.named("comments", ["div", "section"])
            items = "".join(r.choice([f"<p>{self.words(4, 60)}</p>", f'<div class="comment"><p>{self.words(4, 50)}</p></div>', f"<article><p>{self.words(3, 40)}</p></article>"]) for _ in range(r.randint(1, 4)))
            return a + r.choice(["", f"<h3>{self.words(1, 2)}</h3>"]) + items + b
        a, b = self.named(kind, ["div", "div", "section", "aside"])
        return a + r.choice([self.words(3, 40), f"<p>{self.words(3, 50)}</p>", f"<p>{self.words(2, 20)}</p><p>{self.words(2, 20)}</p>"]) + b

    def article(self) -> str:
        r, m = self.r, MARK
        title = f"<h1>{self.words(1, 12)}{m}</h1>"
        if r.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [title if r.random() < 0.9 else self.block(self.words(6, 60), m)]
        short = 1.0 if r.random() < 0.15 else 0.25
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 7, 10])):
            parts.append(self.block(self.words(1, 6) if r.random() < short else self.words(6, 90), m))
            if r.random() < 0.07:
                parts.append(self.junk(r.choice(["ad", "share", "aside", "notice", "form", "nav"])))
        if r.random() < 0.12:
            parts.append(self.junk("comments"))
        if r.random() < 0.1:
            parts.append(f"<footer>{self.words(1, 8)}</footer>")
        body = "".join(parts)
        if r.random() < 0.2:
            body = f"<div>{body}</div>"
        kind = r.random()
        if kind < 0.35:
            return f"<article>{body}</article>"
        if kind < 0.5:
            return f"<main>{body}</main>"
        if kind < 0.65:
            return body
        if kind < 0.8:
            tag = r.choice(["div", "div", "section"])
            return f'<{tag} {r.choice(["class", "id"])}="{self.unknown()}">{body}</{tag}>' if r.random() < 0.8 else f"<{tag}>{body}</{tag}>"
        a, b = self.named("content", ["div", "section", "article"])
        return a + body + b

    def page(self) -> str:
        r = self.r
        bare = r.random()
        if bare < 0.08:  # paragraphs, or text, and nothing else
            tag = r.choice(["p", "p", "div", ""])
            texts = [self.words(4, 80) + MARK for _ in range(r.choice([1, 1, 2, 3, 5]) if tag else 1)]
            inner = "".join(f"<{tag}>{t}</{tag}>" if tag else t for t in texts)
            return inner if r.random() < 0.5 else f"<html><body>{inner}</body></html>"
        before = [self.junk(k) for k in r.sample(["header", "nav", "ad", "notice", "form", "aside", "share"], r.randint(0, 4))]
        after = [self.junk(k) for k in r.sample(["footer", "aside", "ad", "comments", "form", "notice", "nav", "share"], r.randint(0, 5))]
        main = self.article()
        if r.random() < 0.25:
            main = f'<div class="{r.choice(NAMES["plain"])}">{main}{after.pop(0) if after and r.random() < 0.5 else ""}</div>'
        head = f"<html><head><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style></head><body>"
        return "<!DOCTYPE html>" + head + "".join(before) + main + "".join(after) + "</body></html>"


def labelled(n: int = 500, seed: int = 1) -> list[tuple[Tree, list[int]]]:
    """n pages as trees with a label per node: runs of content, and the elements that hold any such run."""
    maker, out = Maker(seed), []
    for _ in range(n):
        tree = read(maker.page())
        own = [0] * len(tree.tag)
        rest = [0] * len(tree.tag)
        for i in range(len(tree.tag) - 1, -1, -1):
            if tree.tag[i] == "#":
                own[i], rest[i] = (1, 0) if MARK in tree.text[i] else (0, 1)
                tree.text[i] = tree.text[i].replace(MARK, "")
            if tree.parent[i] >= 0:
                own[tree.parent[i]] += own[i]
                rest[tree.parent[i]] += rest[i]
        labels = [int(o > 0 and t != "head") for o, t in zip(own, tree.tag)]
        out.append((tree, labels))
    return out
