"""A small tolerant HTML reader: a tree of block elements whose leaves are runs of inline text.

Inline elements belong to the run around them; block starts close open paragraphs and list items as
browsers do; scripts, styles and the like are dropped with all they hold. A cursor walks the page once:
tags and their attributes are read name by name and value by value, as browsers do, so that a quote that
is never closed costs no second look at the page and no part of a tag is ever text. There is no
recursion, so depth and length are not limited.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_WS = r" \t\n\r\f"
SKIP = re.compile(rf"[{_WS}/]*")
NAME = re.compile(rf"=?[^{_WS}/>=]*")
EQUALS = re.compile(rf"[{_WS}]*=[{_WS}]*")
BARE = re.compile(rf"[^{_WS}>]*")
TAG = re.compile(rf"[a-zA-Z][^{_WS}/>]*")
#: The attributes whose values the features look at.
NAMED = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
RAW = {t: re.compile(rf"</{t}(?=[{_WS}/>])", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "html head body article aside blockquote button center caption dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: What the start of a block closes, up to the nearest of its holders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@dataclass
class Tree:
    """Nodes in page order; the parent of a node stands before it. Element nodes have no text, runs have tag ``#``."""

    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters of a run that lie in links

    def add(self, tag: str, names: str, parent: int, text: str = "", linked: int = 0) -> int:
        self.tag.append(tag)
        self.names.append(names)
        self.parent.append(parent)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


class Cursor:
    """A place in a page, and what is known not to come after it."""

    def __init__(self, page: str):
        self.page, self.at, self.absent = page, 0, set()

    def past(self, mark: str, start: int) -> int:
        """The place after the next ``mark``, or -1; a mark that was missing once is not looked for again."""
        if mark in self.absent:
            return -1
        found = self.page.find(mark, start)
        if found < 0:
            self.absent.add(mark)
            return -1
        return found + len(mark)

    def attributes(self, want: bool) -> tuple[str, bool]:
        """(the named attributes as ``name=value`` in lower case, whether the tag closes itself); moves past the tag.

        A quoted value that is not closed ends with the tag, at the next ``>``; so does a page that ends within
        a tag.
        """
        page, at, found, end = self.page, self.at, [], len(self.page)
        while True:
            at = SKIP.match(page, at).end()
            if at >= end:
                self.at = end
                return " ".join(found), False
            if page[at] == ">":
                self.at = at + 1
                return " ".join(found), page[at - 1] == "/"
            m = NAME.match(page, at)
            name, at = m.group(), m.end()
            m, value = EQUALS.match(page, at), ""
            if m:
                at = m.end()
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote:
                    stop = self.past(quote, at + 1)
                    if stop < 0:
                        stop = self.past(">", at + 1)
                        value = page[at + 1 : stop - 1 if stop > 0 else end]
                        at = stop - 1 if stop > 0 else end
                    else:
                        value, at = page[at + 1 : stop - 1], stop
                else:
                    m = BARE.match(page, at)
                    value, at = m.group(), m.end()
            if want and (name := name.lower()) in NAMED:
                found.append(f"{name}={value}".lower())


def read(page: str | None) -> Tree:
    """The tree of a page; null and empty pages have a root only."""
    tree = Tree()
    stack = [(tree.add("html", "", -1), "html")]
    depths: dict[str, list[int]] = {}  # of the open elements by tag, without the root
    run: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal run, linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            tree.add("#", "", stack[-1][0], text, min(linked, len(text)))
        run, linked = [], 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            run.append(piece)
            if links:
                linked += len(piece)

    def close(depth: int) -> None:
        while len(stack) > depth:
            depths[stack.pop()[1]].pop()

    def nearest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    page = page or ""
    cursor, text_from = Cursor(page), 0
    while True:
        opened = page.find("<", cursor.at)
        if opened < 0:
            say(page[text_from:])
            break
        cursor.at = opened + 1
        end = page.startswith("/", opened + 1)
        m = TAG.match(page, opened + 1 + end)
        if not m:
            after = page[opened + 1 : opened + 2]
            if page.startswith("!--", opened + 1):
                # An empty comment may end at once.
                stop = opened + 5 if page.startswith(">", opened + 4) else opened + 6 if page.startswith("->", opened + 4) else cursor.past("-->", opened + 4)
            elif after in ("!", "?", "/") and after:
                stop = cursor.past(">", opened + 2)
            else:
                continue  # a plain "<": text
            say(page[text_from:opened])
            cursor.at = text_from = stop if stop > 0 else len(page)
            continue
        say(page[text_from:opened])
        tag, cursor.at = m.group().lower(), m.end()
        block = tag in BLOCK
        names, closed = cursor.attributes(block and not end)
        text_from = cursor.at
        if not end and tag in RAW and not (closed and tag == "svg"):
            stop = RAW[tag].search(page, cursor.at)
            cursor.at = stop.end() if stop else len(page)
            cursor.attributes(False)
            text_from = cursor.at
        elif tag == "a":
            links = 0 if end else 1
        elif tag == "br":
            run.append(" ")
        elif not block:
            if tag in VOID:
                run.append(" " if tag == "hr" else "")
        elif end:
            if tag == "p" or depths.get(tag):
                flush()
                if depths.get(tag):
                    close(depths[tag][-1])
                links = 0
        else:
            flush()
            if stack[-1][1] == "p":
                close(len(stack) - 1)
            shut, holders = CLOSES.get(tag, ((), ()))
            depth = nearest(shut)
            if depth and depth > nearest(holders):
                close(depth)
            if tag == "html":
                continue
            depths.setdefault(tag, []).append(len(stack))
            stack.append((tree.add(tag, names, stack[-1][0]), tag))
            links = 0
    flush()
    return tree
