"""Main text of web pages: gradient-boosted trees over DOM nodes, and a decoding that respects the tree.

A page becomes a tree of elements and text blocks (runs of text that no block element interrupts). Every node is described by
its tag, the tokens of its class, id and role, those of its ancestors, densities of its subtree, depth, and its siblings. The
trees give each node log-odds of holding main text. As a node holds main text whenever one below it does, the choice is the set
of nodes with the greatest sum of log-odds among the sets that hold every chosen node's parent: ``f(n) = max(0, own + sum of
f(children))``, from the leaves up, and top-down a node is kept if its f is positive and its parent is kept.

The trees are trained on pages from a seeded generator (``sample_pages``) that knows which of its blocks are main text: articles
in semantic tags and in plain boxes, with menus, headers, footers, sidebars, notices, adverts, forms, related links and comments
around and inside them. The sample is bounded by its parameter; extraction covers every character of every page.

Defined cases: null or empty html gives empty text; text outside any tag is a block of the page; repeated rows are extracted one
by one; an empty table gives no rows; other columns are kept, one named ``text`` is replaced. A ``<`` that starts no complete
tag is text. Work and memory grow with a page's length and no faster, whatever it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.boosting import Boosted

PAGES, SEED = 500, 11
#: HTML's void elements, elements whose content is never text of the page, block elements, and what ends what.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style head template svg math iframe object noscript textarea select audio video canvas".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}
NO_PARAGRAPH = BLOCK - {"button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "html", "body"}
#: Groups of tokens in class, id and role.
TOKENS = {
    "main": "article content main post entry story body text prose page copy",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs tab skip links",
    "head": "header head masthead topbar logo branding",
    "foot": "footer foot copyright legal colophon imprint",
    "side": "sidebar side aside widget rail related recommended recommendations more popular trending teaser",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe subscription paywall dialog toast privacy",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted dfp outbrain taboola banner affiliate",
    "form": "form login search signup register contact field input searchbox",
    "comment": "comment comments reply replies respond disqus discussion feedback thread review reviews",
    "share": "share sharing social follow buttons toolbar tools print actions",
    "meta": "meta byline author date time published tags tag category categories info credits bio",
}
_GROUP = {token: g for g, tokens in enumerate(TOKENS.values()) for token in tokens.split()}
#: Groups of tags.
TAGS = {t: g for g, names in enumerate(["html body", "article main", "section div center", "nav menu", "header hgroup", "footer", "aside", "form fieldset button legend option optgroup dialog", "p pre blockquote", "h1", "h2 h3 h4 h5 h6", "ul ol dl dir", "li dt dd", "table tbody thead tfoot tr", "td th caption", "figure figcaption", "a", "#text"]) for t in names.split()}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")
#: Elements that shield an open paragraph from a block within them.
SHIELDS = ("td", "th", "li", "div", "button")
_LONG_NUMBER = re.compile(r"&#[0-9]{4000,};?")


def _unescaped(text: str) -> str:
    try:
        return unescape(text)
    except ValueError:  # a character number of thousands of digits
        return unescape(_LONG_NUMBER.sub("\ufffd", text))


class _Next:
    """Where a pattern is found next; asking at rising places costs one pass over the text."""

    def __init__(self, pattern: str, text: str):
        self.search, self.text, self.start, self.at = re.compile(pattern).search, text, 0, -1

    def __call__(self, start: int) -> int:
        """The first place from ``start`` on, or the text's length."""
        if not self.start <= start <= self.at:
            found = self.search(self.text, start)
            self.start, self.at = start, found.start() if found else len(self.text)
        return self.at


class Tags:
    """The tags of a page in one forward pass: what fails to be one is text, and is remembered so that no later try repeats it."""

    def __init__(self, html: str):
        self.html = html
        self.opening, self.name_end, self.special = _Next("<[!?/a-zA-Z]", html), _Next(r"[\s/>]", html), _Next("[>\"']", html)
        self.close = _Next(">", html)
        self.failed: set[int] = set()  # quotes and ends from which no end of a tag can be reached

    def _end(self, at: int) -> int:
        """Behind the ``>`` that ends a tag whose attributes start at ``at``, quoted ones skipped; -1 if there is none."""
        visited = []
        while True:
            at = self.special(at)
            if at == len(self.html) or at in self.failed:
                break
            if self.html[at] == ">":
                return at + 1
            visited.append(at)
            other = self.html.find(self.html[at], at + 1)
            if other < 0:
                break
            at = other + 1
        self.failed.update(visited)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, int]:
        """(start, end, closes, name, where attributes start) of the next tag or markup from ``at`` on; name is empty for markup
        without one, and start is the length of the page if there is nothing more."""
        html, size = self.html, len(self.html)
        while (start := self.opening(at)) < size:
            kind = html[start + 1]
            if kind in "!?":
                for head, tail in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                    if html.startswith(head, start):
                        end = html.find(tail, start + len(head))
                        return start, size if end < 0 else end + len(tail), False, "", 0
                if (end := self.close(start)) < size:
                    return start, end + 1, False, "", 0
            else:
                first = start + 1 + (kind == "/")
                if first < size and html[first].isascii() and html[first].isalpha():
                    stop = self.name_end(first)
                    if (end := self._end(stop)) >= 0:
                        return start, end, kind == "/", html[first:stop].lower(), stop
            at = start + 1
        return size, size, False, "", 0


class _Open:
    """The open block elements, with the places of each name."""

    def __init__(self):
        self.nodes, self.names, self.places = [0], ["html"], {"html": [0]}

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.nodes.append(node)
        self.names.append(name)

    def cut(self, at: int) -> None:
        """Closes all from place ``at`` on."""
        for name in self.names[at:]:
            self.places[name].pop()
        del self.nodes[at:], self.names[at:]

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names, 0 if there is none (the root's)."""
        best = 0
        for n in names:
            if (p := self.places.get(n)) and p[-1] > best:
                best = p[-1]
        return best

    def first_after(self, at: int, names: set[str]) -> int | None:
        """Place of the outermost open element of these names behind place ``at``."""
        found = [p[k] for n in names if (p := self.places.get(n)) and (k := bisect_right(p, at)) < len(p)]
        return min(found, default=None)


class Page:
    """Nodes in page order; children follow their parents."""

    def __init__(self, html: str):
        self.tag, self.parent, self.groups, self.text, self.linked = ["html"], [-1], [0], [""], [0]
        self.pieces: list[str] = []
        self.link_chars = 0
        tags, opened, at, links = Tags(html), _Open(), 0, 0
        unclosed: set[str] = set()  # dropped elements that don't end on the rest of the page
        while True:
            start, end, closes, name, attributes = tags.next(at)
            if start > at:
                piece = _unescaped(html[at:start])
                self.pieces.append(piece)
                if links:
                    self.link_chars += len(piece.strip())
            if start == len(html):
                break
            at = end
            if not name:
                continue
            if closes:
                if name == "a":
                    links = max(0, links - 1)
                elif name in BLOCK and name not in ("html", "body") and (place := opened.last(name)):
                    self._flush(opened.nodes[-1])
                    opened.cut(place)
                    links = 0
                continue
            if name in DROPPED:
                found = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(html, at)
                if found:
                    at = found.end()
                elif name in ("script", "style", "textarea"):
                    at = len(html)
                else:
                    unclosed.add(name)
                continue
            if name == "br":
                self.pieces.append(" ")
            elif name == "hr":
                self._flush(opened.nodes[-1])
            elif name == "a":
                links = 1
            elif name in BLOCK:
                if name in ("html", "body"):
                    continue  # one root stands for both
                self._flush(opened.nodes[-1])
                links = 0
                if name in NO_PARAGRAPH and (place := opened.last("p")) and place > opened.last(*SHIELDS):
                    opened.cut(place)
                if name in ENDS and (place := opened.first_after(opened.last(*WALLS[name]), ENDS[name])):
                    opened.cut(place)
                groups = 0
                for _, a, b, c in _ATTRIBUTE.findall(html[attributes : end - 1]) if end - attributes > 6 else ():
                    for token in _TOKEN.findall(a or b or c):
                        g = _GROUP.get(token.lower())
                        if g is not None:
                            groups |= 1 << g
                opened.push(name, self._add(name, opened.nodes[-1], groups))
        self._flush(opened.nodes[-1])

    def _add(self, tag: str, parent: int, groups: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.groups.append(groups)
        self.text.append("")
        self.linked.append(0)
        return len(self.tag) - 1

    def _flush(self, parent: int) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        if text:
            node = self._add("#text", parent)
            self.text[node] = text
            self.linked[node] = min(self.link_chars, len(text))
        self.pieces, self.link_chars = [], 0

    def features(self) -> np.ndarray:
        return np.concatenate(list(self.feature_parts()))

    def feature_parts(self, rows: int = 20_000) -> Iterator[np.ndarray]:
        """The nodes' features, ``rows`` nodes at a time: a long page's whole matrix need not fit."""
        n = len(self.tag)
        parent = self.parent
        kind = [TAGS.get(t, 2) for t in self.tag]
        chars, linked, blocks, nodes, sentences, words = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
        depth, above_groups, above_kinds = [0] * n, [0] * n, [0] * n
        children, place = [0] * n, [0] * n
        for i in range(n):
            if self.text[i]:
                chars[i], linked[i], blocks[i] = len(self.text[i]), self.linked[i], 1
                sentences[i], words[i] = len(_SENTENCE.findall(self.text[i])), self.text[i].count(" ") + 1
            p = parent[i]
            if p >= 0:
                depth[i] = depth[p] + 1
                above_groups[i] = above_groups[p] | self.groups[p]
                above_kinds[i] = above_kinds[p] | 1 << kind[p]
                place[i] = children[p]
                children[p] += 1
        inside = [0] * n  # kinds in the subtree
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            blocks[p] += blocks[i]
            nodes[p] += nodes[i]
            sentences[p] += sentences[i]
            words[p] += words[i]
            inside[p] |= inside[i] | 1 << kind[i]
        before, after, last = [0] * n, [0] * n, {}
        for i in range(1, n):
            k = last.get(parent[i])
            if k is not None:
                before[i], after[k] = chars[k], chars[i]
            last[parent[i]] = i
        c, l, b, m, s, w, child = (np.array(v, float) for v in (chars, linked, blocks, nodes, sentences, words, children))
        every = np.array(parent)
        every[0] = 0
        ints = [np.array(v, np.int64) for v in (self.groups, above_groups, above_kinds, inside, kind)]
        floats = [np.array(v, float) for v in (depth, place, before, after)]
        bits = lambda v, size: (v[:, None] >> np.arange(size) & 1).astype(float)
        kinds_n = max(TAGS.values()) + 1
        one = lambda v: (v[:, None] == np.arange(kinds_n)).astype(float)
        for start in range(0, n, rows):
            at = slice(start, start + rows)
            up = every[at]
            own, above, kinds, below, k = (v[at] for v in ints)
            deep, order, behind, ahead = (v[at] for v in floats)
            numbers = np.stack([
                np.log1p(c[at]), l[at] / np.maximum(c[at], 1), np.log1p(b[at]), c[at] / m[at], s[at] / np.maximum(w[at], 1), np.log1p(w[at] / np.maximum(b[at], 1)), deep, order / np.maximum(child[up], 1),
                np.log1p(child[up]), c[at] / max(1.0, c[0]), np.log1p(behind), np.log1p(ahead), np.log1p(c[up]), l[up] / np.maximum(c[up], 1),
            ], axis=1)
            yield np.concatenate([numbers, bits(own, len(TOKENS)), bits(above, len(TOKENS)), one(k), one(ints[4][up]), bits(kinds, kinds_n), bits(below, kinds_n)], axis=1)

    def main_text(self, margin: np.ndarray) -> str:
        """The blocks of the best set of nodes that holds every node's parent."""
        best = margin.tolist()
        for i in range(len(best) - 1, 0, -1):
            if best[i] > 0:
                best[self.parent[i]] += best[i]
        kept = [best[0] > 0] + [False] * (len(best) - 1)
        out = []
        for i in range(1, len(best)):
            kept[i] = kept[self.parent[i]] and best[i] > 0
            if kept[i] and self.text[i]:
                out.append(self.text[i])
        return "\n".join(out)


def sample_pages(n: int = PAGES, seed: int = SEED) -> Iterator[str]:
    """Pages whose main text, and nothing else, holds the word ``mainword`` in every block."""
    rng = np.random.default_rng(seed)
    syllables = "ta re mi no lu sa ke vo di pe ran sel tor min dal".split()
    chance = lambda p: rng.random() < p
    pick = lambda *options: options[rng.integers(len(options))]
    word = lambda: "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(int(np.exp(rng.uniform(np.log(low), np.log(high))))))

    def sentences(low: int, high: int) -> str:
        text = words(low, high).split()
        for i in range(rng.integers(4, 14), len(text), rng.integers(5, 15)):
            text[i] += "."
        return " ".join(text) + pick(".", ".", "", "!", "?")

    def main(low: int, high: int) -> str:
        text = sentences(low, high)
        if chance(0.25):
            text = " ".join(f"<a href='/x'>{w}</a>" if chance(0.06) else f"<b>{w}</b>" if chance(0.05) else w for w in text.split())
        return f"mainword {text}"

    def links(low: int = 2, high: int = 9) -> str:
        items = [f"<li><a href='/{word()}'>{words(1, 4)}</a></li>" for _ in range(rng.integers(low, high))]
        return f"<ul>{''.join(items)}</ul>" if chance(0.75) else "".join(re.sub("</?li>", " ", i) for i in items)

    def box(semantic: str, *tokens: str) -> tuple[str, str]:
        """A start and an end tag: the semantic element, or a plain one with a telling class or id."""
        token = pick(*tokens)
        if chance(0.55):
            return f"<{semantic}{f' class={chr(34)}{token}{chr(34)}' if chance(0.5) else ''}>", f"</{semantic}>"
        return f"<{pick('div', 'div', 'section')} {pick('class', 'id')}=\"{token}{pick('', '-wrap', ' box', '_1')}\">", "</div>"

    def within(tags: tuple[str, str], body: str) -> str:
        end = tags[1] if tags[0].startswith(f"<{tags[1][2:-1]}") else "</section>"
        return tags[0] + body + end

    menu = lambda: within(box("nav", "nav", "menu", "main-menu", "breadcrumb", "pagination"), links())
    header = lambda: within(box("header", "header", "site-header", "masthead", "top-bar"), pick(f"<h1>{words(1, 5)}</h1>", f"<p>{words(1, 8)}</p>", f"<a href='/'>{words(1, 3)}</a>") + (menu() if chance(0.6) else ""))
    footer = lambda: within(box("footer", "footer", "site-footer", "colophon", "copyright"), pick(f"&copy; {sentences(2, 30)}", f"<p>{sentences(3, 40)}</p>", links() + f"<p>{words(2, 9)}</p>"))
    aside = lambda: within(box("aside", "sidebar", "widget", "related", "popular"), f"<h3>{words(1, 4)}</h3>" * chance(0.6) + pick(links(), f"<p>{sentences(4, 60)}</p>", f"<p>{sentences(5, 50)}</p>" + links()))
    plain = lambda *tokens: (f"<{pick('div', 'div', 'section', 'p')} {pick('class', 'id', 'class')}=\"{pick(*tokens)}{pick('', '', ' box', '-1')}\">", "")

    def closed(start: str, body: str) -> str:
        return f"{start}{body}</{start[1:].split(' ')[0]}>"

    notice = lambda: closed(plain("cookie-notice", "consent", "notice", "newsletter", "alert", "popup", "gdpr", "cookie-banner")[0], pick(sentences(4, 50), sentences(4, 40) + f" <button>{words(1, 3)}</button>"))
    advert = lambda: closed(plain("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement")[0], pick(sentences(3, 50), f"<a href='/x'>{sentences(3, 30)}</a>"))
    form = lambda: f"<form{pick('', ' class=search', ' id=contact-form', ' class=newsletter-form')}>" + pick(f"<label>{words(1, 4)}</label><input><button>{words(1, 2)}</button>", f"<p>{sentences(3, 25)}</p><input><button>{words(1, 3)}</button>") + "</form>"
    share = lambda: closed(plain("share", "social", "share-buttons", "tools")[0], links(2, 5))
    meta = lambda: closed(plain("byline", "meta", "post-meta", "author", "tags")[0], words(2, 9))

    def comments() -> str:
        one = lambda: pick(f"<div class=\"comment\"><b>{word()}</b><p>{sentences(3, 80)}</p></div>", f"<li class=comment><p>{sentences(3, 80)}</p></li>", f"<article class=\"comment\"><p>{sentences(3, 80)}</p></article>", f"<div class='reply'>{sentences(3, 60)}</div>", f"<p>{sentences(3, 80)}</p>")
        body = f"<h{pick(2, 3)}>{words(1, 3)}</h3>".replace("h2>", "h3>").replace("<h2", "<h3") + "".join(one() for _ in range(rng.integers(1, 7))) + (form() if chance(0.3) else "")
        tag = pick("div", "section", "ol", "div")
        return f"<{tag} {pick('id', 'class')}=\"{pick('comments', 'comment-list', 'discussion', 'reader-comments', 'replies')}\">{body}</{tag}>"

    def block() -> str:
        kind = rng.random()
        if kind < 0.62:
            return f"<p>{main(2, 220)}" + pick("</p>", "</p>", "</p>", "", "<br>")
        if kind < 0.72:
            return f"<p><b>{main(3, 200)}<br>"
        if kind < 0.79:
            return f"<h{(k := pick(2, 3))}>{main(1, 8)}</h{k}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{main(1, 30)}{pick('</li>', '')}" for _ in range(rng.integers(1, 6))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{pick('<p>', '')}{main(4, 60)}</blockquote>"
        if kind < 0.95:
            return f"<div>{main(4, 160)}</div>"
        return f"<table><tr><td>{main(1, 10)}</td><td>{main(1, 10)}</td></tr></table>"

    for _ in range(n):
        inner = [block() for _ in range(rng.integers(1, 14))]
        if chance(0.25):
            inner = inner[:1]
        for extra, p in ((advert, 0.18), (aside, 0.1), (share, 0.1), (notice, 0.08), (form, 0.06), (menu, 0.04)):
            if chance(p):
                inner.insert(int(rng.integers(0, len(inner) + 1)), extra())
        title = f"<h1>{main(1, 12)}</h1>" if chance(0.8) else ""
        if title and chance(0.15):
            title = f"<header>{title}{meta() if chance(0.5) else ''}</header>"
        elif chance(0.15):
            title += meta()
        body = title + "".join(inner)
        if chance(0.12):
            body += comments()
        if chance(0.06):
            body += f"<footer>{words(2, 12)}</footer>"
        where = rng.random()
        if where < 0.6:
            body = f"<article>{body}</article>"
        elif where < 0.7:
            body = f"<main><article>{body}</article></main>"
        elif where < 0.78:
            body = f"<main>{body}</main>"
        else:
            body = f"<div {pick('class', 'id')}=\"{pick('content', 'article', 'post-body', 'entry-content', 'story', 'main')}\">{body}</div>"
        before = [f() for f, p in ((header, 0.5), (menu, 0.6), (notice, 0.25), (advert, 0.35), (aside, 0.12), (form, 0.1)) if chance(p)]
        behind = [f() for f, p in ((comments, 0.3), (aside, 0.3), (share, 0.12), (advert, 0.2), (notice, 0.12), (form, 0.12), (menu, 0.1), (footer, 0.75)) if chance(p)]
        rng.shuffle(before)
        middle = "".join(before) + body + "".join(behind)
        if chance(0.25):
            middle = f"<div class=\"{pick('wrapper', 'container', 'page', 'layout')}\">{middle}</div>"
        yield f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title></head><body>{middle}" + ("</body></html>" if chance(0.9) else "")


@cache
def train(n: int = PAGES, seed: int = SEED) -> Boosted:
    """Trees for the label: this node or one below it holds main text."""
    x, y = [], []
    for html in sample_pages(n, seed):
        page = Page(html)
        holds = ["mainword" in t for t in page.text]
        for i in range(len(holds) - 1, 0, -1):
            if holds[i]:
                holds[page.parent[i]] = True
        # the marker itself must not be a feature
        page.text = [t.replace("mainword ", "").replace("mainword", "") for t in page.text]
        page.linked = [min(a, len(t)) for a, t in zip(page.linked, page.text, strict=True)]
        x.append(page.features())
        y.append(holds)
    return Boosted().fit(np.concatenate(x), np.concatenate(y).astype(float))


def main_texts(pages: list[str | None], trees: Boosted, rows: int = 20_000) -> list[str]:
    """The pages' texts; the trees are asked about some ``rows`` nodes at a time, of many short pages or a part of a long one."""
    out, waiting, held = [""] * len(pages), [], 0

    def decide() -> None:
        sizes = [len(f) for _, _, parts in waiting for f in parts]
        margins = iter(np.split(trees.margin(np.concatenate([f for _, _, parts in waiting for f in parts])), np.cumsum(sizes)[:-1]))
        for at, page, parts in waiting:
            out[at] = page.main_text(np.concatenate([next(margins) for _ in parts]))
        waiting.clear()

    for at, html in enumerate(pages):
        if not html:
            continue
        page = Page(html)
        if len(page.tag) > rows:
            out[at] = page.main_text(np.concatenate([trees.margin(f) for f in page.feature_parts(rows)]))
            continue
        waiting.append((at, page, list(page.feature_parts(rows))))
        held += len(page.tag)
        if held > rows:
            decide()
            held = 0
    if waiting:
        decide()
    return out


def extract(pages: DataFrame, trees: Boosted | None = None, html: str = "html") -> DataFrame:
    """``pages`` with its column ``html`` replaced by ``text``."""
    trees = train() if trees is None else trees
    others = [c for c in pages.columns if c not in (html, "text")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*others).schema.fields), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = main_texts(part.column(0).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*others, "text"])

    return pages.select(html, *others).mapInArrow(run, schema)
