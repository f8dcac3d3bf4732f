"""Main text of web pages: boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into a tree whose leaves are runs of text. Features of every node (its
subtree's density, its attributes' tokens, its depth, its siblings) go to gradient-boosted
trees, trained on pages that a seeded generator makes and labels. Decoding picks the best
labels of the whole tree under one rule: what is kept lies in what is kept. A dropped
menu cannot hold a kept paragraph, and a kept article may hold a dropped advert.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import pick, table

# --- parsing -----------------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>))|[^>]*)(?:>|\Z)",
    re.S,
)
# HTML's void, raw-text and never-shown elements, what may stand in a head, its inline elements, and which open elements a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe object svg math textarea select datalist noembed noframes xmp".split())
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes script style template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
TEXT = "#text"


class Page:
    """Nodes in document order: tag, parent, attributes; leaves have text. breaks: a block edge lies between a leaf and the one before it."""

    __slots__ = ("attrs", "breaks", "parents", "tags", "texts")

    def __init__(self) -> None:
        self.tags, self.parents, self.attrs = ["#root"], [-1], [""]
        self.texts: list[str | None] = [None]
        self.breaks: list[bool] = [False]


def parse(source: str | None) -> Page:
    """The tree of a page, however broken, in time linear in its length; nothing is recursive, so depth has no limit.

    Beside the stack of open elements stand the places in it of each tag, and of elements
    that are not inline, so that no tag makes the stack be searched.
    """
    page = Page()
    tags, parents, attrs, texts, breaks = page.tags, page.parents, page.attrs, page.texts, page.breaks
    source = source or ""
    stack = [0]
    places: dict[str, list[int]] = defaultdict(list)
    blocks = [0]
    at, edge = 0, True

    def add(tag: str, attr: str, text: str | None, broken: bool) -> int:
        tags.append(tag)
        parents.append(stack[-1])
        attrs.append(attr)
        texts.append(text)
        breaks.append(broken)
        return len(tags) - 1

    def push(node: int) -> None:
        places[tags[node]].append(len(stack))
        if tags[node] not in INLINE:
            blocks.append(len(stack))
        stack.append(node)

    def close(place: int) -> None:
        """Closes the element at this place of the stack and all that it holds."""
        while len(stack) > place:
            tag = tags[stack.pop()]
            places[tag].pop()
            if tag not in INLINE:
                blocks.pop()

    def innermost(names: Iterable[str]) -> int:
        """The last place of an element of these names, or 0."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def say(text: str) -> None:
        nonlocal edge
        if text:
            if tags[stack[-1]] == "head" and text.strip():
                close(len(stack) - 1)
            add(TEXT, "", entities.unescape(text) if "&" in text else text, edge)
            edge = False

    while at < len(source):
        m = _TOKEN.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        inline = tag in INLINE
        edge = edge or not inline
        if m["end"]:
            place = innermost([tag])
            if place and not (inline and blocks[-1] > place):
                close(place)
            continue
        if not m[0].endswith(">"):
            break  # the page ends inside a tag
        if not inline and tag != "br":
            block = blocks[-1]
            if tags[stack[block]] == "p" and (tag not in VOID | {"script", "style"} or tag == "hr"):
                close(block)
        if tag in CLOSES:
            closed, scope = CLOSES[tag]
            place = innermost(closed)
            if place > innermost(scope):
                close(place)
        if tag == "body" and places.get("head"):
            close(places["head"][-1])
        if tags[stack[-1]] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in VOID:
            continue
        node = add(tag, m["attrs"], None, False)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif not m["attrs"].endswith("/") or tag not in ("svg", "path"):
            push(node)
    return page


# --- features ----------------------------------------------------------------

# Tokens of class, id, role and the like that speak for or against main text.
FOR = frozenset("article articlebody body content contents entry main maincontent page post postbody story text blog prose markdown readable".split())
AGAINST = frozenset(
    "actions alert archive author banner bar bio bottom breadcrumb breadcrumbs button byline category consent contentinfo cookie cookies copyright crumbs cta disclaimer dialog dropdown footer foot form gdpr head header hero "
    "hidden legal links list login logo masthead menu menubar meta metadata modal more nav navbar navigation newsletter notice notification outbrain overlay pagination pager paywall complementary popular popup privacy prev next rail rating recommended "
    "related register search share sharing sidebar side sitemap skip signup site social subscribe subscription tags taboola toc toolbar tools top topbar topics trending utility warning widget widgets".split()
)
ADS = frozenset("ad ads adv advert advertise advertisement adbox adslot banner dfp gpt promo promoted promotion sponsor sponsored".split())
REPLIES = frozenset("comment comments commentlist commenter discussion disqus feedback guestbook replies reply respond response responses review reviews thread".split())
_VALUES = re.compile(r"""(?:class|id|role|aria-label|itemprop|data-[\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_MARKS = re.compile(r"[.,;:!?]")

# Groups of tags, one feature each.
GROUPS = [
    {"article", "main"}, {"nav", "menu"}, {"footer"}, {"header", "hgroup"}, {"aside"}, {"form", "button", "fieldset", "input", "label", "dialog"}, {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"p", "blockquote", "pre"}, {"figure", "figcaption", "table", "tr", "td", "th", "tbody", "dd", "dt", "dl"}, {"ul", "ol"}, {"li"}, {"a"}, {"div", "section"}, {"#root", "html", "body"}, {TEXT},
]
_GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in g}
N_FEATURES = len(GROUPS) + 30


@lru_cache(maxsize=20_000)
def _attribute_counts(attrs: str) -> tuple[int, int, int, int, int]:
    words: list[str] = []
    for m in _VALUES.finditer(attrs):
        value = m[1] or m[2] or m[3] or ""
        words += re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().replace("-", " ").replace("_", " ").split()
    return sum(w in FOR for w in words), sum(w in AGAINST for w in words), sum(w in ADS for w in words), sum(w in REPLIES for w in words), 1 if _HIDDEN.search(attrs) else 0


def features(page: Page) -> np.ndarray:
    """One row a node."""
    n = len(page.tags)
    tags, parents, texts = page.tags, page.parents, page.texts
    chars, links, marks, inner, paras, leaves = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    depth, index, kids = [0] * n, [0] * n, [0] * n
    before = [0] * n
    signs = [(0, 0, 0, 0, 0)] * n
    above_for, above_against, above_ads, above_replies, above_hidden, above_tag, unseen = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    total = 0
    same: dict[tuple[int, str], int] = {}
    for i in range(n):
        p = parents[i]
        text = texts[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            index[i] = kids[p]
            kids[p] += 1
            same[p, tags[i]] = same.get((p, tags[i]), 0) + 1
            s = signs[p]
            g = _GROUP_OF.get(tags[p], -1)
            above_for[i] = above_for[p] + (s[0] > 0)
            above_against[i] = above_against[p] + (s[1] > 0)
            above_ads[i] = above_ads[p] + (s[2] > 0)
            above_replies[i] = above_replies[p] + (s[3] > 0)
            above_hidden[i] = above_hidden[p] or s[4]
            # bits: in an article or main, in a part that is none (menu, footer, header, aside, form)
            above_tag[i] = above_tag[p] | (1 if g == 0 else 2 if 1 <= g <= 5 else 4 if g == 11 else 0)
            unseen[i] = unseen[p] or tags[p] in UNSEEN
        unseen[i] = unseen[i] or tags[i] in UNSEEN
        before[i] = total
        if text is not None:
            if not unseen[i]:
                size = len(text) - text.count(" ") if text.strip() else 0
                chars[i] = size
                total += size
                marks[i] = len(_MARKS.findall(text))
                leaves[i] = size > 0
                if above_tag[i] & 4:
                    links[i] = size
        elif page.attrs[i]:
            signs[i] = _attribute_counts(page.attrs[i])
        if tags[i] == "p":
            paras[i] = 1
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        paras[p] += paras[i]
        leaves[p] += leaves[i]
        inner[p] += inner[i] + 1
    out = np.zeros((n, N_FEATURES), np.float32)
    base = len(GROUPS)
    log, whole = math.log1p, max(1, total)
    rows = []
    for i in range(n):
        p = max(0, parents[i])
        c, around = chars[i], kids[p] or 1
        s, ps = signs[i], signs[p]
        rows.append((
            depth[i], log(c), c / whole, links[i] / c if c else 0.0, marks[i] / c if c else 0.0, log(inner[i]), c / (inner[i] + 1), log(paras[i]), c / leaves[i] if leaves[i] else 0,
            around, index[i] / around, same.get((p, tags[i]), 1) / around, c / max(1, chars[p]), before[i] / whole, (total - before[i] - c) / whole,
            s[0], s[1], s[2], s[3], s[4], above_for[i], above_against[i], above_ads[i], above_replies[i], above_hidden[i],
            above_tag[i] & 1, above_tag[i] >> 1 & 1, ps[0] - ps[1], _GROUP_OF.get(tags[p], -1), marks[p] / chars[p] if chars[p] else 0.0,
        ))
        g = _GROUP_OF.get(tags[i])
        if g is not None:
            out[i, g] = 1
    out[:, base:] = rows
    return out


# --- boosted trees -----------------------------------------------------------

TREES, DEPTH, RATE, BINS = 60, 4, 0.25, 32


class Trees:
    """Gradient-boosted trees of logistic loss: complete binary trees of one depth, split at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        self.start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        score = np.full(len(y), self.start)
        self.split = np.zeros((TREES, (1 << DEPTH) - 1), np.int32)
        self.cut = np.full((TREES, (1 << DEPTH) - 1), np.inf, np.float32)
        self.leaf = np.zeros((TREES, 1 << DEPTH))
        width = BINS + 1
        offsets = np.arange(x.shape[1]) * width
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, count = (1 << level) - 1, 1 << level
                at = ((node - first)[:, None] * (x.shape[1] * width) + offsets + binned).ravel()
                size = count * x.shape[1] * width
                gs = np.bincount(at, np.repeat(g, x.shape[1]), size).reshape(count, x.shape[1], width).cumsum(2)
                hs = np.bincount(at, np.repeat(h, x.shape[1]), size).reshape(count, x.shape[1], width).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = np.where((hs < 1) | (ht - hs < 1), 0, gain).reshape(count, -1)
                best = gain.argmax(1)
                for k in range(count):
                    f, b = divmod(int(best[k]), width)
                    if gain[k, best[k]] > 1e-9 and b < len(cuts[f]):
                        self.split[t, first + k], self.cut[t, first + k] = f, cuts[f][b]
                here = self.split[t][node]
                node = 2 * node + 1 + (x[np.arange(len(y)), here] > self.cut[t][node])
            k = node - ((1 << DEPTH) - 1)
            self.leaf[t] = RATE * np.bincount(k, g, 1 << DEPTH) / (np.bincount(k, h, 1 << DEPTH) + 1)
            score += self.leaf[t][k]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, split[node]] > cut[node])
            score += leaf[node - ((1 << DEPTH) - 1)]
        return score


# --- training pages ----------------------------------------------------------

#: The model is fitted to so many made pages, whatever the corpus.
TRAINING_PAGES = 500
_MARK = "\ue000"


class Maker:
    """Makes pages of many layouts; every word of the main text carries a mark that labels it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int, main: bool = False) -> str:
        r = self.r
        out = []
        for _ in range(n):
            w = "".join(r.choice("ba do ki lu me no pra sti tre wo an el ou in".split()) for _ in range(r.randint(1, 4)))
            out.append((_MARK if main else "") + w + r.choice(["", "", "", "", "", ",", "."]))
        return " ".join(out).capitalize()

    def link(self, n: int = 2) -> str:
        return f'<a href="/{self.words(1)}">{self.words(self.r.randint(1, n))}</a>'

    def some(self, names: str) -> str:
        """A class or id among names, or none."""
        r = self.r
        name = r.choice(names.split())
        return r.choice(["", f' class="{name}"', f' id="{name}"', f' class="{name} c{r.randint(1, 99)}"', f" class='{name}-{r.choice(['box', 'wrap', 'inner', 'area'])}'"])

    def named(self, names: str) -> str:
        while not (got := self.some(names)):
            pass
        return got

    def items(self, n: int, words: int = 2) -> str:
        return "<ul>" + "".join(f"<li>{self.link(words)}{self.r.choice(['</li>', ''])}" for _ in range(n)) + "</ul>"

    def noise(self) -> str:
        """Something that is not main text."""
        r = self.r
        long = lambda: self.words(r.choice([4, 8, 15, 40, 90]))
        kind = r.randrange(14)
        if kind == 0:
            return f"<nav{self.some('menu navigation navbar breadcrumbs')}>{self.items(r.randint(2, 9))}</nav>"
        if kind == 1:
            return f"<div{self.named('ad ads advert banner-ad sponsored promo advertisement')}>{long()}</div>"
        if kind == 2:
            return f"<aside{self.some('sidebar related widget')}><h3>{self.words(2)}</h3>{r.choice([self.items(r.randint(2, 6), 6), f'<p>{long()}</p>'])}</aside>"
        if kind == 3:
            return f"<div{self.named('sidebar menu nav related-posts popular widget share social tags')}>{r.choice([self.items(r.randint(2, 8), 5), '<p>' + long() + '</p>', ' | '.join(self.link() for _ in range(4))])}</div>"
        if kind == 4:
            return f"<{r.choice(['div', 'section', 'p'])}{self.named('cookie-notice notice consent alert cookie-banner gdpr privacy-notice disclaimer')}>{long()} <button>{self.words(1)}</button></div>"
        if kind == 5:
            return f"<form{self.some('search newsletter login subscribe contact')} action='/'><label>{self.words(3)}</label><input name='q'><p>{self.words(r.choice([3, 12, 30]))}</p><select><option>{self.words(1)}</select><button>{self.words(1)}</button></form>"
        if kind == 6:
            tag = r.choice(["div", "section"])
            one = lambda: f"<{r.choice(['div', 'li', 'article'])}{self.named('comment reply comment-body response')}><b>{self.words(1)}</b><p>{self.words(r.randint(3, 80))}</p></div>"
            return f"<{tag}{self.named('comments commentlist discussion responses reviews comment-section')}><h2>{self.words(1)}</h2>" + "".join(one() for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind == 7:
            return f"<script>var a = '<p>{self.words(5)}</p>';</script><style>p{{margin:0}}</style>"
        if kind == 8:
            return f"<!-- {self.words(4)} <p> -->"
        if kind == 9:
            return f"<noscript><p>{self.words(8)}</p></noscript>"
        if kind == 10:
            return f"<div hidden><p>{long()}</p></div>" if r.random() < 0.5 else f'<div style="display:none">{long()}</div>'
        if kind == 11:
            return f"<div{self.named('subscribe newsletter signup paywall cta login')}><h3>{self.words(3)}</h3><p>{self.words(r.choice([6, 20, 50]))}</p></div>"
        if kind == 12:
            return f"<p{self.named('copyright meta byline author tags breadcrumb legal')}>{self.words(r.randint(2, 10))} {self.link()}</p>"
        return f"<div role='{r.choice(['navigation', 'banner', 'complementary', 'search', 'dialog', 'contentinfo'])}'>{r.choice([self.items(4), long()])}</div>"

    def block(self) -> str:
        """A block of main text."""
        r = self.r
        w = lambda n: self.words(n, True)
        kind = r.random()
        if kind < 0.62:
            inner = w(r.choice([1, 2, 5, 20, 45, 90, 160]))
            if r.random() < 0.3:
                inner += f" <{(t := r.choice(['b', 'i', 'em', 'strong', 'code', 'span']))}>{w(3)}</{t}> {w(6)}"
            if r.random() < 0.2:
                inner += f' <a href="/x">{w(2)}</a> {w(8)}'
            if r.random() < 0.1:
                inner = f"<b>{inner}<br>"
            return f"<p>{inner}{r.choice(['</p>', '</p>', ''])}"
        if kind < 0.74:
            tag = r.choice(["h2", "h3", "h4"])
            return f"<{tag}>{w(r.randint(1, 7))}</{tag}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{w(r.randint(1, 20))}" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.87:
            return f"<blockquote>{w(r.randint(5, 40))}</blockquote>"
        if kind < 0.91:
            return "<table>" + "".join(f"<tr><td>{w(2)}</td><td>{w(3)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if kind < 0.94:
            return f"<figure><img src='a.png'><figcaption>{w(8)}</figcaption></figure>"
        if kind < 0.97:
            return f"<pre>{w(15)}</pre>"
        return f"<div>{w(r.randint(10, 60))}</div>"

    def page(self) -> str:
        r = self.r
        title = f"<h1>{self.words(r.randint(1, 12), True)}</h1>"
        blocks = [self.block() for _ in range(r.choice([0, 1, 2, 4, 7, 12, 20]))]
        if r.random() < 0.35 and blocks:
            for _ in range(r.randint(1, 3)):
                blocks.insert(r.randint(0, len(blocks)), self.noise())
        if r.random() < 0.1:
            blocks.append(self.words(25, True))
        body = (title if r.random() < 0.85 else "") + "".join(blocks)
        if r.random() < 0.2:
            body = f"<header>{title}<p{self.named('byline meta author')}>{self.words(4)}</p></header>" + "".join(blocks)
        shape = r.random()
        if shape < 0.5:
            main = f"<article{self.some('post entry story article')}>{body}</article>"
        elif shape < 0.65:
            main = f"<main>{body}</main>"
        elif shape < 0.9:
            main = f"<div{self.named('content post-content entry-content article-body main story-body text')}>{body}</div>"
        else:
            main = f"<div>{body}{''.join(self.block() for _ in range(4))}</div>"
        if r.random() < 0.3:
            main = f"<{(t := r.choice(['main', 'div', 'section']))}{self.some('container wrapper main page')}>{main}{self.noise() if r.random() < 0.5 else ''}</{t}>"
        head = [self.noise() for _ in range(r.randint(0, 3))]
        if r.random() < 0.5:
            head.insert(0, f"<header{self.some('site-header masthead top')}><div{self.some('logo site-title')}>{self.words(2)}</div>{self.items(4) if r.random() < 0.5 else '<p>' + self.words(5) + '</p>'}</header>")
        if r.random() < 0.6:
            head.insert(0, f"<nav>{self.items(r.randint(3, 8))}</nav>")
        foot = [self.noise() for _ in range(r.randint(0, 4))]
        if r.random() < 0.75:
            long = self.words(r.choice([4, 10, 20, 40, 80]))
            foot.append(f"<footer{self.some('footer site-footer')}>{r.choice([f'&copy; {self.words(3)} &middot; {self.link()}', f'&copy; {self.words(1)} &middot; {long}', long, f'<p>{long}</p>', f'<div>{long}</div>', self.items(5)])}</footer>")
        out = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.words(4)}</title><style>p{{}}</style></head><body>{''.join(head)}{main}{''.join(foot)}</body></html>"
        return out if r.random() < 0.9 else out[: int(len(out) * r.uniform(0.6, 1))]


def training_rows(pages: int = TRAINING_PAGES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of made pages; a node is positive if it holds main text."""
    maker = Maker(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = parse(maker.page())
        label = [_MARK in (t or "") for t in page.texts]
        page.texts[:] = [None if t is None else t.replace(_MARK, "") for t in page.texts]
        for i in range(len(label) - 1, 0, -1):
            if label[i]:
                label[page.parents[i]] = True
        used = [i for i, (tag, t) in enumerate(zip(page.tags, page.texts)) if tag not in UNSEEN and (t is None or t.strip())]
        xs.append(features(page)[used])
        ys.append(np.array(label)[used])
    return np.concatenate(xs), np.concatenate(ys).astype(np.float64)


@lru_cache(maxsize=1)
def model() -> Trees:
    return Trees(*training_rows())


# --- decoding ----------------------------------------------------------------


def _bound(page: Page) -> list[bool]:
    """Nodes that share their parent's label: text and plain inline elements of a block that holds no other block."""
    n = len(page.tags)
    holds = [False] * n  # a block below
    for i in range(n - 1, 0, -1):
        if holds[i] or (page.tags[i] != TEXT and page.tags[i] not in INLINE and page.tags[i] not in UNSEEN):
            holds[page.parents[i]] = True
    bound = [False] * n
    for i in range(1, n):
        p = page.parents[i]
        if not holds[p] and (page.tags[i] == TEXT or page.tags[i] in INLINE) and (bound[p] or (page.tags[p] not in INLINE and page.tags[p] != "#root")):
            bound[i] = not any(_attribute_counts(page.attrs[i])[1:]) if page.attrs[i] else True
    return bound


def decode(page: Page, score: np.ndarray) -> list[bool]:
    """The likeliest labels in which every kept node's parent is kept.

    score: log-odds of each node. Keeping a node is worth its log-odds and what its
    children are then worth, if that is more than dropping them with all they hold. Text
    and plain inline elements of a block go with the block, whose log-odds their mean joins.
    """
    worth = score.tolist()
    parents, tags = page.parents, page.tags
    bound = _bound(page)
    said = [(0.0, 0)] * len(worth)  # of a block: its text's log-odds and length
    for i in range(len(worth) - 1, 0, -1):
        blank = tags[i] == TEXT and not page.texts[i].strip()
        if said[i][1] and not bound[i]:
            worth[i] += said[i][0] / said[i][1]
        if tags[i] in UNSEEN:
            worth[i] = -math.inf
        elif bound[i] or blank:
            total, size = said[i]
            if tags[i] == TEXT and not blank:
                total, size = worth[i] * len(page.texts[i]), len(page.texts[i])
            said[parents[i]] = (said[parents[i]][0] + total, said[parents[i]][1] + size)
            worth[i] = 0.0
        if worth[i] > 0:
            worth[parents[i]] += worth[i]
    kept = [True] * len(worth)
    for i in range(1, len(worth)):
        free = tags[i] not in UNSEEN and (bound[i] or (tags[i] == TEXT and not page.texts[i].strip()))
        kept[i] = kept[parents[i]] and (worth[i] > 0 or free)
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    """Kept text in page order: white space inside a block is one space, and so is a block's edge."""
    out: list[str] = []
    edge = False
    for i, text in enumerate(page.texts):
        if text is None:
            continue
        edge = edge or page.breaks[i]
        if kept[i]:
            if edge:
                out.append(" ")
            out.append(text)
            edge = False
    return " ".join("".join(out).split())


def extract(sources: list[str | None], trees: Trees) -> list[str]:
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    rows = [features(p) for p in pages]
    scores = trees.log_odds(np.concatenate(rows))
    out, at = [], 0
    for p in pages:
        out.append(text_of(p, decode(p, scores[at : at + len(p.tags)])))
        at += len(p.tags)
    return out


def _extractor(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = extract(part.column("html").to_pylist(), trees)
                kept = [(c, n) for c, n in zip(part.columns, part.schema.names) if n != "html"]
                yield pa.RecordBatch.from_arrays([c for c, _ in kept] + [pa.array(found, pa.string())], names=[n for _, n in kept] + ["text"])

    return run


def main_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the main text of the whole html of each row; empty if there is none.

    Null html is empty. Equal pages get equal texts; repeated rows stay, an empty table
    gives no rows, and of other columns only those in keep are read. Map-side only.
    """
    rows = pick(pages, [*keep, "html"])
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "html")
    return rows.mapInArrow(_extractor(model()), f"{kinds}, text string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op10_html_text": op10_html_text}
