"""Main-text extraction by gradient-boosted trees over DOM nodes.

Each block node of a page gets features: its tag, tokens of its class, id and
role, those of its ancestors, depth, the density of text, links and tags in its
subtree, and how it compares with its siblings.  Boosted regression trees
(histogram splits, logistic loss, NumPy only) give the log odds that its subtree
holds main text.  Trees alone may keep a paragraph in a dropped menu; decoding
is hierarchical instead: of all labellings in which a dropped node's descendants
are dropped too, it takes the one with the largest sum of log odds, by a dynamic
program from the leaves up.  The texts of kept leaves are the blocks.

There are no labelled pages, so the trees are fitted on pages that a generator
here composes from many layouts, with known main text; fitting takes seconds on
the driver and is the same each time.

Defined results: a null, empty or textless page gives an empty text; broken and
cut-off markup is read as far as it goes; very long pages are read whole;
repeated rows and other columns make no difference.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopix.llm.common import map_batches
from chronopix.llm.dom import Node, clean, parse

# Tokens of class, id and role attributes that speak for and against main text, by what they mean.
FOR = frozenset("article articles articlebody post posts entry story content main body text page hentry blog news prose markdown richtext copy".split())
AGAINST = {
    "menu": "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs crumbs pagination pager tabs toolbar skip".split(),
    "edge": "header masthead banner footer foot colophon copyright legal bottom top logo branding site sitefooter siteheader".split(),
    "side": "sidebar side aside widget widgets rail related recommended popular trending more teaser promo tags tag archive toc".split(),
    "ad": "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors dfp promo promotion promoted commercial".split(),
    "notice": "cookie cookies consent gdpr notice notification alert alertdialog popup modal overlay dialog banner privacy paywall subscribe newsletter signup".split(),
    "talk": "comment comments reply replies respond disqus discussion reactions feedback reviews thread".split(),
    "form": "form search login signin register subscribe newsletter signup contact share sharing social follow buttons".split(),
}
_AGAINST = {k: frozenset(v) for k, v in AGAINST.items()}
_TAGS = ("p", "h1", "h2", "li", "ul", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "#text", "body")
_ALIAS = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "dl": "ul", "dd": "li", "dt": "li", "th": "td", "pre": "blockquote", "#root": "body", "html": "body", "menu": "nav", "search": "form", "dialog": "aside", "fieldset": "form"}
_BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
_POINT = re.compile(r"[.!?,;:]")


def features(nodes: list[Node]) -> np.ndarray:
    """nodes x features, in page order."""
    n = len(nodes)
    own = np.zeros((n, 5))  # characters, link characters, tags, punctuation, controls
    for i, x in enumerate(nodes):
        if x.text:
            t = "".join(x.text)
            own[i] = len(t.strip()), x.links, x.inline, len(_POINT.findall(t)), x.controls
        else:
            own[i] = 0, 0, 1, 0, x.controls
    sub = own.copy()
    blocks = np.zeros(n)
    paragraphs = np.zeros(n)
    anchors = np.array([x.anchors for x in nodes], float)
    children: list[list[int]] = [[] for _ in nodes]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        children[p].append(i)
        sub[p] += sub[i]
        anchors[p] += anchors[i]
        blocks[i] += nodes[i].tag == "#text"
        blocks[p] += blocks[i]
        paragraphs[i] += nodes[i].tag == "p"
        paragraphs[p] += paragraphs[i]
    for c in children:
        c.reverse()
    whole = max(1.0, sub[0, 0])
    out = np.zeros((n, 58))
    hits = np.zeros((n, 8))
    above = np.zeros((n, 8 + 4))
    start = np.cumsum(own[:, 0]) - own[:, 0]
    for i, x in enumerate(nodes):
        tokens = x.tokens
        if tokens:
            hits[i, 0] = sum(t in FOR for t in tokens)
            for k, words in enumerate(_AGAINST.values()):
                hits[i, k + 1] = sum(t in words for t in tokens)
        if i:
            p = x.parent
            above[i] = above[p]
            above[i, :8] = np.maximum(above[p, :8], hits[p])
            tag = nodes[p].tag
            above[i, 8] = max(above[p, 8], tag in ("article", "main"))
            above[i, 9] = max(above[p, 9], tag in _BAD_TAGS)
            above[i, 10] = max(above[p, 10], tag in ("ul", "ol", "li"))
            above[i, 11] = max(above[p, 11], tag in ("table", "td"))
    for i, x in enumerate(nodes):
        f = out[i]
        name = _ALIAS.get(x.tag, x.tag)
        if name in _TAGS:
            f[_TAGS.index(name)] = 1
        f[19:27] = hits[i]
        f[27:39] = above[i]
        chars = sub[i, 0]
        f[39] = x.depth
        f[40] = np.log1p(chars)
        f[41] = chars / whole
        f[42] = sub[i, 1] / max(1.0, chars)
        f[43] = np.log1p(chars / max(1.0, sub[i, 2]))
        f[44] = sub[i, 3] / max(1.0, chars) * 30
        f[45] = np.log1p(chars / max(1.0, blocks[i]))
        f[46] = sub[i, 4]
        f[47] = paragraphs[i]
        f[48] = anchors[i] / max(1.0, blocks[i])
        f[49] = start[i] / whole
        f[50] = len(children[i])
        if i:
            p = x.parent
            like = children[p]
            f[51] = np.log1p(len(like))
            f[52] = chars / max(1.0, sub[p, 0])
            parent = nodes[p]
            f[53] = _TAGS.index(t) + 1 if (t := _ALIAS.get(parent.tag, parent.tag)) in _TAGS else 0
            f[54] = hits[p, 1:].sum() - hits[p, 0]
    for kids in children:
        for k, i in enumerate(kids):
            out[i, 55] = k / len(kids)
            out[i, 56] = sum(nodes[j].tag == nodes[i].tag for j in kids[max(0, k - 3) : k + 4]) - 1
            out[i, 57] = np.log1p(max((sub[j, 0] for j in kids[max(0, k - 3) : k + 4] if j != i), default=0))
    return out


@dataclass
class Forest:
    """Boosted trees of one depth as flat arrays; a split sends larger values right."""

    depth: int
    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray
    value: np.ndarray  # trees x 2**depth
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 2.0) -> Forest:
    """Gradient boosting with logistic loss and Newton leaves on binned features."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    cuts = [np.unique(np.concatenate([c, [0.5]])) if len(np.unique(x[:, f])) <= 8 else c for f, c in enumerate(cuts)]
    size = max(map(len, cuts)) + 1
    code = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], axis=1)
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    z = np.full(n, np.log(p0 / (1 - p0)))
    forest = Forest(depth, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), float(z[0]))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width_l = 2**level - 1, 2**level
            best = np.full(width_l, 1e-6)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                key = (at - first) * size + code[:, f]
                gs = np.bincount(key, g, width_l * size).reshape(width_l, size)
                hs = np.bincount(key, h, width_l * size).reshape(width_l, size)
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[:, len(cuts[f]) :] = 0
                k = gain.argmax(axis=1)
                for node in np.flatnonzero(gain[np.arange(width_l), k] > best):
                    best[node] = gain[node, k[node]]
                    forest.feature[t, first + node], forest.cut[t, first + node] = f, cuts[f][k[node]]
            at = 2 * at + 1 + (x[np.arange(n), forest.feature[t, at]] > forest.cut[t, at])
        leaf = at - (2**depth - 1)
        forest.value[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        z += forest.value[t][leaf]
    return forest


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Kept nodes: the consistent labelling (no kept node below a dropped one) with the largest sum of log odds."""
    keep = np.array(odds, float)
    for i, x in enumerate(nodes):
        if x.hidden:
            keep[i] = -1e6
    gain = keep.copy()  # of keeping node i, with the best for what is below
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    out = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        out[i] = gain[i] > 0 and (i == 0 or out[x.parent])
    return out


# -- pages with known main text ------------------------------------------------


class _Page:
    """Composes one page; texts of main blocks carry the mark that ``labels`` finds again."""

    MARK = "\x01"

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts = self.r.sample(["ba", "den", "lo", "mi", "tur", "sha", "ver", "on", "ex", "pli", "no", "ré", "gü", "ter", "isch", "al", "qui", "za", "thr", "ing", "um"], 12)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice(self.parts) for _ in range(r.randint(1, 3)))
            out.append(w + (r.choice([".", ",", ".", ";", "?"]) if r.random() < 0.12 else ""))
        return " ".join(out).capitalize() + r.choice([".", ".", "", "!"])

    def maybe(self, p: float, part, *a) -> str:
        return part(*a) if self.r.random() < p else ""

    def attribute(self, *names: str) -> str:
        r = self.r
        name = r.choice(names)
        return r.choice([f' class="{name}"', f" class={name}", f' id="{name}"', f' class="{name} {r.choice(["x1", "col-8", "clearfix", "wide", "block"])}"'])

    def rich(self, text: str) -> str:
        r, out = self.r, []
        for w in text.split(" "):
            q = r.random()
            out.append(f"<b>{w}</b>" if q < 0.01 else f'<a href="/x">{w}</a>' if q < 0.025 else f"<em>{w}</em>" if q < 0.035 else w + "<br>" if q < 0.04 else w)
        text = " ".join(out)
        return "<b>" + text if r.random() < 0.08 else text

    def para(self, low: int = 3, high: int = 90) -> str:
        return f"<p>{self.MARK}{self.rich(self.words(low, high))}" + self.r.choice(["</p>", "</p>", "</p>\n", ""])

    def links(self, low: int = 3, high: int = 12) -> str:
        r = self.r
        items = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(r.randint(low, high))]
        kind = r.randrange(4)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if kind < 2 else " | ".join(items) if kind == 2 else "".join(f"<div>{x}</div>" for x in items)

    def nav(self) -> str:
        body = self.links()
        return self.r.choice([f"<nav>{body}</nav>", f"<div{self.attribute('menu', 'navbar', 'nav', 'main-menu', 'navigation', 'breadcrumb')}>{body}</div>", f"<ul{self.attribute('menu', 'nav')}>" + "".join(f"<li><a href=/>{self.words(1, 2)}</a>" for _ in range(5)) + "</ul>"])

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div class=logo>{self.words(1, 3)}</div>", f"<p>{self.words(3, 12)}</p>", f"<a href=/>{self.words(1, 3)}</a>"]) + self.maybe(0.5, self.nav) + self.maybe(0.3, self.form)
        return self.r.choice([f"<header>{inner}</header>", f"<div{self.attribute('header', 'masthead', 'site-header', 'top', 'banner')}>{inner}</div>"])

    def footer(self) -> str:
        r = self.r
        inner = r.choice([f"&copy; {self.words(2, 5)} &middot; {self.words(4, 30)}", f"<p>{self.words(5, 40)}</p>", self.links(), f"<p>Copyright 2024 {self.words(2, 6)}</p>{self.links()}"])
        return r.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{self.attribute('footer', 'site-footer', 'colophon', 'bottom', 'copyright')}>{inner}</div>"])

    def ad(self) -> str:
        return self.r.choice([f"<div{self.attribute('ad', 'ads', 'advert', 'sponsored', 'ad-slot', 'promo', 'advertisement')}>{self.words(2, 25)}</div>", f"<aside class=ad><p>{self.words(4, 25)}</p></aside>", f"<div{self.attribute('ad-box', 'sponsor', 'banner-ad')}><p>{self.words(5, 30)}</p><a href=/buy>{self.words(1, 3)}</a></div>"])

    def side(self) -> str:
        inner = "".join(self.r.choice([f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<p>{self.words(6, 45)}</p>", self.ad(), f"<div class=widget><h4>{self.words(1, 3)}</h4><p>{self.words(5, 40)}</p></div>"]) for _ in range(self.r.randint(1, 3)))
        return self.r.choice([f"<aside>{inner}</aside>", f"<div{self.attribute('sidebar', 'side', 'widgets', 'right-rail', 'related', 'recommended')}>{inner}</div>", f"<section{self.attribute('related', 'sidebar', 'more-stories')}>{inner}</section>"])

    def notice(self) -> str:
        return self.r.choice([f"<div{self.attribute('cookie', 'cookie-banner', 'notice', 'consent', 'alert', 'gdpr', 'modal', 'popup')}><p>{self.words(6, 40)}</p><button>{self.words(1, 2)}</button></div>", f"<div{self.attribute('notice', 'cookie-notice', 'alert')}>{self.words(6, 35)}</div>", f"<div role=alert>{self.words(4, 25)}</div>", f"<p{self.attribute('notice', 'cookie-notice', 'alert')}>{self.words(6, 35)}</p>"])

    def form(self) -> str:
        return self.r.choice([f"<form><label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button></form>", f"<form{self.attribute('search', 'newsletter', 'login', 'subscribe')}><p>{self.words(5, 25)}</p><input name=q><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select></form>", f"<div{self.attribute('newsletter', 'signup', 'subscribe')}><p>{self.words(4, 25)}</p><input><button>Go</button></div>"])

    def share(self) -> str:
        return f"<div{self.attribute('share', 'social', 'tags', 'follow')}>{self.links(2, 5)}</div>"

    def comments(self) -> str:
        r = self.r
        kind = r.randrange(4)
        each = [[f"<div class=comment><b>{self.words(1, 2)}</b><p>{self.words(5, 80)}</p></div>", f"<li{self.attribute('comment')}><p>{self.words(5, 80)}</p></li>", f"<article class=comment><header>{self.words(1, 3)}</header><p>{self.words(5, 80)}</p></article>", f"<p>{self.words(4, 60)}</p>"][kind] for _ in range(r.randint(1, 6))]
        inner = self.maybe(0.6, lambda: f"<h3>{self.words(1, 2)}</h3>") + ("<ol>" + "".join(each) + "</ol>" if kind == 1 else "".join(each)) + self.maybe(0.3, self.form)
        return r.choice([f"<section{self.attribute('comments', 'discussion', 'reader-comments', 'responses comments')}>{inner}</section>", f"<div{self.attribute('comments', 'comment-list', 'disqus', 'replies', 'user-comments')}>{inner}</div>"])

    def story(self) -> str:
        r, m = self.r, self.MARK
        out = [self.maybe(0.85, lambda: f"<h1>{m}{self.words(2, 12)}</h1>")]
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            q = r.random()
            if q < 0.78:
                out.append(self.para())
            elif q < 0.84:
                out.append(f"<{(h := r.choice(['h2', 'h3']))}>{m}{self.words(1, 8)}</{h}>")
            elif q < 0.89:
                out.append("<ul>" + "".join(f"<li>{m}{self.rich(self.words(2, 25))}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 6))) + "</ul>")
            elif q < 0.92:
                out.append(f"<blockquote>{m}{self.words(5, 40)}</blockquote>")
            elif q < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            elif q < 0.96:
                out.append(f"<pre>{m}{self.words(5, 30)}</pre>")
            elif q < 0.98:
                out.append(f"<figure><img src=x><figcaption>{m}{self.words(3, 15)}</figcaption></figure>")
            else:
                out.append(f"<div>{m}{self.words(10, 60)}</div>")
            if r.random() < 0.08:
                out.append(r.choice([self.ad, self.share, self.form, self.side, self.notice])())
        if r.random() < 0.06:
            out.append(f"{m}{self.words(5, 40)}")
        return "".join(out)

    def build(self) -> str:
        r = self.r
        tail = self.maybe(0.12, self.comments) + self.maybe(0.1, self.share)
        story = self.story() + tail
        main = r.choice([
            f"<article>{story}</article>", f"<article>{story}</article>", f"<article{self.attribute('post', 'story', 'entry')}>{story}</article>", f"<main>{story}</main>", f"<main><article>{story}</article></main>",
            f"<div{self.attribute('content', 'post', 'entry-content', 'article-body', 'main', 'story', 'text')}>{story}</div>", f"<div{self.attribute('c1', 'wrap', 'box', 'col')}>{story}</div>", f"<section{self.attribute('content', 'article', 'post')}>{story}</section>",
            f"<div id=main><div class=post>{story}</div></div>",
        ])
        pieces = [self.maybe(0.5, self.header), self.maybe(0.6, self.nav), self.maybe(0.25, self.notice), self.maybe(0.5, self.ad), self.maybe(0.2, self.side), main, self.maybe(0.3, self.comments), self.maybe(0.35, self.side), self.maybe(0.2, self.ad), self.maybe(0.2, self.form), self.maybe(0.85, self.footer), self.maybe(0.15, self.notice)]
        body = "".join(f"<!-- {self.words(1, 3)} -->" * (r.random() < 0.1) + p for p in pieces)
        if r.random() < 0.3:
            body = f"<div{self.attribute('container', 'wrapper', 'page', 'outer', 'site')}>{body}</div>"
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head * (r.random() < 0.9)}<body>{body}" + r.choice(["</body></html>", "</body></html>", ""])


def labels(nodes: list[Node]) -> np.ndarray:
    """Whether a generated page's node holds main text; takes the marks out."""
    y = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        if any(_Page.MARK in t for t in nodes[i].text):
            y[i] = 1
        nodes[i].text = [t.replace(_Page.MARK, "") for t in nodes[i].text]
        if y[i] and i:
            y[nodes[i].parent] = 1
    return y


@lru_cache(maxsize=2)
def train(pages: int = 700, seed: int = 17) -> Forest:
    """The forest fitted on ``pages`` composed pages."""
    xs, ys = [], []
    for k in range(pages):
        nodes = parse(_Page(seed * 1_000_003 + k).build())
        ys.append(labels(nodes))
        xs.append(features(nodes))
    return boost(np.vstack(xs), np.concatenate(ys))


def blocks_of(sources: list[str | None], forest: Forest) -> list[list[str]]:
    """The main-text blocks of each page; all pages' nodes go through the forest together."""
    trees = [parse(s) for s in sources]
    xs = [features(t) for t in trees]
    odds = forest.predict(np.vstack(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for nodes in trees:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        texts = (clean(x.text) for x, k in zip(nodes, kept, strict=True) if k and x.text)
        out.append([t for t in texts if t])
    return out


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", forest: Forest | None = None) -> DataFrame:
    """(id, blocks): the main-text blocks of every page, in page order."""
    forest = forest or train()

    def make():
        return lambda ids, sources: [ids, blocks_of(sources, forest)]

    kind = dict(pages.dtypes)[id_column]
    return map_batches(pages.select(F.col(id_column).alias("id"), F.col(html_column).alias("html")), make, ["id", "html"], f"id {kind}, blocks array<string>", 128)
