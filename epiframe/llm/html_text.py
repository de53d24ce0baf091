"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements, whose leaves are blocks of text. Each node has a hidden state: 0
boilerplate, 1 content, 2 holder of both (leaves only 0 or 1). Unary factors come from a node's tag, its class
and id words, and a leaf's length, links and punctuation; pairwise factors tie child to parent by the child's
kind of tag. Sum-product messages go up and then down the tree, exact on trees, for all pages of a batch at
once, level by level; leaves whose marginal of content is above one half are the text.

All factors are relative frequencies counted on ``PAGES`` labelled pages, which a seeded generator writes in many
layouts (menus, headers, adverts, notices, sidebars, forms, comments, footers around and within articles).

Elements that are not displayed (``hidden``, or ``display: none`` in their style) give no text.

Edge cases: null or empty html gives an empty text; unclosed tags, comments, quotes and scripts are tolerated; a
page of any length is read whole; repeated rows give repeated results; null ids and urls stay null; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import html as html_lib
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.common import table

PAGES, SEED, SMOOTH = 700, 5, 0.5
STATES = 3

_BLOCK = frozenset("html body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset blockquote pre figure figcaption address details summary center hr dialog menu legend label button select option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no text of the page.
_HIDDEN = frozenset("head script style noscript template svg iframe object math canvas audio video".split())
_CLOSES_P = _BLOCK - {"label", "button", "option", "legend"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_name = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: An attribute up to its value's end, or to the quote (group 1) that opens its value.
_attribute = re.compile(r"[\s/]*+(?:[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:([\"'])|[^\s>]*+))?)?")
_attr = re.compile(r"(?i)\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_quoted = re.compile(r"\"[^\"]*\"|'[^']*'")
_hidden_style = re.compile(r"(?i)\bstyle\s*=\s*(?:\"[^\"]*?\bdisplay\s*:\s*none|'[^']*?\bdisplay\s*:\s*none|display:none)")
_hidden_flag = re.compile(r"(?i)(?:^|\s)hidden(?=[\s=/]|$)")
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Words of class, id and role attributes, by what they tell.
_WORDS = {w: group for group, words in {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "nav": "nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager toc topbar",
    "foot": "footer foot copyright colophon legal",
    "head": "header masthead top logo branding",
    "side": "sidebar side aside rail widget widgets complementary related recommended popular trending",
    "comment": "comment comments reply replies discussion disqus respond commentlist reader",
    "notice": "notice notices cookie cookies consent gdpr alert warning popup modal overlay paywall subscribe newsletter signup message",
    "form": "form search login register contact",
    "share": "share sharing social tags meta byline author toolbar tools buttons",
    "body": "article content post entry main story text body page single blog prose",
}.items() for w in words.split()}


class Tree:
    """Nodes of one page in order: parent, tag, features; ``texts`` holds the leaves' texts by node."""

    __slots__ = ("parents", "kinds", "features", "texts")

    def __init__(self):
        self.parents, self.kinds, self.features, self.texts = [], [], [], {}

    def add(self, parent: int, kind: str, features: list[str]) -> int:
        self.parents.append(parent)
        self.kinds.append(kind)
        self.features.append(features)
        return len(self.parents) - 1


def _unseen(attributes: str) -> bool:
    """Whether the attributes take an element off the page: ``hidden``, or a style that displays nothing."""
    return bool(_hidden_style.search(attributes) or _hidden_flag.search(_quoted.sub("''", attributes)))


def _element_features(tag: str, attributes: str) -> list[str]:
    out = [f"t:{tag}"]
    if attributes and not attributes.isspace():
        for m in _attr.finditer(attributes):
            words = _part.findall(m[2] or m[3] or m[4] or "")
            out += {f"w:{_WORDS[w]}" for w in map(str.lower, words) if w in _WORDS}
    return list(dict.fromkeys(out))


def _leaf_features(text: str, linked: int, tag: str) -> list[str]:
    n = len(text)
    share = linked / max(n, 1)
    return [
        f"n:{min(int(math.log2(n + 1)), 9)}",
        f"l:{0 if not linked else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"e:{text[-1] in '.!?…\"”»)' if n else False}",
        f"p:{tag}",
        f"c:{'©' in text or '&copy' in text}",
    ]


def _tag(page: str, lt: int, quotes: dict[str, int], dead: set[int]) -> tuple[str, str, str, int] | None:
    """Slash, name, attributes and end of the tag at ``lt``. A quote opens a string only as an attribute's value and
    if one more follows (``quotes`` has each kind's last place); ``dead`` collects places from which no tag ends, so
    that a page takes linear time."""
    m = _name.match(page, lt)
    if not m:
        return None
    at, seen = m.end(), []
    while at < len(page) and page[at] != ">":
        if at in dead:
            at = len(page)
            break
        seen.append(at)
        a = _attribute.match(page, at)
        at = a.end()
        if a[1] and at <= quotes[a[1]]:
            at = page.find(a[1], at) + 1
    if at < len(page):
        return m[1], m[2], page[m.end() : at], at + 1
    dead.update(seen)
    return None


def parse(page: str) -> Tree:
    """The tree of a page. Inline elements are part of the text of their block."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", tree.add(-1, "#root", ["t:#root"]))]
    buffer: list[str] = []
    linked = links = 0
    at, end, last = 0, len(page), page.rfind(">")
    unseen: tuple[str, int] | None = None  # an inline element that is not displayed, and how many of its name are open
    covered = 0  # depth of the outermost block that is not displayed, 0 where there is none
    quotes, dead = {q: page.rfind(q) for q in "\"'"}, set()

    def flush():
        nonlocal linked, unseen
        unseen = None
        if buffer:
            text = " ".join(html_lib.unescape("".join(buffer)).split())
            buffer.clear()
            if text and not covered:
                tag, node = stack[-1]
                leaf = tree.add(node, "#text", _leaf_features(text, linked, tag))
                tree.texts[leaf] = text
        linked = 0

    def close(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        """Ends the innermost open element of these names, unless the scope's element is nearer."""
        nonlocal covered
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                covered = covered if covered < len(stack) else 0
                return
            if stack[i][0] in scope:
                return

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and unseen is None:
            buffer.append(page[at:lt])
            linked += (lt - at) if links else 0
        if lt == end:
            break
        if lt > last:  # no tag can end any more
            buffer.append(page[lt:])
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _tag(page, lt, quotes, dead)
        if not m:
            buffer.append("<")
            at = lt + 1
            continue
        slash, tag, attributes, at = m
        tag = tag.lower()
        if tag not in _BLOCK and tag not in _HIDDEN and tag not in _VOID:
            if unseen is not None and tag == unseen[0]:
                unseen = (tag, unseen[1] + (-1 if slash else 1)) if not slash or unseen[1] > 1 else None
            elif unseen is None and not slash and _unseen(attributes):
                unseen = (tag, 1)
        if slash:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCK:
                flush()
                close((tag,))
        elif tag in _HIDDEN:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag == "head":
                    pass
                else:
                    at = end
        elif tag in _BLOCK:
            flush()
            if tag in _SAME:
                close(_SAME[tag], _SCOPE.get(tag, ()))
            if tag in _CLOSES_P and tag != "p" and stack[-1][0] == "p":
                close(("p",))
            links = 0
            if tag not in _VOID:
                stack.append((tag, tree.add(stack[-1][1], tag, _element_features(tag, attributes))))
                if not covered and tag not in ("html", "body") and _unseen(attributes):
                    covered = len(stack) - 1
        elif tag == "a":
            links += 1
        elif tag == "br" or tag in ("img", "input", "textarea"):
            buffer.append(" ")
    flush()
    return tree


def _edge(kind: str) -> str:
    return kind if kind in ("#text", "p", "div", "section", "article", "main", "body", "html", "li", "ul", "ol", "table", "tr", "td") else "h" if kind in ("h1", "h2", "h3", "h4") else "bar" if kind in ("nav", "header", "footer", "aside", "form") else "other"


class Factors:
    """Log factors: unary by feature, pairwise (parent state, child state) by the child's kind."""

    def __init__(self, pages: list[tuple[Tree, list[int]]]):
        seen, states = defaultdict(Counter), Counter()
        pairs = defaultdict(lambda: np.full((STATES, STATES), SMOOTH))
        root = np.full(STATES, SMOOTH)
        for tree, labels in pages:
            for node, (parent, kind, features) in enumerate(zip(tree.parents, tree.kinds, tree.features, strict=True)):
                y, leaf = labels[node], kind == "#text"
                states[leaf, y] += 1
                for f in features:
                    seen[f][leaf, y] += 1
                if parent < 0:
                    root[y] += 1
                else:
                    pairs[_edge(kind)][labels[parent], y] += 1
        self.root = np.log(root / root.sum())
        self.pairs = {k: np.log(v / v.sum(1, keepdims=True)) for k, v in pairs.items()}
        self.unknown_pair = np.log(np.full((STATES, STATES), 1 / STATES))
        self.unary = {}
        for f, n in seen.items():
            leaf = max(n.items(), key=lambda x: x[1])[0][0]
            self.unary[f] = np.array([math.log((n[leaf, y] + SMOOTH) / (states[leaf, y] + 2 * SMOOTH + 1)) for y in range(STATES)])

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        """P(state 1) of every node of every tree, by messages up and down all trees together."""
        offsets = np.cumsum([0, *(len(t.parents) for t in trees)])
        total = int(offsets[-1])
        unary, pair = np.zeros((total, STATES)), np.empty((total, STATES, STATES))
        parent, depth = np.full(total, -1), np.zeros(total, np.int64)
        i = 0
        for t, base in zip(trees, offsets, strict=False):
            for p, kind, features in zip(t.parents, t.kinds, t.features, strict=True):
                for f in features:
                    if (u := self.unary.get(f)) is not None:
                        unary[i] += u
                if kind == "#text":
                    unary[i, 2] = -1e9
                pair[i] = self.pairs.get(_edge(kind), self.unknown_pair)
                if p < 0:
                    unary[i] += self.root
                else:
                    parent[i], depth[i] = base + p, depth[base + p] + 1
                i += 1
        below, up = unary.copy(), np.zeros((total, STATES))
        by_depth = np.argsort(depth, kind="stable")
        levels = np.split(by_depth, np.cumsum(np.bincount(depth))[:-1]) if total else []
        for level in levels[:0:-1]:
            up[level] = _lse(below[level][:, None, :] + pair[level], 2)
            np.add.at(below, parent[level], up[level])
        full = below.copy()
        for level in levels[1:]:
            down = _lse((full[parent[level]] - up[level])[:, :, None] + pair[level], 1)
            full[level] = below[level] + down
        full -= full.max(1, keepdims=True) if total else 0
        p = np.exp(full)
        one = p[:, 1] / p.sum(1)
        return [one[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _labelled(rng: random.Random) -> tuple[Tree, list[int]]:
    """A page of a random layout; content leaves carry a mark that tells their label."""
    syllable = ("an", "er", "on", "th", "re", "ti", "le", "mo", "ka", "su", "vi", "do", "ist", "ung", "é")
    word = lambda: "".join(rng.choice(syllable) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=4, b=25: words(a, b).capitalize() + rng.choice(".....!?")
    text = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    pick = rng.choice
    mark = "⁠"  # in every content block

    def links(a=3, b=9):
        items = [link() for _ in range(rng.randint(a, b))]
        return pick((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)))()

    def attr(*names):
        return pick((f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="{word()} {pick(names)}"', f" class='{pick(names)}-{word()}'"))

    def ad():
        return pick((f'<div{attr("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner")}>{pick((sentence, lambda: text(1, 3), link))()}</div>', f'<aside{attr("ad", "promo")}><p>{sentence()}</p></aside>', f'<p{attr("ad", "sponsored")}>{text(1, 2)}</p>'))

    def notice():
        tag = pick(("div", "p", "section", "aside"))
        return f'<{tag}{attr("notice", "cookie-notice", "alert", "consent", "newsletter", "subscribe", "popup")}>{pick((sentence, lambda: f"<p>{text(1, 3)}</p><button>{words(1, 2)}</button>"))()}</{tag}>'

    def form():
        return f'<form action="/{word()}"{pick(("", attr("search", "login", "newsletter", "contact")))}><label>{words(1, 4)}</label><input name="q"><p>{sentence()}</p><button>{words(1, 2)}</button></form>'

    def nav():
        return pick((f"<nav>{links()}</nav>", f'<div{attr("nav", "menu", "navbar", "breadcrumbs", "pagination")}>{links()}</div>', f'<ul{attr("menu", "nav")}>' + "".join(f"<li>{link()}" for _ in range(5)) + "</ul>", f"<nav><p>{words(2, 5)}</p>{links()}</nav>"))

    def header():
        return pick((f"<header>{pick((f'<h1>{words(1, 4)}</h1>', f'<p>{sentence()}</p>', link()))}{pick(('', nav()))}</header>", f'<div{attr("header", "masthead", "branding")}><div>{words(1, 5)}</div>{pick(("", nav()))}</div>'))

    def side():
        inner = "".join(pick((lambda: f"<h3>{words(1, 3)}</h3>{links()}", lambda: f"<p>{text(1, 2)}</p>", ad, lambda: f"<div>{sentence()}</div>"))() for _ in range(rng.randint(1, 3)))
        return pick((f"<aside>{inner}</aside>", f'<div{attr("sidebar", "side", "widget", "related", "popular")}>{inner}</div>', f'<section{attr("sidebar", "related")}>{inner}</section>'))

    def foot():
        inner = pick((f"&copy; {word()}.example.net &middot; {text(1, 2)}", f"<p>&copy; 20{rng.randint(10, 29)} {words(1, 4)}</p>{links()}", f"<p>{text(1, 2)}</p>"))
        return pick((f"<footer>{inner}</footer>", f'<div{attr("footer", "copyright", "legal")}>{inner}</div>'))

    def comments():
        one = lambda: pick((f"<p>{text(1, 4)}</p>", f'<li><b>{word()}</b><p>{text(1, 3)}</p></li>', f'<div{attr("comment", "reply")}><p>{words(1, 2)}</p><p>{text(1, 3)}</p></div>', f"<article><p>{text(1, 3)}</p></article>"))
        inner = f"<h2>{words(1, 2)}</h2>" + "".join(one() for _ in range(rng.randint(1, 6)))
        tag = pick(("section", "div", "ol", "aside"))
        return f'<{tag}{attr("comments", "comment-list", "discussion", "replies", "reader-comments")}>{inner}</{tag}>'

    def block():
        inline = lambda s: pick((s, s, s, f"<b>{s}</b>", f"{s} <a href='/x'>{words(1, 2)}</a> {words(2, 9)}.", f"<em>{words(1, 3)}</em> {s}"))
        para = lambda: pick((f"<p>{mark}{inline(text(1, 8))}</p>", f"<p>{mark}{inline(text(1, 5))}", f"<p>{mark}{sentence(1, 6)}</p>", f"<p><b>{mark}{sentence()}<br>"))
        k = rng.random()
        if k < 0.72:
            return para()
        if k < 0.80:
            return f"<h{(n := rng.randint(2, 4))}>{mark}{words(1, 8)}</h{n}>"
        if k < 0.85:
            return "<ul>" + "".join(f"<li>{mark}{sentence(1, 12)}{pick(('</li>', ''))}" for _ in range(rng.randint(2, 6))) + "</ul>"
        if k < 0.89:
            return f"<blockquote>{pick((f'<p>{mark}{text(1, 3)}</p>', mark + text(1, 2)))}</blockquote>"
        if k < 0.92:
            return f"<div>{mark}{text(1, 6)}</div>"
        if k < 0.95:
            return "<table>" + "".join(f"<tr><td>{mark}{words(1, 3)}</td><td>{mark}{words(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
        if k < 0.97:
            return f"<figure><img src='x'><figcaption>{mark}{sentence()}</figcaption></figure>"
        return f"<pre>{mark}{words(3, 30)}</pre>"

    inner = []
    if rng.random() < 0.85:
        h = f"<h1>{mark}{words(2, 12)}{pick(('', '.'))}</h1>"
        inner.append(pick((h, h, f"<header>{h}</header>")))
    for _ in range(rng.randint(1, 14)):
        inner.append(block())
        if rng.random() < 0.06:
            inner.append(pick((ad, notice, form, side))())
    if rng.random() < 0.1:
        inner.append(comments())
    open_, close_ = pick((("<article>", "</article>"),) * 4 + ((f'<div{attr("content", "post", "entry", "article", "main", "story", "text")}>', "</div>"),) * 3 + (("<main>", "</main>"), ("<main><article>", "</article></main>"), (f'<section{attr("content", "post", "article")}>', "</section>"), ("<div>", "</div>"), (f'<article{attr("post", "entry")}><div{attr("content", "body")}>', "</div></article>")))
    article = open_ + "".join(inner) + close_
    before = [f() for f in (header, nav, ad, notice, form, side) if rng.random() < 0.4]
    after = [f() for f in (comments, side, ad, notice, form, nav) if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    middle = "".join(before) + article + "".join(after)
    if rng.random() < 0.35:
        middle = f'<div{pick(("", attr("wrapper", "container", "page")))}>{middle}</div>'
    if rng.random() < 0.85:
        middle += foot()
    tree = parse(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{pick(('', '<script>var t=1;</script>'))}{middle}{pick(('</body></html>', '</body></html>', ''))}")
    n = len(tree.parents)
    has = np.zeros((n, 2), np.int64)
    for leaf, t in tree.texts.items():
        has[leaf, int(mark in t)] = 1
    for node in range(n - 1, 0, -1):
        has[tree.parents[node]] += has[node]
    # an element is content if what it holds is mostly that, boilerplate if none is, else a holder of both
    return tree, [int(h[1] > 0) if kind == "#text" else 0 if not h[1] else 1 if h[1] >= 0.8 * h.sum() and kind not in ("body", "html", "#root") else 2 for h, kind in zip(has, tree.kinds, strict=True)]


@functools.cache
def model() -> Factors:
    rng = random.Random(SEED)
    return Factors([_labelled(rng) for _ in range(PAGES)])


def extract(pages: list[str | None], factors: Factors | None = None) -> list[str]:
    trees = [parse(p or "") for p in pages]
    marginals = (factors or model()).marginals(trees)
    return ["\n".join(t for leaf, t in tree.texts.items() if p[leaf] > 0.5) for tree, p in zip(trees, marginals, strict=True)]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    factors = model()
    group = 256

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            for at in range(0, b.num_rows, group):
                texts += extract(b.column(2).slice(at, group).to_pylist(), factors)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string")


def op3_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
