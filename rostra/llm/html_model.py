"""HTML extraction by a tree-structured graphical model.

A page becomes a tree of block elements with runs of inline text as leaves. Every node is
main text or not; node potentials come from tags, class and id words, text length and
link density, parent-child potentials from the kind of child. Sum-product messages go
upward and downward, and give the exact marginal of each node; runs whose marginal is at
least half that of the likeliest run are the main text, if the page is likely enough to have any. The weights maximise the likelihood of labelled pages,
whose gradient uses the same messages. Pages are labelled by :func:`labelled_pages`,
which composes pages in the usual layouts and knows which parts are the article;
``PAGES`` of them, a fixed number, are fitted on the driver once.

Scripts, styles and other elements that are never text are left out by the parser.
Character references are decoded, white space inside a run becomes one space, runs are
trimmed and joined in page order by one space.

Defined results: null, empty and textless html give an empty text; cut-off tags, missing
end tags and bare text are read as browsers do; a ``data-main`` attribute of an input page
means nothing; what ``hidden`` or a style of no display hides is no text; very long and very deep pages are read whole, in time that follows their
length; repeated rows give the same; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAGES = 1200
#: Pages that have main text with less than this probability have none.
LEAST_LIKELY = 0.05
#: Elements that are nested deeper count as children of the last one above.
DEEPEST = 200

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Elements that a page does not show.
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])(?!\s*=\s*["']?(?:false|until-found))|(?<![\w-])style\s*=\s*["'][^"']*?(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
#: The label of text outside all elements, in pages that this module composes.
_ALL_MAIN = "<!--data-main-->"
_WORD = re.compile(r"[a-z]+")
_SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Fixed values of HTML: elements without content, of raw text, never shown as text, of inline text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template noscript textarea title iframe svg math object select datalist head noembed noframes canvas audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


_VALUE = re.compile(r"""([\w-]+)\s*=\s*("[^"]*"|'[^']*')""")


def _kept(m: re.Match) -> str:
    """An attribute without its value, but for styles."""
    return m[0] if m[1].lower() == "style" else m[1] + '="' + ("false" if m[1].lower() == "hidden" and m[2][1:-1].lower() in ("false", "until-found") else "") + '"'


class Tree:
    """Nodes in page order: parent, depth, kind (1 for runs of text), feature names, text, label."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.run: list[int] = []
        self.features: list[list[str]] = []
        self.text: list[str] = []
        self.label: list[int] = []

    def add(self, parent: int, run: int, features: list[str], text: str, label: int) -> int:
        if parent >= 0 and self.depth[parent] >= DEEPEST:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.run.append(run)
        self.features.append(features)
        self.text.append(text)
        self.label.append(label)
        return len(self.parent) - 1


def _bucket(n: int) -> str:
    return "0" if n == 0 else "1-3" if n < 4 else "4-9" if n < 10 else "10-24" if n < 25 else "25-"


def parse(page: str | None, labelled: bool = False) -> Tree:
    """The tree of a page; only pages that this module composes are ``labelled``."""
    tree = Tree()
    page = page or ""
    outside = int(labelled and page.startswith(_ALL_MAIN))
    at = tree.add(-1, 0, ["tag=#root"], "", outside)
    # open elements: name, block node, label, whether they hide what is in them
    stack: list[tuple[str, int, int, bool]] = [("#root", at, outside, False)]
    # how many elements of each name are open, so that a tag costs no walk through the stack
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = 0
    links = 0
    hidden = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            _, node, label, _ = stack[-1]
            words = text.count(" ") + 1
            share = linked / max(1, sum(map(len, pieces)))
            last = text[-1]
            features = ["tag=#text", f"words={_bucket(words)}", f"link={'0' if share == 0 else 'some' if share < 0.5 else 'most'}", "end=long" if words > 24 else "end=stop" if last in ".!?:;\"”»…" else "end=open"]
            features += ["sign=copy"] if "©" in text else []
            tree.add(node, 1, features, text, label)
        pieces.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal hidden, links
        while stack[-1][0] != name:
            pop()
        pop()

    def pop() -> None:
        nonlocal hidden, links
        top, _, _, hides = stack[-1]
        if top not in INLINE:
            flush()
        stack.pop()
        opened[top] -= 1
        hidden -= hides
        links -= top == "a"

    pos = 0
    n = len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        end = m.start() if m else n
        if end > pos and not hidden:
            pieces.append(page[pos:end])
            linked += (end - pos) if links else 0
        if not m:
            break
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if opened[name]:
                close(name)
            elif name == "p":
                flush()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in CLOSES_P and opened["p"]:
            close("p")
        elif name in CLOSED_BY:
            ends, scope = CLOSED_BY[name]
            while any(opened[e] for e in ends):
                inner = next(s[0] for s in reversed(stack) if s[0] in scope or s[0] in ends or s[0] == "#root")
                if inner not in ends:
                    break
                close(inner)
                if name != "tr" or inner == "tr":
                    break
        elif name == "body" and opened["head"]:
            close("head")
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        attrs = {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(m[3] or m[6] or "")}
        label = stack[-1][2]
        if labelled and "data-main" in attrs:
            label = int(attrs["data-main"])
        # only attributes outside other attributes' values hide
        rest = m[3] or m[6] or ""
        hides = name in UNSEEN or ("hidden" in rest.lower() or "none" in rest.lower()) and bool(_HIDDEN.search(_VALUE.sub(_kept, rest)))
        if name in INLINE:
            stack.append((name, stack[-1][1], stack[-1][2], hides))
        else:
            flush()
            words = {w for k in ("class", "id", "role") for w in _WORD.findall(_SPLIT_CASE.sub(" ", attrs.get(k, "")).lower())}
            node = stack[-1][1]
            if not hidden and not hides:
                node = tree.add(node, 0, [f"tag={name}", *(f"word={w}" for w in sorted(words))], "", label)
            stack.append((name, node, label, hides))
        opened[name] += 1
        hidden += hides
        links += name == "a"
        if name in RAW:
            k = re.compile(rf"</{name}", re.I).search(page, pos)
            pos = k.start() if k else n
    while len(stack) > 1:
        pop()
    flush()
    return tree


class Forest:
    """Trees side by side, as arrays by depth."""

    def __init__(self, trees: list[Tree]) -> None:
        first = np.cumsum([0, *(len(t.parent) for t in trees)])
        self.parent = np.concatenate([np.array(t.parent) + f for t, f in zip(trees, first, strict=False)])
        self.run = np.concatenate([t.run for t in trees]).astype(np.int64)
        self.first = first
        depth = np.concatenate([t.depth for t in trees])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])

    def log_sums(self, unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The log partition sum of each tree, by the upward messages."""
        inside = unary.copy()
        for level in self.levels[:0:-1]:
            joint = inside[level][:, None, :] + pair[self.run[level]]
            np.add.at(inside, self.parent[level], np.logaddexp(joint[:, :, 0], joint[:, :, 1]))
        root = inside[self.levels[0]]
        return np.logaddexp(root[:, 0], root[:, 1])

    def messages(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Node marginals of label 1, pair marginals by kind of child, and the log partition sum.

        unary: log potentials (nodes, 2); pair: log potentials (kind of child, parent, child).
        """
        inside = unary.copy()
        up = np.zeros_like(unary)
        for level in self.levels[:0:-1]:
            joint = inside[level][:, None, :] + pair[self.run[level]]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(inside, self.parent[level], up[level])
        belief = inside.copy()
        pairs = np.zeros((2, 2, 2))
        root = inside[self.levels[0]]
        total = float(np.logaddexp(root[:, 0], root[:, 1]).sum())
        for level in self.levels[1:]:
            joint = (belief[self.parent[level]] - up[level])[:, :, None] + pair[self.run[level]]
            belief[level] = inside[level] + np.logaddexp(joint[:, 0], joint[:, 1])
            joint += inside[level][:, None, :]
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            joint /= joint.sum((1, 2), keepdims=True)
            leaf = self.run[level] == 1
            pairs[0] += joint[~leaf].sum(0)
            pairs[1] += joint[leaf].sum(0)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), pairs, total


class Model:
    def __init__(self, names: dict[str, int], weights: np.ndarray, pair: np.ndarray) -> None:
        self.names, self.weights, self.pair = names, weights, pair

    def unary(self, trees: list[Tree]) -> np.ndarray:
        rows, columns = _entries(trees, self.names)
        n = sum(len(t.parent) for t in trees)
        out = np.zeros((n, 2))
        out[:, 1] = np.bincount(rows, weights=self.weights[columns], minlength=n)
        return out

    def given_some(self, forest: Forest, unary: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Marginals of runs in proportion to the likeliest of their page.

        That no run of a page is main has a probability of its own, from the same messages with all
        runs held at 0. Where main text is likely enough, though no run alone is, the likeliest are it;
        a page with a certain run is as it was.
        """
        held = unary.copy()
        held[forest.run == 1, 1] = -60.0
        some = -np.expm1(np.minimum(forest.log_sums(held, self.pair) - forest.log_sums(unary, self.pair), 0.0))
        best = np.maximum.reduceat(np.where(forest.run == 1, p, 0.0), forest.first[:-1])
        scale = np.where((best > 0) & (some >= LEAST_LIKELY), best, 1.0)
        return p / np.repeat(scale, np.diff(forest.first))

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page."""
        trees = [parse(p) for p in pages]
        if not trees:
            return []
        forest = Forest(trees)
        unary = self.unary(trees)
        p, _, _ = forest.messages(unary, self.pair)
        p = self.given_some(forest, unary, p)
        return [" ".join(x for x, r, q in zip(t.text, t.run, p[f : f + len(t.run)], strict=True) if r and q >= 0.5) for t, f in zip(trees, forest.first, strict=False)]


def _entries(trees: list[Tree], names: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    rows, columns, k = [], [], 0
    for t in trees:
        for features in t.features:
            for f in features:
                j = names.get(f)
                if j is not None:
                    rows.append(k)
                    columns.append(j)
            k += 1
    return np.array(rows, np.int64), np.array(columns, np.int64)


def fit(pages: list[str], rounds: int = 150, rate: float = 0.12, decay: float = 0.0005) -> Model:
    """Maximum likelihood of the labels in ``data-main`` by Adam on the exact gradient."""
    trees = [parse(p, labelled=True) for p in pages]
    names: dict[str, int] = {}
    for t in trees:
        for features in t.features:
            for f in features:
                names.setdefault(f, len(names))
    forest = Forest(trees)
    rows, columns = _entries(trees, names)
    y = np.concatenate([t.label for t in trees]).astype(np.int64)
    below = np.concatenate(forest.levels[1:])
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.run[below], y[forest.parent[below]], y[below]), 1)
    model = Model(names, np.zeros(len(names)), np.zeros((2, 2, 2)))
    size = len(names)
    first, second = np.zeros(size + 8), np.zeros(size + 8)
    for step in range(1, rounds + 1):
        unary = np.zeros((len(y), 2))
        unary[:, 1] = np.bincount(rows, weights=model.weights[columns], minlength=len(y))
        p, pairs, _ = forest.messages(unary, model.pair)
        grad = np.concatenate([np.bincount(columns, weights=(p - y)[rows], minlength=size), (pairs - seen).ravel()]) / len(trees)
        theta = np.concatenate([model.weights, model.pair.ravel()])
        grad += decay * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model.weights, model.pair = theta[:size], theta[size:].reshape(2, 2, 2)
    return model


# Class words that sites commonly use, by part of the page.
_PARTS = {
    "menu": ("nav", "nav menu navbar navigation topnav breadcrumb breadcrumbs menubar mainmenu links pagination tabs"),
    "head": ("header", "header masthead banner top site branding logo topbar hero"),
    "foot": ("footer", "footer foot bottom copyright legal colophon siteinfo"),
    "side": ("aside", "sidebar side aside widget related rail recommended more popular trending tags archive"),
    "notice": ("div", "cookie cookies consent notice gdpr alert banner popup modal overlay message disclaimer privacy"),
    "advert": ("div", "ad ads advert advertisement sponsor sponsored promo adsense banner promoted commercial"),
    "form": ("form", "form newsletter signup subscribe login search contact subscription register searchform"),
    "comment": ("section", "comments comment reply replies responses disqus discussion respond thread commentlist reader"),
    "share": ("div", "share social sharing follow buttons toolbar print"),
}
_LAYOUT = "row col column cell grid flex box block inner outer left right center wide full half panel section unit wrap region area"
_MAIN = "content post article entry story main body text prose page single hentry container wrapper"


#: Layouts of composed pages besides containers with telling names.
BARE = ("short", "loose", "unnamed")


def labelled_pages(n: int = PAGES, seed: int = 11, layouts: tuple[str, ...] = BARE, only: bool = False) -> list[str]:
    """Pages in varied layouts; ``data-main`` tells which elements are main text.

    Besides articles in containers with telling names there are, by ``layouts``, short pages and text without tags,
    articles whose blocks have no container, and containers that say nothing; with ``only`` no others.
    """
    rng = random.Random(seed)
    pool = ["".join(rng.choices("aeioutnrslhd", k=rng.randrange(2, 9))) for _ in range(3000)]

    def word() -> str:
        return rng.choice(pool)

    def words(lo: int, hi: int) -> str:
        return " ".join(rng.choices(pool, k=rng.randrange(lo, hi)))

    def sentences(lo: int, hi: int) -> str:
        return " ".join(words(4, 14).capitalize() + "." for _ in range(rng.randrange(lo, hi)))

    def maybe(p: float) -> bool:
        return rng.random() < p

    def named(options: str, p: float = 0.8) -> str:
        if not maybe(p):
            return ""
        pick = rng.choices(options.split(), k=2)
        value = pick[0] if maybe(0.6) else f"{pick[0]}-{word()}" if maybe(0.5) else f"{pick[0]} {pick[1]}"
        return f' {"id" if maybe(0.2) else "class"}="{value}"'

    def link_list() -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 4)}</a>{"</li>" if maybe(0.8) else ""}' for _ in range(rng.randrange(1, 9)))
        return f"<ul>{items}</ul>" if maybe(0.7) else " ".join(f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(5))

    def prose(tag: str = "p") -> str:
        text = sentences(1, 7) if maybe(0.85) else words(1, 12)
        if maybe(0.25):
            text += f' <a href="/{word()}">{words(1, 4)}</a> {words(2, 9)}.'
        if maybe(0.2):
            text = f"<b>{words(2, 6)}</b>{'<br>' if maybe(0.5) else ' '}{text}"
        return f"<{tag}>{text}" + (f"</{tag}>" if maybe(0.85) else "")

    def part(kind: str) -> str:
        tag, options = _PARTS[kind]
        name = tag if maybe(0.65) else rng.choice(["div", "section", "div"])
        attrs = named(options, 0.3 if name == tag and tag not in ("div", "section") else 1.0)
        if kind == "menu":
            inner = link_list()
        elif kind == "head":
            inner = f"<h1>{words(1, 5)}</h1>" * maybe(0.5) + (link_list() if maybe(0.6) else f"<p>{words(2, 9)}</p>")
        elif kind == "foot":
            inner = (f"&copy; {words(1, 4)} &middot; {sentences(1, 3)}" if maybe(0.6) else f"<p>&copy; {words(2, 8)}</p>") + link_list() * maybe(0.4)
        elif kind == "side":
            inner = f"<h3>{words(1, 4)}</h3>" + (link_list() if maybe(0.7) else prose() + prose())
        elif kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name=q><p>{sentences(1, 3)}</p><button>{words(1, 3)}</button>"
        elif kind == "comment":
            inner = f"<h3>{words(1, 3)}</h3>" + "".join(f"<div{named('comment reply body author')}><p>{sentences(1, 4)}</p></div>" for _ in range(rng.randrange(1, 5)))
        elif kind == "share":
            inner = link_list()
        else:
            inner = sentences(1, 3) if maybe(0.5) else f"<p>{sentences(1, 3)}</p>"
        return f'<{name}{attrs} data-main="0">{inner}</{name}>'

    def bare() -> str:
        """No name, or one of layout alone."""
        return "" if maybe(0.5) else f' class="{rng.choice(_LAYOUT.split())}{rng.choice(["", "", "-8", "-md-6", " " + word()])}"'

    def heading(level: int) -> str:
        return f"<h{level}>{words(2, 9)}</h{level}>"

    def article() -> str:
        body = [heading(1)] if maybe(0.85) else []
        if body and maybe(0.25):
            body = [f"<header>{body[0]}</header>"]
        if maybe(0.15):
            body += [f"<p>{words(1, 5)}{'.' if maybe(0.6) else ''}</p>" for _ in range(rng.randrange(4, 30))]
        for _ in range(rng.randrange(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                body.append(prose())
            elif kind < 0.78:
                body.append(heading(rng.randrange(2, 4)))
            elif kind < 0.84:
                body.append("<ul>" + "".join(f"<li>{sentences(1, 2) if maybe(0.6) else words(1, 8)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.88:
                body.append(f"<blockquote>{prose()}</blockquote>")
            elif kind < 0.91:
                body.append("<table><tr><td>" + words(1, 5) + "<td>" + words(1, 5) + "</table>")
            elif kind < 0.94:
                body.append(f"<pre><code>{words(3, 12)}</code></pre>")
            elif layouts and kind < 0.96:
                body.append(f'<button data-main="0">{words(1, 4)}</button>')
            else:
                body.append(part(rng.choice(["advert", "share", "side", "notice", "form"])))
        if maybe(0.1):
            body.append(part("comment"))
        layout = rng.random() * (0.35 if only else 1) if layouts else 1.0
        if layout < 0.15 and "loose" in layouts or only and layouts == ("loose",):  # blocks without a container of their own
            return "".join(b if re.match(r"<\w+[^>]*data-main", b) else re.sub(r"^<(\w+)", r'<\1 data-main="1"', b) for b in body)
        if layout < 0.35 and "unnamed" in layouts:  # containers that say nothing
            inner = "".join(body) if maybe(0.85) else f" {'<br>' if maybe(0.5) else ' '} ".join(sentences(1, 6) for _ in range(rng.randrange(1, 6)))
            for _ in range(rng.randrange(0, 3)):
                inner = f"<div{bare()}>{inner}</div>"
            tag = rng.choice(["div", "div", "div", "section", "center"])
            return f'<{tag}{bare()} data-main="1">{inner}</{tag}>'
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        inner = "".join(body)
        if maybe(0.25):
            inner = f"<div{named(_MAIN)}>{inner}</div>"
        return f'<{tag}{named(_MAIN, 0.35 if tag in ("article", "main") else 1.0)} data-main="1">{inner}</{tag}>'

    def short() -> str:
        """Text without tags, single paragraphs, and bodies that hold nothing but text."""
        kind = rng.random()
        if kind < 0.35:
            return _ALL_MAIN + "\n".join(sentences(1, 8) for _ in range(rng.randrange(1, 6)))
        if kind < 0.65:
            inner = "".join(prose() for _ in range(rng.randrange(1, 4))) if maybe(0.6) else sentences(1, 9)
            return f'{"<html>" * maybe(0.7)}<body data-main="1">{heading(1) * maybe(0.4)}{inner}'
        if kind < 0.9:
            return "".join(re.sub(r"^<(\w+)", r'<\1 data-main="1"', heading(1) * (k == 0 and maybe(0.3)) or prose()) for k in range(rng.randrange(1, 6)))
        cell = "td" if maybe(0.6) else "th"
        return f'<body><table><tr><{cell}{named(_PARTS["menu"][1], 0.7)} data-main="0">{link_list()}</{cell}><td data-main="1">{"".join(prose() for _ in range(rng.randrange(1, 6)))}</td></tr></table>'

    def page() -> str:
        if "short" in layouts and (layouts == ("short",) and only or maybe(0.15)):
            return short()
        before = [part(k) for k in ("notice", "head", "menu", "advert", "form", "share") if maybe(0.45)]
        after = [part(k) for k in ("share", "comment", "side", "advert", "form", "foot", "notice") if maybe(0.45)]
        rng.shuffle(before)
        middle = article()
        if maybe(0.35):
            wrap = rng.choice(["div", "main", "section"])
            side = part("side")
            middle = f"<{wrap}{named('container wrapper layout page row site')}>" + (side + middle if maybe(0.5) else middle + side) + f"</{wrap}>"
        out = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var t='</p>';</script></head><body>" + "<!-- x -->".join(before) + middle + "".join(after)
        return out + "</body></html>" * maybe(0.9)

    return [page() for _ in range(n)]


@functools.cache
def default_model() -> Model:
    half = PAGES // 2
    return fit(labelled_pages(half) + labelled_pages(half, 12, ()))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``; one pass, no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for lo in range(0, batch.num_rows, 64):
                text += shared.value.texts(batch.column("html")[lo : lo + 64].to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
