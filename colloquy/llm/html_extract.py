"""Main text of web pages: boosted trees judge DOM nodes, decoding makes the judgements agree along the tree.

A page becomes a tree of elements. Each element gets features: size and density of the text below it, share of link
text, attribute tokens, depth, place among its siblings and what stands in it. The model gives the probability that an
element holds article text. Decoding picks the labels of greatest total likelihood under the rule that an element is
kept only if its parent is, so a dropped sidebar keeps nothing below it and a kept paragraph has kept ancestors.

The model is fitted on a bounded sample: ``SAMPLE_PAGES`` pages (smallest hash of the html) that mark their article by
an ``article`` element, and ``VARIANTS`` rearrangements of each with other element names, attributes and added page
furniture, so that no single mark decides. Every page is then read whole, in one scan without a shuffle.

Reading is linear in a page, whatever is left open in it. Quotes count at the start of an attribute's value only; an
unclosed one ends with its tag. A null html counts as empty and gives an empty text; repeated rows and identifiers return as
often as they occur; an empty table gives no rows; without a page that marks its article the texts are empty.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.boosted_trees import BoostedTrees, fit as fit_trees

SAMPLE_PAGES = 240
SAMPLE_CHARS = 60_000
VARIANTS = 3
PAGES_AT_ONCE = 400

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title".split())
# Elements whose whole content goes, and those of a choice list, which a block ends.
_DROPPED = frozenset("noscript template iframe select".split())
_CHOICE = frozenset("select option optgroup".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Formulas, drawings and embedded objects stand in a line of text; their elements may end in "/>".
_EMBEDDED = frozenset("math svg object".split())
_INLINE |= _EMBEDDED | frozenset(
    "mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mmultiscripts mtable mtr mtd mspace mstyle mpadded mphantom "
    "menclose mfenced merror semantics annotation annotation-xml g path circle ellipse line polygon polyline rect use defs symbol tspan textpath desc "
    "lineargradient radialgradient stop clippath mask pattern marker filter foreignobject image text".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = frozenset("article section div main aside nav header footer table ul ol dl body form td th blockquote".split())
_PART = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(>|$)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAMES = re.compile(r"[a-z]+|[0-9]+")

# Attribute tokens and element names by what they announce.
TOKENS = {
    "body": "article content entry main post story text body page hentry prose markdown blog".split(),
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs tabs toc pagination pager skip links topbar".split(),
    "head": "header masthead banner logo brand hero top branding".split(),
    "foot": "footer foot copyright colophon legal bottom".split(),
    "side": "sidebar side aside widget related recommended popular trending rail promo teaser more secondary".split(),
    "note": "cookie cookies consent notice alert popup modal gdpr overlay toast newsletter subscribe signup paywall disclaimer".split(),
    "ads": "ad ads advert advertisement adsense sponsor sponsored adslot dfp promotion".split(),
    "form": "form search login contact input field register feedback poll".split(),
    "talk": "comment comments reply replies respond discussion disqus reader reviews thread".split(),
    "share": "share social sharing follow tweet like buttons meta byline tags author date".split(),
}
TAGS = {
    "body": ("article", "main"),
    "box": ("div", "section", "td", "center", "span"),
    "para": ("p", "blockquote", "pre"),
    "title": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "list": ("ul", "ol", "li", "dl", "dt", "dd"),
    "table": ("table", "tbody", "tr"),
    "menu": ("nav", "menu"),
    "head": ("header", "hgroup"),
    "foot": ("footer", "address"),
    "side": ("aside",),
    "form": ("form", "button", "fieldset", "label", "legend", "dialog"),
    "figure": ("figure", "figcaption"),
}
_KIND = {token: k for k, names in enumerate(TOKENS.values()) for token in names}
_TAG_KIND = {tag: k for k, names in enumerate(TAGS.values()) for tag in names}


class Node:
    """An element; ``parts`` are its texts and child elements in page order."""

    __slots__ = ("tag", "attrs", "parts", "parent", "block", "box", "drawn", "open", "depth", "chars", "links", "tags", "paras", "stops", "kept", "children")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[str | Node] = []
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.kept = False
        # nearest element, itself included, that is not inline; nearest one that stray end tags do not leave
        self.block: Node = parent.block if parent and tag in _INLINE else self
        self.box: Node = parent.box if parent and tag not in _SCOPE else self
        # whether it is, or directly stands among, the parts of a formula, a drawing or an object
        self.drawn: bool = tag in _EMBEDDED or tag in _INLINE and parent is not None and parent.drawn
        self.open: Counter = Counter() if self.box is self else self.box.open  # open elements of the box by tag


def parse(page: str) -> Node:
    """Element tree of a page. Scripts, styles, comments and other markup are left out; references are decoded."""
    root = node = Node("body", "", None)
    at, size = 0, len(page)
    boxes: Counter = Counter()  # open boxes of the page by tag

    def close(n: Node) -> Node:
        (boxes if n.tag in _SCOPE else n.open)[n.tag] -= 1
        return n.parent

    def add(text: str) -> None:
        if text:
            node.parts.append(entities.unescape(text))

    while at < size:
        m = _PART.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name or name in ("html", "body", "head"):
            continue
        if m.group(1):
            # an end tag without a start tag, or a stray one inside a box, is left out; all others close what they leave
            if (boxes if name in _SCOPE else node.open)[name]:
                while True:
                    tag, node = node.tag, close(node)
                    if tag == name:
                        break
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "br":
            node.parts.append(" ")
        if name in _VOID:
            continue
        closes = _CLOSES.get(name, ())
        if name not in _INLINE and name not in _DROPPED and name not in _CHOICE:
            up = node.block
            while up.parent and (up.tag == "p" or up.tag in closes or up.tag in TAGS["title"] or up.tag in _CHOICE):
                while node is not up:
                    node = close(node)
                node = close(up)
                up = node.block
        child = Node(name, m.group(3), node)
        if name not in _DROPPED:
            node.parts.append(child)
            node.children.append(child)
        if not m.group(3).rstrip().endswith("/") or name not in ("p", "div", "span") and not child.drawn:
            node = child
            (boxes if name in _SCOPE else child.open)[name] += 1
    return root


def _measure(root: Node) -> list[Node]:
    """Elements in page order without inline ones; sums over what stands below each."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(reversed(n.children))
    for n in reversed(order):
        own = "".join(p for p in n.parts if type(p) is str)
        n.chars = len(own) - own.count(" ") - own.count("\n")
        n.stops = own.count(".") + own.count(",") + own.count("!") + own.count("?")
        n.links = n.tags = n.paras = 0
        for c in n.children:
            n.chars += c.chars
            n.stops += c.stops
            n.links += c.links
            n.tags += c.tags + 1
            n.paras += c.paras + (c.tag == "p")
        if n.tag == "a":
            n.links = n.chars
    return order


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """Block elements in page order and their feature rows."""
    nodes = [n for n in _measure(root) if n.tag not in _INLINE]
    total = max(1, root.chars)
    seen = 0
    rows = []
    place: dict[int, tuple[int, int, int, int]] = {}
    for n in nodes:
        blocks = [c for c in n.children if c.tag not in _INLINE]
        same = {}
        for i, c in enumerate(blocks):
            same[c.tag] = same.get(c.tag, 0) + 1
            place[id(c)] = (i, len(blocks), same[c.tag], n.chars)
        i, siblings, twins, around = place.get(id(n), (0, 1, 1, n.chars))
        marks = [0] * len(TOKENS)
        for m in _ATTR.finditer(n.attrs) if n.attrs else ():
            if m.group(1).lower() in ("class", "id", "role", "itemprop", "aria-label", "data-type"):
                for t in _NAMES.findall((m.group(2) or m.group(3) or m.group(4) or "").lower()):
                    k = _KIND.get(t)
                    if k is not None:
                        marks[k] += 1
        kind = [0] * len(TAGS)
        k = _TAG_KIND.get(n.tag)
        if k is not None:
            kind[k] = 1
        up_kind = _TAG_KIND.get(n.parent.tag, -1) if n.parent else -1
        rows.append([
            math.log1p(n.chars), n.chars / total, n.links / max(1, n.chars), n.chars / (n.tags + 1), n.stops * 100 / max(1, n.chars),
            n.depth, i, siblings - i, siblings, twins, len(blocks), n.paras, n.chars / max(1, n.paras), n.chars / max(1, around),
            seen / total, up_kind, *marks, *kind,
        ])
        if not blocks:
            seen += n.chars
    return nodes, np.array(rows, dtype=np.float64)


def decode(nodes: list[Node], probability: np.ndarray) -> None:
    """Set ``kept`` to the likeliest labels under which a kept element's parent is kept; the root always is."""
    own = np.log(np.clip(probability, 1e-6, 1 - 1e-6))
    none = np.log(1 - np.clip(probability, 1e-6, 1 - 1e-6))
    at = {id(n): i for i, n in enumerate(nodes)}
    drop, keep = none.copy(), own.copy()  # of the whole part of the tree below
    for i in range(len(nodes) - 1, 0, -1):
        up = at[id(_block_parent(nodes[i]))]
        drop[up] += drop[i]
        keep[up] += max(keep[i], drop[i])
    nodes[0].kept = True
    for i in range(1, len(nodes)):
        nodes[i].kept = _block_parent(nodes[i]).kept and bool(keep[i] > drop[i])


def _block_parent(n: Node) -> Node:
    n = n.parent
    while n.tag in _INLINE:
        n = n.parent
    return n


def kept_text(root: Node) -> str:
    """Blocks of kept elements in page order, white space made single, joined by newlines."""
    blocks, now = [], []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        n, k = stack.pop()
        while k < len(n.parts):
            part = n.parts[k]
            k += 1
            if type(part) is str:
                now.append(part)
                continue
            if part.tag in _INLINE:
                stack += [(n, k), (part, 0)]
                break
            flush()
            if part.kept:
                stack += [(n, k), (part, 0)]
                break
        else:
            if n.tag not in _INLINE:
                flush()
    return "\n".join(blocks)


def extract(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """Main texts of some pages."""
    trees = [parse(p or "") for p in pages]
    found = [features(t) for t in trees]
    if not found:
        return []
    p = model.probability(np.concatenate([x for _, x in found]))
    at, out = 0, []
    for tree, (nodes, x) in zip(trees, found):
        decode(nodes, p[at:at + len(x)])
        at += len(x)
        out.append(kept_text(tree))
    return out


_FURNITURE = {
    "menu": (("nav", ""), ("div", "class='{}-menu'"), ("ul", "class='navbar {}'"), ("div", "role='navigation'"), ("ol", "class='breadcrumb'")),
    "head": (("header", ""), ("div", "class='site-header {}'"), ("div", "id='masthead'"), ("div", "role='banner'")),
    "foot": (("footer", ""), ("div", "id='footer'"), ("div", "class='{} copyright'"), ("section", "class='site-footer'")),
    "side": (("aside", ""), ("div", "class='sidebar {}'"), ("section", "class='related-posts'"), ("div", "id='widget{}'"), ("div", "class='promo'")),
    "note": (("div", "class='cookie-notice {}'"), ("div", "id='consent'"), ("section", "class='newsletter'"), ("div", "role='alert'"), ("p", "class='notice'")),
    "ads": (("div", "class='ad'"), ("div", "class='ads {}'"), ("div", "id='advert'"), ("aside", "class='sponsored'"), ("p", "class='advertisement'")),
    "form": (("form", ""), ("form", "class='search {}'"), ("div", "class='login-form'")),
    "talk": (("div", "id='comments'"), ("section", "class='comments {}'"), ("div", "class='reader-comments'"), ("ol", "class='comment-list'"), ("div", "class='discussion'")),
    "share": (("div", "class='share {}'"), ("ul", "class='social'"), ("div", "class='byline'")),
}
_BODIES = (("article", ""), ("article", "class='post'"), ("main", ""), ("div", "id='content'"), ("div", "class='entry-content {}'"), ("div", "class='article-body'"), ("section", "class='story'"), ("div", "class='{}'"), ("div", ""))


def _furniture(kind: str, texts: list[str], rng: random.Random) -> str:
    tag, attrs = rng.choice(_FURNITURE[kind])
    attrs = attrs.format(rng.choice(["x", "box", "wrap", "col", "block"]))
    some = lambda n: " ".join(rng.choice(texts).split()[:n])
    item = "li" if tag in ("ul", "ol") else rng.choice(["p", "div", "li"])
    if kind in ("menu", "share"):
        inner = "".join(f"<li><a href='/'>{some(rng.randint(1, 3))}</a></li>" for _ in range(rng.randint(2, 9)))
        inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>"
    elif kind == "form":
        inner = f"<label>{some(2)}</label><input><button>{some(1)}</button>" + (f"<p>{some(12)}</p>" if rng.random() < 0.5 else "")
    elif kind == "talk":
        inner = f"<h3>{some(2)}</h3>" * rng.randint(0, 1) + "".join(f"<{item} class='comment'>{rng.choice(['', '<b>' + some(1) + '</b> '])}{some(rng.randint(4, 60))}</{item}>" for _ in range(rng.randint(1, 6)))
    elif kind == "side":
        inner = f"<h3>{some(2)}</h3>" * rng.randint(0, 1) + rng.choice(["<ul>" + "".join(f"<li><a href='/'>{some(6)}</a></li>" for _ in range(rng.randint(2, 6))) + "</ul>", f"<p>{some(rng.randint(5, 40))}</p>"])
    else:
        inner = rng.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<p>{}</p><a href='/'>more</a>"]).format(some(rng.randint(3, 30)))
    return f"<{tag} {attrs}>{inner}</{tag}>"


def _variant(title: str, paragraphs: list[str], texts: list[str], rng: random.Random) -> str:
    """A page around the given article; ``data-type='gold'`` marks it and ``data-type='junk'`` what stands in it."""
    esc = entities.escape
    some = lambda kinds, chance: "".join(_furniture(k, texts, rng) for k in kinds if rng.random() < chance)
    inner = f"<h1>{esc(title)}</h1>" if rng.random() < 0.8 else ""
    for k, text in enumerate(paragraphs):
        shape = rng.random()
        if shape < 0.06:
            inner += "<ul>" + "".join(f"<li>{esc(x)}</li>" for x in text.split(". ") if x) + "</ul>"
        elif shape < 0.1:
            inner += f"<h2>{esc(' '.join(text.split()[:4]))}</h2><p>{esc(text)}</p>"
        elif shape < 0.15:
            inner += f"<blockquote><p>{esc(text)}</p></blockquote>"
        elif shape < 0.2:
            inner += f"<div>{esc(text)}</div>"
        else:
            inner += f"<p>{esc(text)}</p>"
        if rng.random() < 0.06:
            inner += f"<junk>{_furniture(rng.choice(['ads', 'note', 'share', 'side', 'form']), texts, rng)}</junk>"
    if rng.random() < 0.3:
        inner += f"<junk>{_furniture(rng.choice(['talk', 'share', 'side']), texts, rng)}</junk>"
    if rng.random() < 0.15:
        inner = f"<junk>{_furniture(rng.choice(['head', 'share']), texts, rng)}</junk>" + inner
    tag, attrs = rng.choice(_BODIES)
    body = f"<gold><{tag} {attrs.format(rng.choice(['x', 'wrap', 'text', 'main']))}>{inner}</{tag}></gold>"
    page = some(["head", "menu", "note", "ads"], 0.5) + body + some(["share", "talk", "side", "ads", "form", "note", "foot"], 0.5)
    for _ in range(rng.choice([0, 0, 1, 2])):
        page = f"<div class='{rng.choice(['page', 'wrap', 'container', ''])}'>{page}</div>"
    return page


def _labelled(page: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and labels of a marked page; the marks themselves are taken out first. None without an article."""
    root = parse(page)
    inside: dict[int, int] = {}
    order = [root]
    for n in order:
        was = inside.get(id(n.parent), 0) if n.parent else 0
        inside[id(n)] = 1 if n.tag in ("gold", "article") and not was else 2 if n.tag == "junk" else was
        order += n.children
    gold = [n for n in order if n.tag == "gold"] or [n for n in order if n.tag == "article"]
    if len(gold) != 1:
        return None
    holds = set()
    up = gold[0]
    while up:
        holds.add(id(up))
        up = up.parent
    label = {id(n): inside[id(n)] == 1 or id(n) in holds for n in order}
    for n in order:  # take the marks out
        if n.tag in ("gold", "junk"):
            up = n.parent
            k = up.parts.index(n)
            up.parts[k:k + 1] = n.parts
            k = up.children.index(n)
            up.children[k:k + 1] = n.children
            for c in n.children:
                c.parent = up
    todo = [root]
    for n in todo:
        n.depth = n.parent.depth + 1 if n.parent else 0
        todo += n.children
    nodes, x = features(root)
    return x, np.array([label[id(n)] for n in nodes], dtype=float)


def _article(page: str) -> list[str]:
    root = parse(page)
    todo = [root]
    for n in todo:
        if n.tag == "article":
            for m in _measure(n):
                m.kept = True
            return kept_text(n).split("\n")
        todo += n.children
    return []


def train(sample: list[str]) -> BoostedTrees:
    """Fit on marked pages and on rearrangements of their articles."""
    rng = random.Random(7)
    articles = [a for a in map(_article, sample) if a and a[0]]
    if not articles:
        words = [f"{a}{b}" for a in "ba ce di fo gu".split() for b in "lan mer tis pon rud".split()]
        articles = [[" ".join(rng.choices(words, k=rng.randint(6, 60))) + "." for _ in range(rng.randint(2, 9))] for _ in range(60)]
    texts = [t for a in articles for t in a]
    rows = [_labelled(p) for p in sample]
    for a in articles:
        for _ in range(VARIANTS):
            size = rng.choice([len(a), len(a), 2, 4])
            if rng.random() < 0.15:  # some articles are hardly longer than a menu
                a = [" ".join(t.split()[:rng.randint(1, 5)]) for t in a]
            rows.append(_labelled(_variant(a[0], a[1:1 + size] or a, texts, rng)))
    rows = [r for r in rows if r]
    return fit_trees(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))


def fit(pages: DataFrame, html_col: str = "html") -> BoostedTrees:
    """Fit on the ``SAMPLE_PAGES`` different pages of at most ``SAMPLE_CHARS`` characters with the smallest hash.

    The hashes are ranked first, so tasks never send whole pages that another task's pages displace.
    """
    page = F.col(html_col)
    rows = pages.filter(page.isNotNull() & (F.length(page) <= SAMPLE_CHARS)).select(page.alias("page"), F.xxhash64(page).alias("h"))
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    picked = rows.filter(F.col("h") <= (least[-1] if least else 0)).groupBy("h").agg(F.min("page").alias("page")).orderBy("h").collect()
    return train([r["page"] for r in picked])


def main_text(pages: DataFrame, html_col: str = "html", out: str = "text", model: BoostedTrees | None = None) -> DataFrame:
    """Add the main text of every page as ``out``."""
    model = model or fit(pages, html_col)

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        done: list[str] = []
        for at in range(0, len(pages), PAGES_AT_ONCE):
            done += extract(pages.iloc[at:at + PAGES_AT_ONCE].tolist(), model)
        return pd.Series(done, dtype=object)

    return pages.withColumn(out, text(F.col(html_col)))


def report(pages: DataFrame) -> DataFrame:
    return main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
