"""Main text of web pages by composite text density.

A page is parsed into a tree (void, optional and unclosed tags as browsers treat them). For each node, with C characters and T tags below
it, LC characters and LT tags of links, and LCb, Cb of the body::

    density = C / T * log(C / LC' * T / LT') / log(log(C / (C - LC)' * LC + LCb / Cb * C + e))

(primes: at least 1). A node's sum is that of the densities of its children. The threshold is the least
density on the path from the body to the node of greatest sum. From the body down, each node that reaches the threshold is content, and so is text
between elements that would reach it; the least subtree that covers all of them and the node of greatest sum is kept. Beside that path, only children
below the threshold that are links for the greater part are left out of it, unless it is an article. Parts that never are content, by tag, role, class or id
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments), are cut before anything is counted. A class or id counts as
a whole name: a slug that only has such a word in it marks nothing, nor does any on running text within an article. Nothing
else of the chosen subtree is dropped; where it is a part of an article, the whole article counts.

Text comes block by block in page order: character references are decoded, white space within a block becomes one space, blocks are joined by a line feed.

Cases: null html counts as empty, and gives an empty text with n_chars 0, as does a page without text. Plain text without tags is one block.
Repeated rows each give a row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import map_texts, table

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes template xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset(
    "script style noscript template iframe head title nav menu aside footer form button select textarea input option svg annotation annotation-xml embed audio video dialog noframes".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An opened tag closes an open one of these, up to the nearest of the others.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that mark what is not content, if all words of a class or id are of these or NEUTRAL.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside rail widget "
    "widgets footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login register search comment comments commentlist disqus respond "
    "discussion replies related recommended recommendations share sharing social pagination pager skip tags tagcloud copyright legal disclaimer form".split()
)

#: Words that say of a marked part what it is made of or where it stands.
NEUTRAL = frozenset("area articles bar block box button buttons bottom container entries global google holder icons inner js left link links list main outer page panel posts primary right section secondary site slot stories thread top unit wrap wrapper".split())
#: Those of UNWANTED that headings have as well: as ids, generated from a heading, they mark nothing within an article, nor any section.
HEADINGS = frozenset(
    "advertisement advertising banner comment consent cookies copyright disclaimer discussion form legal login menu navigation notice notices promotion recommendations register search sharing social sponsors "
    "subscription tags".split()
)
_NO_HEADINGS = UNWANTED - HEADINGS
#: Elements of running text: their ids mark nothing, and within an article their classes neither.
TEXT = INLINE | frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr caption figure figcaption blockquote pre br hr img math".split())

_MARKUP = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
_TOKEN = re.compile(_MARKUP + r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
#: From a quote on that is never closed, quotes hide no ``>``; so no quote is looked for to the end of a page twice.
_UNQUOTED = re.compile(_MARKUP + r"([^>]*)(?:>|\Z)", re.S)
_TAG = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/\"']|\Z)", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Names that tell what stands beside an element, not what it is.
_LAYOUT = re.compile(r"(?:has|with|no|without|layout|page|body|wrapper|container)[-_]")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "within", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.within = tag in ("article", "main") or parent is not None and parent.within
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _marks(names: list[str], words: frozenset) -> bool:
    """Whether a whole name, and not only a word of it, says that an element is not content."""
    found = [_WORDS.findall(n) for n in names if not _LAYOUT.match(n)]
    return any(not words.isdisjoint(f) and all(w in words or w in NEUTRAL for w in f) for f in found)


def unwanted(tag: str, attributes: str, within: bool = False) -> bool:
    """Whether an element never is content, from its tag and attributes; ``within``: it stands in an article."""
    if tag in NEVER:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            if tag in ("article", "main") or tag in TEXT and (within or name == "id"):
                continue
            if _marks(value.split(), _NO_HEADINGS if name == "id" and (within or tag == "section") else UNWANTED):
                return True
        elif name == "role":
            if value in ROLES:
                return True
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif name == "hidden" or value == "true":
            return True
    return False


class _Open:
    """The open elements, outermost first, and where those of each tag are; no question about them looks through them all."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}
        self.block, self.solid = [0], [0]  # the depth of the innermost element that is not inline; and no paragraph either

    @property
    def now(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        depth, inline = len(self.nodes), node.tag in INLINE
        self.at.setdefault(node.tag, []).append(depth)
        self.block.append(self.block[-1] if inline else depth)
        self.solid.append(self.solid[-1] if inline or node.tag == "p" else depth)
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        """Close the element at this depth and all in it."""
        for node in reversed(self.nodes[depth:]):
            self.at[node.tag].pop()
        del self.nodes[depth:], self.block[depth:], self.solid[depth:]

    def innermost(self, *tags: str) -> int:
        """The depth of the innermost open element of these; 0, the root's, if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tag: str) -> None:
        """After an end tag; one that fits nothing open is ignored. Inline ends do not close blocks."""
        depth = self.innermost(tag)
        if depth and not (tag in INLINE and self.block[-1] > depth):
            self.cut(depth)

    def make_room(self, tag: str) -> None:
        """What a start tag closes."""
        if tag in CLOSES_P and (depth := self.innermost("p")) > self.solid[-1]:
            self.cut(depth)
        elif tag == "body" and (depth := self.innermost("head")):
            self.cut(depth)
        elif tag in SIBLINGS:
            tags, bounds = SIBLINGS[tag]
            bound = self.innermost(*bounds)
            own = [self.at[t] for t in tags if self.at.get(t)]
            first = [depths[k] for depths in own if (k := bisect_right(depths, bound)) < len(depths)]
            if first:
                self.cut(min(first))


def _tokens(html: str) -> Iterator[str | re.Match]:
    """The texts and the markup of a page, in turn."""
    token, at, seek = _TOKEN, 0, 0
    while (found := html.find("<", seek)) >= 0:
        m = token.match(html, found)
        if m is None and token is _TOKEN and _TAG.match(html, found):
            token = _UNQUOTED
            m = token.match(html, found)
        if m is None:
            seek = found + 1
            continue
        if found > at:
            yield html[at:found]
        at = seek = (yield m) or m.end()
    if at < len(html):
        yield html[at:]


def parse(html: str) -> Node:
    """The tree of a page; elements that never are content hold their text still, but are marked."""
    root = Node("#root", None)
    open_, tokens, on = _Open(root), _tokens(html), None
    while True:
        try:
            m, on = tokens.send(on), None
        except StopIteration:
            return root
        if isinstance(m, str):
            open_.now.children.append(m)
            continue
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                open_.now.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            open_.close(tag)
            continue
        if tag in ("html", "body") and open_.innermost(tag):
            continue
        open_.make_room(tag)
        now = open_.now
        node = Node(tag, now, unwanted(tag, m[3], now.within))
        if tag == "header" and not open_.innermost("article", "main", "section"):
            node.dropped = True
        now.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, m.end())
            node.children.append(html[m.end() : end.start() if end else len(html)])
            on = end.end() if end else len(html)
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path")):
            open_.push(node)


def _below(root: Node) -> list[Node]:
    """The nodes that are not dropped, parents first; no recursion, so that depth is no limit."""
    order, at = [root], 0
    while at < len(order):
        order += [c for c in order[at].children if isinstance(c, Node) and not c.dropped]
        at += 1
    return order


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes that are not dropped; the nodes, parents first."""
    order = _below(root)
    for node in reversed(order):
        inner = _inner(node)
        node.chars = sum(len(_SPACE.sub("", unescape(c))) for c in node.children if isinstance(c, str)) + sum(c.chars for c in inner)
        node.tags = sum(1 + c.tags for c in inner if c.tag not in ("br", "wbr"))
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in inner)
        node.link_tags = sum((c.tag == "a") + c.link_tags for c in inner)
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in order:
        node.density = composite_density(node, share)
    for node in order:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.dropped)
    return order


def composite_density(node: Node, body_share: float) -> float:
    c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
    if not c:
        return 0.0
    base = math.log(max(c / max(1, c - lc) * lc + body_share * c + math.e, math.e))
    return c / t * max(0.0, math.log(c / max(1, lc) * t / lt)) / max(1.0, base)


def content(root: Node) -> Node:
    """The node whose subtree is the main text."""
    order = measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    best = max(_below(body), key=lambda n: n.total)  # the first, so the outermost, on a tie
    path = [best if best.total > 0 else body]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    share = body.link_chars / max(1, body.chars)
    top = max((k for k in range(1, len(path)) if _reaches_beside(path[k], path[k - 1], threshold, share)), default=0)
    chosen = _whole_article(path[top])
    if chosen is path[top] and chosen.tag not in ("article", "main"):
        for node, kept in zip(path[1 : top + 1], path, strict=False):
            for c in _inner(node):
                if c is not kept and c.density < threshold and 2 * c.link_chars > c.chars:
                    c.dropped = True
    return chosen


def _inner(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and not c.dropped]


def _reaches_beside(node: Node, inner: Node, threshold: float, body_share: float) -> bool:
    """Whether a child of ``node`` other than ``inner``, or the text between its children, has the threshold's density."""
    if any(c is not inner and c.chars and c.density >= threshold for c in _inner(node)):
        return True
    bare = Node("#text", None)
    bare.chars = node.chars - sum(c.chars for c in _inner(node))
    return bare.chars > 0 and composite_density(bare, body_share) >= threshold


def _whole_article(node: Node) -> Node:
    """The outermost article, main or inline-started container around a node: a part of an article stands for all of it."""
    found, at = node, node
    while at is not None:
        if at.tag in ("article", "main"):
            found = at
        elif found is at.parent is None:
            break
        at = at.parent
    while found.parent is not None and (found.tag in INLINE or found.tag in ("p", "br")):
        found = found.parent
    return found


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below a node, in page order."""
    out: list[list[str]] = [[]]
    todo: list[Node | str | None] = [node]  # None: a block ends
    while todo:
        item = todo.pop()
        if item is None:
            out.append([])
        elif isinstance(item, str):
            out[-1].append(unescape(item))
        elif not item.dropped:
            if item.tag in BLOCKS:
                out.append([])
                todo.append(None)
            todo += reversed(item.children)
    texts = [_SPACE.sub(" ", "".join(parts)).strip() for parts in out]
    return [t for t in texts if t]


def main_text(html: str) -> str:
    return "\n".join(blocks(content(parse(html)))) if html else ""


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars``."""

    def make():
        def run(htmls: list[str]) -> list:
            texts = [main_text(h) for h in htmls]
            return [texts, [len(t) for t in texts]]

        return run

    return map_texts(pages, "html", [pa.field("text", pa.string()), pa.field("n_chars", pa.int64())], make, keep)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
