"""Main text of web pages by tree scoring.

A page becomes a tree of elements; elements that hold menus, notices, forms and the like by what they are fall out. Each paragraph has
points for its length and commas, which its ancestors get, less with each step up, and a container's points are
discounted by the share of its text that is in links. An element whose class only sounds like a menu or a notice falls out too,
but not if most of the page's paragraph points are in it. The best container is kept, with those siblings that are like it.

Pages are extracted one by one (``mapInArrow`` over the scan's own partitions): no shuffle, and a task holds one batch. A page is
read in one pass; nothing in it makes that pass look back or start anew.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
LEFT_OUT = RAW | set(
    "nav footer button select option input dialog menu svg canvas object audio video map head datalist".split()
)
#: Elements that fall out unless the page's main text is in them: some pages stand in one form as a whole.
WRAPPERS = {"form", "fieldset", "aside"}
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section summary table ul".split()
)
#: An open element of the key ends where one of the values starts, if no element of BOUNDS lies between.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
BOUNDS = set("ul ol dl table tbody thead tfoot div article section main body".split())
P_BOUNDS = BOUNDS | {"td", "li", "button"}
ENDS = {new: [old for old, by in ENDED_BY.items() if new in by] for by in ENDED_BY.values() for new in by}
UNLIKELY = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup paywall sidebar side rail widget related recommended "
    "recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar "
    "comment comments disqus respond reply replies login search skip print copyright legal".split()
)
UNLIKELY_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NEVER_UNLIKELY = {"html", "body", "article", "main"}
PARAGRAPHS = set("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption div section article main".split())
TAG_POINTS = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "ol": -3.0, "ul": -3.0}

#: Share of the page's paragraph points from which on an element stays, whatever its class.
MOST = 0.8

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_CLASS = re.compile(r"""\bclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "out", "unlikely", "attrs", "points", "held", "chars", "link_chars")

    def __init__(self, tag: str, parent: Node | None, out: bool, unlikely: bool = False, attrs: str = ""):
        self.tag, self.parent, self.children, self.out, self.unlikely, self.attrs = tag, parent, [], out, unlikely, attrs
        self.points, self.held, self.chars, self.link_chars = 0.0, 0.0, 0, 0


def judged(tag: str, attrs: str, within_main: bool) -> tuple[bool, bool]:
    """Whether an element of this tag and these attributes holds no main text, and whether its class or id only sounds so."""
    if tag in LEFT_OUT or tag == "header" and not within_main:
        return True, False
    if not attrs or tag in NEVER_UNLIKELY:
        return False, tag in WRAPPERS
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    if a.get("role", "").lower() in UNLIKELY_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return True, False
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{a.get('class', '')} {a.get('id', '')}").lower()
    return False, tag in WRAPPERS or not UNLIKELY.isdisjoint(_WORDS.findall(names))


def tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the ``>`` is that ends a tag, from ``at`` in it on; -1 if none does. A quote that opens a value and is never closed
    (``last``: the last place of each) does not count."""
    while at <= last[">"]:
        m = _STOP.search(html, at)
        if m is None or m[0] == ">":
            return m.start() if m else -1
        j = at = m.start()
        while html[j - 1].isspace():
            j -= 1
        if html[j - 1] == "=" and at < last[m[0]]:
            at = html.index(m[0], at + 1)
        at += 1
    return -1


def tokens(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, tag or text, attributes, place after it): kind is "text", "open" or "close". Comments and declarations are passed over.

    After an "open" the caller may send the place to go on from.
    """
    last = {c: html.rfind(c) for c in ">\"'"}
    start = at = 0
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            break
        close = html.startswith("/", lt + 1)
        name = _NAME.match(html, lt + 1 + close)
        if name is None and not close and html[lt + 1 : lt + 2] not in ("!", "?"):
            at = lt + 1
            continue
        if lt > start:
            yield "text", html[start:lt], "", lt
        if name is not None:
            end = tag_end(html, name.end(), last)
            if end < 0:
                return
            goto = yield "close" if close else "open", name[0].lower(), html[name.end() : end], end + 1
            at = end + 1 if goto is None else goto
        elif html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = len(html) if end < 0 else end + 3
        else:
            end = html.find(">", lt)
            at = len(html) if end < 0 else end + 1
        start = at
    if start < len(html):
        yield "text", html[start:], "", len(html)


def parsed(html: str) -> Node:
    """The tree of a page: children are nodes and strings with their character references decoded."""
    root = at = Node("#root", None, False)
    pos = 0
    opened: Counter[str] = Counter()  # open elements by tag: without one, there is no way up to go

    def left(node: Node) -> Node:
        """Closes ``node`` and what is open in it."""
        inner = at
        while inner is not node.parent:
            opened[inner.tag] -= 1
            inner = inner.parent
        return inner

    def within(node: Node, tags: set[str], until: set[str] = frozenset()) -> Node | None:
        while node.parent is not None:
            if node.tag in tags:
                return node
            if node.tag in until:
                return None
            node = node.parent
        return None

    reader, goto = tokens(html), None
    while True:
        try:
            kind, tag, attrs, pos = reader.send(goto)
        except StopIteration:
            return root
        goto = None
        if kind == "text":
            at.children.append(unescape(tag))
            continue
        if kind == "close":
            if opened[tag] and (node := within(at, {tag})) is not None:
                at = left(node)
            continue
        if tag in CLOSES_P and opened["p"] and (node := within(at, {"p"}, P_BOUNDS)) is not None:
            at = left(node)
        for old in ENDS.get(tag, ()):
            if opened[old] and (node := within(at, {old}, BOUNDS)) is not None:
                at = left(node)
        out, unlikely = judged(tag, attrs, opened["article"] > 0 or opened["main"] > 0)
        node = Node(tag, at, at.out or out, unlikely, attrs)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, pos)
            goto = len(html) if end is None else (html.find(">", end.start()) + 1 or len(html))
        elif tag not in VOID:
            at = node
            opened[tag] += 1


def is_heading(tag: str) -> bool:
    return len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()


def measured(root: Node) -> list[Node]:
    """Counts characters, those in links, and paragraph points of every element; the elements, parents before children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.points = node.held = 0.0
        node.chars = node.link_chars = 0
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.out]
    for node in reversed(order):  # children before parents
        own = commas = 0
        for c in node.children:
            if isinstance(c, str):
                own += len(c.strip())
                commas += c.count(",")
            elif not c.out:
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.held += c.held
                if c.tag in INLINE:
                    own += c.chars
        node.chars += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars = node.chars
        if node.tag in PARAGRAPHS and own >= 25 or is_heading(node.tag) and own:
            share, up = 1.0 + commas + min(own / 100, 3.0), node.parent
            node.held += share
            for part in (1.0, 0.5, 0.25):
                if up is None:
                    break
                up.points += share * part
                up = up.parent
            if node.tag in ("div", "section", "article", "main"):
                node.points += share
    return order


def inside(node: Node, outer: Node) -> bool:
    while node is not None and node is not outer:
        node = node.parent
    return node is outer


def without_unlikely(root: Node) -> None:
    """Drops elements whose class sounds like no main text, and forms and the like, but for one that holds most of the page's paragraph points, or of
    its characters on a page without paragraphs. A form or the like beside an article goes in any case, and on a page without paragraphs."""
    order = measured(root)
    articles = [n for n in order if n.tag in ("article", "main") and n.held]
    for node in order:
        if node.parent is not None and node.parent.out:
            node.out = True
        elif node.unlikely:
            node.out = node.held < MOST * root.held if root.held else node.tag in WRAPPERS or node.chars < MOST * root.chars
            if node.tag in WRAPPERS and not node.out:
                node.out = not all(inside(a, node) or inside(node, a) for a in articles)


def scored(root: Node) -> tuple[Node, list[Node]]:
    """Deals out the points; the best container, and all elements."""
    without_unlikely(root)
    best, order = None, measured(root)
    for node in order:
        if node.chars and node.tag not in INLINE and node.tag not in ("p", "#root", "html") and not is_heading(node.tag):
            node.points = (node.points + TAG_POINTS.get(node.tag, 0.0)) * (1 - node.link_chars / node.chars)
            if best is None or node.points > best.points:
                best = node
    return best or root, order


def same_kind(a: Node, b: Node) -> bool:
    return a.tag == b.tag and _CLASS.findall(a.attrs) == _CLASS.findall(b.attrs)


def cousins(best: Node, order: list[Node]) -> list[Node]:
    """Containers like the best one in other branches, which an article that is cut in parts has: as strong as a sibling must be, and of the same tag and
    classes, as are all elements around them up to one that holds both. The strongest under each parent."""
    found: dict[int, Node] = {}
    for node in order:
        if node is best or node.out or node.points < max(10.0, 0.2 * best.points) or node.link_chars >= 0.5 * node.chars:
            continue
        x, y = node, best
        while x.parent is not None and y.parent is not None and x.parent is not y.parent and same_kind(x, y):
            x, y = x.parent, y.parent
        if x is not node and x is not y and x.parent is y.parent and same_kind(x, y):
            old = found.get(id(node.parent))
            if old is None or node.points > old.points:
                found[id(node.parent)] = node
    return list(found.values())


def stands_alone(chars: int, links: float, best: Node) -> bool:
    """Whether a paragraph beside the best container, or text there that is in no block, is main text."""
    return chars >= 80 and links < 0.25 or chars > 0 and best.tag not in ("article", "main") and links == 0


def alike(node: Node, best: Node) -> bool:
    """Whether a sibling of the best container is kept with it."""
    if node is best:
        return True
    if node.out or not node.chars:
        return False
    links = node.link_chars / node.chars
    if node.points >= max(10.0, 0.2 * best.points):
        return links < 0.5
    return node.tag in ("p", "h1", "h2", "h3") and stands_alone(node.chars, links, best)


def around(best: Node) -> list[Node | str]:
    """The best container and what is kept beside it; text between blocks is judged as a paragraph."""
    if best.parent is None:
        return [best]
    out: list[Node | str] = []
    loose: list[Node | str] = []

    def settle() -> None:
        chars = sum(len(x.strip()) if isinstance(x, str) else x.chars for x in loose)
        links = sum(x.link_chars for x in loose if isinstance(x, Node))
        if stands_alone(chars, links / max(chars, 1), best):
            out.extend([" ", *loose, " "])
        loose.clear()

    for c in best.parent.children:
        if isinstance(c, str) or c.tag in INLINE and not c.out:
            loose.append(c)
        elif not c.out:
            settle()
            if alike(c, best):
                out.append(c)
    settle()
    return out


def text_of(nodes: list[Node | str]) -> str:
    parts: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.out:
            gap = [] if x.tag in INLINE else [" "]
            stack += [*gap, *reversed(x.children), *gap]
    return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parsed(html)
    best, order = scored(root)
    parts = {id(n) for n in [best, *cousins(best, order)]}
    if len(parts) == 1:
        return text_of(around(best))
    out: list[Node | str] = []
    stack: list[Node] = [root]
    while stack:  # in the order of the page
        node = stack.pop()
        if id(node) in parts:
            out += around(node)
        else:
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return text_of(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row. Null or empty html, or a page without main text: the empty text. Rows that
    repeat are extracted each, also those with null ids; other columns of ``pages`` are not carried. A page is held whole by its task."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, rows.select("page_id", "url", F.lit("").alias("text")).schema)


def extraction_digest(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``, as :func:`main_texts`; n_chars counts code points."""
    return main_texts(pages).withColumn("n_chars", F.length("text").cast("long"))
