"""The main text of web pages by composite text density.

A page becomes a tree of its block elements. Each node has its characters, tags, characters in
links and links; its density is characters per tag, lowered the more of them are links. The node
whose children's densities have the greatest sum, the maximum-sum subtree, leads to the content: of
the nodes on the path from it to the body, the highest one that is denser than the body is kept
whole; if the path leads through an element that marks an article, that one is.

What elements, roles and classes say only weighs in. Densities inside an article count PRIOR times,
those inside menus, forms, notices, adverts, comments and the like LOWERED times, and of the content
such parts are left out, unless they hold the maximum-sum subtree themselves. A class or id names
such a part if one of its tokens consists of such words alone: `cookie-notice` does, `has-sidebar`
and `social-science` do not. Elements without text of their own to show, and hidden ones, are gone.

A block is the text between two boundaries of block elements. Null and empty pages give empty text,
and so does an empty table no rows. Rows that repeat are extracted each. Of nodes that tie, the
first of the outermost is taken. Trees are walked by loops, so depth does not matter.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.shared import small_batches

#: Elements that show no text, or none that is part of a page's.
DROPPED = frozenset("head script style noscript template svg math iframe object embed canvas audio video "
                    "button select option textarea".split())
#: Elements of other parts of a page.
OTHER_ELEMENTS = frozenset("nav footer aside form label fieldset menu dialog".split())
#: How much densities count inside an article, and inside other parts of a page.
PRIOR, LOWERED = 3.0, 0.1
#: Elements with raw text, which ends at their end tag only.
RAW = "script|style|textarea|title|noscript|template|svg|iframe|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that change nothing about a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rb rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr input link meta param source "
                   "track area".split())
#: Words of a class or id, and roles, that name other parts of a page.
OTHER_PARTS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
                        "comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation "
                        "newsletter notice notices pager pagination popup promo promotion related replies reply "
                        "share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
PAGE_PARTS = OTHER_PARTS | {"header", "masthead", "topbar"}
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                        "menubar toolbar".split())
#: A start tag that ends an open element of these, up to the elements after the bar.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"})}

_TOKEN = re.compile(
    rf"""(?isx)<!--.*?(?:-->|\Z)
    |<(?P<raw>{RAW})\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<[!?/][^>]*+>""")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "dropped", "other", "article", "weight", "chars", "tags", "link_chars", "links",
                 "density", "total", "best")

    def __init__(self, tag: str, parent: int, dropped: bool, other: bool, article: int, weight: float):
        self.tag, self.parent, self.dropped, self.other = tag, parent, dropped, other
        self.article, self.weight = article, weight
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0
        self.best = -1


def _names_part(value: str, names: frozenset[str]) -> bool:
    """Whether a token of a class or id is made of such names alone, numbers aside."""
    return any(words and all(w.lower() in names for w in words)
               for words in map(_NAME_WORD.findall, value.split()))


def _kind(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """(dropped, other): whether an element is gone, and whether it is another part of the page."""
    if tag in DROPPED:
        return True, False
    other = tag in OTHER_ELEMENTS or tag == "header" and not in_article
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, other
    names = OTHER_PARTS if in_article else PAGE_PARTS
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "style" and _HIDDEN.search(value):
            return True, False
        if name == "role" and value.lower() in OTHER_ROLES:
            other = True
        if name in ("class", "id") and _names_part(value, names):
            other = True
    return False, other


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents before children, and the blocks (node, text) in page order."""
    nodes = [Node("html", -1, False, False, -1, 1.0)]
    blocks: list[tuple[int, str]] = []
    stack, text = [0], []
    in_link = False
    is_open: Counter[str] = Counter()

    def boundary() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line and not nodes[stack[-1]].dropped:
                blocks.append((stack[-1], line))
                nodes[stack[-1]].chars += len(line)
            text.clear()

    def close(tag_set: set[str], stop: set[str] = frozenset()) -> None:
        if not any(is_open[tag] for tag in tag_set):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[depth]].tag
            if tag in tag_set:
                boundary()
                is_open.subtract(nodes[i].tag for i in stack[depth:])
                del stack[depth:]
                return
            if tag in stop:
                return

    def add(chunk: str) -> None:
        if chunk and not nodes[stack[-1]].dropped:
            chunk = html.unescape(chunk)
            text.append(chunk)
            if in_link:
                nodes[stack[-1]].link_chars += len(" ".join(chunk.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        here = nodes[stack[-1]]
        if m["end"]:
            if tag == "a":
                in_link = False
            close({tag})
            continue
        dropped, other = (False, False) if tag in VOID else _kind(tag, m["attrs"], here.article >= 0)
        part = tag not in VOID and (dropped or other or (here.dropped or here.other) and here.tag == tag)
        if tag in INLINE and not part:
            if not here.dropped:
                here.tags += 1
                if tag == "a":
                    here.links += 1
            if tag == "a":
                in_link = True
            if tag == "br":
                add(" ")
            continue
        if tag in VOID:
            boundary()
            here.tags += 1
            continue
        if tag == "html":
            continue
        if tag not in INLINE:  # else it is a piece of a line that is left out, as a node of its own
            in_link = False
            if tag == "body":
                close({"head"})
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            close({"p"}, {"table", "td", "th", "li", "div", "article", "section", "body"})
            boundary()
        here = nodes[stack[-1]]
        article = here.article if here.article >= 0 else len(nodes) if tag in ("article", "main") else -1
        weight = here.weight * (PRIOR if article == len(nodes) else 1.0)
        if other and here.weight >= 1.0:
            weight *= LOWERED
        nodes.append(Node(tag, stack[-1], here.dropped or dropped, other, article, weight))
        stack.append(len(nodes) - 1)
        is_open[tag] += 1
    add(page[at:])
    boundary()
    return nodes, blocks


def weigh(nodes: list[Node]) -> int:
    """Fills in densities, and gives the body."""
    body = next((i for i, n in enumerate(nodes) if n.tag == "body" and not n.dropped), 0)
    for i in range(len(nodes) - 1, 0, -1):
        n, up = nodes[i], nodes[nodes[i].parent]
        if not n.dropped:
            up.chars, up.link_chars = up.chars + n.chars, up.link_chars + n.link_chars
            up.tags, up.links = up.tags + n.tags + 1, up.links + n.links
    whole = nodes[body].link_chars / max(1, nodes[body].chars)
    for n in nodes:
        if n.chars:
            linked = min(n.link_chars, n.chars)
            base = math.log(n.chars / max(1, n.chars - linked) * linked + whole * n.chars + math.e)
            # without any link on the page the base would be one
            adjust = math.log((n.chars / max(1, linked)) * (max(1, n.tags) / max(1, n.links)) + 1)
            n.density = n.chars / max(1, n.tags) * adjust / max(math.log(base), math.log(math.log(1 + math.e)))
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.best < 0 or n.total >= nodes[n.best].total:
            n.best = i
        if i and not n.dropped:
            up = nodes[n.parent]
            up.total += n.density * n.weight
            if up.best < 0 or nodes[n.best].total >= nodes[up.best].total:
                up.best = n.best
    return body


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by line feeds."""
    nodes, blocks = parse(page or "")
    if not blocks:
        return ""
    body = weigh(nodes)
    top = nodes[body].best
    path = [top]
    while path[-1] not in (body, 0):
        path.append(nodes[path[-1]].parent)
    denser = [i for i in path[:-1] if nodes[i].density > nodes[body].density]
    article = nodes[top].article
    chosen = article if article >= 0 else denser[-1] if denser else top
    # other parts are left out, but for those that hold the content
    leads, at = set(), top
    while at >= 0:
        leads.add(at)
        at = nodes[at].parent
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = i == chosen or n.parent >= 0 and inside[n.parent] and (not n.other or i in leads)
    return "\n".join(line for at, line in blocks if inside[at])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row (page_id, url, html)."""
    small_batches(pages.sparkSession)
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(_extract, "page_id long, url string, text string, n_chars long"))
