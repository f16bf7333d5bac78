"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text, each with its path of tags (with class and id)
from the root.  Text length and punctuation are summed by path and divided by
the path's number of blocks; the two ratios, smoothed over neighbouring paths in
page order, are fused by their product, weighted by the share of text outside of links and by
what the path's elements are declared to be, and held against a threshold.
Blocks of the paths above it are content nodes; the smallest container that
holds them all is the article, of which everything is kept but declared parts (menus, adverts,
comments ...) whose paths stay below the threshold.  A class, id or role declares an element only if all its words are of that kind, so that
an article's own sections keep their names: "side-bar" does, "side-effects" doesn't.  A declared element that holds most
of a page's text is taken for a wrapper, and its declaration doesn't count: comments, adverts, menus and the like only if they hold a heading, too.
Pages are taken one by one, in Arrow batches, in time that grows with their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose contents are not text of the page, and of these the ones that hold no elements.
UNSEEN = frozenset("head title script style noscript template textarea iframe svg select object canvas audio video".split())
RAW = frozenset("title script style noscript template textarea iframe svg".split())
OTHER = frozenset("nav header footer aside form menu button dialog".split())
LOOSE = frozenset("header aside form dialog".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("article", "main", "h1", "h2", "h3"))
#: A start tag of the first kind closes an open element of the second.
CLOSES = {
    **{t: "p" for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()},
    "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
}
#: Elements above which a start tag closes nothing.
SCOPE = frozenset("html body article aside blockquote button caption details dialog div fieldset figure footer form header main menu nav object ol section table td th ul".split())
#: Elements that can be an article's root; others are parts of one.
CONTAINERS = frozenset("html body main article div center td".split())
#: Words of a class, id or role that say what an element is: those that can hold a page's article by mistake, and those that hardly can.
LOOSE_WORDS = frozenset("banner side aside header masthead widget popup modal toolbar complementary".split())
OTHER_WORDS = LOOSE_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments discussion disqus reply replies respond cookie cookies consent notice gdpr newsletter subscribe signup login share sharing social related recommended pagination pager search contentinfo".split()
)
#: Words that stand beside those and leave their meaning as it is.
BESIDE = frozenset(
    "page site main top bottom left right primary secondary global local container wrapper wrap inner outer box block list items item section area bar slot unit link links post posts article articles content row col column group holder panel button buttons icon icons form user reader readers text title body the js id".split()
)
#: Weights of paths inside article or main, and inside something declared to be other than the article.
MAIN_WEIGHT, OTHER_WEIGHT = 2.0, 0.05
#: Share of a page's text from which a declared element is a wrapper.
WRAPPER = 0.6
#: Smoothing counts a path's own ratio so many times more than a neighbour's.
OWN = 4
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[a-z]+")
#: An attribute's value without quotes at a tag's end, which a slash there belongs to.
_BARE = re.compile(r"=\s*[^\s\"'>][^\s>]*$")
_ENDS = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.I) for t in RAW}
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


def declared_words(named: str) -> frozenset[str]:
    """The words that declare something, of names of which each consists of such words and words beside them."""
    found: set[str] = set()
    for name in named.split():
        words = set(_WORDS.findall(name))
        if not words.isdisjoint(OTHER_WORDS) and words <= OTHER_WORDS | BESIDE:
            found |= words & OTHER_WORDS
    return frozenset(found)


def closes_itself(tag: str, rest: str, foreign: bool) -> bool:
    """A slash ends svg and math and what is in them; for other elements it means nothing."""
    return rest.endswith("/") and (foreign or tag in ("svg", "math")) and not _BARE.search(rest)


class Node:
    """An element in its place: `number` counts start tags, `last` is that of its last descendant."""

    __slots__ = ("tag", "label", "parent", "number", "last", "declared", "loose", "held", "headed", "path", "linked", "unseen", "beside")

    def __init__(self, tag: str, attributes: str, parent: Node | None, number: int):
        named = " ".join(x or y or z for _, x, y, z in _NAMED.findall(attributes)).lower() if "=" in attributes else ""
        self.tag, self.label, self.parent, self.number, self.last = tag, f"{tag}.{named}" if named else tag, parent, number, number
        words = declared_words(named) if named and tag not in ("html", "body") else frozenset()
        self.declared = tag in OTHER or bool(words)
        self.loose = (tag not in OTHER or tag in LOOSE) and words <= LOOSE_WORDS
        self.held, self.headed, self.path = 0, False, -1
        self.linked = tag == "a" or parent is not None and parent.linked
        self.unseen = tag in UNSEEN or parent is not None and parent.unseen
        #: Inside a declared element that is no block and within the block that is open: an advert in a span, say.
        self.beside = tag not in BLOCK and (self.declared or parent is not None and parent.beside)


class Block:
    """A run of text in a block-level element; `linked` counts its characters inside links."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the > of a tag is, outside of quotes; a quote without its other end is a character like others; -1 if there is none."""
    while m := _STOP.search(html, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        if last[m[0]] >= at:
            at = html.find(m[0], at) + 1
    return -1


def pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page's parts in order: text, start tags with attributes, end tags."""
    last = {q: html.rfind(q) for q in "\"'"}
    at = 0
    while (lt := html.find("<", at)) >= 0:
        after = html[lt + 1 : lt + 2]
        name = _NAME.match(html, lt + 2 if after == "/" else lt + 1)
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            end = len(html) if end < 0 else end + 2
        elif name:
            end = _tag_end(html, name.end(), last)
        elif after and after in "!?/":
            end = html.find(">", lt)
        else:  # a character like others
            yield "text", "", html[at : lt + 1]
            at = lt + 1
            continue
        yield "text", "", html[at:lt]
        if end < 0:
            return
        at = end + 1
        if name:
            tag = name[0].lower()
            yield "end" if after == "/" else "start", tag, html[name.end() : end]
            if after != "/" and tag in RAW and not closes_itself(tag, html[name.end() : end], False):
                m = _ENDS[tag].search(html, at)
                at = m.start() if m else len(html)
    yield "text", "", html[at:]


def blocks_of(html: str) -> list[Block]:
    """The blocks of text in page order, on a tree whose root holds all."""
    root = Node("", "", None, 0)
    stack, opened, out = [root], {}, []
    parts: list[str] = []
    where, linked, number = root, 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, where, linked))
            parts.clear()
            linked = 0

    def pop(k: int):
        for x in stack[k:]:
            x.last = number
            opened[x.tag] -= 1
        del stack[k:]

    for kind, tag, rest in pieces(html):
        if kind == "text":
            top = stack[-1]
            if not rest or top.unseen:
                continue
            if top.beside:  # a block of its own
                text = " ".join(unescape(rest).split())
                if text:
                    out.append(Block(text, top, len(text) if top.linked else 0))
                continue
            if not parts or not parts[-1].strip() and not "".join(parts).strip():
                where = top
            parts.append(rest)
            linked += len(rest) if top.linked else 0
        elif kind == "end":
            if tag in BLOCK:
                flush()
            if opened.get(tag):
                pop(max(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
        else:
            if tag in BLOCK:
                flush()
            for closed in CLOSES.get(tag, "").split():
                if opened.get(closed):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == closed:
                            pop(k)
                            break
                        if stack[k].tag in SCOPE:
                            break
            if tag == "br" and parts:
                parts.append(" ")
            if tag not in VOID and not closes_itself(tag, rest, bool(opened.get("math"))):
                number += 1
                stack.append(Node(tag, rest, stack[-1], number))
                opened[tag] = opened.get(tag, 0) + 1
    flush()
    pop(1)
    root.last = number
    return out


def _measured(blocks: list[Block]) -> tuple[list[Node], set[int]]:
    """All elements above blocks, parents first, with the text they hold; and the numbers of wrappers."""
    nodes: dict[int, Node] = {}
    for b in blocks:
        x: Node | None = b.node
        b.node.held += len(b.text)
        while x is not None and x.number not in nodes:
            nodes[x.number] = x
            x = x.parent
    order = [nodes[k] for k in sorted(nodes)]
    for x in reversed(order):
        if x.parent is not None:
            x.parent.held += x.held
            x.parent.headed |= x.headed or x.tag in HEADINGS
    total = sum(len(b.text) for b in blocks)
    return order, {x.number for x in order if x.declared and (x.headed or x.loose) and x.held >= WRAPPER * total}


def scores(blocks: list[Block], spread: int = 1) -> tuple[list[float], list[bool]]:
    """Of every path, by the numbers that nodes get in `path`, in page order of their first blocks: the fused ratio, and whether it is declared as other."""
    order, wrappers = _measured(blocks)
    ids: dict[tuple[int, str], int] = {}
    kinds: dict[int, tuple[int, bool, bool]] = {}  # of an element: its path as a number, declared, in main
    for x in order:
        above, other, main = kinds[x.parent.number] if x.parent is not None else (-1, False, False)
        path = ids.setdefault((above, x.label), len(ids))
        kinds[x.number] = (path, other or x.declared and x.number not in wrappers, main or x.tag in MAIN)
    sums: dict[tuple[int, bool], list[float]] = {}
    number: dict[tuple[int, bool], int] = {}
    for b in blocks:
        path, other, main = kinds[b.node.number]
        s = sums.setdefault((path, other), [0, 0, 0, 0, main])
        b.node.path = number.setdefault((path, other), len(number))
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(PUNCTUATION.findall(b.text))
        s[3] += min(b.linked, len(b.text))
    ratios = [(sqrt(c / n), sqrt(p / n)) for n, c, p, _, _ in sums.values()]
    out = []
    for k, ((_, other), (_, chars, _, linked, main)) in enumerate(sums.items()):
        near = [ratios[j] for j in range(max(0, k - spread), min(len(ratios), k + spread + 1))] + [ratios[k]] * OWN
        text, marks = (sum(x[i] for x in near) / len(near) for i in (0, 1))
        weight = (OTHER_WEIGHT if other else 1.0) * (MAIN_WEIGHT if main else 1.0) * (1.05 - linked / chars)
        out.append(text * (0.1 + marks) * weight)
    return out, [other for _, other in sums]


def main_text(html: str | None, threshold: float = 0.3) -> str:
    """The article's blocks in page order, two line ends between; '' if there is none.

    `threshold` is the share of the best path's score from which a path counts.
    """
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    score, other = scores(blocks)
    least = threshold * max(score)
    content = [b.node for b in blocks if score[b.node.path] >= least]
    # the smallest element around the first and the last holds all between; of these only containers
    low, high = min(content, key=lambda x: x.number), max(x.number for x in content)
    root: Node | None = low
    while root.parent is not None and (root.last < high or root.tag not in CONTAINERS):
        root = root.parent
    inside = (b for b in blocks if root.number <= b.node.number <= root.last)
    return "\n\n".join(b.text for b in inside if not other[b.node.path] or score[b.node.path] >= least)


def extract(pages: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Takes page_id, url and html; returns a row per row: page_id, url, text, n_chars.

    Null or empty html, or no text: text '' and 0 characters.  Very long or broken pages are
    read whole.  What follows a tag that never ends is part of it, as in browsers.  Repeated rows: a row each.  No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [main_text(x.as_py(), threshold) for x in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {x: pages.schema[x].dataType.simpleString() for x in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
