"""Operator 8, HTML extraction by tree scoring.

A page is cut into tags and text; the elements form a tree. Every block of text passes points for
its length and commas to the elements around it, discounted by the share of its text that is in
links. The element with the most points is the container of the article; siblings that hold
article text as well are kept, everything else goes. Elements marked as boilerplate go before that,
unless the tree shows that they are wrappers around the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements by kind, as HTML names them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes title svg math".split())
DROPPED = RAW | frozenset("nav footer aside form button select dialog menu head object canvas audio video label fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend", "summary"}
#: An open element of the key ends where one of these starts, unless one of the last group is in between.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
FENCE = frozenset("table ul ol dl div section article main body html td th li blockquote".split())
#: Words in class, id or role of what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "side aside complementary footer contentinfo masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay dialog "
    "comment comments disqus respond reply replies discussion share sharing social related recommended newsletter subscribe signup login search "
    "pagination pager widget form hidden".split()
)


class Element:
    """marks: the marked elements from the root down to this one; core: the article or main that it is
    or lies in."""

    __slots__ = ("tag", "parent", "dropped", "order", "marks", "core")

    def __init__(self, tag: str, parent: Element | None, verdict: int, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.dropped = verdict == GONE or parent is not None and parent.dropped
        above = parent.marks if parent is not None else ()
        self.marks = (*above, self) if verdict == MARKED else above
        self.core = self if tag in ("article", "main") else parent.core if parent is not None else None


#: What tag and attributes say of an element: nothing, that it is boilerplate or a wrapper, that it goes.
FREE, MARKED, GONE = 0, 1, 2


def boilerplate(tag: str, attributes: str, parent: Element) -> int:
    """Whether tag or attributes say that an element is not part of the article."""
    if tag in DROPPED and tag not in ("form", "fieldset"):
        return GONE
    if tag == "header" and not any(x.tag in ("article", "main") for x in ancestors(parent)):
        return GONE
    verdict = MARKED if tag in DROPPED else FREE
    if not attributes or tag in ("html", "body", "article", "main"):
        return verdict
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return GONE
        if name in ("class", "id", "role") and not BOILERPLATE.isdisjoint(re.split(r"[^a-z]+", value)):
            verdict = MARKED
    return verdict


def ancestors(element: Element | None) -> Iterator[Element]:
    while element is not None:
        yield element
        element = element.parent


class Block:
    """Text between two borders of blocks, directly inside `element`."""

    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def parse(page: str) -> list[Block]:
    """The blocks of text of a page in order, without those in dropped elements. Markup may be
    cut off or badly nested."""
    root = Element("html", None, FREE, 0)
    at, blocks, pieces, linked, links, position, count = root, [], [], 0, 0, 0, 0

    def end_block() -> None:
        nonlocal pieces, linked
        if pieces:
            text = "".join(pieces)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                holder = at
                while holder.tag not in BLOCK:
                    holder = holder.parent or root
                    if holder is root:
                        break
                blocks.append(Block(holder, text, linked))
        pieces, linked = [], 0

    def close_to(element: Element) -> None:
        nonlocal at, links
        while at is not element:
            if at.tag in BLOCK:
                end_block()
            links -= at.tag == "a"
            at = at.parent

    def open_in(tags: frozenset | set, fence: frozenset) -> Element | None:
        for x in ancestors(at):
            if x.tag in tags:
                return x
            if x.tag in fence:
                return None
        return None

    search, size = TOKEN.search, len(page)
    while position < size:
        found = search(page, position)
        if found is None:
            if not at.dropped:
                pieces.append(page[position:])
            break
        if found.start() > position and not at.dropped:
            text = page[position : found.start()]
            pieces.append(text)
            if links:
                linked += len(text)
        position = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if closing:
            opened = open_in({tag}, frozenset())
            if opened is not None and opened is not root:
                close_to(opened)
                if tag in BLOCK:
                    end_block()
                links -= tag == "a"
                at = opened.parent
            elif tag in BLOCK:
                end_block()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append(" ")
            continue
        if tag in CLOSES_P and (p := open_in({"p"}, FENCE)) is not None:
            close_to(p)
            end_block()
            at = p.parent
        for ended, starts in ENDED_BY.items():
            if tag in starts and (x := open_in({ended}, FENCE - {ended})) is not None:
                close_to(x)
                end_block()
                at = x.parent
        if tag in BLOCK:
            end_block()
        if tag in ("html", "body") and count:
            if tag == "body" and at.tag != "html":  # an unclosed head ends here
                close_to(root)
            if tag == "html":
                continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, position)
            position = end.end() if end else size
            continue
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        count += 1
        at = Element(tag, at, boilerplate(tag, attributes, at), count)
        links += tag == "a"
    end_block()
    return unwrapped(blocks)


def unwrapped(blocks: list[Block]) -> list[Block]:
    """The blocks without those in marked elements. A mark is lifted, the one around most text first,
    while no article or main element has text outside of marks and the marked element holds a main
    element, an article with more text than is outside, or most of the page's text and four times as
    much as is outside. Text in links does not count."""
    if not any(b.element.marks for b in blocks):
        return blocks
    lifted: set[Element] = set()
    while True:
        outside, core, held = 0, False, {}
        for b in blocks:
            size = max(0, len(b.text) - b.linked)
            mark = next((x for x in b.element.marks if x not in lifted), None)
            if mark is None:
                outside += size
                core |= b.element.core is not None
                continue
            have = held.setdefault(mark, [0, 0])
            have[0] += size
            inner = b.element.core
            if inner is not None and mark in inner.marks:
                have[1] = max(have[1], 2 if inner.tag == "main" else 1)
        if held and not core:
            most, whole = max(held, key=lambda x: held[x][0]), outside + sum(x[0] for x in held.values())
            size, kind = held[most]
            if size and (kind == 2 or kind == 1 and size > outside or 2 * size > whole and size > 4 * outside):
                lifted.add(most)
                continue
        return [b for b in blocks if lifted.issuperset(b.element.marks)]


def points(block: Block) -> float:
    """What a block is worth as article text."""
    n = len(block.text)
    worth = (n >= 25) + min(n / 100, 3.0) + sum(map(block.text.count, ",،、，"))
    return worth * (1 - min(1.0, block.linked / n))


def container_of(block: Block) -> Element:
    """Where a block hands in its points: around a paragraph, else the element itself."""
    e = block.element
    while e.parent is not None and e.tag in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "br", "blockquote", "li", "ul", "ol", "dd", "dt", "dl", "figcaption", "figure"):
        e = e.parent
    return e


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by one blank. Empty without one."""
    blocks = parse(page) if page else []
    if not blocks:
        return ""
    given: dict[Element, float] = {}
    for b in blocks:
        worth = points(b)
        if worth <= 0:
            continue
        for level, e in enumerate(ancestors(container_of(b))):
            given[e] = given.get(e, 0.0) + worth / (1 if level == 0 else 2 * level)
    if not given:
        return ""
    best = max(given, key=lambda e: (given[e], e.order))
    # An element that holds the best one and as much again in its other children is the container.
    while best.parent is not None and given.get(best.parent, 0.0) > given[best]:
        best = best.parent
    least = max(10.0, 0.2 * given[best])
    kept = []
    for b in blocks:
        way = list(ancestors(b.element))
        if best in way:
            kept.append(b.text)
            continue
        beside = next((x for x in way if x.parent is best.parent and best.parent is not None), None)
        if beside is None:
            continue
        share = b.linked / len(b.text)
        if given.get(beside, 0.0) >= least or beside.tag == "p" and (len(b.text) > 80 and share < 0.25 or share == 0 and b.text.endswith((".", "!", "?"))):
            kept.append(b.text)
    return " ".join(kept)


def extract(df: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of each row's page. Null html is empty. A column of that name is replaced."""

    def pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    udf = F.pandas_udf(pages, "string")
    return df.withColumn(name, udf(F.coalesce(F.col(html_column), F.lit(""))))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).drop("html").withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op8_html": op8_html}
