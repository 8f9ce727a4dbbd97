"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every block of text (a paragraph, heading, list item, or a stretch of text
between such) gives points for its length and commas to its container, half as many to the next ancestor, a
quarter to the one after, and so on. An element's score is its points times the part of its text that is not in
links. The best element, widened to the article or main element around it, makes up the article; where there is no
such element, also those of its siblings that hold prose, and of the siblings of its ancestors those that hold an element
of comparable score. Menus, headers, footers, sidebars, notices, adverts, forms, comments and
everything that is not text take no part.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelframe.llm.columns import take
from pixelframe.llm.workers import map_slices

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|noscript|template|iframe|svg|title|textarea|noembed|noframes)(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are paragraphs themselves: their points go to the parent.
_PARAGRAPH = set("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption summary".split())
#: A start tag that ends an open element, up to the nearest of the fences.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
#: Elements that can be menus by their links alone.
_LISTS = {"ul", "ol", "dl", "div", "table"}
_P_FENCE = {"table", "td", "th", "button", "object", "caption"}

#: Elements that never belong to an article.
_OUTSIDE = set("nav footer aside form head button select dialog menu object audio video canvas input label".split())
#: Values of the role attribute likewise.
_OUTSIDE_ROLES = set(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split()
)
#: Parts of class and id names that mark such elements.
_OUTSIDE_NAMES = set(
    "nav navbar navigation menu ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo "
    "promotion promoted banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription share sharing social related recommended recommendations comment comments commentlist disqus "
    "reply replies respond discussion breadcrumb breadcrumbs pagination pager sidebar side rail footer header masthead "
    "toolbar login signin signup register search widget widgets copyright tags toc skip".split()
)
#: Further parts that such names may have.
_NEUTRAL_NAMES = set(
    "area bar block blocks box btn button buttons container content div form group holder icons inner item items left link "
    "links list main message outer panel post posts right row section sections site top bottom wrap wrapper".split()
)
#: Elements that names may drop anywhere; outside of an article, names may drop any element.
_CONTAINERS = set("div ul ol dl table".split())
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion"}
#: Parts of names of elements that hold articles.
_INSIDE_NAMES = set("article content main body post entry story page wrapper container layout".split())


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    dropped: bool = False
    link: bool = False
    article: bool = False
    points: float = 0.0
    text: int = 0
    linked: int = 0
    links: int = 0
    children: list[Node] = field(default_factory=list)


def _outside(tag: str, attributes: str, parent: Node) -> bool:
    """Whether an element is none of the article's business, by its tag, role and names."""
    if tag in _OUTSIDE:
        return True
    inside_article = parent.article
    if tag == "header":
        return not inside_article
    if not attributes or tag in ("html", "body", "article", "main", "a"):
        values = {} if not attributes or tag != "article" else _attributes(attributes)
        return inside_article and bool(_marks(values) & _COMMENTS)
    values = _attributes(attributes)
    if "hidden" in values or values.get("aria-hidden") == "true" or values.get("role", "").lower() in _OUTSIDE_ROLES:
        return True
    if "display:none" in values.get("style", "").replace(" ", "").lower():
        return True
    marks = _marks(values)
    if inside_article and tag not in _CONTAINERS:
        return tag == "section" and bool(marks & _COMMENTS)
    return bool(marks & _COMMENTS) or (bool(marks) and not _names(values) & _INSIDE_NAMES)


def _marks(values: dict[str, str]) -> set[str]:
    """Parts that mark an element as none of the article's, from class and id tokens that hold nothing else but neutral
    parts: ``share-buttons`` marks, ``share-price`` does not."""
    found = set()
    for token in f"{values.get('class', '')} {values.get('id', '')}".split():
        parts = {p.lower() for p in _PART.findall(token)}
        marks = parts & _OUTSIDE_NAMES
        if marks and parts <= marks | _NEUTRAL_NAMES:
            found |= marks
    return found


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _names(values: dict[str, str]) -> set[str]:
    return {p.lower() for p in _PART.findall(f"{values.get('class', '')} {values.get('id', '')}")}


def _ancestor(node: Node | None, tags: set[str]) -> Node | None:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def _blocks(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All elements, parents first, and the blocks of text in page order, each with its element."""
    root = Node("#root", None)
    nodes, open_tags = [root], Counter()
    at, blocks, pieces = root, [], []
    linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not at.dropped:
            piece = html.unescape(raw) if "&" in raw else raw
            pieces.append(piece)
            if at.link:
                linked += len("".join(piece.split()))

    def flush(owner: Node) -> None:
        """End the block that stands in ``owner``."""
        nonlocal pieces, linked
        joined = " ".join("".join(pieces).split())
        if joined:
            while owner.tag not in _BLOCK and owner.parent is not None:
                owner = owner.parent
            blocks.append((owner, joined))
            owner.text += len(joined)
            owner.linked += linked
        pieces, linked = [], 0

    def close(until: Node) -> None:
        """Leave ``until`` and everything in it."""
        nonlocal at
        node = at
        while node is not until.parent:
            if node.tag in _BLOCK:
                flush(at)
                break
            node = node.parent
        node = at
        while node is not until.parent:
            open_tags[node.tag] -= 1
            node = node.parent
        at = until.parent

    end = 0
    for token in _TOKEN.finditer(page):
        text(page[end : token.start()])
        end = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if token[2]:
            if not open_tags[tag]:
                continue
            opened = at
            while opened.parent is not None and opened.tag != tag:
                opened = opened.parent
            if opened.parent is not None:
                close(opened)
            continue
        if tag in _VOID:
            if tag in ("br", "hr", "img") and not at.dropped:
                pieces.append(" ")
                if tag == "hr":
                    flush(at)
            continue
        ended, fences = _ENDS.get(tag, (set(), set()))
        if tag in _BLOCK:
            flush(at)
            ended, fences = (ended | {"p"}, fences | _P_FENCE) if tag not in ("body", "html") else (ended, fences)
        if ended:
            open_one, found = at, None
            while any(open_tags[x] for x in ended) and open_one.parent is not None and open_one.tag not in fences:
                if open_one.tag in ended:
                    found = open_one
                open_one = open_one.parent
            if found is not None:
                close(found)
        node = Node(tag, at)
        node.dropped = at.dropped or _outside(tag, token[4], at)
        node.link = at.link or tag == "a"
        node.article = at.article or tag == "article"
        node.links = int(tag == "a" and not node.dropped)
        at.children.append(node)
        nodes.append(node)
        if not token[4].rstrip().endswith("/") or tag not in ("svg", "math", "path"):
            at = node
            open_tags[tag] += 1
    text(page[end:])
    flush(at)
    return nodes, blocks


def _density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def extract(page: str) -> str:
    """The article's text: one line per block, white space inside a block made single."""
    nodes, blocks = _blocks(page)
    for node, text in blocks:
        holder = node.parent if node.tag in _PARAGRAPH and node.parent is not None else node
        holder.points += 1 + text.count(",") + text.count("，") + len(text) / 100
    for node in reversed(nodes[1:]):
        up = node.parent
        up.points += node.points / 2
        up.text += node.text
        up.linked += node.linked
        up.links += node.links
    scored = [n for n in nodes[1:] if n.points]
    if not scored:
        return "\n".join(text for _, text in blocks)
    value = {id(n): n.points * (1 - _density(n)) for n in scored}
    best = max(scored, key=lambda n: (value[id(n)], n.text))
    whole = _ancestor(best, {"article"}) or _ancestor(best, {"main"})
    kept = {id(whole)} if whole is not None else _around(best, nodes, value)
    for node in nodes[1:]:  # what a kept element holds is kept, but for lists of links
        menu = node.tag in _LISTS and node.links >= 3 and _density(node) > 0.6
        if id(node.parent) in kept and not menu:
            kept.add(id(node))
    return "\n".join(text for node, text in blocks if id(node) in kept)


def _around(best: Node, nodes: list[Node], value: dict[int, float]) -> set[int]:
    """The best element and, on its way up the page, the siblings that hold prose like it.

    Beside the best element that is prose of the same kind; beside its ancestors, elements that hold one of comparable
    value, and what stands between such elements.
    """
    kept = {id(best)}
    if best.tag in ("html", "body") or best.parent is None:
        return kept
    for sibling in best.parent.children:
        alike = sibling.tag == best.tag or sibling.tag in _PARAGRAPH
        if sibling.text and _density(sibling) <= 0.25 and (alike or value.get(id(sibling), 0) >= 0.2 * value[id(best)]):
            kept.add(id(sibling))
    peak = dict(value)
    for node in reversed(nodes[1:]):
        peak[id(node.parent)] = max(peak.get(id(node.parent), 0.0), peak.get(id(node), 0.0))
    at = best
    while at.parent is not None and at.tag not in ("html", "body"):
        row = at.parent.children
        equals = [
            i for i, n in enumerate(row)
            if n is at or (_density(n) <= 0.25 and peak.get(id(n), 0.0) >= 0.25 * value[id(best)])
        ]
        if len(equals) > 1:
            kept |= {id(n) for n in row[equals[0] : equals[-1] + 1] if n is not at and n.text and _density(n) <= 0.25}
        at = at.parent
    return kept


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per input row.

    A null or empty page has an empty text, a page of any length is read whole, repeated rows come back repeated, other
    columns are left out whatever they are called, and an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(page) if page else "" for page in batch.column(2).to_pylist()]
        sizes = pa.array(list(map(len, texts)), pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes],
            ["page_id", "url", "text", "n_chars"],
        )

    chosen = take(pages, page_id=id_col, url=url_col, html=html_col)
    kinds = [chosen.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return map_slices(chosen, run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint", "html")
