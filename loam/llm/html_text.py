"""Main text of web pages by scoring the containers of a page's tree."""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
RAW = "script|style|noscript|template|textarea|title|iframe|select|object|canvas|audio|video|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
                  "tfoot th thead tr ul".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th caption figcaption blockquote address summary legend".split())
LEFT_OUT = frozenset("head nav aside footer form button dialog menu fieldset label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# A start tag ends these open elements, looked for up to the elements named second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody"}, {"table"}),
        "a": ({"a"}, {"body"}), "body": ({"head"}, set())}
MAIN = ("article", "main")

_ATTRIBUTES = r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)"
_UNSEEN = rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
_DRAWING = rf"|<svg(?=[\s/>]){_ATTRIBUTES.replace('((', '(?:(', 1)}(?<!/)>.*?</svg\s*>"
_TAG = rf"|<(/?)([a-zA-Z][^\s/>]*){_ATTRIBUTES}>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)"
_TOKEN = re.compile(_UNSEEN + _DRAWING + _TAG, re.S | re.I)
_NO_DRAWING = re.compile(_UNSEEN + _TAG, re.S | re.I)
_DRAWING_ENDS = re.compile(r"</svg\s*>", re.I)
# Points of a text reach this many ancestors; further ones would get less than a thirtieth.
REACH = 12
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# A class or id is left out if it is one of these names, alone or with words that only say where or in what.
_REPLIES = r"comments?|commentlist|disqus\w*|replies|respond"
_NAME = (rf"ads?|adverts?|advertisements?|advertising|adsense|banners?|sponsors?|sponsored|promos?|promotions?|promoted|nav|navbar|navigation|menus?|menubar|"
         rf"breadcrumbs?|side[-_]?bars?|footer|masthead|{_REPLIES}|cookies?|consent|gdpr|notices?|alert|disclaimer|newsletter|subscribe|subscription|signup|login|"
         r"share|sharing|social|related|recommended|popup|modal|overlay|widgets?|search|searchbox|searchbar|searchform|pagination|pager|copyright|skip[-_]?link|toolbar")
_PLACE = (r"site|page|global|main|primary|secondary|top|bottom|left|right|upper|lower|inner|outer|sticky|fixed|mobile|desktop|box|wrap|wrapper|container|block|section|"
          r"area|bar|list|item|items|body|form|slot|unit|panel|links?|buttons?|icons?|media|posts?|articles?|stories|\d+")


def _named(names: str, others: str = _NAME) -> re.Pattern[str]:
    return re.compile(rf"(?<!\S)(?:(?:{_PLACE}|{others})[-_]+)*(?:{names})(?:[-_]+(?:{_PLACE}|{others}))*(?!\S)", re.I)


_OUT, _COMMENTS = _named(_NAME), _named(_REPLIES)
_HEADER = re.compile(r"(?<!\S)(?:(?:site|page|top|main)[-_]?)?header(?!\S)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "up", "out", "named", "link", "inner", "score", "text", "linked", "links", "mark")

    def __init__(self, tag: str, attributes: str = "", up: Node | None = None, spared: bool = False):
        self.tag, self.up = tag, up
        self.link = tag == "a" or up is not None and up.link
        self.inner = tag in MAIN or up is not None and up.inner
        why = unwanted(tag, attributes, up) if up is not None else ""
        self.named = why == "name"
        self.out = up is not None and (up.out or bool(why) and not (self.named and spared))
        self.score, self.text, self.linked, self.links, self.mark = 0.0, 0, 0, 0, False

    def above(self) -> Iterator[Node]:
        node: Node | None = self
        while node:
            yield node
            node = node.up

    def density(self) -> float:
        return self.linked / self.text if self.text else 0.0

    def value(self) -> float:
        return (self.score + (25 if self.tag in MAIN else 0)) * (1 - self.density())


def unwanted(tag: str, attributes: str, up: Node) -> str:
    """Why an element is left out: "kind" (its name, role, hidden, comments), "name" (its class or id), or not at all."""
    if tag in LEFT_OUT or tag == "header" and not up.inner:
        return "kind"
    if not attributes or tag in ("html", "body"):
        return ""
    said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or said.get("role", "").lower() in ROLES or _HIDDEN.search(said.get("style", "")):
        return "kind"
    names = said.get("class", "") + " " + said.get("id", "")
    if _COMMENTS.search(names):
        return "kind"
    return "name" if tag not in MAIN and (_OUT.search(names) or not up.inner and _HEADER.search(names)) else ""


def points_of(node: Node, text: str, linked: int) -> float:
    if len(text) < 25 and node.tag not in LEAF:
        return 0.0
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def spared(page: str) -> frozenset[int]:
    """Places of the elements that stay although their class or id is an unwanted one.

    They hold an article or main element with text, or most points of the page's text.
    """
    places: dict[Node, int] = {}
    found, nodes = blocks(page, None, places)
    total = 0.0
    for node, text, linked in found:
        points = points_of(node, text, linked)
        total += points
        node.score += points
        node.text += len(text)
    for n in reversed(nodes):  # children come before their parents; `mark`: holds an article or main
        if n.up:
            n.up.score += n.score
            n.up.text += n.text
            n.up.mark |= n.mark or n.text > 0 and n.tag in MAIN
    return frozenset(place for n, place in places.items() if n.mark or n.score > total / 2)


def tokens(page: str) -> Iterator[re.Match[str]]:
    """Tags, comments and raw elements in order. Drawings are looked for up to the last end of one."""
    ends = max((m.start() for m in _DRAWING_ENDS.finditer(page)), default=-1)
    at = 0
    while m := (_TOKEN if at <= ends else _NO_DRAWING).search(page, at):
        yield m
        at = m.end()


def blocks(page: str, stay: frozenset[int] | None = frozenset(), places: dict[Node, int] | None = None) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """(block element, text, characters in links) of all that is not left out, in page order, and all elements in order of their start.

    Elements at the places `stay` (None: all) are not left out for their class or id; `places`
    gets where elements with such a class or id begin.
    """
    at = root = Node("html")
    nodes = [root]
    opened: Counter[str] = Counter()
    found: list[tuple[Node, str, int]] = []
    held: list[str] = []
    linked = last = 0

    def put(part: str) -> None:
        nonlocal linked
        if part and not at.out:
            held.append(part)
            if at.link:
                linked += len("".join(markup.unescape(part).split()))

    def end_block() -> None:
        nonlocal linked
        if held:
            words = markup.unescape("".join(held)).split()
            if words:
                node = next(n for n in at.above() if n.tag in BLOCK)
                text = " ".join(words)
                found.append((node, text, len(text) if linked >= len("".join(words)) else linked))
            held.clear()
            linked = 0

    def close(tags: set[str], within: set[str] | frozenset = frozenset()) -> None:
        nonlocal at
        if any(opened[t] for t in tags):
            for node in at.above():
                if node is root or node.tag in within:
                    return
                if node.tag in tags:
                    for n in at.above():
                        opened[n.tag] -= 1
                        if n is node:
                            break
                    at = node.up or root
                    return

    for m in tokens(page):
        put(page[last:m.start()])
        last = m.end()
        tag = (m[4] or "").lower()
        if not tag or tag == "html":
            continue
        if tag in BLOCK:
            end_block()
        if tag in VOID:
            put(" ")
        elif m[3]:
            close({tag})
        else:
            if tag in BLOCK and opened["p"]:
                close({"p"}, {"td", "th", "li", "div", "section", "article", "blockquote", "body"})
            if tag in ENDS:
                close(*ENDS[tag])
            if tag in ("svg", "math") and m[5].endswith("/"):
                continue
            at = Node(tag, m[5], at, stay is None or m.start() in stay)
            nodes.append(at)
            if at.named and places is not None:
                places[at] = m.start()
            opened[tag] += 1
            if tag == "a":
                at.links = 1
    put(page[last:])
    end_block()
    return found, nodes


def main_text(page: str) -> str:
    """Text of the best container and of those of its siblings that belong to it.

    Every block of a leaf element or of at least 25 characters gives its container one
    point, one a comma and one for each 100 characters up to three, less the share of its
    text that is links; the next ancestor gets half, further ones a third of that by their
    distance. Articles and main elements get 25 more. Points of a container count by the
    share of its text outside links. The article (else the main element) nearest
    around the best container takes its place. Otherwise siblings with a fifth of its points are kept too,
    and paragraphs beside it that read like text. Outside articles, lists that are nearly all
    links are left out. The work grows with the page, however deep its tree.
    """
    found, tree = blocks(page, spared(page))
    for node, text, linked in found:
        node.text += len(text)
        node.linked += linked
        if points := points_of(node, text, linked):
            holder = node.up if node.tag in LEAF and node.up else node
            for depth, n in enumerate(islice(holder.above(), REACH)):
                n.score += points / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
    for n in reversed(tree):  # children come before their parents
        if n.up:
            n.up.text += n.text
            n.up.linked += n.linked
            n.up.links += n.links
    holders: dict[Node, None] = {}
    for node, _, _ in found:
        for n in node.above():
            if n in holders:
                break
            holders[n] = None
    nodes = [n for n in holders if n.tag not in LEAF and n.tag in BLOCK]
    if not nodes:
        return ""
    best = max(nodes, key=Node.value)
    for tag in MAIN:
        if around := next((n for n in best.above() if n.tag == tag), None):
            best = around
            break
    keep = {best}
    if best.tag not in MAIN and best.up:
        enough = 0.2 * best.value()
        keep |= {n for n in nodes if n.up is best.up and n.value() >= enough}
        keep |= {node for node, text, linked in found if node.up is best.up and node.tag in LEAF and (
            len(text) > 80 and linked < 0.25 * len(text) or not linked and text[-1:] in ".!?")}
    article, lists = set(), set()
    for n in tree:  # parents come before their children; `mark`: is or lies in what is kept
        n.mark = n in keep or n.up is not None and n.up.mark
        if n.tag == "article" or n.up in article:
            article.add(n)
        elif n.up in lists or n.links >= 3 and n.density() >= 0.8 and n.tag not in ("html", "body", *MAIN):
            lists.add(n)
    return "\n".join(text for node, text, _ in found if node.mark and node not in lists)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every page, from its whole html.

    Null or empty html, and pages without text, give an empty text. Repeated rows get a
    row each; an empty table gives none; other columns are ignored. Markup may be broken:
    paragraphs, list items and cells end where the next begins, end tags without a start
    are ignored, what is open at the end ends there.
    """
    source = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(read, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
