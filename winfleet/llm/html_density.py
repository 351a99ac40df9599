"""Main text of web pages by composite text density.

The page becomes a tree of its tags, with the tags that HTML leaves open closed as a browser would, in time linear in its length.
Every node has its characters, those inside links, its tags and its link tags below it. The composite density is characters per tag,
scaled down where links hold much of the text; a node's sum is over the densities of its children, as far as they are blocks:
formatting is part of its block. The node with the largest sum is the heart of the page; the least density on its path up to the
body is the threshold, and of the subtrees that reach it, the one with the largest sum is kept.

Elements that never hold main text (scripts, styles, navigation, headers, footers, asides, forms) and those that classes, ids or
roles name as adverts, notices, sidebars, menus or comments are cut before densities are taken, unless they hold most of the page.
"""

from __future__ import annotations

import html
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = BLOCKS - VOID
NEVER_MAIN = frozenset(
    "script style noscript template head title meta link nav header footer aside form button select textarea input iframe object embed svg canvas audio video menu dialog noembed noframes xmp".split()
)
#: What each start tag closes if it is open, up to the nearest of the elements that bound the search.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small span strike strong sub sup tt u".split())
# Names of what is never main text: notices, sidebars, menus, footers and comments.
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:notices?|newsletter|subscribe|side-?bar|menu|nav|navs|navbars?|navigation|navigations|navmenu|breadcrumbs?|foot|footer|footers|comments?|disqus|replies|respond|pagination|pager)(?:$|[\s_-])"
)
# Names of what is mostly links around the text; such an element is cut only if links hold at least half of it.
_AROUND = re.compile(r"(?:^|[\s_-])(?:related|recommend\w*|social|share|sharing|skip|toolbar)(?:$|[\s_-])")
# Names that mark adverts and consent notices only: what bears them stays cut, however long it is.
_ADVERT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal)(?:$|[\s_-])")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_EVENT = re.compile("[>\"']")
_NAMING = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    noise: int = 0  # 1 if a name alone says so, 2 for sure, 3 if links hold much of it
    parts: list = field(default_factory=list)  # text and nodes, in page order
    chars: int = 0
    link_chars: int = 0
    tags: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0


def _noise(tag: str, rest: str) -> int:
    if tag in NEVER_MAIN:
        return 2
    if not rest or tag in ("html", "body", "article", "main"):
        return 0
    noise = 0
    for name, value in _NAMING.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name in ("class", "id") and _ADVERT.search(value):
            return 2
        if name == "role" and value in _ROLES or name in ("class", "id") and _NOISE.search(value):
            noise = 1
        elif name in ("class", "id") and not noise and _AROUND.search(value):
            noise = 3
    return noise


class Ends:
    """Where tags end: the first ``>`` outside of quotes, from any place of a page on. All ends are found in one pass from the right."""

    def __init__(self, page: str):
        self.places, self.ends = array("q"), array("q")
        after = {">": -1, '"': -1, "'": -1}  # from the place after the nearest one of each to the right: where a tag ends that is there outside of quotes
        end = -1
        for event in reversed([*_EVENT.finditer(page)]):
            sign = event[0]
            end, after[sign] = event.end() if sign == ">" else after[sign], end
            self.places.append(event.start())
            self.ends.append(end)
        self.places.reverse()
        self.ends.reverse()

    def of(self, place: int) -> int:
        """The place after the tag's end; -1 if there is none, as when a quote is never closed."""
        k = bisect_left(self.places, place)
        return self.ends[k] if k < len(self.ends) else -1


class Open:
    """The elements that are open, with the places of each name among them, so that no tag searches for its partner."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}
        self.plain = [0]  # places of elements that are not formatting

    def place_of(self, *tags: str) -> int:
        """The innermost open element of these names; 0 if there is none."""
        return max((places[-1] for tag in tags if (places := self.at.get(tag))), default=0)

    def push(self, node: Node) -> None:
        if node.tag not in FORMATTING:
            self.plain.append(len(self.stack))
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > place > 0:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag not in FORMATTING:
                self.plain.pop()


def parse(page: str) -> Node:
    """The tree of a page, in time linear in its length. What is open at the end is closed there.

    End tags without a partner are passed over; an end tag of formatting closes nothing beyond its block. A ``<`` that starts no
    tag, or a tag that never ends, is text; a comment that never ends reaches to the end of the page.
    """
    root = Node("#page")
    open_, ends = Open(root), Ends(page)
    place, size = 0, len(page)  # the page is done up to here
    seen = 0  # text from place up to here has no tag

    def text_until(stop: int) -> None:
        if stop > place:
            open_.stack[-1].parts.append(page[place:stop])

    while (start := page.find("<", seen)) >= 0:
        sign = page[start + 1 : start + 2]
        closing = sign == "/"
        name = _NAME.match(page, start + 1 + closing)
        if name is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = end + 3 if end >= 0 else size
            elif sign and sign in "!?/":
                end = page.find(">", start) + 1
            else:
                end = 0
            if not end:
                if sign and sign in "!?/":
                    break  # no tag ends from here on
                seen = start + 1
                continue
            text_until(start)
            place = seen = end
            continue
        end = ends.of(name.end())
        if end < 0:
            seen = start + 1
            continue
        text_until(start)
        place = seen = end
        tag, rest = name[0].lower(), page[name.end() : end - 1]
        if closing:
            where = open_.place_of(tag)
            if tag not in FORMATTING or where > open_.plain[-1]:
                open_.close(where)
            continue
        if tag in CLOSES_P:
            if open_.stack[open_.plain[-1]].tag == "p":
                open_.close(open_.plain[-1])
        elif tag in CLOSES:
            inner, bounds = CLOSES[tag]
            where = open_.place_of(*inner)
            if where > open_.place_of(*bounds):
                open_.close(where)
        node = Node(tag, _noise(tag, rest))
        open_.stack[-1].parts.append(node)
        if tag in RAW:
            last = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, place)
            end = page.find(">", last.end()) + 1 if last else 0
            if not node.noise:
                node.parts.append(page[place : last.start() if end else size])
            place = seen = end or size
        elif tag not in VOID and not rest.endswith("/"):
            open_.push(node)
    text_until(size)
    _spare_most(root)
    return root


def _spare_most(root: Node) -> None:
    """Keep what a class, id or role alone marks as noise if it holds more than half of the body's characters outside links.

    What is inside it may be noise in turn and is judged by the same measure. Elements that never hold main text stay cut, as do
    adverts, and nothing is spared where an article or main outside of noise has text. Names that stand for links around the
    text cut an element only if links hold half of it or more.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        stack.extend((p, linked) for p in node.parts if type(p) is Node and p.tag not in NEVER_MAIN)
    plain: dict[int, int] = {}
    every: dict[int, int] = {}
    for node, linked in reversed(order):
        own = sum(len(p.strip()) for p in node.parts if type(p) is str)
        below = [id(p) for p in node.parts if type(p) is Node]
        every[id(node)] = own + sum(every.get(p, 0) for p in below)
        plain[id(node)] = (0 if linked else own) + sum(plain.get(p, 0) for p in below)
    body = next((n for n, _ in order if n.tag == "body"), root)
    for node, _ in order:
        if node.noise == 3 and plain[id(node)] * 2 > every[id(node)]:
            node.noise = 0
    if any(n.tag in ("article", "main") and every[id(n)] for n in _walk(root)):
        return
    for node, _ in order:
        if node.noise == 1 and plain[id(node)] * 2 > plain[id(body)]:
            node.noise = 0


def _walk(root: Node) -> list[Node]:
    """Nodes that may hold main text, parents before children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if type(p) is Node and not p.noise)
    return order


def _weigh(order: list[Node], body: Node) -> None:
    for node in reversed(order):
        for part in node.parts:
            if type(part) is str:
                node.chars += len(part.strip())
            elif not part.noise:
                node.chars += part.chars
                node.link_chars += part.link_chars
                node.tags += part.tags + 1
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        if node.chars:
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + ratio * node.chars + math.e)
            inner = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            node.density = node.chars / max(node.tags, 1) * math.log(max(inner, 1.0)) / base
    for node in order:
        node.total = sum(p.density for p in node.parts if type(p) is Node and not p.noise and p.tag in CONTAINERS)


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order, none inside another."""
    order = _walk(root)
    body = next((n for n in order if n.tag == "body"), root)
    _weigh(order, body)
    heart = max((n for n in order if n.chars), key=lambda n: n.total, default=None)
    if heart is None:
        return []
    parents = {id(p): n for n in order for p in n.parts if type(p) is Node and not p.noise}
    path = [heart]
    while path[-1] is not body and id(path[-1]) in parents:
        path.append(parents[id(path[-1])])
    threshold = min(n.density for n in path)
    best = {}  # of each node: the node at or below it with the largest sum
    for node in reversed(order):
        below = [best[id(p)] for p in node.parts if type(p) is Node and not p.noise and p.chars]
        best[id(node)] = max([node, *below], key=lambda n: n.total)
    marked = {id(best[id(n)]) for n in order if n.chars and n.density >= threshold and n is not body}
    found, stack = [], [body]
    while stack:
        node = stack.pop()
        if id(node) in marked:
            found.append(node)
        else:
            stack.extend(p for p in reversed(node.parts) if type(p) is Node and not p.noise)
    return found or [heart]


def text_of(nodes: list[Node]) -> str:
    """Blocks of text under the nodes, joined by one line feed; references decoded, white space inside a block made one space."""
    blocks: list[list[str]] = [[]]
    for node in nodes:
        blocks.append([])
        stack: list = [node]
        while stack:
            part = stack.pop()
            if type(part) is str:
                blocks[-1].append(html.unescape(part) if "&" in part else part)
            elif part is None:
                blocks.append([])
            elif not part.noise:
                if part.tag in BLOCKS:
                    blocks.append([])
                    stack.append(None)
                stack.extend(reversed(part.parts))
    lines = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(line for line in lines if line)


def extract(page: str | None) -> str:
    return text_of(main_nodes(parse(page))) if page else ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row.

    A null or empty html, and a page without main text, give an empty text. Ids and urls may be null or repeat. Pages are read
    whole, whatever their length or depth; nothing here recurses.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [extract(page) for page in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
