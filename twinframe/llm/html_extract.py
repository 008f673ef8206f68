"""HTML extraction by tree scoring.

A page becomes a tree of block elements; inline elements only mark link text. Elements
that are menus, headers, footers, sidebars, notices, adverts, forms or comments by their tag,
role or name go first. Each paragraph of the rest earns points for its length and commas;
its parent gets all of them, its grandparent half and ancestors further up a share that
falls with distance. An element's score is its points times the share of its text outside
links. The best element, or the article element around it, is the container; siblings that
score well or read like prose are kept with it, and lists of links in it go.

Scale: pages are independent; one pass without a shuffle, time in proportion to the page.

Defined cases: null, empty or text-free pages give an empty text; a page without markup is
one block; unclosed, crossed or stray tags never fail; if nothing scores, all that is left
of the page is its text, and if the names of elements hide everything they are ignored;
repeated rows give equal texts; an empty table gives an empty table; other columns pass
through `extract`, whatever their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, append_columns

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed object svg math canvas audio video applet select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
DROPPED = frozenset("head nav aside footer form fieldset dialog menu template search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: An open element of the left ends where one of the right begins, up to a container.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",))}

_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menus?|submenu|sidebars?|sidenav|side|aside|rail|footers?|foot|masthead|topbar|banners?|ads?|adverts?|advertisements?|advertising|adsense|adslot|adbox|sponsor|sponsored|promo|promos|promotion|comments?|commentlist|commentary-list|disqus|respond|replies|share|sharing|sharebar|social|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|lightbox|newsletter|subscribe|subscription|signup|login|related|recommended|recommendations|recommend|breadcrumbs?|pagination|pager|widgets?|toolbar|outbrain|taboola|skyscraper|sitemap|skip|toc-nav)(?:[\s_-]|\d|$)"
)
_HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:headers?|site-?header|page-?header|top)(?:[\s_-]|\d|$)")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Characters of the shortest paragraph that earns points; a full length point per so many; length points at most.
PARAGRAPH, LENGTH_STEP, LENGTH_POINTS = 25, 100, 3
#: Share of the best score from which a sibling is kept, and of link text above which it isn't.
SIBLING_SCORE, SIBLING_LINKS, LINK_LIST = 0.1, 0.33, 0.5


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: str = ""
    role: str = ""
    hidden: bool = False
    parts: list = field(default_factory=list)  # texts (str, linked) and children (int), in page order


def _attributes(node: Node, text: str) -> None:
    if "=" not in text and "hidden" not in text:
        return
    names = []
    for key, *values in _ATTRIBUTE.findall(text):
        value = "".join(values)
        key = key.lower()
        if key in ("class", "id"):
            names.append(value)
        elif key == "role":
            node.role = value.strip().lower()
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN_STYLE.search(value.lower()):
            node.hidden = True
    if names:
        # camelCase parts count as parts
        node.names = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", " ".join(names)).lower()


@dataclass
class Page:
    nodes: list[Node]
    title: str
    links: list[tuple[str, str]]


def parse(source: str) -> Page:
    """The page's tree of block elements; node 0 is the page itself."""
    nodes = [Node("html", -1)]
    stack = [0]
    open_at: dict[str, list[int]] = {}  # tag -> depths of its open elements, so that nothing is looked for in vain
    titles, links = [], []
    linked_in = -1  # the node in which a link is open
    link_text: list[str] = []
    at = 0
    end = len(source)
    lower = None

    def text(piece: str) -> None:
        if piece:
            nodes[stack[-1]].parts.append((piece, linked_in >= 0))
            if linked_in >= 0:
                link_text.append(piece)

    def end_link() -> None:
        nonlocal linked_in
        linked_in = -1
        links[-1] = (links[-1][0], " ".join(html.unescape("".join(link_text)).split()))
        link_text.clear()

    def pop(depth: int) -> None:
        while len(stack) > depth:
            last = stack.pop()
            if last:
                open_at[nodes[last].tag].pop()
            if last == linked_in:
                end_link()

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        closing, tag, attributes = m.groups()
        if tag is None:
            if m.group().startswith("<![CDATA["):
                text(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                if linked_in >= 0:
                    end_link()
            elif tag in BLOCKS and tag not in ("html", "body") and open_at.get(tag):
                pop(open_at[tag][-1])
            continue
        if tag == "a":
            if linked_in >= 0:
                end_link()
            linked_in = stack[-1]
            href = next((a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes) if k.lower() == "href"), "")
            links.append((html.unescape(href), ""))
        elif tag in RAW:
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            lower = source.lower() if lower is None else lower
            if len(lower) != end:  # a few characters change their length in lower case
                found = re.compile(f"</{tag}", re.I).search(source, at)
                stop = found.start() if found else -1
            else:
                stop = lower.find(f"</{tag}", at)
            stop = end if stop < 0 else stop
            if tag == "title":
                titles.append(source[at:stop])
            at = stop
        elif tag == "br":
            text(" ")
        elif tag in BLOCKS:
            if tag == "html":
                continue
            if (tag == "body" or nodes[stack[-1]].tag == "head") and open_at.get("head"):
                pop(open_at["head"][0])
            if nodes[stack[-1]].tag == "p":
                pop(len(stack) - 1)
            if tag in CLOSES:
                ended, bounds = CLOSES[tag]
                bound = max((open_at[b][-1] for b in bounds if open_at.get(b)), default=0)
                first = min((of[k] for e in ended if (of := open_at.get(e)) and (k := bisect_right(of, bound)) < len(of)), default=0)
                if first:
                    pop(first)
            node = Node(tag, stack[-1])
            if attributes:
                _attributes(node, attributes)
            nodes.append(node)
            nodes[stack[-1]].parts.append(len(nodes) - 1)
            if tag not in VOID:
                open_at.setdefault(tag, []).append(len(stack))
                stack.append(len(nodes) - 1)
    pop(0)
    if linked_in >= 0:
        end_link()
    return Page(nodes, " ".join(html.unescape(titles[0]).split()) if titles else "", links)


def _clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _dropped(nodes: list[Node], by_name: bool) -> list[bool]:
    """Which elements go, with all below them."""
    main = next((i for i, n in enumerate(nodes) if n.tag in ("article", "main") and not _BAD_NAME.search(n.names)), -1)
    above_main = set()
    i = main
    while i >= 0:
        above_main.add(i)
        i = nodes[i].parent
    out, inside = [False] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes):
        if i and (out[n.parent]):
            out[i] = True
            continue
        inside[i] = i > 0 and inside[n.parent] or n.tag in ("article", "main")
        if n.tag in ("html", "body") or i in above_main:
            continue
        out[i] = n.tag in DROPPED or n.hidden or n.role in ROLES or n.tag == "header" and not inside[i] or by_name and bool(n.names) and bool(_BAD_NAME.search(n.names) or not inside[i] and _HEADER_NAME.search(n.names))
    return out


def _blocks(nodes: list[Node], root: int, dropped: list[bool]) -> list[tuple[int, str, int]]:
    """(node, text, characters in links) of each block below root, in page order."""
    out = []
    todo = [(root, 0)]
    parts: list[str] = []
    linked = 0

    def flush(node: int) -> None:
        nonlocal linked
        if parts and (text := _clean(parts)):
            out.append((node, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    while todo:
        node, k = todo.pop()
        here = nodes[node].parts
        while k < len(here):
            part = here[k]
            k += 1
            if isinstance(part, int):
                if not dropped[part]:
                    flush(node)
                    todo.append((node, k))
                    todo.append((part, 0))
                    break
                flush(node)
            else:
                parts.append(part[0])
                if part[1]:
                    linked += len(part[0].strip())
        else:
            flush(node)
    return out


def _scores(nodes: list[Node], blocks: list[tuple[int, str, int]]) -> tuple[list[float], list[int], list[int], list[int]]:
    """Score, text length, length in links and number of link blocks of every element."""
    size, linked, lists, points = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes), [0.0] * len(nodes)
    for node, text, links in blocks:
        size[node] += len(text)
        linked[node] += links
        lists[node] += links * 2 > len(text)
        if len(text) >= PARAGRAPH:
            worth = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // LENGTH_STEP, LENGTH_POINTS)
            # text that stands in a container itself counts there; that in a paragraph, for its parent
            up, level = (node if nodes[node].tag in ("html", "body", "div", "section", "article", "main", "td") else nodes[node].parent), 0
            while up >= 0 and level < 8:
                points[up] += worth if level == 0 else worth / 2 if level == 1 else worth / (3 * level)
                up, level = nodes[up].parent, level + 1
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        size[up] += size[i]
        linked[up] += linked[i]
        lists[up] += lists[i]
    return [p * (1 - linked[i] / size[i]) if size[i] else 0.0 for i, p in enumerate(points)], size, linked, lists


def _prose(text: str) -> bool:
    return len(text) >= 40 and text.rstrip("\"'”’»)")[-1:] in tuple(".!?…:;。！？")


class _Edges:
    """Tells whether a link list begins or ends an article's text, and no heading or line with a colon leads to it."""

    def __init__(self, nodes: list[Node], blocks: list[tuple[int, str, int]], article: int):
        self.nodes, self.blocks = nodes, blocks
        # blocks below an element follow each other: the first and the last of them
        self.first, self.last = [len(blocks)] * len(nodes), [-1] * len(nodes)
        for k, (node, _, _) in enumerate(blocks):
            self.first[node], self.last[node] = min(k, self.first[node]), k
        for i in range(len(nodes) - 1, 0, -1):
            up = nodes[i].parent
            self.first[up], self.last[up] = min(self.first[up], self.first[i]), max(self.last[up], self.last[i])
        self.begin, self.end = self.first[article], self.last[article]
        prose = [k for k in range(self.begin, self.end + 1) if blocks[k][2] <= LINK_LIST * len(blocks[k][1])]
        self.prose = (prose[0], prose[-1]) if prose else (self.end + 1, -1)

    def __call__(self, at: int) -> bool:
        first, last = self.first[at], self.last[at]
        if first > self.begin:
            node, text, _ = self.blocks[first - 1]
            if self.nodes[node].tag in HEADINGS or text.endswith((":", "：")):
                return False
        return not self.prose[0] < first or not self.prose[1] > last


def _choose(nodes: list[Node], dropped: list[bool]) -> list[str]:
    blocks = _blocks(nodes, 0, dropped)
    scores, size, linked, lists = _scores(nodes, blocks)
    best = max(range(len(nodes)), key=lambda i: (scores[i], -i))
    if scores[best] <= 0:
        return [t for _, t, _ in blocks]
    around = best
    while around >= 0 and nodes[around].tag not in ("article", "main"):
        around = nodes[around].parent
    kept = {around if around >= 0 else best}
    if around < 0 and best and nodes[best].parent >= 0:
        own: dict[int, list[str]] = {}
        up = nodes[best].parent
        child_of: dict[int, int] = {}
        for node, text, _ in blocks:
            path, i = [], node
            while i >= 0 and i not in child_of and nodes[i].parent != up:
                path.append(i)
                i = nodes[i].parent
            top = child_of.get(i, i)
            for x in (*path, i):
                if x >= 0:
                    child_of[x] = top
            if top >= 0:
                own.setdefault(top, []).append(text)
        for part in nodes[up].parts:
            if isinstance(part, int) and part in own and part != best:
                few_links = linked[part] <= SIBLING_LINKS * size[part]
                if few_links and (scores[part] >= SIBLING_SCORE * scores[best] or nodes[part].tag in HEADINGS or any(map(_prose, own[part]))):
                    kept.add(part)
    inside, header = [False] * len(nodes), [False] * len(nodes)
    gone = list(dropped)
    at_edge = _Edges(nodes, blocks, around) if around >= 0 else None
    for i, n in enumerate(nodes):
        inside[i] = i in kept or i > 0 and inside[n.parent]
        header[i] = n.tag == "header" or i > 0 and header[n.parent]
        if inside[i] and i not in kept and n.tag in ("ul", "ol", "div", "section", "table", "dl") and lists[i] >= 3 and linked[i] > LINK_LIST * size[i]:
            # an explicit article's own lists stay; what is marked as navigation went before
            gone[i] = at_edge is None or header[i] or at_edge(i)
        gone[i] = gone[i] or i > 0 and gone[n.parent]
    return [t for node, t, _ in blocks if inside[node] and not gone[node]]


def main_text(source: str | None) -> str:
    """The article's blocks, one a line."""
    if not source:
        return ""
    nodes = parse(source).nodes
    return "\n".join(_choose(nodes, _dropped(nodes, True)) or _choose(nodes, _dropped(nodes, False)))


def visible_text(page: Page) -> str:
    """All blocks of the page that a reader would see, one a line."""
    dropped = [False] * len(page.nodes)
    for i, n in enumerate(page.nodes):
        dropped[i] = i > 0 and dropped[n.parent] or n.tag in ("head", "template") or n.hidden
    return "\n".join(t for _, t, _ in _blocks(page.nodes, 0, dropped))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with `__tf_text`, the main text of each page."""

    def make():
        return lambda values: [[main_text(v.decode("utf-8", "replace") if v else None) for v in values]]

    return append_columns(pages, column, [T.StructField(f"{OWN}text", T.StringType())], make)


def digest(pages: DataFrame) -> DataFrame:
    got = extract(pages.select("page_id", "url", F.col("html").cast("string").alias("html")))
    return got.select("page_id", "url", F.col(f"{OWN}text").alias("text"), F.length(f"{OWN}text").cast("long").alias("n_chars"))
