"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at its block-level tags.  Per block, a linear classifier over text and markup gives the
cost of calling it content and the cost of calling it boilerplate; these are the capacities to the two terminals.
Neighbouring blocks, and blocks that are consecutive children of the same parent or share more of their path, are tied by smoothness
edges, so that a block is only labelled against its surroundings if its own evidence outweighs the ties it cuts.  The
minimum cut of that graph, found by maximum flow, is the cheapest labelling.

Costs and ties are whole numbers, so the cut is exact; of several minimum cuts, the one with the most content is taken.
What can never be text (scripts, styles, markup comments, form fields, the head) is left out before labelling.

Defined cases: null or empty html has an empty text, and so has a page without content; a tag that is not closed at the
end of the page is dropped; repeated rows are extracted each; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import log1p

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ticktape.llm.spotsigs import ANCHORS
from ticktape.llm.tables import text_of

# Element names by what they do to text.
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_NO_TEXT = frozenset("script style noscript template head title svg math object iframe textarea select button input datalist canvas audio video".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math select object canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCK_TAGS - frozenset("body html caption tbody td tfoot th thead tr legend option optgroup".split())
_ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
_BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners bottombar breadcrumb breadcrumbs comment "
    "commentlist comments consent cookie cookies copyright disqus discussion dropdown foot footer gdpr header hidden links login "
    "masthead menu menus message modal nav navbar navigation newsletter notice notices notification notifications overlay pager "
    "pagination paywall popup popups privacy promo promoted promotion ratings recommended related replies reply respond "
    "response responses review reviews search share sharing sidebar sidebars signup skip skyscraper social sponsor sponsored "
    "sponsors subscribe subscription tags taboola toc toolbar topbar topnav trending warning widget widgets alert".split()
)
_CONTENT_NAMES = frozenset("article articlebody body content contents entry main maincontent post postbody story text".split())
# Names that only describe the page's layout, and names of parts that an article may have too.
_LAYOUT_NAMES, _OWN_PARTS = frozenset("has with without no layout".split()), frozenset(["header"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_COMMON = frozenset(ANCHORS)

#: Capacities and ties are rounded to 1 / UNIT.
UNIT = 1000
#: Ties of neighbours, of consecutive children of one parent, and for each shared step of their paths.
TIE_NEAR, TIE_PARENT, TIE_STEP = 0.4, 1.2, 0.1

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r"[\"'>]")
#: A whole name, and its value if it has one: what stands inside a value is no attribute.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def _tag(page: str, at: int, dead: set[int]) -> tuple[str, str, str, int] | None:
    """The tag that begins at ``at``: slash, name, attributes and where it ends; None if it never ends.

    Quoted values may hold anything and be of any length.  ``dead`` remembers opening quotes from which no end was reached, so that a
    page of broken tags is not searched to its end for each of them.
    """
    head = _TAG.match(page, at)
    if not head:
        return None
    pos, opened = head.end(), []
    while (stop := _TAG_STOP.search(page, pos)) is not None:
        if stop[0] == ">":
            return head[1], head[2], page[head.end() : stop.start()], stop.end()
        opened.append(stop.start())
        close = -1 if stop.start() in dead else page.find(stop[0], stop.end())
        if close < 0:
            break
        pos = close + 1
    dead.update(opened)
    return None


def _attributes(text: str) -> tuple[int, bool]:
    """What class, id and role say about an element (1 content, -1 boilerplate, 0 nothing), and whether it is hidden."""
    says, hidden = 0, False
    for name, value in _ATTRIBUTE.findall(text):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names = set(_NAME.findall(_CAMEL.sub(r"\1 \2", value).lower()))
            boiler = names & _BOILER_NAMES
            if names & _CONTENT_NAMES:
                boiler -= _OWN_PARTS
            if boiler and not names & _LAYOUT_NAMES:
                says = -1
            elif names & _CONTENT_NAMES and not says:
                says = 1
        elif name == "role":
            says = -1 if value.lower() in _ROLES else says or int(value.lower() in ("main", "article"))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return says, hidden


class _Element:
    __slots__ = ("tag", "parent", "depth", "boiler", "in_form", "content", "silent", "link")

    def __init__(self, tag: str, parent: _Element | None, says: int = 0, hidden: bool = False):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        inside = parent is not None and parent.content
        heading = tag == "header" and not inside
        named = says < 0 and tag not in ("html", "body", "article", "main")
        self.boiler = (parent is not None and parent.boiler) or tag in _BOILER_TAGS or heading or named
        # a form may be wrapped around the whole page: then its article is none of it
        self.in_form = (tag == "form" or parent is not None and parent.in_form) and tag not in ("article", "main")
        self.content = tag in ("article", "main") or says > 0 and tag not in ("html", "body") or inside
        self.silent = (parent is not None and parent.silent) or tag in _NO_TEXT or hidden
        self.link = tag == "a" or (parent is not None and parent.link)


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: _Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order, their character references decoded and white space turned into single spaces."""
    top = _Element("", None)
    stack, found, parts, n_linked = [top], [], [], 0
    holder: _Element | None = None

    def say(text: str) -> None:
        nonlocal holder, n_linked
        if not stack[-1].silent:
            parts.append(text)
            if holder is None and text.strip():
                holder = next(e for e in reversed(stack) if e.tag in _BLOCK_TAGS or e is top)
            if stack[-1].link:
                n_linked += len(text)

    def end_block() -> None:
        nonlocal parts, holder, n_linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, holder or stack[-1], n_linked))
        parts, holder, n_linked = [], None, 0

    def close(at: int) -> None:
        del stack[at:]

    pos, size, dead = 0, len(page), set()
    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            say(page[pos:])
            break
        if at > pos:
            say(page[pos:at])
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            pos = size if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), at):
            stop = page.find(">", at)
            pos = size if stop < 0 else stop + 1
            continue
        tag = _tag(page, at, dead)
        if not tag:
            following = page[at + 1 : at + 3].lstrip("/")
            if following[:1].isalpha() or not following:
                stop = page.find(">", at)
                pos = size if stop < 0 else stop + 1  # a broken tag, or one cut off at the end
            else:
                say("<")
                pos = at + 1
            continue
        pos, name = tag[3], tag[1].lower()
        if tag[0]:
            if name in _BLOCK_TAGS:
                end_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table", "article", "main", "body") and name not in _BLOCK_TAGS:
                    break  # a stray inline end tag does not close what holds it
            continue
        if name == "br":
            say(" ")
            continue
        if name in _BLOCK_TAGS:
            end_block()
            if name in _CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in _BLOCK_TAGS:
                        break
            if name in _ITEMS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name or name in ("dt", "dd") and stack[i].tag in ("dt", "dd") or name in ("td", "th") and stack[i].tag in ("td", "th"):
                        close(i)
                        break
                    if stack[i].tag in _ITEMS[name]:
                        break
            if name == "body":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "head":
                        close(i)
                        break
        if name in _VOID or tag[2].endswith("/") and name not in _BLOCK_TAGS:
            continue
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
            pos = size if stop is None else stop.end()
            continue
        stack.append(_Element(name, stack[-1], *_attributes(tag[2])) if tag[2].strip() else _Element(name, stack[-1]))
    end_block()
    return found


def leaning(block: Block) -> float:
    """The classifier: log odds that a block is content.  Weights are fixed values."""
    element, words = block.element, block.text.lower().split()
    n = len(words)
    common = sum(map(_COMMON.__contains__, words)) / n
    odds = -1.2 + 0.9 * min(log1p(n), 5.0) + 1.5 * min(common, 0.5) - 4.0 * min(1.0, block.linked / len(block.text))
    odds += 0.6 if block.text[-1] in ".!?:;\"'”»…" else 0.0
    odds += 3.0 if element.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and element.content else 0.0
    odds += 4.0 if element.content else -0.8
    odds -= 25.0 if element.boiler or element.in_form else 0.0
    return odds


class _Graph:
    """Maximum flow by blocking flows over level graphs."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def tie(self, a: int, b: int, there: int, back: int) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, source: int) -> list[int]:
        level, line = [-1] * len(self.out), [source]
        level[source] = 0
        for x in line:
            for e in self.out[x]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    line.append(self.to[e])
        return level

    def saturate(self, source: int, sink: int) -> None:
        to, room = self.to, self.room
        while (level := self.levels(source))[sink] >= 0:
            turn, path, x = [0] * len(self.out), [], source
            while True:
                if x == sink:
                    n = min(room[e] for e in path)
                    for e in path:
                        room[e] -= n
                        room[e ^ 1] += n
                    first = next(i for i, e in enumerate(path) if not room[e])
                    x = to[path[first] ^ 1]
                    del path[first:]
                    continue
                while turn[x] < len(self.out[x]):
                    e = self.out[x][turn[x]]
                    if room[e] and level[to[e]] == level[x] + 1:
                        break
                    turn[x] += 1
                else:
                    if x == source:
                        break
                    x = to[path.pop() ^ 1]
                    turn[x] += 1
                    continue
                path.append(e)
                x = to[e]

    def reaching(self, sink: int) -> list[bool]:
        """Which nodes can still send to the sink."""
        found, line = [False] * len(self.out), [sink]
        found[sink] = True
        for x in line:
            for e in self.out[x]:
                if self.room[e ^ 1] and not found[self.to[e]]:
                    found[self.to[e]] = True
                    line.append(self.to[e])
        return found


def shared_steps(a: _Element, b: _Element) -> int:
    while a.depth > b.depth:
        a = a.parent
    while b.depth > a.depth:
        b = b.parent
    while a is not b:
        a, b = a.parent, b.parent
    return a.depth


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next, and with the next one of the same parent."""
    out, last = [], {}
    for i, block in enumerate(found):
        if i:
            steps = shared_steps(found[i - 1].element, block.element)
            out.append((i - 1, i, TIE_NEAR + TIE_STEP * min(steps, 8)))
        parent = id(block.element.parent or block.element)
        if parent in last:
            out.append((last[parent], i, TIE_PARENT))
        last[parent] = i
    return out


def labels(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The minimum cut: which blocks are content."""
    n = len(odds)
    graph = _Graph(n + 2)
    for i, odd in enumerate(odds):
        cost = round(abs(odd) * UNIT)
        if odd >= 0:
            graph.tie(n, i, cost, 0)  # cut if the block is called boilerplate
        else:
            graph.tie(i, n + 1, cost, 0)  # cut if it is called content
    for a, b, weight in edges:
        graph.tie(a, b, round(weight * UNIT), round(weight * UNIT))
    graph.saturate(n, n + 1)
    return [not x for x in graph.reaching(n + 1)[:n]]


def main_text(page: str) -> str:
    found = blocks(page)
    odds = [leaning(b) for b in found]
    chosen = labels(odds, ties(found)) if found else []
    return "\n\n".join(b.text for b, content in zip(found, chosen) if content)


def extracted(pages: DataFrame, page: str = "html") -> DataFrame:
    """``row`` (the input row) and ``text``, the page's main text."""

    @pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    return pages.select(F.struct("*").alias("row"), extract(text_of(page)).alias("text"))
