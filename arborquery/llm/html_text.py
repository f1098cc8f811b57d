"""The main text of web pages by minimum-cut labelling.

A tolerant tokenizer turns a page into blocks of text with their place in the element tree. A classifier gives each
block a cost of being content and one of being boilerplate, from its tags, the class and id names around it, its
length and its share of link text. The costs are terminal capacities; edges between neighbours, and between blocks of
one parent, are what it costs to label them differently. A minimum cut, found by maximum flow, is the labelling of
least total cost. Blocks whose own cost outweighs all their edges are settled beforehand, which changes no minimum.

Defined cases: a null or empty page, or one of markup alone, gives the empty text; unclosed, misnested and truncated
markup is read as far as it goes, an unclosed comment or script to the end of the page; whole pages are read; equal
pages give equal texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

# Element names of HTML by what they do to text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_HIDDEN = frozenset("head template svg math object audio video canvas select option datalist map".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
_AWAY = frozenset("nav header footer aside form menu dialog button fieldset".split())
_TOWARDS = frozenset("article main".split())
# Parts of class and id names.
_AWAY_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar topbar header masthead footer foot sidebar aside rail widget "
    "widgets comment comments discussion disqus replies reply respond cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar tags copyright legal disclaimer search form skip".split()
)
_TOWARDS_NAMES = frozenset("article articlebody post entry story content main maintext body text".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


class Block(NamedTuple):
    text: str
    linked: int  # characters of link text
    tag: str
    zone: int  # -1 away from the main text, 0 unknown, 1 named like it, 2 in an article or main element
    parent: int
    grand: int


def _names(value: str) -> int:
    """What a class or id says: its last known part decides."""
    for name in reversed(value.split()):
        for part in reversed(_PART.findall(name)):
            part = part.lower()
            if part in _AWAY_NAMES:
                return -1
            if part in _TOWARDS_NAMES:
                return 1
    return 0


def _zone(tag: str, attrs: str, zone: int) -> tuple[int, bool]:
    """The zone inside an element, and whether it is hidden."""
    hidden, said = False, 0
    if attrs and tag not in ("html", "body"):
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next(filter(None, values), "")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                hidden = True
            elif name == "role":
                said = -1 if value.lower() in _AWAY_ROLES else 2 if value.lower() in ("main", "article") else said
            elif name == "itemprop":
                said = 2 if value.lower() == "articlebody" else said
            elif name in ("class", "id") and said == 0:
                said = _names(value)
    if zone < 0 or said < 0:
        return -1, hidden
    if tag == "header" and zone == 2:
        return zone, hidden  # an article's own head has its title
    if tag in _AWAY:
        return -1, hidden
    return (2 if tag in _TOWARDS or said == 2 else max(zone, said)), hidden


def blocks(page: str) -> list[Block]:
    """The visible blocks of text in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int, bool]] = []  # tag, zone, hidden, id of the block element, in a link
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = serial = pos = 0
    zone, hidden, in_link, tag_now = 0, False, False, ""
    line: list[int] = [0, 0]  # ids of the block elements around

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                out.append(Block(text, min(linked, len(text)), tag_now, zone, line[-1], line[-2]))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal zone, hidden, in_link, tag_now
        tag, _, _, block, _ = stack.pop()
        opened[tag] -= 1
        if block:
            line.pop()
        _, zone, hidden, _, in_link = stack[-1] if stack else ("", 0, False, 0, False)
        if block:
            tag_now = next((s[0] for s in reversed(stack) if s[3]), "")

    while True:
        lt = page.find("<", pos)
        if lt < 0 or lt + 1 >= len(page):
            lt = len(page)
        if lt > pos and not hidden:
            parts.append(page[pos:lt])
            if in_link:
                linked += lt - pos
        if lt == len(page):
            break
        after = page[lt + 1]
        if after in "!?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end, pos = end, end + 3
            else:
                end = page.find(">", lt)
                pos = end + 1
            if end < 0:
                break
            continue
        m = _TAG.match(page, lt)
        if not m:
            if after.isalpha() or after == "/":
                end = page.find(">", lt)
                if end < 0:
                    break  # a tag cut off at the end of the page
                pos = end + 1
            else:
                if not hidden:
                    parts.append("<")
                pos = lt + 1
            continue
        pos = m.end()
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if tag in _INLINE:
            if closing:
                if opened.get(tag) and stack[-1][0] == tag:
                    pop()
                elif tag == "a" and in_link:
                    while stack[-1][0] in _INLINE and stack[-1][0] != "a":
                        pop()
                    if stack[-1][0] == "a":
                        pop()
            elif not attrs.endswith("/") and tag != "wbr":
                if tag == "a" and in_link and stack[-1][0] == "a":
                    pop()
                inner, gone = _zone(tag, attrs, zone) if attrs else (zone, False)
                if inner != zone and not hidden:
                    flush()
                in_link |= tag == "a"
                zone, hidden = inner, hidden or gone
                stack.append((tag, zone, hidden, 0, in_link))
                opened[tag] = opened.get(tag, 0) + 1
            continue
        flush()
        if closing:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _RAW:
            if end := _ENDS[tag].search(page, pos):
                close = page.find(">", end.end())
                pos = close + 1 if close >= 0 else len(page)
            else:
                pos = len(page)
            continue
        if tag in _VOID:
            continue
        if opened.get("p"):
            while stack[-1][0] != "p":
                pop()
            pop()
        if tag in ("li", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
            pop()
        if attrs.endswith("/") and not attrs.strip("/ "):
            continue
        inner, gone = _zone(tag, attrs, zone)
        serial += 1
        zone, hidden, tag_now = inner, hidden or gone or tag in _HIDDEN, tag
        stack.append((tag, zone, hidden, serial, in_link))
        opened[tag] = opened.get(tag, 0) + 1
        line.append(serial)
    flush()
    return out


# Parameters of the classifier: log-odds of being content, in thousandths.
_START, _AWAY_COST, _OUTSIDE, _NAMED, _INSIDE, _LINKED = -500, -9000, -4000, 1800, 4500, -4000
_BY_TAG = {"p": 700, "h1": 500, "h2": 400, "h3": 300, "h4": 200, "blockquote": 400, "pre": 400, "li": -300, "td": -300, "div": -100}
_PER_CHAR, _MOST_CHARS = 15, 160
#: Edges: neighbours of one parent, of one grandparent, others; to the block before last of one parent; across zones.
_SAME, _NEAR, _FAR, _SIBLING, _ACROSS = 900, 500, 200, 300, 100


def costs(found: list[Block]) -> list[int]:
    """Each block's cost of being boilerplate less that of being content."""
    has_main = any(b.zone == 2 for b in found)
    out = []
    for b in found:
        share = b.linked / len(b.text)
        value = _START + _BY_TAG.get(b.tag, 0) + _PER_CHAR * min(len(b.text), _MOST_CHARS) + int(_LINKED * share)
        value += _AWAY_COST if b.zone < 0 else (0, _NAMED, _INSIDE)[b.zone]
        if has_main and b.zone != 2:
            value += _OUTSIDE
        out.append(value)
    return out


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Costs of labelling two blocks differently."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            weight = _SAME if a.parent == b.parent else _NEAR if a.grand == b.grand else _FAR
            out.append((i - 1, i, _ACROSS if a.zone != b.zone else weight))
        before = last.get(b.parent)
        if before is not None and before < i - 1:
            out.append((before, i, _SIBLING))
        last[b.parent] = i
    return out


def min_cut(terminal: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling of least cost: a node's cost is |terminal| if its label is not the sign's, an edge's its weight if
    its ends differ. Where several are least, the one with the fewest True."""
    n = len(terminal)
    value, around = list(terminal), [dict() for _ in range(n)]
    for i, j, w in links:
        around[i][j] = around[i].get(j, 0) + w
        around[j][i] = around[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    free = [sum(x.values()) for x in around]
    queue = deque(range(n))
    while queue:  # nodes that outweigh their edges are settled, and pull their neighbours
        i = queue.popleft()
        if label[i] is None and (value[i] > free[i] or value[i] <= -free[i]):
            label[i] = value[i] > free[i]
            for j, w in around[i].items():
                if label[j] is None:
                    value[j] += w if label[i] else -w
                    free[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        inner = [{place[j]: w for j, w in around[i].items() if j in place} for i in rest]
        for i, side in zip(rest, _max_flow([value[i] for i in rest], inner), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(value: list[int], around: list[dict[int, int]]) -> list[bool]:
    """Dinic's algorithm; True for nodes on the source's side of the smallest minimum cut."""
    n = len(value)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((there, back))

    for i, v in enumerate(value):
        if v > 0:
            arc(s, i, v, 0)
        elif v < 0:
            arc(i, t, -v, 0)
        for j, w in around[i].items():
            if i < j:
                arc(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if not cap[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def main_text(page: str) -> str:
    """The main text of a page."""
    found = blocks(page)
    keep = min_cut(costs(found), edges(found))
    return " ".join([b.text for b, k in zip(found, keep, strict=True) if k])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return map_arrow(own, run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
