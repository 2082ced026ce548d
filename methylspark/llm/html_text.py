"""Main text of web pages by minimum cut.

A page is cut into blocks at block-level tags. A classifier gives every block a cost of being called
boilerplate and one of being called content, from its enclosing tags, class and id words, length and
links. These are the capacities from the source and to the sink. Smoothness edges join neighbouring
blocks and blocks with one parent, stronger the closer they are in the tree. The minimum cut labels
all blocks of a page at once: a short line between paragraphs goes with them.

Null and empty html, and pages without content, give an empty text. Pages of any length are read
whole. Repeated rows are read alike, each on its own row. An empty table gives an empty result.
Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names, and words of class and id attributes.
BLOCKS = set("""address article aside blockquote body button caption center dd details dialog div dl
dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
iframe label legend li main menu nav ol optgroup option p pre search section select summary table
tbody td template tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose inside is not markup.
RAW = set("iframe math noembed noframes noscript script style svg template textarea title "
          "xmp".split())
CLOSES_P = BLOCKS - set("body button head html label legend option optgroup caption td th tr tbody "
                        "thead tfoot".split())
NEVER = set("button datalist dialog footer form head menu nav aside search select".split())
CONTENT_TAGS = {"article", "main"}
CONTENT_WORDS = set("article content entry main post prose story".split())
FURNITURE = set("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs
comment comments consent cookie cookies copyright disqus gdpr legal login menu modal nav navbar
navigation newsletter notice notices overlay pager pagination popup promo promoted promotion
recommended related reply replies respond share sharing signup skip social sponsor sponsored
subscribe subscription toolbar warning alert discussion""".split())
#: Words that on a content element only describe the page's layout.
LAYOUT = set("aside footer header masthead sidebar topbar widget widgets".split())
ROLES = set("banner navigation complementary contentinfo search form alert dialog menu menubar "
            "alertdialog".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")

#: Costs in units of 1 / 100: from structure, which no neighbours can outvote, to mere length.
STRONG, CLEAR, WEAK = 2000, 600, 100
NEAR, SIBLING = 60, 120


class _Element:
    __slots__ = ("tag", "parent", "furniture", "content", "number")

    def __init__(self, tag, parent, attributes, number):
        self.tag, self.parent, self.number = tag, parent, number
        self.furniture = bool(parent and parent.furniture)
        self.content = bool(parent and parent.content) or tag in CONTENT_TAGS
        if tag in NEVER or tag == "header" and not self.content:
            self.furniture = True
        if attributes:
            self._look(attributes)

    def _look(self, attributes):
        words: set[str] = set()
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id"):
                words.update(_WORD.findall(value))
            elif name == "role":
                self.furniture |= value in ROLES and self.tag not in CONTENT_TAGS
                self.content |= value in ("main", "article")
            elif name == "style" and _HIDDEN.search(value) or (
                    name == "aria-hidden" and value == "true"):
                self.furniture = True
        if re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
            self.furniture = True
        if words and self.tag not in ("html", "body"):
            if words & FURNITURE:
                self.furniture = True
            elif words & LAYOUT and not self.content and not words & CONTENT_WORDS:
                self.furniture = True
            elif words & CONTENT_WORDS:
                self.content = True


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text, element, linked):
        self.text, self.element, self.linked = text, element, linked


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, with the innermost block element around each."""
    number = 0
    top = _Element("html", None, "", 0)
    stack = [top]  # open block elements
    found: list[Block] = []
    parts: list[str] = []
    links, linked, at = 0, 0, 0

    def finish():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append(Block(text, stack[-1], linked))
            parts.clear()
        linked = 0

    while True:
        match = _TAG.search(html, at)
        piece = html[at:match.start() if match else len(html)]
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)
        if not match:
            break
        at = match.end()
        end, name, attributes = match[1], match[2], match[3]
        if name is None:
            end, name, attributes = match[4], match[5], match[6]
            if name is None:
                continue
        name = name.lower()
        if not end and name in RAW:
            close = re.compile(f"</{name}[^>]*>", re.I).search(html, at)
            if not attributes.endswith("/") or name not in ("svg", "math"):
                at = close.end() if close else len(html)
            if name in BLOCKS or name == "title":
                finish()
        elif name == "a":
            links = 0 if end else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            finish()
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        del stack[k:]
                        links = 0
                        break
            else:
                if name in CLOSES_P and stack[-1].tag == "p" or (
                        name in ("li", "option", "tr", "td", "th", "dd", "dt")
                        and stack[-1].tag == name):
                    stack.pop()
                if name not in VOID:
                    number += 1
                    stack.append(_Element(name, stack[-1], attributes, number))
                    links = 0
        elif name not in VOID and not end and attributes and "=" in attributes:
            # inline elements count only where they hide their inside or mark furniture
            probe = _Element(name, None, attributes, 0)
            if probe.furniture:
                close = re.compile(f"</{name}[^>]*>", re.I).search(html, at)
                if close and not re.search("<(?:p|div|h[1-6]|article)[\\s>]",
                                           html[at:close.start()], re.I):
                    at = close.end()
                    parts.append(" ")
    finish()
    return found


def costs(found: list[Block]) -> list[tuple[int, int]]:
    """Per block the costs of calling it boilerplate and of calling it content."""
    semantic = any(b.element.content and not b.element.furniture for b in found)
    out = []
    for b in found:
        as_boilerplate = as_content = 0
        e = b.element
        if e.furniture:
            as_content += STRONG
        elif e.content:
            as_boilerplate += STRONG
        elif semantic:
            as_content += CLEAR
        size = len(b.text)
        if e.tag in ("p", "pre", "blockquote", "h1"):
            as_boilerplate += WEAK
        if size >= 80 or b.text[-1:] in ".!?:;":
            as_boilerplate += WEAK
        as_boilerplate += min(size, 400) * WEAK // 200
        if b.linked * 2 > size:
            as_content += 3 * WEAK
        if size < 30:
            as_content += WEAK
        out.append((as_boilerplate, as_content))
    return out


def edges(found: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness between neighbours and between next blocks of one parent."""
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            out[k - 1, k] = NEAR
        parent = b.element.parent.number if b.element.parent else -1
        before = last.get(parent)
        if before is not None:
            out[before, k] = out.get((before, k), 0) + SIBLING
        last[parent] = k
    return out


def cut(capacity: list[tuple[int, int]], smooth: dict[tuple[int, int], int]) -> list[bool]:
    """The source side of a minimum cut. ``capacity``: from the source and to the sink.

    Flow that can pass a node straight is pushed at once. Nodes whose rest outweighs all their edges
    are then settled, and their edges become capacities of their neighbours; flow is augmented along
    shortest paths for the others. Nodes that no cut decides are on the sink side.
    """
    n = len(capacity)
    extra = [s - t for s, t in capacity]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), weight in smooth.items():
        near[i][j] = near[i].get(j, 0) + weight
        near[j][i] = near[j].get(i, 0) + weight
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(extra[i]) > sum(near[i].values()):
            side[i] = extra[i] > 0
            for j, weight in near[i].items():
                extra[j] += weight if side[i] else -weight
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    while True:  # shortest augmenting paths from what has a rest to what lacks one
        parent = {i: -1 for i in rest if extra[i] > 0}
        queue, goal = deque(parent), -1
        while queue and goal < 0:
            i = queue.popleft()
            for j, room in near[i].items():
                if room > 0 and j not in parent:
                    parent[j] = i
                    if extra[j] < 0:
                        goal = j
                        break
                    queue.append(j)
        if goal < 0:
            break
        path = [goal]
        while parent[path[-1]] >= 0:
            path.append(parent[path[-1]])
        flow = min(extra[path[-1]], -extra[goal],
                   *(near[b][a] for a, b in zip(path, path[1:], strict=False)))
        extra[path[-1]] -= flow
        extra[goal] += flow
        for a, b in zip(path, path[1:], strict=False):
            near[b][a] -= flow
            near[a][b] += flow
    for i in rest:
        side[i] = i in parent
    return [bool(s) for s in side]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = blocks(html)
    chosen = cut(costs(found), edges(found))
    return "\n\n".join(b.text for b, kept in zip(found, chosen, strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts],
                                             ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", F.col("html").cast("string"))
    return rows.mapInArrow(run, T.StructType([rows.schema["page_id"], rows.schema["url"],
                                              T.StructField("text", T.StringType())]))
