"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text (in page order) with the path of open elements above
each.  Every block is a node of a flow network:

* the source stands for *content*, the sink for *boilerplate*; a classifier's costs (tags,
  class and id names, link share, text length, closeness to an article) are the capacities
  of the terminal edges;
* smoothness edges join neighbouring blocks and blocks of one parent; they are the stronger
  the more ancestors two blocks share.

A maximum flow separates the blocks at the cheapest cut; blocks on the source's side are the text.
Blocks whose evidence outweighs all their edges are settled without flow, so it runs on the doubtful
ones only.  What can never be text (scripts, styles, markup, forms
and the like) is not read into blocks at all.  A page's network has as many nodes as blocks
and a few edges each; pages are independent, so there is no shuffle.

The costs are fixed values and not fitted: no table labels blocks.  A form around an article or a
main part holds the page and is read; other forms are not.

Null, empty and block-less pages give an empty text.  Very long pages are read whole.  Ties of cost
count as boilerplate.  Repeated rows are extracted alike, other columns pass by unread and an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .wordtools import chunks

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
SKIPPED = RAW | {"head", "select", "option", "button", "svg", "canvas", "object", "form", "fieldset", "datalist", "dialog"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
CLOSES = {"p": BLOCK - {"br", "html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|aside|foot\w*|masthead|header|topbar|toolbar|cookie\w*|consent|notice\w*|"
    r"popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social\w*|related|recommend\w*|comment\w*|disqus|respons?es|replies|reply|widget\w*|pagination|pager|tags|copyright|legal|navigation|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I)
_FORM_PART = re.compile(r"<(/form|article|main)(?=[\s>/])", re.I)
_SPACES = re.compile(r"\s+")

#: Cost of calling boilerplate content, and content boilerplate, by evidence.
BOILER_TAG, BOILER_NAME, PRIOR, LINKED, TINY = 12.0, 12.0, 0.4, 3.0, 0.5
IN_ARTICLE, IN_MAIN, NAMED, PARAGRAPH, LONG = 8.0, 5.0, 2.0, 2.0, 1.5
NEAR, SAME_PARENT = 0.3, 0.6


class Block:
    __slots__ = ("text", "path", "linked", "size")

    def __init__(self, text: str, path: tuple, linked: int, size: int):
        self.text, self.path, self.linked, self.size = text, path, linked, size


def blocks(page: str) -> list[Block]:
    """Blocks of text with their open elements: (tag, names, number) each."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []
    pieces: list[str] = []
    linked = count = skipping = links = held_forms = 0
    ahead = (-1, False)  # where the next form ends or a main part begins, and which of them
    seen = 0

    def close_block():
        nonlocal linked
        if pieces:
            text = _SPACES.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append(Block(text, tuple(x for x in stack if x[0] in BLOCK or x[1]), linked, len(text)))
            pieces.clear()
        linked = 0

    def pop_to(at: int):
        nonlocal skipping, links
        while len(stack) > at:
            tag = stack.pop()[0]
            skipping -= tag in SKIPPED
            links -= tag == "a"

    def holds_a_page() -> bool:
        """Whether the form that has just begun has an article or a main part in it; the page is searched once for all forms."""
        nonlocal ahead
        if ahead[0] < seen:
            part = _FORM_PART.search(page, seen)
            ahead = (part.start(), part.group(1).lower() != "/form") if part else (len(page), False)
        return ahead[1]

    def add(text: str):
        nonlocal linked
        if stack and stack[-1][0] == "head" and text.strip():  # text can't be in a head, so the body has begun
            pop_to(len(stack) - 1)
        if not skipping and text:
            pieces.append(text)
            if links:
                linked += len(text.strip())

    while True:
        m = _TOKEN.search(page, seen)
        if m is None:
            add(page[seen:])
            break
        add(page[seen : m.start()])
        seen = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                add(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag == "form" and m.group(1) and held_forms:
            tag, held_forms = "div", held_forms - 1
        if m.group(1):
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCK:
                close_block()
            if at is not None:
                pop_to(at)
            continue
        if tag not in IN_HEAD and stack and stack[-1][0] == "head":
            pop_to(len(stack) - 1)
        if tag in BLOCK:
            close_block()
        for i in range(len(stack) - 1, -1, -1):
            open_tag = stack[i][0]
            if tag in CLOSES.get(open_tag, ()):
                pop_to(i)
                break
            if open_tag in BLOCK and open_tag not in CLOSES:
                break
        if tag in VOID or m.group(3).endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, seen)
            seen = end.end()
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m.group(3))) if m.group(3) else ""
        count += 1
        stack.append((tag, names, count))
        if tag == "form" and holds_a_page():
            stack[-1] = ("div", names, count)
            held_forms += 1
            continue
        skipping += tag in SKIPPED
        links += tag == "a"
    close_block()
    return out


def costs(block: Block, has_article: bool) -> tuple[float, float]:
    """(evidence for content, evidence for boilerplate)."""
    content = boiler = 0.0
    tags = {t for t, _, _ in block.path}
    inner = False
    for tag, names, _ in block.path:
        if tag in ("article", "main"):
            content += IN_ARTICLE if tag == "article" and not inner else IN_MAIN
            inner = True
        if tag in ("nav", "aside", "footer", "menu", "search") or tag == "header" and not inner:
            boiler += BOILER_TAG
        if names:
            if _BOILER.search(names):
                boiler += BOILER_NAME
            elif _CONTENT.search(names):
                content += NAMED
    if has_article and not inner:
        boiler += IN_ARTICLE
    elif not inner:
        content += PRIOR
    if tags & {"p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}:
        content += PARAGRAPH
    if block.size >= 80:
        content += LONG
    elif block.size < 15:
        boiler += TINY
    if not inner:
        boiler += LINKED * block.linked / max(1, block.size)
    return content, boiler


def _settled(excess: list[float], near: list[dict[int, float]]) -> list[bool | None]:
    """Labels that every minimum cut can have; ``excess`` is content's evidence less boilerplate's.

    A block with more evidence than all its edges weigh has that label whatever the others have, and
    what its edges weigh becomes evidence of its neighbours.  Each edge is looked at twice at most.
    """
    label: list[bool | None] = [None] * len(excess)
    weight = [sum(e.values()) for e in near]
    waiting = list(range(len(excess)))
    while waiting:
        i = waiting.pop()
        if label[i] is None and abs(excess[i]) >= weight[i]:
            label[i] = excess[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    excess[j] += w if label[i] else -w
                    weight[j] -= w
                    waiting.append(j)
    return label


def _flow(nodes: list[int], excess: list[float], near: list[dict[int, float]]) -> set[int]:
    """Content's side of a minimum cut of connected blocks, by blocking flows on levels."""
    left = {i: dict(near[i]) for i in nodes}
    gives = {i: excess[i] for i in nodes if excess[i] > 0}
    takes = {i: -excess[i] for i in nodes if excess[i] < 0}
    while True:
        level = {i: 0 for i, x in gives.items() if x > 1e-9}
        queue = deque(level)
        reached = False
        while queue:
            i = queue.popleft()
            reached |= takes.get(i, 0.0) > 1e-9
            for j, w in left[i].items():
                if w > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return set(level)
        open_edges = {i: iter(list(left[i])) for i in level}
        for start in [i for i, n in level.items() if n == 0]:
            path = [start]
            while path and gives[start] > 1e-9:
                i = path[-1]
                if takes.get(i, 0.0) > 1e-9:
                    pushed = min([gives[start], takes[i], *(left[a][b] for a, b in zip(path, path[1:], strict=False))])
                    gives[start] -= pushed
                    takes[i] -= pushed
                    for a, b in zip(path, path[1:], strict=False):
                        left[a][b] -= pushed
                        left[b][a] = left[b].get(a, 0.0) + pushed
                    full = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if left[a][b] <= 1e-9), None)
                    if full is not None:
                        del path[full + 1 :]
                    continue
                for j in open_edges[i]:
                    if left[i].get(j, 0.0) > 1e-9 and level.get(j) == level[i] + 1:
                        open_edges[i] = itertools.chain([j], open_edges[i])  # it may take more
                        path.append(j)
                        break
                else:
                    path.pop()
                    if path:
                        next(open_edges[path[-1]], None)


def _cut(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content's side of a minimum cut.

    Terminal capacities of a block cancel; blocks with decisive evidence are settled first, and a
    maximum flow separates each connected group of the others.
    """
    near: list[dict[int, float]] = [{} for _ in content]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    excess = [c - b for c, b in zip(content, boiler, strict=True)]
    label = _settled(excess, near)
    open_blocks = {i for i, x in enumerate(label) if x is None}
    for i in open_blocks:
        near[i] = {j: w for j, w in near[i].items() if j in open_blocks}
    while open_blocks:
        group, queue = [], [open_blocks.pop()]
        while queue:
            i = queue.pop()
            group.append(i)
            fresh = [j for j in near[i] if j in open_blocks]
            open_blocks.difference_update(fresh)
            queue += fresh
        content_side = _flow(group, excess, near)
        for i in group:
            label[i] = i in content_side
    return [bool(x) for x in label]


def extract(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    found = blocks(page)
    has_article = any(t in ("article", "main") for b in found for t, _, _ in b.path)
    marks = [costs(b, has_article) for b in found]
    edges, last_of = [], {}
    for i, b in enumerate(found):
        if i:
            depth = 0
            for x, y in zip(b.path, found[i - 1].path):
                if x != y:
                    break
                depth += 1
            share = depth / max(len(b.path), len(found[i - 1].path), 1)
            edges.append((i - 1, i, NEAR * share))
        parent = b.path[-2][2] if len(b.path) > 1 else 0
        if parent in last_of and last_of[parent] != i - 1:
            edges.append((last_of[parent], i, SAME_PARENT))
        last_of[parent] = i
    side = _cut([c for c, _ in marks], [x for _, x in marks], edges)
    return "\n".join(b.text for b, keep in zip(found, side, strict=True) if keep)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "html"):
            texts = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``."""
    return pages.select("page_id", "url", "html").mapInArrow(_rows, "page_id long, url string, text string, n_chars long")
