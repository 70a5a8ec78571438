"""HTML extraction by tag-path ratios.

Every text node has a root-to-leaf tag path.  For each path of a page the text
length and the punctuation marks are summed and divided by the path's nodes; the
two ratios are smoothed over neighbouring nodes in page order and multiplied.
Paths whose fused ratio reaches ``CUT`` of the page's deviation hold content.

The paths' text decides on the container: an article or main element if it holds
``MOST`` of that text, else the deepest element with ``HOLDS`` of it.  Its text is
returned whole, short paragraphs and headings included, but for

* what boilerplate elements hold (``NEVER``),
* what elements hold whose class, id or role says so (``MARKS``), unless that is
  most of the page's text: then the name is taken for a layout's, and
* parts of it without any content path that are mostly links.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

#: Elements without content, with raw text, that start a block, that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
FOREIGN = frozenset("svg math iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head nav footer aside button select option dialog menu header".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body center td html #".split())
CLOSES_P = BLOCK - frozenset(("option", "legend", "caption"))
#: Class, id and role names (or their first or last part) that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo related recommended search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Marks that stand whatever the share of text, and on an article or main element too; first parts that take a mark back.
FIRM = frozenset("comment comments disqus ad ads advert adverts advertisement sponsored".split())
LAYOUT = frozenset("no not non has have with without is hide hides layout".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
CUT = 0.5
#: Share of the content's text that an article or main element must hold to be its container, and any other element.
MOST, HOLDS = 0.5, 0.9
#: Share of its text in links that makes a part without content paths boilerplate.
LINKS = 0.6

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[_\-]+")
BLANK = re.compile(r"\s+")


def mark_of(attributes: str) -> int:
    """0: no mark, 1: a mark, 2: a firm one."""
    found = 0
    for a in ATTRIBUTE.finditer(attributes):
        for name in (a[1] or a[2] or a[3] or "").lower().split():
            parts = [x for x in PARTS.split(name) if x]
            if not parts or parts[0] in LAYOUT:
                continue
            if parts[0] in MARKS or parts[-1] in MARKS:
                found = max(found, 2 if parts[0] in FIRM or parts[-1] in FIRM else 1)
    return found


class _Element:
    """An element; ``path`` numbers its tag path, ``of`` counts characters below it: text, text of content paths, text in links."""

    __slots__ = ("name", "parent", "path", "mark", "never", "heading", "body", "header", "link", "text", "content", "links")

    def __init__(self, name: str, parent: _Element | None, path: int, mark: int):
        self.name, self.parent, self.path, self.mark = name, parent, path, mark
        self.heading = name in HEADING or (parent is not None and parent.heading)
        self.body = name in ("article", "main") or (parent is not None and parent.body)
        own_header = name == "header" and parent is not None and parent.body
        # an article's own header is no boilerplate, but only its headings are text
        self.header = own_header or (parent is not None and parent.header)
        self.link = name == "a" or (parent is not None and parent.link)
        self.never = (name in NEVER and not own_header) or (parent is not None and parent.never)
        self.text = self.content = self.links = 0


Node = tuple[_Element, str, int]


def parse(page: str) -> tuple[list[_Element], list[Node]]:
    """Elements, parents first, and text nodes in page order: (element, decoded text, block number).

    Nodes with the same block number belong to one block.  Malformed markup is
    closed as it goes; a raw element without an end tag ends at the next tag.
    """
    paths: dict[tuple[int, str], int] = {}
    at = _Element("#", None, 0, 0)
    elements, out, open_names = [at], [], Counter()
    block = pos = 0
    n = len(page)

    def leave(e: _Element) -> _Element:
        """Close elements up to and including ``e``."""
        here = at
        while True:
            open_names[here.name] -= 1
            if here is e:
                return e.parent
            here = here.parent

    while pos < n:
        m = TOKEN.search(page, pos)
        if m is None:
            out.append((at, html.unescape(page[pos:]), block))
            break
        if m.start() > pos:
            out.append((at, html.unescape(page[pos : m.start()]), block))
        pos = m.end()
        name = m[2]
        if name is None or not m[4]:  # a comment or declaration, or a tag that the page's end cuts off
            continue
        name = name.lower()
        if m[1]:
            block += name in BLOCK
            e = at if open_names[name] > 0 else None
            while e is not None and e.name != name:
                e = None if e.name in ("article", "main", "body", "table", "#") and name not in ("body", "html") else e.parent
            if e is not None:
                at = leave(e)
            continue
        if name in BLOCK:
            block += 1
            # a block ends an open paragraph, a list item or cell the one before it
            e = at
            while e is not None:
                if (e.name == "p" and name in CLOSES_P) or (e.name == name and name in ("li", "dd", "dt", "td", "th", "tr", "option")):
                    at = leave(e)
                    break
                e = None if e.name in BLOCK else e.parent
        closed = m[3].endswith("/")
        if name in RAW:
            if not (closed and name in FOREIGN):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                if end is None:
                    end = TOKEN.search(page, pos)
                    pos = end.start() if end else n
                else:
                    pos = end.end()
            continue
        if name == "br":
            out.append((at, " ", block))
        if name in VOID or closed and name not in BLOCK:
            continue
        mark = mark_of(m[3]) if "=" in m[3] and name not in ("html", "body") else 0
        at = _Element(name, at, paths.setdefault((at.path, name), len(paths) + 1), max(mark, int(name == "form")))
        open_names[name] += 1
        elements.append(at)
    return elements, out


def boilerplate(elements: list[_Element], nodes: list[Node]) -> None:
    """Set ``never`` below marks: firm ones, and those of elements with less than half of the page's text."""
    for e, text, _ in nodes:
        if not e.never:
            e.text += len(text.strip())
    for e in reversed(elements[1:]):
        e.parent.text += e.text
    whole = elements[0].text
    for e in elements[1:]:
        counts = e.mark == 2 or (e.mark == 1 and e.name not in ("article", "main") and 2 * e.text < whole)
        e.never = e.never or e.parent.never or counts


def content_paths(nodes: list[Node]) -> set[int]:
    """Paths whose fused ratio of text and punctuation passes the threshold."""
    size: Counter[int] = Counter()
    marks: Counter[int] = Counter()
    count: Counter[int] = Counter()
    order = []
    for e, text, _ in nodes:
        if e.never or not text.strip():
            continue
        size[e.path] += len(text.strip())
        marks[e.path] += len(PUNCTUATION.findall(text))
        count[e.path] += 1
        order.append(e.path)
    if not order:
        return set()
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), [0.25, 0.5, 0.25], "valid")
    length = smooth(np.array([size[p] / count[p] for p in order], float))
    dots = smooth(np.array([(1 + marks[p]) / count[p] for p in order], float))
    fused = length * dots
    mean: dict[int, list[float]] = {}
    for p, v in zip(order, fused.tolist()):
        mean.setdefault(p, []).append(v)
    least = min(CUT * float(fused.std()), max(sum(v) / len(v) for v in mean.values()))
    return {p for p, v in mean.items() if sum(v) / len(v) >= least}


def container(elements: list[_Element]) -> _Element:
    """The outermost article or main element with ``MOST`` of the content, else the deepest element with ``HOLDS`` of it."""
    total = elements[0].content
    for e in elements:
        if e.name in ("article", "main") and not e.parent.body and e.content >= MOST * total:
            return e
    # elements follow their parents, so the last that holds enough is below all others that do
    return [e for e in elements if e.content >= HOLDS * total and e.name in CONTAINERS][-1]


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, one a line; empty if there is none."""
    elements, nodes = parse(page or "")
    boilerplate(elements, nodes)
    paths = content_paths(nodes)
    if not paths:
        return ""
    for e in elements:
        e.text = 0
    for e, text, _ in nodes:
        if not e.never:
            n = len(text.strip())
            e.text += n
            e.content += n * (e.path in paths)
            e.links += n * e.link
    for e in reversed(elements[1:]):
        e.parent.text += e.text
        e.parent.content += e.content
        e.parent.links += e.links
    inside = container(elements)
    kept = {id(inside): not inside.never}
    for e in elements[1:]:
        if id(e.parent) in kept and e is not inside:
            listed = e.name in BLOCK and not e.content and e.text and e.links >= LINKS * e.text
            kept[id(e)] = kept[id(e.parent)] and not e.never and not listed
    blocks: dict[int, list[str]] = {}
    for e, text, block in nodes:
        if kept.get(id(e)) and (e.heading or not e.header):
            blocks.setdefault(block, []).append(text)
    lines = (BLANK.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Add the main text of each page as ``out_col`` and its code points as n_chars; input columns of these names are replaced.

    White space inside a block becomes one space, blocks are trimmed and joined
    by one line feed, character references are decoded once, and nothing else is
    dropped.  Null and empty pages, and pages without main text, give the empty
    text.  Repeated rows give equal results; an empty table gives an empty one.
    """
    K.small_batches(pages.sparkSession)
    pages = pages.drop(*[c for c in (out_col, "n_chars") if c in pages.columns])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), f"`{out_col}` string", "n_chars long"])

    def run(batches):
        for batch in batches:
            for s in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(s, 500)
                texts = [main_text(x) for x in part.column(html_col).to_pylist()]
                yield pa.record_batch({name: part.column(name) for name in part.schema.names} | {out_col: pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.mapInArrow(run, schema)
