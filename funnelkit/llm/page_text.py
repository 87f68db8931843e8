"""Main text of web pages: flat blocks classified by a decision tree.

A page is cut into blocks of text at block-level tags.  A block is described
by its words and link density, those of the blocks before and after it, whether
it is a heading, whether it lies inside an element that HTML means for the
article or for what is beside it, and by what the names of its containers
suggest (a weak sign: names that suggest both say nothing).  A decision tree
trained on the small labelled table below says which blocks are text.  Where
elements and names are silent, words and links decide.

Scripts, styles and comments are no text and make no blocks.  Controls and
embedded objects are left out up to their end tag; one that is never closed
ends at the next block-level tag.  Nesting is kept in counters and inherited
flags, so a page takes time in proportion to its length, however it is nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from funnelkit.llm.trees import Flat, fit
from funnelkit.llm.words import chunks

# HTML's elements whose content is no markup or isn't shown, that
# start a block, and that never have an end tag.
_RAW = {"script", "style", "textarea", "title", "template"}
_SILENT = {"noscript", "svg", "iframe", "object", "select", "button"}
_NESTING = {"svg", "object"}  # of the silent ones, those that may hold their like
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li",
          "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# containers by their tag, and by words in their class, id or role
_SIDE = {"nav", "header", "footer", "aside", "menu", "form", "dialog", "fieldset"}
_MAIN = {"article", "main"}
_SIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|footer|side-?bar|aside|widget\w*|related|recommend\w*|share|sharing|"
    r"social|comments?|commentlist|replies|reply|discussion|respond|cookies?|consent|notice|gdpr|privacy|newsletter|subscribe|signup|login|popup|modal|overlay|toolbar|"
    r"tags|meta|copyright|legal|disclaimer|skip|pagination|pager|search|form|feedback)(?:$|[\s_-])", re.I)
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article(?:-?body)?|entry(?:-?content)?|post(?:-?(?:content|body))?|story(?:-?body)?|main(?:-?content)?|content)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WHITE = re.compile(r"\s+")


# The small labelled table: words, link density (percent), words and link
# density of the block before and after, inside an article element, inside an
# element for what is beside it, what names suggest (1 article, -1 beside it),
# heading; then 1 if it is the page's text.  The first part has pages with
# article elements and pages of plain blocks, the second names that help or
# mislead, link lists inside articles, and plain pages' ends and beginnings.
LABELLED = """
8 0 5 100 60 0 1 0 0 1 1
12 0 7 0 45 0 1 0 0 1 1
4 0 0 0 80 0 1 0 0 1 1
3 0 9 0 20 0 1 0 0 1 1
60 0 12 0 75 0 1 0 0 0 1
45 0 60 0 30 0 1 0 0 0 1
120 2 80 0 95 0 1 0 0 0 1
20 0 45 0 8 0 1 0 0 0 1
5 0 90 0 70 0 1 0 0 0 1
1 0 40 0 33 0 1 0 0 0 1
2 0 8 0 0 0 1 0 0 0 1
8 0 20 0 14 0 1 0 0 0 1
14 30 40 0 22 0 1 0 0 0 1
9 100 60 0 50 0 1 0 0 0 1
6 0 3 0 9 100 1 0 0 0 1
250 5 10 0 180 1 1 0 0 0 1
35 0 7 0 0 0 1 0 0 0 1
70 10 50 0 25 0 1 0 0 0 1
16 0 18 0 13 0 1 0 0 0 1
3 0 55 0 12 0 1 0 0 0 1
1 0 1 0 1 0 1 0 0 0 1
1 0 2 0 3 0 1 0 0 0 1
2 0 1 0 25 0 1 0 0 0 1
3 0 300 0 2 0 1 0 0 0 1
2 0 120 0 1 0 1 0 0 0 1
3 0 5 0 3 0 1 0 0 0 1
4 0 2 0 400 0 1 0 0 0 1
6 0 4 0 5 0 1 0 0 0 1
10 0 1 0 2 0 1 0 0 0 1
12 0 6 0 150 0 1 0 0 0 1
16 0 3 0 1 0 1 0 0 0 1
24 0 2 0 4 0 1 0 0 0 1
30 0 250 0 6 0 1 0 0 0 1
50 0 3 0 2 0 1 0 0 0 1
85 0 1 0 12 0 1 0 0 0 1
200 0 8 0 3 0 1 0 0 0 1
400 0 35 0 60 0 1 0 0 0 1
900 0 2 0 1 0 1 0 0 0 1
1 0 60 0 0 0 1 0 0 0 1
2 0 3 0 14 0 1 0 0 1 1
1 0 6 0 1 0 1 0 0 1 1
5 0 1 100 5 0 1 0 0 1 1
15 0 2 100 15 0 1 0 0 1 1
3 0 10 0 3 0 1 0 0 1 1
7 0 15 0 9 0 1 0 0 1 1
5 0 7 0 30 0 1 0 0 0 1
7 0 2 0 9 0 1 0 0 0 1
13 0 90 0 1 0 1 0 0 0 1
18 0 5 0 20 0 1 0 0 0 1
110 0 4 0 5 0 1 0 0 0 1
2 50 40 0 60 0 1 0 0 0 1
4 100 30 0 20 0 1 0 0 0 1
80 0 40 0 65 0 0 0 0 0 1
55 0 70 3 90 0 0 0 0 0 1
130 4 22 0 60 0 0 0 0 0 1
40 0 9 0 35 0 0 0 0 0 1
28 0 30 0 45 0 0 0 0 0 1
65 8 100 0 15 0 0 0 0 0 1
22 0 60 0 70 0 0 0 0 0 1
7 0 30 0 85 0 0 0 0 1 1
5 0 4 100 60 0 0 0 0 1 1
90 0 6 0 6 0 0 0 0 0 1
18 0 75 0 50 0 0 0 0 0 1
33 5 28 0 40 0 0 0 0 0 1
1 100 0 0 1 100 0 1 0 0 0
2 100 1 100 1 100 0 1 0 0 0
1 100 2 100 3 100 0 1 0 0 0
3 100 1 100 7 0 0 1 0 0 0
7 0 1 100 9 0 0 1 0 0 0
11 0 2 100 10 0 0 1 0 0 0
25 0 3 100 40 0 0 1 0 0 0
14 20 70 0 0 0 0 1 0 0 0
10 0 50 0 0 0 0 1 0 0 0
40 0 60 0 8 0 0 1 0 0 0
75 0 20 0 30 0 0 1 0 0 0
30 0 12 0 25 0 0 1 0 0 0
5 0 50 0 22 0 0 1 0 1 0
3 0 30 0 14 0 0 1 0 1 0
18 0 5 0 12 0 1 1 0 0 0
9 0 40 0 60 0 1 1 0 0 0
22 0 80 0 15 0 1 1 0 0 0
60 0 30 0 24 0 1 1 0 0 0
2 0 70 0 8 100 1 1 0 1 0
6 100 60 0 6 100 1 1 0 0 0
110 3 90 0 45 0 0 1 0 0 0
15 0 8 0 0 0 1 1 0 0 0
4 100 5 100 6 100 0 0 0 0 0
1 100 1 100 1 100 0 0 0 0 0
6 80 2 100 4 100 0 0 0 0 0
3 0 2 100 3 100 0 0 0 0 0
2 0 0 0 1 100 0 0 0 0 0
5 0 1 100 2 0 0 0 0 0 0
8 60 9 70 3 100 0 0 0 0 0
12 90 10 80 15 95 0 0 0 0 0
30 95 25 90 10 100 0 0 0 0 0
4 0 2 0 3 0 0 0 0 0 0
3 0 4 0 0 0 0 0 0 0 0
3 100 2 100 4 100 1 0 0 0 0
1 100 1 100 1 100 1 0 0 0 0
2 100 3 100 2 100 1 0 0 0 0
5 90 4 100 3 100 1 0 0 0 0
4 100 6 95 2 100 1 0 0 0 0
12 0 0 0 40 0 0 0 1 0 1
90 2 6 0 70 0 0 0 1 0 1
40 0 85 0 3 0 0 0 1 0 1
3 0 60 0 45 0 0 0 1 0 1
6 0 5 0 80 0 0 0 1 1 1
25 4 12 0 2 100 0 0 1 0 1
2 0 35 0 0 0 0 0 1 0 1
150 1 20 0 200 0 0 0 1 0 1
7 0 9 0 6 0 0 0 1 0 1
1 0 2 0 12 0 0 0 1 0 1
3 100 2 100 4 100 0 0 1 0 0
2 100 1 100 2 100 0 0 1 0 0
8 0 60 0 45 0 0 0 -1 0 0
4 0 2 100 30 0 0 0 -1 0 0
15 0 3 0 0 0 0 0 -1 0 0
60 0 25 0 80 0 0 0 -1 0 0
35 0 40 0 18 0 0 0 -1 0 0
90 5 5 0 30 0 0 0 -1 0 0
2 100 3 100 1 100 0 0 -1 0 0
6 30 70 0 12 0 0 0 -1 0 0
22 0 0 0 90 0 0 0 -1 0 0
3 0 50 0 20 0 0 0 -1 1 0
120 0 60 0 4 0 0 0 -1 0 0
18 0 45 0 60 0 1 0 -1 0 0
9 0 70 0 35 0 1 0 -1 0 0
4 100 30 0 5 100 1 0 -1 0 0
70 0 80 0 60 0 1 0 -1 0 0
60 0 5 0 7 0 0 0 0 0 1
45 0 50 0 4 0 0 0 0 0 1
80 3 90 0 6 100 0 0 0 0 1
35 0 4 100 40 0 0 0 0 0 1
26 0 60 0 12 85 0 0 0 0 1
95 0 0 0 70 0 0 0 0 0 1
50 0 75 0 0 0 0 0 0 0 1
30 10 8 0 55 0 0 0 0 0 1
42 0 3 0 3 0 0 0 0 0 1
140 6 2 100 8 0 0 0 0 0 1
20 0 2 100 65 0 0 0 0 0 1
24 0 33 0 5 60 0 0 0 0 1
65 0 12 0 30 0 0 0 0 0 1
38 0 6 100 2 100 0 0 0 0 1
9 0 50 0 70 0 0 0 0 0 1
5 0 35 0 28 0 0 0 0 0 1
12 0 80 0 24 0 0 0 0 0 1
2 0 40 0 95 0 0 0 0 0 1
14 8 26 0 60 0 0 0 0 0 1
6 0 22 0 45 0 0 0 0 1 1
4 0 0 0 60 0 0 0 0 1 1
8 0 2 100 30 0 0 0 0 1 1
3 0 90 0 40 0 0 0 0 1 1
8 0 45 0 0 0 0 0 0 0 0
7 0 6 100 0 0 0 0 0 0 0
11 0 3 100 0 0 0 0 0 0 0
9 0 60 0 2 100 0 0 0 0 0
6 0 30 0 4 0 0 0 0 0 0
10 0 2 100 3 100 0 0 0 0 0
3 0 0 0 2 100 0 0 0 0 0
5 0 1 100 4 100 0 0 0 0 0
12 0 4 0 2 0 0 0 0 0 0
4 0 5 0 70 0 0 0 0 0 0
14 0 0 0 3 100 0 0 0 0 0
2 0 3 0 50 0 0 0 0 0 0
5 100 40 0 60 0 0 0 0 0 0
40 90 30 0 50 0 0 0 0 0 0
60 85 4 100 3 100 0 0 0 0 0
25 70 8 100 20 90 0 0 0 0 0
8 60 50 0 6 100 0 0 0 0 0
6 100 60 0 0 0 0 0 0 0 0
1 100 30 0 0 0 0 0 0 0 0
2 100 45 0 1 100 0 0 0 0 0
1 100 80 0 2 100 0 0 0 0 0
3 100 25 0 40 0 0 0 0 0 0
2 80 60 0 55 0 0 0 0 0 0
3 0 4 0 3 0 0 0 0 1 0
2 0 30 0 3 100 0 0 0 1 0
"""


@lru_cache(maxsize=1)
def model() -> Flat:
    """One tree, fitted on LABELLED."""
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.split("\n") if line])
    rows = np.repeat(rows, 4, axis=0)  # so that a leaf of one labelled block is allowed
    return fit(rows[:, :-1], rows[:, -1], trees=1, depth=8, rate=1.0, least=4, ridge=0.01)


def _ends(tokens: list[tuple[str, bool, int, int]], page: str) -> dict[int, int]:
    """For the token of each silent element's start tag, the token of its end
    tag; none for elements that aren't closed."""
    open_: dict[str, list[int]] = {t: [] for t in _SILENT}
    ends: dict[int, int] = {}
    for k, (tag, closing, _, _) in enumerate(tokens):
        if tag not in _SILENT:
            continue
        if closing:
            if open_[tag]:
                ends[open_[tag].pop()] = k
        else:
            if tag not in _NESTING:
                open_[tag].clear()  # the one before was never closed
            open_[tag].append(k)
    return ends


def _tokens(page: str) -> list[tuple[str, bool, int, int]]:
    """(tag or "", closing, start, end) of every piece of markup; elements
    whose content isn't markup are one piece up to their end tag."""
    out, at = [], 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in _RAW and not m[1]:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            out.append(("", False, m.start(), at))
        else:
            out.append((tag, bool(m[1]), m.start(), at))
    return out


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, features) of every block, in page order."""
    found: list[tuple[str, int, int, int, int, int, bool]] = []  # text, words, linked words, main, side, names, heading
    stack: list[tuple[str, int, int, int]] = []  # tag and the flags inside it
    inside: dict[str, int] = {}  # how often a tag is in the stack
    parts: list[str] = []
    linked = links = 0
    heading = False
    flags = (0, 0, 0)

    def flush() -> None:
        nonlocal parts, linked
        text = _WHITE.sub(" ", "".join(parts)).strip()
        if text:
            found.append((text, len(_WORD.findall(text)), linked, *flags, heading))
        parts, linked = [], 0

    def shown(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if links:
                linked += len(_WORD.findall(text))

    def pop() -> None:
        nonlocal flags
        inside[stack.pop()[0]] -= 1
        flags = stack[-1][1:] if stack else (0, 0, 0)

    tokens = _tokens(page)
    ends = _ends(tokens, page)
    at, k, silent = 0, 0, False
    while k < len(tokens):
        tag, closing, start, end = tokens[k]
        if silent and tag not in _BLOCK:  # in an element that isn't closed
            at, k = end, k + 1
            continue
        if not silent:
            shown(page[at:start])
        silent, at, k = False, end, k + 1
        if not tag:
            continue
        if tag in _SILENT:
            if not closing and not page.endswith("/>", start, end):
                if (to := ends.get(k - 1)) is not None:
                    at, k = tokens[to][3], to + 1
                else:
                    silent = True
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            parts.append(" ")
        if tag not in _BLOCK:
            continue
        flush()
        links = 0
        if closing:
            if inside.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            heading = False
        elif tag not in _VOID:
            if tag == "p" and stack and stack[-1][0] == "p":
                pop()
            names = " ".join(x for n in _NAMES.findall(page[start:end]) for x in n if x)
            main, side, name = flags
            if tag in _MAIN:
                main = 1
            elif tag in _SIDE and not (tag == "header" and main):
                side = 1
            if names and tag not in ("html", "body"):
                good, bad = bool(_MAIN_NAME.search(names)), bool(_SIDE_NAME.search(names))
                # what is beside the article may lie in it, but not the other way round
                name = name if good == bad or name < 0 else -1 if bad else 1
            stack.append((tag, main, side, name))
            inside[tag] = inside.get(tag, 0) + 1
            flags = (main, side, name)
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    if not silent:
        shown(page[at:])
    flush()
    out = []
    none = ("", 0, 0, 0, 0, 0, False)
    density = lambda b: 100.0 * b[2] / b[1] if b[1] else 0.0
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else none, found[k + 1] if k + 1 < len(found) else none
        out.append((b[0], [b[1], density(b), before[1], density(before), after[1], density(after), *map(float, b[3:])]))
    return out


def main_text(page: str | None) -> str:
    """The blocks that are text, joined by an empty line; "" if there are none."""
    found = blocks(page or "")
    if not found:
        return ""
    good = model().raw(np.array([f for _, f in found])) > 0
    return "\n\n".join(t for (t, _), ok in zip(found, good, strict=True) if ok)


def op3(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    A null or empty page has the empty text, as has one without text blocks;
    an unfinished or very long page is read to its end.  Repeated rows are extracted each
    for itself, columns other than page_id, url and html are not read, and an
    empty table gives no rows.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            text = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
