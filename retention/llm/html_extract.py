"""Main-text extraction: flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags.  Each block is described by its word count and
link density, those of its neighbours, whether it is a heading, and where it stands (inside or
outside an article or main element, inside a navigation, notice, advert, form or comment part).  A
small decision tree, trained here on the labelled table below, keeps or drops each block.

A part is named by its tag (nav, aside, footer, ...), or by a listed word in its class, id, role or a
short aria-label.  Words after has-, with- or no- describe a page's layout and name nothing.  A name
from words alone is dropped where the part turns out to be a wrapper: it holds the page's article or
main element and none stands outside of named parts, or the page has neither and no text with few
links outside of named parts.

Pages are independent: one map-only stage over whole pages.

Defined results: null and empty html give an empty text; a page cut off anywhere is read to its
end (an unfinished tag, comment, script or style is markup; other elements without text of their own
end at the next block where their end tag is missing); repeated rows are extracted alike; other columns
pass through, and one that has the name of the text column is replaced by it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, with_fields

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "heading", "region", "boiler")

# Labelled blocks, by hand: the features above, then 1 for main text.
# links: share of a block's characters inside links; region: 0 outside the page's article or main
# element, 1 the page has none, 2 inside it; boiler: 1 inside a part named for navigation, notices,
# adverts, forms, comments and the like.
LABELLED = np.array([
    # inside an article: paragraphs of any length, headings, lists with some links
    [120, 0.0, 80, 0.0, 95, 0.0, 0, 2, 0, 1], [45, 0.0, 9, 0.0, 60, 0.0, 0, 2, 0, 1], [8, 0.0, 0, 0.0, 40, 0.0, 1, 2, 0, 1],
    [2, 0.0, 50, 0.0, 70, 0.0, 0, 2, 0, 1], [1, 0.0, 3, 0.0, 1, 0.0, 0, 2, 0, 1], [3, 0.0, 60, 0.0, 0, 0.0, 0, 2, 0, 1],
    [30, 0.3, 50, 0.1, 20, 0.0, 0, 2, 0, 1], [6, 0.0, 5, 1.0, 80, 0.0, 1, 2, 0, 1], [12, 0.0, 12, 0.0, 12, 0.0, 0, 2, 0, 1],
    [70, 0.1, 40, 0.0, 2, 1.0, 0, 2, 0, 1], [15, 0.5, 60, 0.0, 55, 0.0, 0, 2, 0, 1], [4, 0.0, 0, 0.0, 0, 0.0, 0, 2, 0, 1],
    [25, 0.0, 2, 1.0, 3, 1.0, 0, 2, 0, 1], [200, 0.05, 0, 0.0, 0, 0.0, 0, 2, 0, 1], [9, 0.7, 70, 0.0, 65, 0.0, 0, 2, 0, 1],
    [3, 1.0, 40, 0.0, 45, 0.0, 0, 2, 0, 1], [1, 0.0, 90, 0.0, 80, 0.0, 0, 2, 0, 1], [6, 0.0, 20, 0.0, 15, 1.0, 0, 2, 0, 1],
    [2, 0.0, 2, 0.0, 2, 0.0, 0, 2, 0, 1], [1, 0.0, 1, 0.0, 1, 0.0, 0, 2, 0, 1], [3, 0.0, 2, 0.0, 0, 0.0, 0, 2, 0, 1],
    [5, 0.0, 1, 0.0, 2, 0.0, 0, 2, 0, 1], [2, 0.0, 1, 0.0, 3, 0.0, 1, 2, 0, 1], [4, 0.0, 2, 0.0, 2, 0.0, 0, 2, 0, 1],
    [2, 0.0, 1, 1.0, 2, 1.0, 0, 2, 0, 1], [1, 0.0, 2, 1.0, 1, 1.0, 0, 2, 0, 1],
    # inside an article, but in a named part
    [20, 0.0, 60, 0.0, 15, 0.0, 0, 2, 1, 0], [4, 1.0, 60, 0.0, 5, 1.0, 0, 2, 1, 0], [40, 0.0, 50, 0.0, 45, 0.0, 0, 2, 1, 0],
    [2, 0.0, 30, 0.0, 25, 0.0, 1, 2, 1, 0], [90, 0.0, 70, 0.0, 0, 0.0, 0, 2, 1, 0], [1, 0.0, 1, 1.0, 70, 0.0, 0, 2, 1, 0],
    # inside an article: rows of links
    [3, 1.0, 3, 1.0, 3, 1.0, 0, 2, 0, 0], [2, 1.0, 70, 0.0, 2, 1.0, 0, 2, 0, 0], [2, 1.0, 2, 1.0, 0, 0.0, 0, 2, 0, 0],
    [5, 1.0, 4, 1.0, 40, 0.0, 0, 2, 0, 0], [1, 1.0, 1, 1.0, 1, 1.0, 0, 2, 0, 0],
    # outside the article of the page
    [1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1, 0], [1, 1.0, 1, 1.0, 10, 0.0, 0, 0, 1, 0], [12, 0.0, 1, 1.0, 9, 0.0, 0, 0, 1, 0],
    [60, 0.0, 1, 1.0, 8, 0.0, 0, 0, 1, 0], [8, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1, 0], [15, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0],
    [50, 0.0, 80, 0.0, 20, 0.0, 0, 0, 0, 0], [5, 0.0, 0, 0.0, 30, 0.0, 1, 0, 0, 0], [110, 0.0, 3, 0.0, 4, 1.0, 0, 0, 0, 0],
    [3, 0.5, 1, 1.0, 60, 0.0, 0, 0, 0, 0], [30, 0.1, 0, 0.0, 0, 0.0, 0, 0, 1, 0],
    [2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0], [1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 0], [4, 0.0, 2, 0.0, 2, 0.0, 1, 0, 0, 0],
    # pages without article or main: word counts, links and neighbours decide
    [90, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0, 1], [40, 0.0, 3, 1.0, 80, 0.0, 0, 1, 0, 1], [25, 0.1, 50, 0.0, 60, 0.0, 0, 1, 0, 1],
    [7, 0.0, 2, 1.0, 60, 0.0, 1, 1, 0, 1], [6, 0.0, 45, 0.0, 55, 0.0, 0, 1, 0, 1], [4, 0.0, 80, 0.0, 40, 0.0, 1, 1, 0, 1],
    [2, 0.0, 60, 0.0, 50, 0.0, 0, 1, 0, 1], [35, 0.0, 70, 0.0, 3, 1.0, 0, 1, 0, 1], [18, 0.2, 40, 0.0, 30, 0.0, 0, 1, 0, 1],
    [130, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1], [22, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1], [8, 0.0, 0, 0.0, 35, 0.0, 1, 1, 0, 1],
    [1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0], [2, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0, 0], [3, 1.0, 2, 1.0, 60, 0.0, 0, 1, 0, 0],
    [8, 0.9, 4, 1.0, 6, 1.0, 0, 1, 0, 0], [15, 0.8, 20, 0.7, 15, 0.9, 0, 1, 0, 0], [5, 0.0, 1, 1.0, 2, 1.0, 0, 1, 0, 0],
    [6, 0.0, 2, 1.0, 0, 0.0, 0, 1, 0, 0], [3, 0.0, 2, 0.0, 4, 1.0, 0, 1, 0, 0], [30, 0.9, 20, 0.9, 25, 0.8, 0, 1, 0, 0],
    [60, 0.0, 40, 0.0, 50, 0.0, 0, 1, 1, 0], [10, 0.0, 1, 1.0, 30, 0.0, 0, 1, 1, 0], [1, 1.0, 3, 1.0, 50, 0.0, 0, 1, 1, 0],
    # pages of one or two short blocks, and short headings that open a page: what follows decides
    [2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1], [1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1], [5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1], [3, 0.0, 0, 0.0, 0, 0.0, 1, 1, 0, 1],
    [3, 0.0, 0, 0.0, 60, 0.0, 1, 1, 0, 1], [2, 0.0, 1, 1.0, 45, 0.0, 1, 1, 0, 1], [4, 0.0, 3, 1.0, 80, 0.0, 1, 1, 0, 1], [5, 0.0, 2, 1.0, 30, 0.0, 1, 1, 0, 1],
    [1, 0.0, 2, 1.0, 50, 0.0, 1, 1, 0, 1], [3, 0.0, 6, 0.0, 70, 0.0, 1, 1, 0, 1], [2, 0.0, 0, 0.0, 12, 0.0, 1, 1, 0, 1], [12, 0.0, 2, 0.0, 0, 0.0, 0, 1, 0, 1],
    # short headings over rows of links or at the end of a page
    [3, 0.0, 50, 0.0, 2, 1.0, 1, 1, 0, 0], [2, 0.0, 70, 0.0, 1, 1.0, 1, 1, 0, 0], [4, 0.0, 2, 1.0, 3, 1.0, 1, 1, 0, 0], [3, 0.0, 40, 0.0, 5, 0.9, 1, 1, 0, 0],
    [3, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0], [2, 0.0, 3, 1.0, 4, 1.0, 0, 1, 0, 0], [4, 0.0, 5, 0.9, 0, 0.0, 0, 1, 0, 0],
    [25, 0.2, 60, 0.0, 0, 0.0, 0, 1, 1, 0], [5, 0.0, 70, 0.0, 12, 0.0, 1, 1, 1, 0], [80, 0.0, 9, 0.0, 60, 0.0, 0, 1, 1, 0],
])

RAW = {"script", "style", "noscript", "template", "textarea", "title", "select", "option", "button", "iframe", "svg", "math", "object", "canvas", "audio", "video"}
# elements that hold no blocks
SHORT = {"select", "option", "button"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINERS = {"div", "section", "article", "main", "nav", "aside", "footer", "header", "form", "ul", "ol", "dl", "table", "figure", "details",
              "dialog", "fieldset", "menu", "body", "p", "li", "blockquote", "span"}
CLOSED_BY_BLOCK = {"p"}
BOILER_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog"}
BOILER_WORDS = set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
                   "popup modal newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead toolbar "
                   "share sharing social related recommended recommendations comment comments reply replies disqus widget login signin search pagination "
                   "pager alert copyright".split())
LAYOUT = {"has", "with", "no", "without"}
# a part named by these may be a wrapper around the text
WRAPPERS = set("sidebar aside related recommended recommendations comment comments reply replies widget share sharing social modal search".split())
OTHER_ARTICLES = set("comment comments reply replies related recommended recommendations ad ads advert adverts advertisement promo promotion sponsored".split())
_BLOCK_TAG = re.compile(r"</?(?:div|section|article|main|nav|aside|footer|header|form|ul|ol|dl|li|table|tr|td|figure|p|h[1-6]|blockquote|pre|hr|body|html|datalist|fieldset)\b", re.I)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?\Z""", re.S)
_NAMES = re.compile(r"""(class|id|role|aria-label)\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
_HEADING = re.compile(r"h[1-6]$")
_SPACE = re.compile(r"\s+")


def _named(attrs: str) -> set[str]:
    """The listed words that the element's attributes name it by."""
    found: set[str] = set()
    for kind, value in _NAMES.findall(attrs):
        tokens = value.strip("\"'").lower().split()
        if kind.lower() == "aria-label" and len(tokens) > 3:
            continue  # a sentence, not a name
        for token in tokens:
            words = re.split(r"[^a-z]+", token)
            if words[0] not in LAYOUT:
                found.update(words)
    return found & BOILER_WORDS


def _part(tag: str, attrs: str, in_main: bool) -> tuple[bool, set[str]]:
    """(named by its tag or hidden, words it is named by)."""
    if tag in BOILER_TAGS or (tag == "header" and not in_main):
        return True, set()
    if tag in ("body", "html") or not attrs:
        return False, set()
    if _HIDDEN.search(attrs) and tag not in ("article", "main"):
        return True, set()
    words = _named(attrs)
    return False, words & OTHER_ARTICLES if tag in ("article", "main") else words


def _end_of(page: str, tag: str, at: int, unclosed: set[str]) -> int:
    """Where an element whose text is not read ends.  ``unclosed`` gathers the tags that no end tag
    follows any more, so a page is not searched again and again for them."""
    limit = len(page)
    if tag in SHORT:
        for stop in (_BLOCK_TAG, re.compile(rf"<{tag}\b", re.I)):
            m = stop.search(page, at, limit)
            limit = m.start() if m else limit
    close = None if tag in unclosed else re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at, limit)
    if close:
        return close.end()
    if tag in SHORT:
        return limit
    unclosed.add(tag)
    block = None if tag in ("script", "style") else _BLOCK_TAG.search(page, at)
    return block.start() if block else len(page)


def blocks_of(page: str) -> list[dict]:
    """The flat text blocks of a page, in order."""
    out: list[dict] = []
    parts: list[str] = []  # text of the block being read
    linked = 0  # its characters inside links
    open_: list[tuple[str, tuple]] = []  # (tag, state) of open containers
    heading = link = False
    outside = (False, False, ())  # in main; in a part named by its tag; the parts named by words it is in
    state = outside
    names: list[set[str]] = []  # of each part named by words
    unclosed: set[str] = set()
    mains: list[tuple] = []  # where articles and main elements stand

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                raw = sum(map(len, parts))
                out.append({"text": text, "words": text.count(" ") + 1, "links": linked / raw, "heading": heading, "main": state[0], "tagged": state[1], "parts": state[2]})
            parts.clear()
            linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if link:
                linked += len(text)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        closing, tag, attrs = m.group(1), m.group(2).lower(), m.group(3)
        if tag == "a":
            link = not closing
        if tag in RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                at = _end_of(page, tag, at, unclosed)
            flush() if tag not in ("svg", "math", "canvas") else None
            continue
        if tag in INLINE and tag != "span":
            continue
        if tag != "span":
            flush()
            link = False
            heading = not closing and _HEADING.match(tag) is not None
        if tag not in CONTAINERS:
            continue
        if not closing:
            if tag != "span" and open_ and open_[-1][0] in CLOSED_BY_BLOCK:
                open_.pop()
                state = open_[-1][1] if open_ else outside
            if attrs.rstrip().endswith("/"):
                continue
            main, tagged, parts_in = state
            by_tag, words = _part(tag, attrs, main)
            if (by_tag or words) and not tagged and not parts_in and tag == "span":
                flush()
            if words:
                names.append(words)
                parts_in = (*parts_in, len(names) - 1)
            if tag in ("article", "main"):
                main = True
                if not words:
                    mains.append((tagged, parts_in))
            state = (main, tagged or by_tag, parts_in)
            open_.append((tag, state))
        else:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    if tag == "span" and k != len(open_) - 1:
                        break
                    del open_[k:]
                    before = open_[-1][1] if open_ else outside
                    if tag == "span" and state[1:] != before[1:]:
                        flush()
                    state = before
                    break
    flush()
    wrappers = _wrappers(out, names, mains)
    for b in out:
        b["boiler"] = b["tagged"] or any(k not in wrappers for k in b["parts"])
    return out


def _wrappers(blocks: list[dict], names: list[set[str]], mains: list[tuple]) -> set[int]:
    """The parts named by words that are wrappers around the text."""
    may = {k for k, words in enumerate(names) if words <= WRAPPERS}
    if mains:
        if any(not tagged and not parts for tagged, parts in mains):
            return set()
        return {k for tagged, parts in mains if not tagged for k in parts if k in may}
    plain = [b for b in blocks if not b["tagged"] and b["links"] < 0.5]
    if any(not b["parts"] for b in plain):
        return set()
    words: dict[int, int] = {}
    for b in plain:
        words[b["parts"][0]] = words.get(b["parts"][0], 0) + b["words"]
    most = max(words, key=words.__getitem__, default=None)
    return {most} & may


def describe(blocks: list[dict]) -> np.ndarray:
    has_main = any(b["main"] for b in blocks)
    words = [0, *[b["words"] for b in blocks], 0]
    links = [0.0, *[b["links"] for b in blocks], 0.0]
    return np.array([
        [b["words"], b["links"], words[i], links[i], words[i + 2], links[i + 2], b["heading"],
         (2 if b["main"] else 0) if has_main else 1, b["boiler"]] for i, b in enumerate(blocks)], float).reshape(-1, len(FEATURES))


def grow(rows: np.ndarray, depth: int = 7):
    """A classification tree: (feature, threshold, below, above) nodes with 0 or 1 at the leaves; the
    split with the least Gini impurity, the first feature and lowest threshold on ties."""
    x, y = rows[:, :-1], rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            below = x[:, f] < t
            p, q = y[below], y[~below]
            impurity = len(p) * p.mean() * (1 - p.mean()) + len(q) * q.mean() * (1 - q.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t))
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t = best
    below = x[:, f] < t
    return f, t, grow(rows[below], depth - 1), grow(rows[~below], depth - 1)


TREE = grow(LABELLED)


def keeps(row: np.ndarray, tree=TREE) -> bool:
    while not isinstance(tree, int):
        f, t, below, above = tree
        tree = below if row[f] < t else above
    return bool(tree)


def extract_text(page: str | None) -> str:
    blocks = blocks_of(page) if page else []
    rows = describe(blocks)
    return " ".join(b["text"] for b, r in zip(blocks, rows.tolist(), strict=True) if keeps(r))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page under ``text_col``."""
    if text_col == html_col:
        raise ValueError("the text column can't take the name of the html column")
    others = pages.drop(text_col)
    at, names = others.columns.index(html_col), [*others.columns, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = [extract_text(p) for p in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return others.transform(bounded).mapInArrow(run, with_fields(others.schema, **{text_col: "string"}))
