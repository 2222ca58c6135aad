"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their path of block tags from the root. For each path the length of its text and its punctuation are added up, and
two ratios taken, each the geometric mean of what the path has a node and of what it has in all: a path of many full nodes is high,
one of many short nodes (links) or of a single one (a page footer) is low. Both ratios are spread over the nodes in page order, smoothed,
and fused into one score; a path's score is the geometric mean of what it has by itself (twice) and of what its neighbourhood has, times a
weight. The weight is bounded: links lower it, and so do holders (not paragraphs, headings or quotes) that name themselves as something else
(menus, page headers and footers, sidebars, notices, adverts, forms, and most of all reader comments), unless they wrap the page. Between
``LEAST`` and 1, it is no veto: a lowered path of as much text as the others is still content.

Paths above ``STRONG`` times the average score of the page's text that nothing lowers are content; the innermost element that holds nearly all of
their text is the article. In it, all blocks stay but those of lowered paths that are not content themselves, so that headings, list
items, captions and short paragraphs stay with their article. A page of less than ``SHORT`` characters has too little text for ratios to
tell anything; there an ``article`` or ``main`` element, if there is one, is the article.

Defined cases: a null or empty html, or one without text, gives an empty text; unclosed and crossed tags are closed as
browsers do for paragraphs, list items and table cells, other open elements end with their parent; what is not shown (scripts,
hidden elements) is no text; a page cut off inside a tag, comment or script ends there; nesting of any depth takes time in
proportion; rows that repeat a page each get a row; names of further columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*\Z|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?、。，；？！…]")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is not markup, with what ends them.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "xmp")}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: A new element closes an open one of these, up to the nearest holder.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Elements before which an open paragraph ends.
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_P_HOLDERS = {"article", "aside", "blockquote", "body", "div", "figure", "footer", "form", "header", "li", "main", "nav", "section", "table", "td", "th", "dd"}
#: Elements without text of the page.
_NO_TEXT = {"button", "canvas", "dialog", "head", "input", "math", "object", "select", "svg", "video", "audio"}
_LEFT_OUT = {"aside", "footer", "menu", "nav"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|adsense|adbox|adslot|banners?|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|subscribe|subscription|"
    r"newsletter|signup|login|paywall|sidebars?|side|rail|widgets?|menus?|nav|navbar|navigation|navigations?|breadcrumbs?|footers?|foot|site-header|page-header|header|topbar|masthead|share|sharing|social|related|recommended|"
    r"recommendations|trending|popular|more-stories|comments?|commentlist|comment-list|discussions?|replies|reply|respond|responses|disqus|pagination|pager|tags|toolbar|copyright|legal|disclaimer|skip-link|search)(?:$|[-_\s])",
    re.I,
)
_CONTENT_TAGS = {"html", "body", "article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


#: An element without text, one that is surely not the article's text, and one that is not unless it wraps the page.
_NOTHING, _SURE, _LIKELY = 3, 2, 1
#: Weights of paths through holders that name themselves as something else, and as reader comments; the latter is the least of all weights.
ASIDE_WEIGHT, LEAST = 0.25, 0.1
#: By how much a block that is all links lies below one without.
LINKS_LOWER = 0.75
#: Score, as a share of the page's average, from which paths are content.
STRONG = 0.24
#: Weight from which a block of the article stays whatever its score.
PLAIN = 0.9
#: Share of the text of content paths that the article holds.
HELD = 0.95
#: Characters of text that ratios need.
SHORT = 800
#: Elements of running text; what they call themselves says nothing against them.
_TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"}
_COMMENTS = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|discussions?|replies|reply|respond|responses|disqus)(?:$|[-_\s])", re.I)


class _Element:
    __slots__ = ("tag", "name", "parent", "veto", "aside", "comment", "number", "depth", "in_link", "in_article")

    def __init__(self, tag: str, name: str, parent: _Element | None, veto: int, number: int, comment: bool = False):
        self.tag, self.name, self.parent, self.veto, self.number, self.aside, self.comment = tag, name, parent, veto, number, False, comment
        self.depth = parent.depth + 1 if parent else 0
        self.in_link = tag == "a" or parent is not None and parent.in_link
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article


def _veto(tag: str, attributes: str, parent: _Element) -> int:
    """What an element says of itself: ``_NOTHING``, ``_SURE`` or ``_LIKELY``, or 0 where it may hold the article's text."""
    found = _LIKELY if tag == "form" else 0
    if tag in _NO_TEXT:
        return _NOTHING
    if tag in _LEFT_OUT:
        return _SURE
    if tag == "header":
        return 0 if parent.in_article else _SURE
    if not attributes or tag in _CONTENT_TAGS and "comment" not in attributes.lower():
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _NOTHING
        if key == "role" and value.lower() in _ROLES and not (found and value.lower() == "form"):
            return _SURE
        if key in ("class", "id") and tag not in _TEXT_TAGS and _NAMES.search(value):
            found = _LIKELY
    return found


def _set_aside(nodes: list[tuple[str, _Element, int]], elements: list[_Element]) -> None:
    """Mark the elements whose paths weigh little. A likely veto does not count for a wrapper of the page: an element with half of the
    text or more that holds the article's elements, or beside which hardly any text is left."""
    sure, likely = [False] * len(elements), [False] * len(elements)
    own, articles, free = [0] * len(elements), [0] * len(elements), 0
    for e in elements[1:]:
        sure[e.number] = sure[e.parent.number] or e.veto == _SURE
        likely[e.number] = likely[e.parent.number] or e.veto > 0
        articles[e.number] = int(not e.veto and e.tag in ("h1", "article", "main"))
    for raw, e, _ in nodes:
        if not sure[e.number]:
            n = len(raw.strip())
            own[e.number] += n
            free += 0 if likely[e.number] else n
    for e in reversed(elements[1:]):
        own[e.parent.number] += own[e.number]
        articles[e.parent.number] += articles[e.number]
    for e in elements[1:]:
        wrapper = e.veto == _LIKELY and 2 * own[e.number] >= own[0] and (articles[e.number] > 0 or 10 * free < own[e.number])
        e.comment = e.parent.comment or e.comment and e.veto > 0 and not wrapper
        e.aside = e.parent.aside or e.veto > 0 and not wrapper
    if own[0] and all(e.aside or not raw.strip() for raw, e, _ in nodes):  # nothing but likely vetoes: none of them counts
        for e in elements[1:]:
            e.aside, e.comment = sure[e.number], False


def text_nodes(page: str) -> tuple[list[tuple[str, _Element, int]], list[_Element]]:
    """Text nodes of a page in order, each with its element and the number of its block, and all elements."""
    root = _Element("#", "#", None, 0, 0)
    nodes, elements, at, block, here = [], [root], 0, 0, root
    open_tags: Counter[str] = Counter()

    def close(upto: _Element) -> _Element:
        """End all open elements up to ``upto`` and that."""
        last = here
        while True:
            open_tags[last.tag] -= 1
            if last is upto:
                return last.parent
            last = last.parent

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            raw = m[0]
            if (raw[0] != "<" or len(raw) == 1) and here.veto != _NOTHING:
                nodes.append((raw, here, block))
            continue
        tag = tag.lower()
        if tag == "br" or tag not in _INLINE:
            block += 1
        if closing:
            if open_tags[tag]:
                open_one = here
                while open_one.tag != tag:
                    open_one = open_one.parent
                here = close(open_one)
            continue
        if tag in _RAW:
            ends = _RAW[tag].search(page, at)
            at = ends.end() if ends else len(page)
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P:
            if open_tags["p"]:
                open_one = here
                while open_one is not root and open_one.tag != "p" and open_one.tag not in _P_HOLDERS:
                    open_one = open_one.parent
                if open_one.tag == "p":
                    here = close(open_one)
        elif tag in _CLOSES:
            closed, holders = _CLOSES[tag]
            if any(open_tags[t] for t in closed):
                open_one, outer = here, None
                while open_one is not root and open_one.tag not in holders:
                    outer = open_one if open_one.tag in closed else outer
                    open_one = open_one.parent
                here = close(outer) if outer else here
        if attributes.endswith("/") and tag in ("path", "circle", "rect", "use"):
            continue
        kind = re.search(r"""class\s*=\s*["']?\s*([-\w]+)""", attributes) if "class" in attributes else None
        veto = _NOTHING if here.veto == _NOTHING else _veto(tag, attributes, here)
        comment = veto == _LIKELY and any(_COMMENTS.search(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id"))
        here = _Element(tag, f"{tag}.{kind[1]}" if kind else tag, here, veto, len(elements), comment)
        open_tags[tag] += 1
        elements.append(here)
    _set_aside(nodes, elements)
    return nodes, elements


def _smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbours in page order."""
    if len(values) < 3:
        return values
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(values, 2, mode="edge"), kernel, mode="valid")


def path_scores(which: np.ndarray, lengths: np.ndarray, marks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The score of each path from the path, text length, punctuation marks and weight of each text node, in page order."""
    count, text, mark = np.bincount(which), np.bincount(which, weights=lengths), np.bincount(which, weights=marks)
    text_ratio = text / np.sqrt(count)  # the geometric mean of text and of text a node
    mark_ratio = mark / np.sqrt(count)
    fused = _smoothed(text_ratio[which]) * np.sqrt(1 + _smoothed(mark_ratio[which]))
    own = text_ratio * np.sqrt(1 + mark_ratio)
    weight = np.bincount(which, weights=lengths * weights) / text
    return np.cbrt(np.bincount(which, weights=fused) / count * own * own) * weight


def _article(elements: list[_Element], nodes: list, strong: np.ndarray, lengths: np.ndarray) -> _Element:
    """The innermost element that holds nearly all strong text, or the article or main element round it; in a short page such an element if there is one."""
    held = np.zeros(len(elements))
    short = lengths.sum() < SHORT
    np.add.at(held, [e.number for _, e, _ in nodes], lengths if short else np.where(strong, lengths, 0.0))
    whole = held.sum()
    for e in reversed(elements[1:]):
        held[e.parent.number] += held[e.number]
    named = [e for e in elements if e.tag in ("article", "main") and not e.aside and held[e.number] > 0]
    if short and named:
        return max(named, key=lambda e: (held[e.number], e.depth))
    found = max((e for e in elements if held[e.number] >= HELD * whole and e.tag not in _INLINE and e.tag != "p"), key=lambda e: e.depth)
    while found.in_article and found.tag not in ("article", "main"):
        found = found.parent
    return found


def _block_tag(e: _Element) -> str:
    """Tag of the innermost element round a text that is not inline."""
    while e.tag in _INLINE and e.parent is not None:
        e = e.parent
    return e.tag


def main_text(page: str | None) -> str:
    """The main text of a page: blocks joined by one space."""
    if not page:
        return ""
    every, elements = text_nodes(page)
    every = [(entities.unescape(raw), e, b) for raw, e, b in every]
    nodes = [(t, e, b) for t, e, b in every if t.strip()]
    if not nodes:
        return ""
    # paths by number; elements come after their parents, and inline ones add nothing to the path
    numbers: dict[tuple[int, str, bool], int] = {}
    path_of = [-1] * len(elements)
    for e in elements[1:]:
        above = path_of[e.parent.number]
        path_of[e.number] = above if e.tag in _INLINE and above >= 0 else numbers.setdefault((above, e.name, e.aside), len(numbers))
    lengths = np.array([len(_SPACE.sub(" ", t).strip()) for t, _, _ in nodes], dtype=np.float64)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t, _, _ in nodes], dtype=np.float64)
    blocks = np.array([b for _, _, b in nodes])
    text_in, link_in = (np.bincount(blocks, weights=x) for x in (lengths, lengths * [e.in_link for _, e, _ in nodes]))
    named = np.array([LEAST if e.comment else ASIDE_WEIGHT if e.aside else 1.0 for _, e, _ in nodes])
    linked = 1 - LINKS_LOWER * (link_in[blocks] / text_in[blocks]) ** 2
    weights = np.maximum(named * linked, LEAST)
    _, which = np.unique([path_of[e.number] for _, e, _ in nodes], return_inverse=True)
    scores = path_scores(which, lengths, marks, weights)[which]
    counts = lengths * (weights >= PLAIN) if (weights >= PLAIN).any() else lengths  # the average is that of the text that nothing speaks against
    average = (scores * counts).sum() / counts.sum()
    strong = scores >= STRONG * average
    article = _article(elements, nodes, strong, lengths)
    inside = [e is article for e in elements]
    for e in elements[1:]:
        inside[e.number] = inside[e.number] or inside[e.parent.number]
    running = [_block_tag(e) in _TEXT_TAGS for _, e, _ in nodes]
    stays = strong | (np.where(running, named, weights) >= PLAIN)
    good = 2 * np.bincount(blocks, weights=lengths * stays) >= text_in
    texts: dict[int, list[str]] = {}
    for t, e, b in every:
        if inside[e.number] and b < len(good) and text_in[b] and good[b]:
            texts.setdefault(b, []).append(t)
    joined = (_SPACE.sub(" ", "".join(parts)).strip() for parts in texts.values())
    return " ".join(t for t in joined if t)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts = [main_text(x.as_py()) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages (page_id, url, html)``."""
    rows = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
