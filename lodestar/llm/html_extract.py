"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one per block of the page, and every line has a weight: its characters outside links,
or nothing if most are in links or it is a copyright line. What elements, classes and roles say changes weights.
Lines inside what is never main text (navigation, header, footer, asides, forms, scripts, ...) weigh nothing, nor do
those of parts whose class or role names boilerplate; but where hinted parts alone hold a page's text, only hints of
adverts, notices of cookies and readers' comments count. Where the page names its article, lines in it weigh a surge more
and others nothing, unless the page has far more text outside, as around a teaser. Then, on every page, sums over
sliding windows rise above a threshold at a surge point and fall below half of it at a dive point; the lines between
them, from the first to the last that is heavy for its window, are the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Lines in a sliding window, and the text (characters outside links) of a window at a surge; a page whose windows
#: are all below twice that is held against half of its largest window instead, so short pages keep their text.
WINDOW_LINES, LEAST_SURGE = 3, 86
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# Element names of the HTML standard, by what they mean for main text.
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
NEVER = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "template", "svg", "canvas", "object", "dialog", "menu", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Class, id and role words of parts that are no main text.
HINT = re.compile(r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|header|footer|masthead|sidebar|aside|widget|related|share|social|comments?|discussion|respond|disqus|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|login|signup|contentinfo|complementary|navigation|search)(?:$|[\s_-])", re.I)
#: Of these, the ones that count even where hinted parts hold all text.
HINT_STRONG = re.compile(r"(?:^|\s)(?:ads?|advert\w*|sponsor\w*|comments?|respond|replies|disqus|cookies?|consent|popup|modal)(?:$|[\s_-])", re.I)
#: Beginnings of a line that is no main text anywhere.
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved\b)", re.I)
#: An article is a teaser if there is so many times its text outside it.
TEASER = 3
#: Of an article's own class, only these.
HINT_MAIN = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|related|teaser|comments?|respond|replies)(?:$|[\s_-])", re.I)
MAIN = {"article": 2, "main": 1}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_HINTED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


#: What tells against a line: nothing, a hint, a hint that always counts, an element that is never main text.
FREE, HINTED, STRONG, NEVER_MAIN = range(4)


def blocks(page: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, what tells against it, 2 in an article or 1 in a main element, characters in links, is a heading) of every block, in page order."""
    out: list[tuple[str, int, int, int, bool]] = []
    stack: list[tuple[str, int]] = []
    words: list[str] = []
    linked: list[str] = []
    against, named = [0, 0, 0, 0], {"article": 0, "main": 0}
    position = 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
        in_links = len(_SPACE.sub(" ", html.unescape("".join(linked))).strip())
        words.clear()
        linked.clear()
        if text:
            level = max(MAIN[k] for k, n in named.items() if n) if any(named.values()) else 0
            out.append((text, max((k for k in (1, 2, 3) if against[k]), default=FREE), level, in_links, any(name in HEADINGS for name, _ in stack)))

    def add(text: str) -> None:
        words.append(text)
        if any(name == "a" for name, _ in stack):
            linked.append(text)

    while position < len(page):
        tag = _TAG.search(page, position)
        if tag is None:
            add(page[position:])
            break
        add(page[position : tag.start()])
        position = tag.end()
        if tag[2] is None:
            continue
        name, closing = tag[2].lower(), tag[1] == "/"
        if name == "br":
            words.append(" ")
        elif name not in INLINE:
            flush()
        if closing:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if at >= 0:
                for other, no in stack[at:]:
                    against[no] -= 1
                    if other in named:
                        named[other] -= 1
                del stack[at:]
            continue
        if name in VOID or tag[3].endswith("/") and name not in MAIN and name not in NEVER:
            continue
        hints = " ".join(next(filter(None, m.groups()), "") for m in _HINTED.finditer(tag[3]))
        hinted = bool((HINT_MAIN if name in MAIN else HINT).search(hints)) and name not in ("html", "body")
        no = NEVER_MAIN if name in NEVER or _HIDDEN.search(tag[3]) else FREE if not hinted else STRONG if HINT_STRONG.search(hints) else HINTED
        stack.append(("anchor" if name == "a" and not _HREF.search(tag[3]) else name, no))
        against[no] += 1
        if name in named:
            named[name] += 1
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, position)
            position = end.start() if end else len(page)
    flush()
    return out


def region_lines(weights: np.ndarray, headings: list[bool], window: int, least: float) -> np.ndarray:
    """Which lines lie between a surge and a dive; a light line before the first or after the last heavy one does not, but for a heading before it."""
    sums = np.convolve(weights, np.ones(window, np.int64))[window - 1 :]  # of each line and those after it in its window
    least = min(least, sums.max() / 2)
    kept, inside, begin = np.zeros(len(weights), bool), False, 0
    for i, weight in enumerate(weights.tolist()):
        heavy = weight * window >= least and weight > 0
        if not inside and sums[i] >= least and (heavy or headings[i] and weight):
            inside, begin = True, i  # surge
        if inside and heavy:
            kept[begin : i + 1] = True
            begin = i + 1
        if inside and 2 * sums[i] < least:
            inside = False  # dive
    return kept & (weights > 0)


def weighed(lines: list[tuple[str, int, int, int, bool]], window: int, least: float) -> np.ndarray:
    """The weight of every line."""
    mass = np.array([0 if 2 * linked > len(text) or RIGHTS.match(text) else len(text) - linked for text, _, _, linked, _ in lines], np.int64)
    against, level = (np.array([line[k] for line in lines]) for k in (1, 2))

    def surges(weights: np.ndarray) -> bool:
        return bool(len(weights)) and np.convolve(weights, np.ones(window, np.int64)).max() >= least

    allowed = FREE if surges(np.where(against == FREE, mass, 0)) or not surges(np.where(against <= HINTED, mass, 0)) else HINTED
    free = against <= allowed
    weights = np.where(free, mass, 0)
    named = level[free].max(initial=0)
    if named:
        inside = free & (level == named)
        outside = np.where(inside, 0, weights)
        if not (surges(outside) and outside.sum() > TEASER * weights[inside].sum()):
            # A surge more, so that a short line or one of links in an article is heavy for its window.
            weights = np.where(inside, mass + int(np.ceil(least)), 0)
    return weights


def main_text(page: str, window: int = WINDOW_LINES, least: int = LEAST_SURGE) -> str:
    """The main text of a page, its blocks joined by two line feeds; empty if there is none."""
    lines = blocks(page)
    weights = weighed(lines, window, least) if lines else np.zeros(0, np.int64)
    if not weights.any():
        return ""
    kept = region_lines(weights, [heading for *_, heading in lines], window, least)
    return "\n\n".join(text for (text, *_), k in zip(lines, kept, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars; one pass without a shuffle.

    A null or empty page has an empty text, as has one with nothing but boilerplate; repeated rows are read
    each; broken and cut-off markup is read as far as it goes; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "h"):
                texts = [main_text(page or "") for page in batch.column("h").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
