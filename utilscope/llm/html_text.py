"""Main text of web pages by the distribution of text over line blocks.

1. Markup is stripped to lines, one per block element, in page order. Menus, headers, footers,
   sidebars, notices, adverts, forms and reader comments count as lines without text, and so
   does all that lies outside a page's <article> or <main>, if that holds the page's text; inside
   it they leave no line at all. Scripts and styles never do. Class names count as evidence only
   as names of known widgets, ids less, those of headings not at all; a name alone drops
   neither an <article>, nor what contains one or a <main>, nor what holds most of the text.
   Comments are also known by their form, a section that begins with a count of responses.
2. The text lengths are summed over a sliding window of lines. Text surges where the sums rise
   from zero and dives where they fall back to zero. Lines that read like labels of a site (Home,
   a copyright line, a word on cookies) have no weight in the sums, nor have links alone.
3. The lines between a surge and its dive are kept if some window in between reaches the
   threshold, or the page's highest sum where that is smaller: a short article is still the
   page's main text. Nothing between the two points is dropped. Headings and paragraphs are kept
   whatever their length. So where no <article> or <main> is to be trusted, the sums decide on list
   items, table cells, links and labels. Of a trusted one all lines are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
THRESHOLD = 86

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|select|title)\b[^>]*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_REPEATED = frozenset("li dd dt tr td th option".split())
_MAIN = frozenset(["article", "main"])
#: Blocks whose own text is a heading or a paragraph; in containers only what is not all links.
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote".split())
_CONTAINERS = frozenset(["", "div", "section", "article", "main", "body", "html", "center", "details", "header"])
_DROPPED = frozenset("nav aside form button fieldset dialog menu head audio video canvas footer header search".split())
_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar "
    "tablist status".split()
)
_NAMES = (
    "ads?|adverts?|advertis(?:ement|ing)s?|adsense|adbox|sponsor(?:s|ed)?|promo(?:s|ted|tion)?|banners?|cookies?|"
    "consent|gdpr|notices?|alerts?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|headers?|masthead|"
    "comments?|commentlist|repl(?:y|ies)|respond|disqus|discussion|shar(?:e|ing)|social|related|recommend(?:ed|ations?)|"
    "newsletter|subscri(?:be|ption)|signup|login|popup|modal|overlay|paywall|pagination|pager|toolbar|widgets?|"
    "copyright|skip-?link|search(?:box|form|bar)?|teasers?"
)
_PARTS = (
    "box|lists?|wrap(?:per)?|container|section|area|block|widgets?|posts?|links?|bar|banners?|notices?|forms?|content|"
    "inner|panel|top|bottom|left|right|items?|slot|unit|[0-9]+"
)
_NAMED = re.compile(rf"(?:(?!has-|with-|no-|without-|is-)(?:.+[-_])?(?:{_NAMES})|(?:{_NAMES})[-_](?:{_PARTS}))\Z", re.I)
#: Ids are also anchors of headings and sections, so only these count; inside an article just as they stand.
_ID_NAMES = (
    "ads?|adverts?|advertisements?|banners?|cookies?|cookie-?notice|consent|gdpr|sidebars?|nav|navbar|navigation|"
    "breadcrumbs?|footers?|masthead|comments?|commentlist|respond|disqus(?:_thread)?|newsletter|popup|modal|pagination"
)
_ID_NAMED = re.compile(rf"(?:(?:.+[-_])?(?:{_ID_NAMES})|(?:{_ID_NAMES})[-_](?:{_PARTS}))\Z", re.I)
_ID_IN_MAIN = re.compile(rf"(?:{_ID_NAMES})\Z", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A section that begins with a heading like "3 responses" or "Leave a comment".
_COMMENT_FORM = re.compile(
    r"\s*(?:<(?:div|header)\b[^>]*>\s*)?<h[1-6]\b[^>]*>\s*(?:<[^>]+>\s*)*"
    r"(?:(?:\d+|no|one|leave an?|post an?|add an?|write an?)\s+(?:readers?'?\s+)?(?:comments?|repl(?:y|ies)|responses?)\b"
    r"|(?:readers?'?\s+)?comments?\s*(?:\(\d+\))?\s*<)", re.I,
)
_FORM_TAGS = frozenset("section div aside".split())
_HEADER_NAMED = re.compile(r"(?:.+[-_])?(?:headers?|masthead)(?:[-_].+)?\Z", re.I)
_COMMENT_NAMED = re.compile(
    r"(?:comments?|commentlist|repl(?:y|ies)|respond|disqus|discussion|teasers?)(?:[-_].+)?\Z|.+[-_]teasers?\Z", re.I
)
#: Whole short lines of a site, not of its text.
_LABEL = re.compile(
    r"(?:home|start|about(?: us)?|contacts?(?: us)?(?:\s*:.*)?|log ?(?:in|out)|sign ?(?:in|up|out)|register|menu|search|"
    r"privacy(?: policy)?|terms(?: of (?:use|service))?|imprint|site ?map|faq|help|subscribe|share(?: this)?|next|previous|"
    r"back(?: to top)?|(?:read|show|load) more|skip to (?:main )?content|follow us|print|e-?mail)\W*\Z", re.I,
)
_SITE_LINE = re.compile(r"(?:©|\(c\)|copyright)\s|all rights reserved|\b(?:uses?|accept|our) cookies\b|\bcookie (?:policy|settings)\b", re.I)
_SITE_LINE_CHARS = 160
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _is_dropped(tag: str, given: dict[str, str], in_main: bool) -> bool:
    """Whether the element is boilerplate by its tag, its role, or for being hidden."""
    if tag in _DROPPED and not (tag == "header" and in_main):
        return True
    if not given or tag in ("html", "body", "main"):
        return False
    if given.get("role", "").lower() in _ROLES or "hidden" in given or given.get("aria-hidden") == "true":
        return True
    return bool(_HIDDEN.search(given.get("style", "")))


def _boilerplate_names(tag: str, given: dict[str, str], in_main: bool) -> list[str]:
    """The class names, and with less trust the id, that speak for boilerplate."""
    if not given or tag in ("html", "body", "main", "header"):
        return []
    names = [name for name in given.get("class", "").split() if _NAMED.match(name)]
    if tag not in _HEADINGS:
        pattern = _ID_IN_MAIN if in_main else _ID_NAMED
        names += [name for name in given.get("id", "").split() if pattern.match(name)]
    return [name for name in names if not (in_main and _HEADER_NAMED.match(name))]


def _is_label(text: str) -> bool:
    """Whether a line reads like a part of the site around the text."""
    if _LABEL.match(text):
        return True
    return len(text) <= _SITE_LINE_CHARS and bool(_SITE_LINE.search(text))


class _Named:
    """An element whose names speak for boilerplate; place 0 of a page's list stands for all others."""

    def __init__(self, above: int, inline: bool, article: bool, comment: bool, in_comment: bool):
        self.above, self.inline, self.comment, self.in_comment = above, inline, comment, in_comment or comment
        self.chars, self.comments = 0, 0
        self.article, self.inner_article, self.free_article = article, False, False
        self.dropped = self.hidden = False


def _judge(named: list[_Named]) -> None:
    """Set which of the named elements are boilerplate, and which of those leave no line.

    A name does not count for an <article>, an element that contains <article> or <main>, or one
    with most of the page's text besides reader comments (four fifths, where an article stands
    against it). Comments are articles too: what is named so is dropped, but on a page without
    another article, or without other text to speak of.
    """
    for element in reversed(named[1:]):
        above = named[element.above]
        above.chars += element.chars
        above.comments += element.chars if element.comment else element.comments
        above.inner_article |= element.article or element.inner_article
        above.free_article |= element.free_article or element.article and not element.in_comment
    total, free = named[0].chars, named[0].free_article
    other = total - named[0].comments
    for element in named[1:]:
        above = named[element.above]
        if element.comment:
            spared = (element.article or element.inner_article) and not free
            spared |= element.chars >= THRESHOLD and 2 * element.chars > total and other < THRESHOLD
        else:
            spared = element.article or element.free_article or element.inner_article and not free
            text = element.chars - element.comments
            spared |= text >= THRESHOLD and text > (4 if free else 1) * (other - text)
        element.dropped = above.dropped or not spared
        element.hidden = above.hidden or element.inline and not spared


class _Open(NamedTuple):
    """An open element: dropped or in an article by itself or from above; muted: its text is ignored.

    `named` is the place of the innermost element whose names speak for boilerplate.
    """

    tag: str
    dropped: bool
    in_main: bool
    muted: bool
    block: str
    named: int


def _holds_the_text(texts: list[str], lines: list[_Open]) -> bool:
    """Whether <article> and <main> hold the page's text: no more of it, or no surge, lies outside them."""
    inside = sum(len(t) for t, line in zip(texts, lines) if line.in_main and not line.dropped)
    outside = np.array([0 if line.in_main or line.dropped else len(t) for t, line in zip(texts, lines)], np.int64)
    return inside > 0 and (inside >= outside.sum() or _sums(outside).max() < THRESHOLD)


class Line(NamedTuple):
    """A line of a page: it may be main text, has weight in the sums, and is kept wherever it stands."""

    text: str
    possible: bool
    weighs: bool
    always: bool


def strip_markup(page: str) -> list[Line]:
    """Lines of a page, one per block.

    Boilerplate inside an article leaves no line. Inline boilerplate never does.
    """
    blocks: list[tuple[_Open, list[tuple[str, int, bool]]]] = []
    parts: list[tuple[str, int, bool]] = []
    named = [_Named(0, False, False, False, False)]
    mains: list[int] = []
    stack = [_Open("", False, False, False, "", 0)]
    in_link = False

    def flush() -> None:
        if parts:
            blocks.append((stack[-1], parts.copy()))
            parts.clear()

    def text_until(end: int) -> None:
        here = stack[-1]
        if end > at and not here.muted:
            text = html.unescape(page[at:end])
            parts.append((text, here.named, not in_link and not text.isspace()))
            if not here.dropped:
                named[here.named].chars += len(text.strip())

    def place_of(names: list[str], above: int, tag: str) -> int:
        """The place of an opened element among the named ones; of the one around it without names."""
        if not names:
            return above
        comment = any(_COMMENT_NAMED.match(name) for name in names)
        named.append(_Named(above, tag not in _BLOCKS, tag in _MAIN, comment, named[above].in_comment))
        return len(named) - 1

    at = 0
    for token in _TOKEN.finditer(page):
        text_until(token.start())
        at = token.end()
        tag = (token["tag"] or token["tag2"] or "").lower()
        attributes = token["attributes"] or token["attributes2"] or ""
        here = stack[-1]
        if not tag:
            continue
        if tag == "a":
            in_link = not (token["end"] or token["end2"])
        if token["end"] or token["end2"]:
            if tag in _BLOCKS:
                flush()
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if place and (tag in _BLOCKS or here.muted or here.tag not in _BLOCKS):
                del stack[place:]
        elif tag in _BLOCKS:
            flush()
            while stack[-1].tag == "p" or tag in _REPEATED and stack[-1].tag == tag:
                stack.pop()  # ended by this one
            here = stack[-1]
            if tag not in _VOID:
                given = _attributes(attributes) if attributes.strip() else {}
                drop = here.dropped or _is_dropped(tag, given, here.in_main)
                names = _boilerplate_names(tag, given, here.in_main)
                if tag in _FORM_TAGS and _COMMENT_FORM.match(page, at):
                    names.append("comments")
                place = place_of(names, here.named, tag)
                if tag in _MAIN and not drop:
                    mains.append(place)
                    if place == here.named:
                        named[place].inner_article = True
                        named[place].free_article |= not named[place].in_comment
                stack.append(_Open(tag, drop, here.in_main or tag in _MAIN and not drop, here.muted, tag, place))
        elif tag == "br":
            parts.append((" ", here.named, False))
        elif tag not in _VOID and not attributes.endswith("/"):
            given = _attributes(attributes) if attributes.strip() else {}
            place = place_of(_boilerplate_names(tag, given, here.in_main), here.named, tag)
            muted = here.muted or _is_dropped(tag, given, here.in_main)
            if muted or place != here.named or here.tag and here.tag not in _BLOCKS:
                stack.append(here._replace(tag=tag, muted=muted, named=place))
    text_until(len(page))
    flush()
    _judge(named)
    lines, texts, prose, linked = [], [], [], []
    for block, found in blocks:
        found = [part for part in found if not named[part[1]].hidden]
        text = " ".join("".join(part[0] for part in found).split())
        if text:
            texts.append(text)
            lines.append(block._replace(dropped=block.dropped or any(named[part[1]].dropped for part in found)))
            linked.append(not any(part[2] for part in found))
            prose.append(block.block in _PROSE or block.block in _CONTAINERS and not linked[-1])
    if all(named[place].dropped for place in mains) or not _holds_the_text(texts, lines):
        weak = [_is_label(text) or link and not p for text, link, p in zip(texts, linked, prose)]
        return [Line(text, not line.dropped, not line.dropped and not w, p and not w)
                for text, line, p, w in zip(texts, lines, prose, weak)]
    return [Line(text, line.in_main, line.in_main, line.in_main)
            for text, line in zip(texts, lines) if not (line.in_main and line.dropped)]


def _sums(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The lengths summed over windows; place i covers lines i - window + 1 .. i."""
    padded = np.concatenate([np.zeros(window - 1, np.int64), lengths, np.zeros(window - 1, np.int64)])
    running = np.concatenate([[0], np.cumsum(padded)])
    return running[window:] - running[:-window]


def surges(lengths: np.ndarray, window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(first, end) lines between each surge of the windowed sums and the dive after it."""
    if not lengths.any():
        return []
    sums = _sums(lengths, window)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]])))
    least = min(threshold, int(sums.max()))
    return [
        (int(start), int(end) - window + 1)
        for start, end in zip(edges[::2], edges[1::2]) if sums[start:end].max() >= least
    ]


def main_text(page: str | None) -> str:
    """The article's blocks, one per line; empty for an empty page or one without main text."""
    lines = strip_markup(page or "")
    lengths = np.array([len(line.text) if line.weighs else 0 for line in lines], np.int64)
    shown = np.array([line.always for line in lines], bool)
    for first, end in surges(lengths):
        shown[first:end] = True
    return "\n".join(line.text for line, show in zip(lines, shown) if show and line.possible)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(page.as_py()) for page in batch.column(batch.num_columns - 1)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], "text"])


def extract_main_text(pages: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """The columns `keep`, `text` and `n_chars` (code points) for every row of `pages`.

    Row by row, whole pages, nothing shuffled. NULL or empty pages and pages without main text
    have an empty text. `keep` must not name `text` or `n_chars`.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("columns named text or n_chars can't be kept beside the result's")
    rows = pages.select(*keep, F.col(page).cast("string").alias("_page"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    found = rows.mapInArrow(_extracted, f"{fields}{', ' if fields else ''}text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
