"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line's weight is the length of its text, or
nothing if half of it is links; lines of menus, notices, forms and the like weigh nothing. Weights are
summed over a sliding window of lines. Between two dives, where a sum falls to nothing, the sums rise
from nothing and fall again; if on the way they surge to a threshold, the text of all weighing lines
between the dives is main text. The threshold is SURGE characters, or the page's greatest sum if that
is less, so a short page is read by the same rule as a long one.

What a page marks as its article is a prior: lines in it weigh PRIOR times their length, and those
outside nothing. A page with the marks taken away goes through the same rule with the plain weights.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, map_arrow, texts

WINDOW = 3  # lines of a block
SURGE = 60  # summed characters that make a text
PRIOR = 4  # how much more a marked article's lines weigh

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
_CHROME = frozenset(("nav", "footer", "aside", "form", "button", "select", "svg", "menu", "dialog", "head", "object", "canvas", "audio", "video", "map", "fieldset"))
_MAIN = frozenset(("article", "main"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_LOOSE = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))  # may stand without an end tag
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|rail|menu|navbar|nav|navigation|breadcrumbs?|footer|header|masthead|topbar|toolbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"comments?|commentlist|discussion|disqus|replies|reply|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|widget|contentinfo|complementary|dialog)(?:$|[\s_-])",
    re.I,
)
_ARTICLE_NAME = re.compile(r"(?:^|\s)(?:article|main|article-body|article-content|post-content|entry-content|main-content|post-body|story-body|articleBody)(?:$|\s)")


def tokens_of(page: str) -> list[tuple[str, str, str]]:
    """(slash, name, rest) of tags, and ("", "text" or "cdata", text), in page order and in one pass.

    Quotes protect a ``>`` inside a tag until one of them is found never to be closed; from there on a
    tag ends at its first ``>``, so no part of a page is searched more than twice. What looks like the
    start of a tag with no ``>`` behind it is text.
    """
    tokens: list[tuple[str, str, str]] = []
    at, since, end = 0, 0, len(page)
    quoted, last, sections = True, page.rfind(">"), page.rfind("]]>")

    def text(upto: int) -> None:
        if upto > since:
            tokens.append(("", "text", page[since:upto]))

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            text(at)
            close = page.find("-->", at + 4)
            at = since = close + 3 if close >= 0 else end
        elif at >= last:
            break
        elif page.startswith("<![CDATA[", at) and sections > at:
            text(at)
            close = page.find("]]>", at + 9)
            if close >= 0:
                tokens.append(("", "cdata", page[at + 9 : close]))
            at = since = close + 3 if close >= 0 else page.find(">", at) + 1
        elif page[at + 1] in "!?":
            text(at)
            at = since = page.find(">", at) + 1
        elif m := _NAME.match(page, at + 1):
            close = _REST.match(page, m.end()).end() if quoted else page.find(">", m.end())
            if quoted and (close == end or page[close] != ">"):
                quoted, close = False, page.find(">", m.end())
            text(at)
            slash, name = ("/", m[0][1:]) if m[0][0] == "/" else ("", m[0])
            name, rest = name.lower(), page[m.end() : close]
            tokens.append((slash, name, rest))
            at = since = close + 1
            if name in _RAW and not slash and not rest.endswith("/"):
                found = re.compile(f"</{name}\\b[^>]*+>?", re.I).search(page, at)
                at = since = found.end() if found else end
                tokens.append(("/", name, ""))
        else:
            at += 1
    text(end)
    return tokens


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, in an article, in chrome) of each block, in page order."""
    tokens = tokens_of(page)
    # Where each element ends: its own end tag, or for loose ones the next of its kind.
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    for i, (slash, name, _) in enumerate(tokens):
        if name in ("text", "cdata") or name in _VOID:
            continue
        stack = open_at.setdefault(name, [])
        if slash:
            if stack:
                ends[stack.pop()] = i
        else:
            if name in _LOOSE and stack:
                ends[stack.pop()] = i
            stack.append(i)

    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked, article, chrome, anchor = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            out.append((" ".join("".join(parts).split()), linked, article > 0, chrome > 0))
            parts.clear()
        linked = 0

    leave: dict[int, list[int]] = {}  # token index: what ends there
    for i, (slash, name, rest) in enumerate(tokens):
        for kind in leave.pop(i, ()):
            flush()
            article -= kind == 0
            chrome -= kind == 1
        if name in ("text", "cdata"):
            piece = html.unescape(rest) if name == "text" and "&" in rest else rest
            parts.append(piece)
            if anchor:
                linked += len(piece.strip())
            continue
        if name == "a":
            anchor = 0 if slash else 1
        if name not in _INLINE:
            flush()
        if slash or name in _VOID or rest.endswith("/"):
            continue
        names = " ".join(filter(None, (x for m in _NAMED.finditer(rest) for x in m.groups()))) if rest else ""
        known = name in _CHROME or name in _RAW or name == "header" and not article
        named = bool(names) and name not in ("html", "body") and name not in _MAIN and bool(_CHROME_NAME.search(names)) or name in _MAIN and bool(re.search(r"(?:^|[\s_-])(?:comments?|ads?|related|promo)", names, re.I))
        if known or named or rest and _HIDDEN.search(rest):
            if i in ends or known:
                flush()
                chrome += 1
                leave.setdefault(ends.get(i, -1), []).append(1)
        elif name in _MAIN or names and _ARTICLE_NAME.search(names):
            flush()
            article += 1
            leave.setdefault(ends.get(i, -1), []).append(0)
    flush()
    return out


def weights_of(lines: list[tuple[str, int, bool, bool]]) -> list[int]:
    """A line's weight: none in chrome, PRIOR times its length in a marked article, else its length unless it is mostly links."""
    marked = any(article and not chrome for _, _, article, chrome in lines)
    return [0 if chrome else PRIOR * len(text) if article else 0 if marked or 2 * linked >= len(text) else len(text) for text, linked, article, chrome in lines]


def main_text(page: str) -> str:
    """Text of the stretches that surge; the empty string where no line weighs anything."""
    lines = [x for x in lines_of(page) if x[0]]
    weights = np.array(weights_of(lines), np.int64)
    if not weights.any():
        return ""
    # sums[i] is of the lines i - WINDOW + 1 to i.
    sums = np.convolve(weights, np.ones(WINDOW, np.int64))
    threshold = min(SURGE, sums.max())
    # A stretch is numbered by the dives before it.
    stretch = np.cumsum(sums == 0)
    surges = np.zeros(stretch[-1] + 1, bool)
    surges[stretch[sums >= threshold]] = True
    return " ".join(lines[i][0] for i in np.flatnonzero((weights > 0) & surges[stretch[: len(lines)]]).tolist())


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = [main_text(t) for t in texts(rows.column("html"))]
        yield batch(_OUT, page_id=rows.column("page_id"), url=rows.column("url"), text=found, n_chars=[len(t) for t in found])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    A null, empty or textless html gives the empty text and 0; null ids and urls are passed on;
    repeated rows come back repeated; no rows, no rows.
    """
    return map_arrow(pages.select("page_id", "url", "html"), _extract, "page_id long, url string, text string, n_chars long")
