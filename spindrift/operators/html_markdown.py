"""HTML pages to Markdown documents.

A small tree is built from the token stream with the end tags that HTML lets authors leave out. Title
and canonical link are read first; page chrome is taken out; the first main, else article, else body
is rendered. One vectorised pass over the pages; everything around it stays in Spark expressions.

Nothing recurses: rendering functions are generators that hand each other to ``call``, which keeps them
on a stack of its own, so markup may be nested as deep as a page likes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import spread
from ..functions.urls import is_document_type

# Elements that are page chrome, and link labels that only mark an anchor.
CHROME = ("script", "style", "nav", "footer", "aside", "header", "noscript", "iframe", "svg", "form", "button")
ANCHOR_LABELS = ("copied", "copy", "copy link", "link", "permalink", "anchor")

_DROP, _LABELS = frozenset(CHROME), frozenset(ANCHOR_LABELS)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
# What an opening tag ends, and what it does not look beyond.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_HEADINGS = {f"h{i}": i for i in range(1, 7)}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # open elements by tag, so that nothing is searched that is not open

    def _close(self, i: int) -> None:
        for n in self.open[i:]:
            self.count[n.tag] -= 1
        del self.open[i:]

    def _close_to(self, tags: set[str], stop: set[str]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                return
            if self.open[i].tag in tags:
                self._close(i)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and (known := self.root.first(tag)):
            known.attrs |= {k: v or "" for k, v in attrs if k not in known.attrs}
            return
        if tag in _CLOSES_P:
            self._close_to({"p"}, {"button", "table", "td", "th", "li", "div", "article", "section", "main", "body"} - {tag})
        if tag in _IMPLIED:
            self._close_to(*_IMPLIED[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag and tag not in _BLOCK:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


# ---------------------------------------------------------------- metadata and chrome


def title_of(root: Node) -> str:
    """First h1 in main, then in article, then the title element."""
    for place in ("main", "article"):
        if (box := root.first(place)) and (h := box.first("h1")):
            return " ".join(h.text().split()) if "\n" in h.text() else h.text().strip()
    found = root.first("title")
    return found.text().strip() if found else ""


def canonical_of(root: Node, url: str) -> str:
    """The last canonical link as it is written, else the page's URL."""
    links = [n.attrs.get("href", "") for n in root.walk() if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split()]
    return next((x for x in reversed(links) if x.strip()), url)


def _hidden(n: Node) -> bool:
    return "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or n.attrs.get("role") == "presentation"


def _self_link(n: Node) -> bool:
    """A link to a place on its own page: a permalink beside a heading, not a cross-reference."""
    try:
        parts = urlsplit(n.attrs.get("href", ""))
    except ValueError:
        return False
    if not parts.fragment or parts.query:
        return False
    if n.attrs.get("aria-label", "").lower().startswith("permalink") or not parts.path:
        return True
    label = n.text().strip()
    return not label or label.startswith("#") or label.lower() in _LABELS


def holding(root: Node, tags: frozenset[str]) -> set[int]:
    """Which nodes hold an element of these tags, at whatever depth, by ``id``."""
    out: set[int] = set()
    for n in reversed(list(root.walk())):
        if any(isinstance(c, Node) and (c.tag in tags or id(c) in out) for c in n.children):
            out.add(id(n))
    return out


def strip_chrome(n: Node) -> None:
    """Take out chrome, hidden elements, menus in disclosures and self links."""
    menus = holding(n, frozenset(("nav",)))
    stack = [n]
    while stack:
        at = stack.pop()
        kept: list[Node | str] = []
        for c in at.children:
            if isinstance(c, Node):
                menu = c.tag in ("details", "summary") and id(c) in menus
                if c.tag in _DROP or _hidden(c) or menu or (c.tag == "a" and _self_link(c)):
                    continue
                stack.append(c)
            kept.append(c)
        at.children = kept


def content_root(root: Node) -> Node:
    return root.first("main") or root.first("article") or root.first("body") or root


# ---------------------------------------------------------------- rendering

_SPACE = re.compile(r"[ \t\r\n\f]+")
_MARKS = re.compile(r"([\\`*_\[\]])")


def _plain(s: str) -> str:
    """Text with Markdown's own marks escaped and angle brackets and ampersands of entities kept."""
    s = _MARKS.sub(r"\\\1", s)
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if "<" in s or ">" in s else s


def call(work: Generator) -> object:
    """The result of a generator that yields generators and is sent their results."""
    stack, value = [work], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


class _Markdown:
    """Rendering of one tree; every method that goes into children is a generator for ``call``."""

    def __init__(self, url: str, root: Node) -> None:
        self.url, self.held = url, holding(root, _BLOCK)

    def link(self, href: str) -> str:
        try:
            return urljoin(self.url, href.strip()) if self.url else href.strip()
        except ValueError:
            return href

    def inline(self, nodes: list[Node | str]) -> Generator:
        out: list[str] = []
        for n in nodes:
            if isinstance(n, str):
                out.append(_plain(_SPACE.sub(" ", n)))
                continue
            if n.tag == "br":
                out.append("  \n")
            elif n.tag == "img":
                if src := n.attrs.get("src", ""):
                    out.append(f"![{n.attrs.get('alt', '')}]({self.link(src)})")
            elif n.tag in ("code", "kbd", "samp", "tt"):
                body = n.text()
                ticks = "`" * (1 + max((len(m) for m in re.findall("`+", body)), default=0))
                pad = " " if body.startswith("`") or body.endswith("`") else ""
                out.append(f"{ticks}{pad}{body}{pad}{ticks}" if body else "")
            else:
                inner = yield self.inline(n.children)
                mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}.get(n.tag)
                if mark and inner.strip():
                    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
                    out.append(f"{lead}{mark}{inner.strip()}{mark}{tail}")
                elif n.tag == "a" and "href" in n.attrs:
                    label = inner.strip()
                    out.append(f"[{label}]({self.link(n.attrs['href'])})" if label else "")
                else:
                    out.append(inner)
        return "".join(out)

    def paragraph(self, nodes: list[Node | str]) -> Generator:
        text = yield self.inline(nodes)
        lines = [_SPACE.sub(" ", x).strip() for x in re.sub(r"  \n", "\x00", text).split("\x00")]
        return "  \n".join(x for x in lines if x)

    def blocks(self, nodes: list[Node | str]) -> Generator:
        out: list[str] = []
        run: list[Node | str] = []
        for n in [*nodes, None]:
            if isinstance(n, str) or (n is not None and n.tag not in _BLOCK and id(n) not in self.held):
                run.append(n)
                continue
            if run and (p := (yield self.paragraph(run))):
                out.append(p)
            run = []
            if n is not None:
                out += yield self.block(n)
        return out

    def block(self, n: Node) -> Generator:
        if level := _HEADINGS.get(n.tag):
            body = (yield self.paragraph(n.children)).replace("  \n", " ")
            return [f"{'#' * level} {body}"] if body else []
        if n.tag == "pre":
            return [self.fence(n)]
        if n.tag == "hr":
            return ["* * *"]
        if n.tag in ("ul", "ol", "menu", "dir"):
            return [x] if (x := (yield self.list(n))) else []
        if n.tag == "table":
            return [x] if (x := (yield self.table(n))) else []
        if n.tag == "blockquote":
            body = "\n\n".join((yield self.blocks(n.children)))
            return ["\n".join(f"> {x}".rstrip() for x in body.split("\n"))] if body else []
        return (yield self.blocks(n.children))

    def fence(self, n: Node) -> str:
        code = n.first("code") or n
        names = f"{code.attrs.get('class', '')} {n.attrs.get('class', '')}".split()
        language = next((x.split("-", 1)[1] for x in names if x.startswith(("language-", "lang-"))), "")
        body = n.text().strip("\n")
        ticks = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", body)), default=0))
        return f"{ticks}{language}\n{body}\n{ticks}"

    def list(self, n: Node) -> Generator:
        try:
            number = int(n.attrs.get("start", "1"))
        except ValueError:
            number = 1
        items = []
        for c in n.children:
            if not isinstance(c, Node):
                continue
            mark = f"{number}. " if n.tag == "ol" else "- "
            number += 1
            inner = yield self.blocks(c.children if c.tag == "li" else [c])
            tight = all(not isinstance(x, Node) or x.tag != "p" for x in c.children)
            body = ("\n" if tight else "\n\n").join(inner)
            lines = body.split("\n")
            items.append(mark + "\n".join([lines[0], *[" " * len(mark) + x if x else "" for x in lines[1:]]]))
        return "\n".join(items)

    def table(self, n: Node) -> Generator:
        rows = []
        stack: list[Node] = [n]
        while stack:
            r = stack.pop()
            # A row may stand in a row whose end was left out; a table in a cell has rows of its own.
            stack += [c for c in reversed(r.children) if isinstance(c, Node) and (c.tag != "table" or r is n)]
            if r.tag == "tr":
                cells = []
                for c in r.children:
                    if isinstance(c, Node) and c.tag in ("td", "th"):
                        cells.append((yield self.paragraph(c.children)).replace("  \n", "<br>").replace("|", "\\|"))
                rows.append(cells)
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
        return "\n".join([line(rows[0]), "|" + "---|" * width, *map(line, rows[1:])])


_FENCE_LINE = re.compile(r"(?m)^\s*```.*$")


def to_markdown(page: str, url: str) -> tuple[str, str, str] | None:
    """(title, canonical URL, Markdown) of a page; None for one without content."""
    if not (page or "").strip():
        return None
    root = tree(page)
    title, canonical = title_of(root), canonical_of(root, url)
    strip_chrome(root)
    body = "\n\n".join(call(_Markdown(url, root).blocks(content_root(root).children))).strip("\n") + "\n"
    if not _FENCE_LINE.sub("", body).strip():
        return None
    return title, canonical, body


def links_of(page: str, url: str) -> list[str]:
    """Normalised targets of all links in page order, repeats kept; unsupported ones left out."""
    from ..functions.urls import UnsupportedUrl, normalize

    out = []
    for n in tree(page or "").walk():
        if n.tag == "a" and "href" in n.attrs:
            try:
                out.append(normalize(n.attrs["href"], url))
            except UnsupportedUrl:
                continue
    return out


def document_hash(markdown: str) -> str:
    lines = "\n".join(x.rstrip(" \t") for x in markdown.split("\n"))
    return hashlib.sha256(lines.strip().encode("utf-8", "surrogatepass")).hexdigest()


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html", content_type: str | None = None) -> DataFrame:
    """(document_id, url, canonical_url, title, markdown, content_hash); pages without content are skipped.

    A row without a URL fails the job: its document would have no identity.
    """
    if content_type:
        pages = pages.where(is_document_type(content_type))
    named = F.when(F.trim(C.text(url)) != "", F.col(url)).otherwise(F.raise_error(F.lit("page has no URL")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if found := to_markdown(h or "", u):
                    rows.append((u, found[1], found[0], found[2]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["url", "canonical_url", "title", "markdown"])

    parsed = spread(pages.select(named.alias("url"), F.col(html).alias("html"))).mapInArrow(run, "url string, canonical_url string, title string, markdown string")
    return parsed.select(C.short_sha("url").alias("document_id"), "url", "canonical_url", "title", "markdown", C.document_hash("markdown").alias("content_hash"))


def link_lists(pages: DataFrame, url: str = "url", html: str = "html", kept: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, url, links): every page's links, one row a page however many have its URL; null for a null page."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if h is None else links_of(h, u or "") for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], b.column(0), pa.array(found, pa.list_(pa.string()))], [*kept, "url", "links"])

    schema = "".join(f"`{k}` {kinds[k]}, " for k in kept) + "url string, links array<string>"
    return spread(pages.select(F.col(url).alias("url"), F.col(html).alias("html"), *kept)).mapInArrow(run, schema)


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, position, link) of every link of every page."""
    return link_lists(pages, url, html).select("url", F.posexplode("links").alias("position", "link"))
