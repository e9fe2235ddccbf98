"""Web sources: sitemaps, robots rules, a page reader, and a crawl in breadth-first levels."""

from __future__ import annotations

import gzip
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import columns as C
from ..functions import urls as U
from ..operators.html_markdown import extract_links
from ..session import settle

AGENT = "spindrift"
# Limits of one crawl.
MAX_PAGES, MAX_DEPTH, CONCURRENCY = 1000, 20, 4
TIMEOUT, BODY_BYTES, REDIRECTS = 20, 10 << 20, 10

PAGE_SCHEMA = "url string, status int, content_type string, html string, etag string, last_modified string, not_modified boolean"


class FetchError(OSError):
    """A page that could not be had whole."""


# ---------------------------------------------------------------- sitemaps


def sitemap_entries(xml: Column | str, root: str = "urlset") -> Column:
    """array<struct<loc, lastmod>> of a urlset, or of a sitemapindex; entries without a loc left out.

    Null where the text is not well-formed XML with that root. Namespaces are set aside.
    """
    item = {"urlset": "url", "sitemapindex": "sitemap"}[root]
    clean = F.regexp_replace(F.regexp_replace(C.text(xml), r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", ""), r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')|\s\w+:\w+\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    body = F.regexp_replace(clean, r"<(/?)\w+:", "<$1")
    whole = F.trim(body).rlike(rf"(?s)^<{root}[\s>/].*(</{root}\s*>|/>)\s*$") & _balanced(body, item) & _balanced(body, "loc")
    items = F.regexp_extract_all(body, F.lit(rf"(?s)<{item}(?:\s[^>]*)?>(.*?)</{item}\s*>"), F.lit(1))
    tag = lambda x, t: _entities(F.trim(F.regexp_extract(x, rf"(?s)<{t}(?:\s[^>]*)?>(.*?)</{t}\s*>", 1)))
    rows = F.transform(items, lambda x: F.struct(tag(x, "loc").alias("loc"), tag(x, "lastmod").alias("lastmod")))
    return F.when(whole, F.filter(rows, lambda r: r["loc"] != ""))


def _balanced(body: Column, name: str) -> Column:
    return F.regexp_count(body, F.lit(rf"<{name}[\s>]")) == F.regexp_count(body, F.lit(rf"</{name}\s*>"))


def _entities(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(c)


def parse_sitemap(xml: bytes | str, root: str = "urlset") -> list[tuple[str, str]]:
    """The same for one document; a wrong root or broken XML is an error."""
    tree = ElementTree.fromstring(xml)
    local = lambda t: t.rsplit("}", 1)[-1]
    if local(tree.tag) != root:
        raise ValueError(f"expected {root}, not {local(tree.tag)}")
    rows = [{local(c.tag): (c.text or "").strip() for c in e} for e in tree]
    return [(r["loc"], r.get("lastmod", "")) for r in rows if r.get("loc")]


def looks_like_sitemap(body: Column | str) -> Column:
    return F.lower(F.substring(C.text(body), 1, 200)).rlike("<(urlset|sitemapindex)")


def sitemap_candidates(base: str, robots: str = "") -> list[str]:
    """Where sitemaps may be: those that robots.txt names, else the two usual places."""
    named = [m.strip() for m in re.findall(r"(?im)^\s*sitemap\s*:\s*(\S+)", robots)]
    p = urlsplit(base)
    return named or [f"{p.scheme}://{p.netloc}/{n}" for n in ("sitemap.xml", "sitemap_index.xml")]


# ---------------------------------------------------------------- robots


@dataclass
class Robots:
    rules: list[tuple[bool, str]] = field(default_factory=list)  # (allow, path pattern)
    delay: float = 0.0

    def allows(self, path: str) -> bool:
        """The longest pattern that matches decides; allow wins between equal ones; no match allows."""
        hits = [(len(p), allow) for allow, p in self.rules if re.match(robots_regex(p), path or "/")]
        return max(hits, default=(0, True))[1]


def robots_regex(pattern: str) -> str:
    end = pattern.endswith("$")
    return "^" + ".*".join(re.escape(x) for x in pattern.rstrip("$" if end else "").split("*")) + ("$" if end else "")


def parse_robots(text: str, agent: str = AGENT) -> Robots:
    """Rules of the group that names the agent, else of *; what cannot be read allows all."""
    groups: dict[str, Robots] = {}
    names: list[str] = []
    fresh = True
    for line in (text or "").splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            names = [value.lower()] if not fresh or not names else [*names, value.lower()]
            fresh = True
            for n in names:
                groups.setdefault(n, Robots())
        elif key in ("allow", "disallow", "crawl-delay") and names:
            fresh = False
            for n in names:
                if key == "crawl-delay":
                    groups[n].delay = float(value) if re.fullmatch(r"\d+(\.\d+)?", value) else 0.0
                elif value:
                    groups[n].rules.append((key == "allow", value))
    own = [n for n in groups if n != "*" and n in agent.lower()]
    return groups[max(own, key=len)] if own else groups.get("*", Robots())


def robots_allowed(path: Column, robots: Robots) -> Column:
    """``Robots.allows`` as an expression over a path column."""
    p = F.when(path == "", "/").otherwise(path)
    hits = [F.when(p.rlike(robots_regex(pattern)), F.struct(F.lit(len(pattern)).alias("n"), F.lit(allow).alias("allow"))) for allow, pattern in robots.rules]
    if not hits:
        return F.lit(True)
    best = F.array_max(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return F.coalesce(best["allow"], F.lit(True))


# ---------------------------------------------------------------- pages over HTTP


def fetch(url: str, etag: str = "", modified: str = "", agent: str = AGENT, timeout: float = TIMEOUT, most: int = BODY_BYTES, opener: Callable | None = None) -> dict:
    """One page: text in its own character set, final URL; a redirect to another site is an error."""

    class Guard(urllib.request.HTTPRedirectHandler):
        max_redirections = REDIRECTS

        def redirect_request(self, req, fp, code, msg, headers, newurl):
            old, new = urlsplit(req.full_url), urlsplit(newurl)
            if (old.scheme, old.netloc.lower()) != (new.scheme, new.netloc.lower()):
                raise FetchError(f"redirect from {old.netloc} to {new.netloc}")
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    headers = {"User-Agent": agent} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
    request = urllib.request.Request(U.normalize(url), headers=headers)
    try:
        answer = (opener or urllib.request.build_opener(Guard).open)(request, timeout=timeout)
    except urllib.error.HTTPError as e:
        if e.code != 304:
            raise FetchError(f"{url}: status {e.code}") from e
        return {"url": url, "status": 304, "content_type": "", "html": "", "etag": etag, "last_modified": modified, "not_modified": True}
    with answer:
        body = answer.read(most + 1)
        if len(body) > most:
            raise FetchError(f"{url}: more than {most} bytes")
        if answer.headers.get("Content-Encoding") == "gzip":
            body = gzip.decompress(body)
        kind = answer.headers.get("Content-Type", "")
        named = re.search(r"charset=[\"']?([\w-]+)", kind) or re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", body[:1024])
        charset = (named[1].decode() if isinstance(named[1], bytes) else named[1]) if named else "utf-8"
        try:
            text = body.decode(charset, "replace")
        except LookupError:
            text = body.decode("utf-8", "replace")
        return {"url": answer.geturl(), "status": answer.status, "content_type": kind, "html": text, "etag": answer.headers.get("ETag", ""), "last_modified": answer.headers.get("Last-Modified", ""), "not_modified": False}


def discover(base: str, agent: str = AGENT, opener: Callable | None = None) -> tuple[Robots, list[str]]:
    """(robots rules, sitemap URLs) of a site; what cannot be had or read counts as not there.

    An index is followed one level down, on the driver: a site has few sitemap files.
    """

    def get(url: str) -> str:
        try:
            return fetch(url, agent=agent, opener=opener)["html"]
        except (OSError, ValueError):
            return ""

    p = urlsplit(base)
    text = get(f"{p.scheme}://{p.netloc}/robots.txt")
    found: list[str] = []
    for candidate in sitemap_candidates(base, text):
        body = get(candidate)
        if not re.search("<(urlset|sitemapindex)", body[:200].lower()):
            continue
        try:
            index = "<sitemapindex" in body[:200].lower()
            bodies = [get(loc) for loc, _ in parse_sitemap(body, "sitemapindex")] if index else [body]
            for b in bodies:
                found += [loc for loc, _ in parse_sitemap(b)] if b else []
        except (ValueError, ElementTree.ParseError):
            continue
        break
    usable = []
    for u in dict.fromkeys(found):
        try:
            usable.append(U.normalize(u))
        except U.UnsupportedUrl:
            continue
    return parse_robots(text, agent), usable


def refetch(known: DataFrame, agent: str = AGENT, concurrency: int = CONCURRENCY, timeout: float = TIMEOUT, most: int = BODY_BYTES, opener: Callable | None = None) -> DataFrame:
    """Pages of ``known`` (url, etag, last_modified) asked for again, by what is known of them: PAGE_SCHEMA.

    A page that is unchanged comes back without text and says so; one that can't be had has no row.
    """
    names = [f.split(" ")[0] for f in PAGE_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for url, etag, modified in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    page = fetch(url, etag or "", modified or "", agent, timeout, most, opener)
                except (OSError, ValueError):
                    continue
                got.append(tuple(page[k] for k in names))
            columns = list(zip(*got, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return known.select("url", "etag", "last_modified").repartition(concurrency).mapInArrow(run, PAGE_SCHEMA)


class WebPages(DataSource):
    """``spark.read.format("web_pages").option("urls", "a b c").load()``: pages read by the executors."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = options.get("urls", "").split()
        self.parts = int(options.get("concurrency", CONCURRENCY))
        self.agent = options.get("agent", AGENT)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[i :: self.parts]) for i in range(min(self.parts, len(self.urls)) or 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.value:
            try:
                page = fetch(url, agent=self.agent)
            except (OSError, ValueError):
                continue  # one lost page does not end a crawl
            yield tuple(page[k] for k in ("url", "status", "content_type", "html", "etag", "last_modified", "not_modified"))


# ---------------------------------------------------------------- crawl

Fetcher = Callable[[DataFrame], DataFrame]  # (link) to (link, url, html)


def from_table(pages: DataFrame) -> Fetcher:
    """Pages that are there already: one row a URL, the first of each normal form."""
    kind = [c for c in pages.columns if c == "content_type"]
    rows = pages.select(U.normalized("url").alias("link"), "url", "html", *kind).where("link is not null")
    if kind:
        rows = rows.where(U.is_document_type("content_type"))
    first = rows.groupBy("link").agg(F.min_by(F.struct("url", "html"), "url").alias("p")).select("link", "p.url", "p.html")
    return lambda frontier: first.join(frontier, "link", "left_semi")


def from_web(agent: str = AGENT, concurrency: int = CONCURRENCY, timeout: float = TIMEOUT, most: int = BODY_BYTES, rate: float = 0.0, opener: Callable | None = None) -> Fetcher:
    """Pages over HTTP, by as many tasks as may run at once; a lost page does not end the crawl.

    ``rate`` is how many requests a second all tasks make together; 0 sets no limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for link in b.column("link").to_pylist():
                if rate:
                    time.sleep(concurrency / rate)
                try:
                    page = fetch(link, agent=agent, timeout=timeout, most=most, opener=opener)
                except (OSError, ValueError):
                    continue
                if page["content_type"].split(";")[0].strip().lower() in ("", "text/html", "application/xhtml+xml"):
                    got.append((link, U.normalize(page["url"]), page["html"]))
            columns = list(zip(*got, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["link", "url", "html"])

    return lambda frontier: frontier.repartition(concurrency).mapInArrow(run, "link string, url string, html string")


def crawl(
    spark: SparkSession, pages: DataFrame | Fetcher, start: str, includes: list[str] = (), excludes: list[str] = (), robots: Robots | None = None,
    sitemap: list[str] | DataFrame = (), max_pages: int | None = MAX_PAGES, max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Pages (url, html) that a crawl reaches from ``start``, with the depth of each, by URL.

    ``pages`` is a table of what can be fetched or a fetcher. A level is one fetch of the frontier, its
    links, the scope filter and an anti join with what was seen. The start is in scope whatever the
    rules say, but not beyond robots; sitemap URLs (a list, or a table's first column) keep to both. If
    there are more than ``max_pages``, the first by depth and URL stay; None sets no limit.
    """
    robots = robots or Robots()
    get = from_table(pages) if isinstance(pages, DataFrame) else pages
    first = U.normalize(start)
    scope = U.in_scope("link", U.base_url(start) if urlsplit(start).path.strip("/") else first, list(includes), list(excludes))
    allowed = robots_allowed(U.path_of("link"), robots)
    if isinstance(sitemap, DataFrame):
        named = sitemap.select(U.normalized(sitemap.columns[0]).alias("link"), F.lit(False).alias("forced")).where("link is not null")
    else:
        named = spark.createDataFrame([(U.normalize(u), False) for u in sitemap], "link string, forced boolean")
    seeds = spark.createDataFrame([(first, True)], "link string, forced boolean").unionByName(named)
    seen, found, count = settle(seeds.where(allowed & (F.col("forced") | scope)).select("link").distinct()), None, 0
    frontier = seen
    for depth in range(max_depth + 1):
        level = settle(get(frontier).select("url", "html").withColumn("depth", F.lit(depth)))
        n = level.count()
        found = level if found is None else found.unionByName(level)
        count += n
        if not n or (max_pages is not None and count >= max_pages) or depth == max_depth:
            break
        links = extract_links(level.select("url", "html")).select("link").distinct()
        frontier = settle(links.where(scope & allowed).join(seen, "link", "left_anti"))
        seen = settle(seen.unionByName(frontier))
    if max_pages is not None:
        found = found.orderBy("depth", "url").limit(max_pages)
    return found.orderBy("url").select("url", "html", "depth")
