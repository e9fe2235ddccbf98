"""The verbs of a documentation library: add, sync, remove, reindex, list, info, resolve, query."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.urls import base_url
from ..operators import diff, embed
from ..operators.chunking import chunk
from ..operators.html_markdown import parse_pages
from ..operators.resolve import LibraryNotFound, resolve, siblings
from ..operators.retrieval import DENSE_K, FINAL, search
from ..session import settle
from ..sources.store import ChunkStore, Registry, Source, new_library_id, parse_library_id
from ..sources.web import Fetcher, Robots, crawl, discover
from .parts import Chunker, Chunks, Crawler, Parser

IdentityMismatch = embed.IdentityMismatch
NO_MATCH = "No indexed libraries match that name."
NO_RESULT = "No documentation matches that query."
# Other names that callers use for an argument.
ALIASES = {
    "libraryId": ("libraryID", "library_ID", "sourceId", "sourceID", "source_id"),
    "libraryName": ("libraryID", "libraryId", "library"),
    "query": ("userQuery", "user_query", "q"),
}


class Library:
    """One data folder: its registry, its chunk table, one embedding provider; its other parts can be replaced."""

    def __init__(
        self, spark: SparkSession, folder: str, provider: embed.Provider | None = None, candidates: int = DENSE_K, final: int = FINAL,
        crawler: Crawler = crawl, parser: Parser = parse_pages, chunker: Chunker = chunk, store: Chunks | None = None, **limits: int,
    ) -> None:
        self.spark, self._provider, self.candidates, self.final, self.limits = spark, provider, candidates, final, limits
        self.crawler, self.parser, self.chunker = crawler, parser, chunker
        self.store, self.registry = store or ChunkStore(spark, f"{folder.rstrip('/')}/chunks"), Registry(spark, folder)

    @property
    def provider(self) -> embed.Provider:
        """The one that was given, else the default one, looked for when it is first needed."""
        self._provider = self._provider or embed.default()
        return self._provider

    @provider.setter
    def provider(self, provider: embed.Provider) -> None:
        self._provider = provider

    # ------------------------------------------------------------ writing

    def _guard(self) -> None:
        recorded = self.store.identity
        if recorded and not embed.compatible(recorded, self.provider):
            raise embed.IdentityMismatch(f"index has {recorded}, provider is {embed.identity(self.provider)}")

    def sync(self, library_id: str, pages: DataFrame | Fetcher, robots: Robots | None = None, sitemap: list[str] = ()) -> dict:
        """Bring a library's chunks up to date with the pages; only what changed is embedded.

        Everything up to the commit is one plan; a failure before it leaves the old table.
        """
        self._guard()
        source = self.registry.get(library_id)
        fetched = settle(self._crawl(source, pages, robots, list(sitemap)))
        n = fetched.count()
        report = self._ingest(source, fetched, n)
        self.registry.update(replace(source, synced_at=datetime.now(UTC).isoformat()))
        return report

    def _crawl(self, source: Source, pages: DataFrame | Fetcher, robots: Robots | None = None, sitemap: list[str] = ()) -> DataFrame:
        if robots is None and not isinstance(pages, DataFrame):
            robots, sitemap = discover(source.base_url)
        return self.crawler(self.spark, pages, source.base_url, source.includes, source.excludes, robots, list(sitemap), **self.limits)

    def _ingest(self, source: Source, fetched: DataFrame, n: int) -> dict:
        documents = self.parser(fetched)
        # Of pages with one canonical URL, the one of the smallest page URL gives the chunks.
        new = settle(diff.one_of_each(self.chunker(documents, source.id, source.library_id, source.version), order=("page_url", "document_id")))
        base = self.store.version
        mine = self.store.read(source.library_id)
        # The statuses are settled, so that the provider is asked once for each changed chunk.
        statuses = settle(diff.diff(new, mine))
        wanted = statuses.where(F.col("status").isin("added", "updated")).select("chunk_id")
        text = C.embedding_text("title", "heading_path", "content")
        changed = settle(embed.embed(new.join(wanted, "chunk_id", "left_semi"), text, self.provider))
        bad = changed.where(~C.is_valid_vector("embedding", self._width() or None)).limit(1).collect()
        if bad:
            raise embed.EmbeddingError(f"chunk {bad[0]['chunk_id']} has no valid vector")
        width = changed.select(F.size("embedding")).take(1)
        identity = embed.identity(self.provider, width[0][0]) if width else self.store.identity
        if identity != self.store.identity or not statuses.where(F.col("status") != "unchanged").isEmpty():
            self.store.commit(diff.apply(mine, changed, statuses), identity, [source.library_id], base)
        pages_with_text = new.select("document_id").distinct().count()
        return diff.report(statuses, pages_with_text, n - pages_with_text).first().asDict()

    def _width(self) -> int:
        return (embed.parse_identity(self.store.identity, self.provider) or 0) if self.store.identity else self.provider.dims

    def add(self, name: str, url: str, pages: DataFrame | Fetcher, version: str = "", description: str = "", includes: list[str] = (), excludes: list[str] = ()) -> dict:
        """Register and sync; a crawl that finds no page is an error and leaves no trace."""
        source = Source(new_library_id(name, version), name, base_url(url), version, description, list(includes), list(excludes))
        self.registry.add(source)
        try:
            report = self.sync(source.library_id, pages)
            if not report["discovered"]:
                raise LookupError(f"{url}: no page was fetched")
            return report
        except Exception:
            self.registry.delete(source.library_id)
            raise

    def remove(self, library_id: str) -> None:
        source = self.registry.get(library_id)
        self.store.delete_source(source.id)
        self.registry.delete(library_id)

    def reindex(self, library_id: str, pages: DataFrame | Fetcher) -> dict:
        """Build a library's chunks anew, with another kind of vector only if no other library has any.

        The swap is the last step: if anything fails, the old chunks are still there.
        """
        source = self.registry.get(library_id)
        base = self.store.version
        others = self.store.read().where(F.col("source_id") != source.id)
        if others.isEmpty():
            width = 0
        else:
            self._guard()
            width = self._width()
        fetched = settle(self._crawl(source, pages))
        new = diff.one_of_each(self.chunker(self.parser(fetched), source.id, source.library_id, source.version), order=("page_url", "document_id"))
        vectors = settle(embed.embed(new, C.embedding_text("title", "heading_path", "content"), self.provider))
        if not vectors.where(~C.is_valid_vector("embedding", width or self.provider.dims or None)).isEmpty():
            raise embed.EmbeddingError("a chunk has no valid vector")
        first = vectors.select(F.size("embedding")).take(1)
        self.store.commit(vectors.select(*others.columns), embed.identity(self.provider, first[0][0]) if first else None, [source.library_id], base)
        return {"indexed": vectors.count()}

    # ------------------------------------------------------------ reading

    def counts(self) -> DataFrame:
        return diff.library_counts(self.store.read())

    def list(self) -> DataFrame:
        return self.registry.table().join(self.counts(), "library_id", "left").na.fill(0, ["chunks", "pages"]).orderBy("library_id")

    def find(self, name: str) -> Source:
        """A library by id or by a name that only one has."""
        if name.startswith("/"):
            return self.registry.get(name)
        found = [s for s in self.registry.list() if s.name.lower() == name.strip().lower()]
        if len(found) != 1:
            raise LookupError(f"{name}: " + (", ".join(s.library_id for s in found) or "unknown"))
        return found[0]

    def resolve(self, name: str, query: str = "") -> DataFrame:
        return resolve(self.registry.table(), name, query, self.counts())

    def query(self, library_id: str, query: str, final: int | None = None) -> DataFrame:
        """The sections of an indexed library that answer a query, at most ``final``, or the library's own number."""
        version = parse_library_id(library_id)[2]
        chunks = self.store.read(library_id)
        if chunks.isEmpty():
            raise LibraryNotFound(f"{library_id} is not indexed")
        vector = embed.check(self.provider.embed([query]), 1, self._width())[0]
        return search(chunks, query, vector, library_id, version, self.final if final is None else final, self.candidates, self.store.lexical(library_id, query))


# ---------------------------------------------------------------- the two tools, as text


def argument(arguments: dict, name: str) -> str:
    """A required argument under its own name or, in order, one of its aliases."""
    for key in (name, *ALIASES.get(name, ())):
        value = arguments.get(key)
        if isinstance(value, str) and value.strip():
            return value.strip()
    raise ValueError(f"{name} is required")


def format_sections(hits: DataFrame) -> str:
    """Sections as Markdown with their source and library; never ids or scores. At most a few rows."""
    rows = hits.select("position", C.heading_label("heading_path", "title", "url").alias("heading"), "url", "library_id", "content").orderBy("position").collect()
    return "\n---\n\n".join(f"### {r.heading}\n\nSource: {r.url}\nLibrary: {r.library_id}\n\n{r.content}\n" for r in rows)


def format_libraries(matches: DataFrame) -> str:
    rows = matches.collect()
    if not rows:
        return NO_MATCH
    others = {r.library_id: r.others for r in siblings(matches).collect()}
    out = ["Available Libraries:\n"]
    for r in rows:
        lines = [f"- Library ID: {r.library_id}", f"  Name: {r.name}"]
        if r.description:
            lines.append(f"  Description: {r.description}")
        lines.append(f"  Indexed Chunks: {r.indexed_chunks}")
        if more := others.get(r.library_id):
            lines += ["  Versions:", *[f"    - {x}" for x in more]]
        out.append("\n".join(lines) + "\n")
    return "\n".join(out).rstrip("\n")


TOOLS = {"resolve-library-id": ("libraryName", "query"), "query-docs": ("libraryId", "query")}


def call_tool(library: Library, tool: str, arguments: dict) -> tuple[str, bool]:
    """(text, whether it is an error) of one of the two read-only tools; errors are answers too."""
    try:
        first, query = (argument(arguments, n) for n in TOOLS[tool])
        if tool == "resolve-library-id":
            return format_libraries(library.resolve(first, query)), False
        parse_library_id(first)
        return format_sections(library.query(first, query)) or NO_RESULT, False
    except (LookupError, ValueError, RuntimeError) as e:
        return str(e), True
