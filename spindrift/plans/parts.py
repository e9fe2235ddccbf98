"""What a library is put together from; each part can be another one of the same shape.

All of them take and give tables: a part declares a transformation, and Spark runs it.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..sources.web import Fetcher, Robots


class Crawler(Protocol):
    """Pages (url, html) that can be reached from ``start``."""

    def __call__(self, spark: SparkSession, pages: DataFrame | Fetcher, start: str, includes: list[str], excludes: list[str], robots: Robots | None, sitemap: list[str], **limits: int) -> DataFrame: ...


class Parser(Protocol):
    """Documents (document_id, url, canonical_url, title, markdown) of pages; pages without content give none."""

    def __call__(self, pages: DataFrame) -> DataFrame: ...


class Chunker(Protocol):
    """Chunks, with ``page_url``, of documents."""

    def __call__(self, documents: DataFrame, source_id: str, library_id: str, version: str) -> DataFrame: ...


class Chunks(Protocol):
    """Where chunks are kept; a commit on a version that another has overtaken on the same libraries fails."""

    @property
    def identity(self) -> str: ...

    @property
    def version(self) -> int: ...

    def read(self, library_id: str = "") -> DataFrame: ...

    def lexical(self, library_id: str, query: str) -> DataFrame: ...

    def commit(self, chunks: DataFrame, identity: str | None = None, libraries: list[str] | None = None, base: int | None = None) -> int: ...

    def delete_source(self, source_id: str) -> int: ...
