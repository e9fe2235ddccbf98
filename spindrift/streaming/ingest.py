"""Page batches as a stream: changed pages are parsed, chunked, embedded and upserted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..operators import diff, embed
from ..operators.chunking import chunk
from ..operators.html_markdown import parse_pages
from ..session import settle
from ..sources.store import ChunkStore, Source


def latest(pages: DataFrame, time: str = "fetched_at", delay: str = "1 hour") -> DataFrame:
    """A page stream without repeats of (url, content) inside the watermark."""
    hashed = pages.withColumn("page_hash", F.sha2(C.text("html"), 256))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url", "page_hash"])


def apply_batch(store: ChunkStore, source: Source, provider: embed.Provider, pages: DataFrame) -> dict:
    """Upsert one batch of pages of a library. Chunks that a page of the batch no longer has go.

    Vectors of another identity than the index's are refused before anything is fetched or embedded.
    Pages that are not in the batch keep their chunks: what has left the site is for a full sync.
    """
    recorded, base = store.identity, store.version
    if recorded and not embed.compatible(recorded, provider):
        raise embed.IdentityMismatch(f"index has {recorded}, provider is {embed.identity(provider)}")
    one = settle(diff.one_of_each(pages.select("url", "html"), "url", ("html",)))
    new = settle(diff.one_of_each(chunk(parse_pages(one), source.id, source.library_id, source.version), order=("page_url", "document_id")))
    # Of all pages of the batch, also of those that have become empty.
    whole = store.read(source.library_id)
    mine = whole.join(one.select(C.short_sha("url").alias("document_id")), "document_id", "left_semi")
    statuses = settle(diff.diff(new, mine))
    wanted = statuses.where(F.col("status").isin("added", "updated")).select("chunk_id")
    changed = settle(embed.embed(new.join(wanted, "chunk_id", "left_semi"), C.embedding_text("title", "heading_path", "content"), provider))
    width = (embed.parse_identity(recorded, provider) or 0) if recorded else provider.dims
    if not changed.where(~C.is_valid_vector("embedding", width or None)).isEmpty():
        raise embed.EmbeddingError("a chunk has no valid vector")
    if not statuses.where(F.col("status") != "unchanged").isEmpty():
        first = changed.select(F.size("embedding")).take(1)
        store.commit(diff.apply(whole, changed, statuses), embed.identity(provider, first[0][0]) if first else recorded, [source.library_id], base)
    return diff.report(statuses).first().asDict()


def stream(pages: DataFrame, store: ChunkStore, source: Source, provider: embed.Provider, checkpoint: str) -> StreamingQuery:
    """Start the stream (url, html, ...). A batch that is run again finds nothing changed."""
    return pages.writeStream.foreachBatch(lambda batch, _: apply_batch(store, source, provider, batch)).option("checkpointLocation", checkpoint).start()
