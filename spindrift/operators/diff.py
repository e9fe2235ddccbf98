"""Incremental reconciliation of a chunk table, counts, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

WATCHED = ("content_hash", "title", "heading_path")


def one_of_each(chunks: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row of each key: the first by ``order``."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return chunks.withColumn("__first", first).where("__first = 1").drop("__first")


def diff(new: DataFrame, old: DataFrame, key: str = "chunk_id", watched: tuple[str, ...] = WATCHED) -> DataFrame:
    """(key, status): unchanged, updated, added or removed. One full outer join on the key."""
    n = new.select(F.col(key), F.struct(*watched).alias("n"))
    o = old.select(F.col(key), F.struct(*watched).alias("o"))
    same = F.col("n").eqNullSafe(F.col("o"))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return n.join(o, key, "full_outer").select(key, status.alias("status"))


def report(statuses: DataFrame, fetched: int = 0, skipped: int = 0) -> DataFrame:
    """One row of counters of a sync."""
    n = lambda s: F.count_if(F.col("status") == s)
    row = statuses.agg(n("added").alias("added"), n("updated").alias("updated"), n("unchanged").alias("unchanged"), n("removed").alias("removed"))
    return row.select(
        F.lit(fetched + skipped).cast("long").alias("discovered"),
        F.lit(fetched).cast("long").alias("fetched"),
        F.lit(skipped).cast("long").alias("skipped"),
        (F.col("added") + F.col("updated")).alias("indexed"),
        "added",
        "updated",
        "unchanged",
        "removed",
    )


def apply(old: DataFrame, changed: DataFrame, statuses: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The next snapshot: old rows that stay, and of ``changed`` the rows that were added or updated."""
    gone = statuses.where(F.col("status") != "unchanged").select(key)
    wanted = statuses.where(F.col("status").isin("added", "updated")).select(key)
    return old.join(gone, key, "left_anti").unionByName(changed.join(wanted, key, "left_semi").select(*old.columns))


def library_counts(chunks: DataFrame) -> DataFrame:
    """(library_id, chunks, pages): chunks and distinct non-empty page URLs of each library."""
    return chunks.groupBy("library_id").agg(F.count("*").alias("chunks"), F.count_distinct(F.when(C.text("url") != "", F.col("url"))).alias("pages"))


def retrieval_metrics(ranks: DataFrame, rank: Column | str = "rank") -> DataFrame:
    """Top-1, -3, -5, MRR and recall at 5 of a table with one row a query; a null rank is a miss."""
    r = C.col(rank)
    hit = lambda k: F.avg(F.when(r <= k, 1.0).otherwise(0.0))
    return ranks.agg(
        F.count("*").alias("queries"), hit(1).alias("top1"), hit(3).alias("top3"), hit(5).alias("top5"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), hit(5).alias("recall5")
    )


def topic_recall(hits: DataFrame, wanted: DataFrame, k: int = 20) -> DataFrame:
    """Recall of topics: for ranked hits (query_id, topic, rank) and wanted (query_id, topic)."""
    first = hits.where(F.col("rank") <= k).groupBy("query_id", "topic").agg(F.min("rank").alias("rank"))
    return wanted.join(first, ["query_id", "topic"], "left").select("query_id", "topic", "rank")


def gold_metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5), depth: int = 20) -> DataFrame:
    """Accuracy on the one page that answers a query: top-k shares and MRR of its first place.

    ``hits`` is (query_id, url, rank), ``gold`` is (query_id, url), one row a query; a page that is not
    among the first ``depth`` is a miss.
    """
    first = hits.where(F.col("rank") <= depth).groupBy("query_id", "url").agg(F.min("rank").alias("rank"))
    ranks = gold.join(first, ["query_id", "url"], "left")
    hit = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"top{k}") for k in ks]
    return ranks.agg(F.count("*").alias("queries"), *hit, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
