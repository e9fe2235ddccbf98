"""Which library does a name refer to: deterministic lexical scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# Scores by how a name agrees.
EXACT, UNVERSIONED, VERSION, PREFIX, CONTAINS, DESCRIBED = 1000, 20, 200, 600, 400, 100
NAME_WORD, DESCRIPTION_WORD = 10, 3


class LibraryNotFound(LookupError):
    """No library of that id, or none of it is indexed."""


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def overlap(name: Column, description: Column, asked: Column) -> Column:
    """Points of the query's words, repeats included, found in the name or else in the description."""
    own, other = C.words(name), C.words(description)
    return _sum(F.transform(asked, lambda w: F.when(F.array_contains(own, w), NAME_WORD).when(F.array_contains(other, w), DESCRIPTION_WORD).otherwise(0)))


def library_score(name: Column, description: Column, version: Column, target: Column, query: Column) -> Column:
    """Score of a library for a target name and query; null where it is no candidate."""
    own, want, asked = C.normal_name(name), C.normal_name(target), C.words(query)
    points = overlap(name, description, asked)
    described = _sum(F.transform(asked, lambda w: F.array_contains(C.words(description), w).cast("int")))
    mention = C.version_mention(query)
    versioned = F.when(C.text(version) == "", UNVERSIONED).otherwise(0) + F.when((mention != "") & (version == mention), VERSION).otherwise(0)
    return (
        F.when(own == want, EXACT + versioned + points)
        .when(F.startswith(own, want) | F.startswith(want, own), PREFIX + points)
        .when(F.contains(own, want) | F.contains(want, own), CONTAINS + points)
        .when(described > 0, DESCRIBED + described)
    )


def with_counts(libraries: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Libraries with indexed_chunks; only indexed ones, unless nothing at all is indexed."""
    if counts is None or counts.isEmpty():
        return libraries.withColumn("indexed_chunks", F.lit(0).cast("long"))
    per = counts.groupBy("library_id").agg(F.sum("chunks").alias("indexed_chunks"))
    return libraries.join(per, "library_id").where("indexed_chunks > 0")


def resolve(libraries: DataFrame, name: str, query: str, counts: DataFrame | None = None) -> DataFrame:
    """Matching libraries with their score, the best first.

    ``libraries`` has library_id, name, version, description, base_url; ``counts`` has library_id and
    chunks. A name that begins with a slash is an exact id: it is found, or that is an error.
    """
    name = name.strip()
    if not name:
        raise ValueError("a library name is required")
    known = with_counts(libraries, counts)
    if name.startswith("/"):
        found = known.where(F.col("library_id") == name)
        if found.isEmpty():
            raise LibraryNotFound(name)
        return found.withColumn("score", F.lit(None).cast("int"))
    score = library_score(F.col("name"), F.col("description"), F.col("version"), F.lit(name), F.lit(query))
    return known.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "library_id")


def siblings(matches: DataFrame) -> DataFrame:
    """(library_id, others): other ids of the same name, the greatest first; ids without others left out.

    The ids of a name are gathered once and joined back, so work grows with the ids and not their pairs.
    """
    names = matches.groupBy("name").agg(F.sort_array(F.collect_set("library_id"), asc=False).alias("ids")).where(F.size("ids") > 1)
    rows = matches.select("library_id", "name").distinct().join(names, "name")
    return rows.select("library_id", F.filter("ids", lambda x: x != F.col("library_id")).alias("others"))
