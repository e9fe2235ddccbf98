"""Retrieval over a chunk table: exact dense top-k, BM25, rank fusion, de-duplication, diversity.

Nothing here collects chunks. A top-k is a sort with a limit, which Spark runs as one bounded heap for
each partition; BM25 counts a chunk's terms where the chunk is read and shuffles only sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import bound_batches, settle, spread

DENSE_K, LEXICAL_K, FINAL = 20, 20, 6
RUN_CAP = 2
TILE, DIGITS, CLOSE = 512, 12, 1e-11  # rows compared at once; places of a distance; more than their rounding moves it
UNROLL = 160  # widest vector whose products are unrolled into the generated code

_IDENTIFIER = regex.compile(r"[\p{L}\p{Nd}._/-]+")
_INNER = regex.compile(r"[._/-]+")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
_WORDS = re.compile(r"[\w./-]+")


@lru_cache(1)
def _odd() -> frozenset[str]:
    """Characters that the fast pattern takes for letters or digits and the exact one does not, or the reverse."""
    return frozenset(chr(i) for i in range(128, sys.maxunicode + 1) if chr(i).isalnum() != (unicodedata.category(chr(i)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd")))


def identifiers(text: str) -> list[str]:
    """Runs of letters, digits and inner marks; by the fast pattern where both agree."""
    return _WORDS.findall(text) if text.isascii() or _odd().isdisjoint(set(text)) else _IDENTIFIER.findall(text)


def _terms(found: str) -> tuple[str, ...]:
    """The lower-case terms of one identifier: itself, its parts, its camel-case pieces."""
    whole = found.strip("._-")
    if not whole:
        return ()
    if whole.isalpha() and (whole.islower() or whole[1:].islower()):
        return (whole.lower(),)  # a plain word has no parts
    parts = [p for p in _INNER.split(whole) if p]
    return tuple({t.lower() for t in (whole, *parts, *(x for p in parts for x in _CAMEL.split(p) if x))})


_known_terms = lru_cache(1 << 16)(_terms)
LONG = 64  # characters from which an identifier is not remembered, so that what is remembered is bounded


def terms_of_identifier(found: str) -> tuple[str, ...]:
    return _known_terms(found) if len(found) < LONG else _terms(found)


def terms_of(text: str) -> Counter:
    """Lower-case identifiers, their parts and their camel-case pieces; each once per occurrence."""
    counts: Counter = Counter()
    get = counts.get
    for found, times in Counter(identifiers(text or "")).items():
        for t in terms_of_identifier(found):
            counts[t] = get(t, 0) + times
    return counts


# ---------------------------------------------------------------- scope and dense search


def scoped(chunks: DataFrame, source_id: str = "", library_id: str = "", version: str = "") -> DataFrame:
    """Chunks of a source, library and version; an empty value asks for nothing. Pushed to the scan."""
    want = {"source_id": source_id, "library_id": library_id, "version": version}
    clauses = [F.col(k) == v for k, v in want.items() if v]
    return chunks.where(reduce(lambda a, b: a & b, clauses)) if clauses else chunks


def dense_topk(chunks: DataFrame, vector: list[float], k: int = DENSE_K, key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """The k chunks nearest to a vector: all columns and ``score`` (cosine distance, less is better)."""
    if not vector:
        return chunks.withColumn("score", F.lit(1.0)).limit(0)
    k = k if k > 0 else 10
    near = C.cosine_distance_to(embedding, vector) if len(vector) <= UNROLL else C.cosine_distance(F.col(embedding), F.array(*[F.lit(float(x)) for x in vector]))
    return chunks.withColumn("score", near).orderBy("score", key).limit(k)


def dense_topk_batch(chunks: DataFrame, queries: DataFrame, k: int = DENSE_K, key: str = "chunk_id", embedding: str = "embedding", block: int = 1024) -> DataFrame:
    """Nearest chunks of every query (query_id, vector): (query_id, key, score, rank).

    The queries are the stated set; they go to the chunks in blocks. A task keeps the k best of each query
    over all its batches by partial selection in tiles of rows and sends them once, so what it holds is
    bounded by the block and the tile, what is shuffled by tasks, queries and k. Distances are rounded to
    DIGITS places and ties go to the lesser key.
    """
    bound_batches(chunks.sparkSession)
    ids, vectors = [], []
    for r in queries.select("query_id", "vector").orderBy("query_id").toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])

    spark = chunks.sparkSession

    def search(lo: int):
        own = np.array(vectors[lo : lo + block], np.float64)
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((own, ids[lo : lo + block]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, names = sent.value
            n = len(names)
            # The best of each query so far, as (query, distance, key), and how far its k-th is.
            best = (np.zeros(0, np.int64), np.zeros(0), None)
            limit = np.full(n, np.inf)
            for b in batches:
                if not b.num_rows or not n:
                    continue
                m = np.asarray(b.column("e").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m /= np.maximum(norm, 1e-300)
                every = b.column("k").to_numpy(zero_copy_only=False)
                for lo in range(0, len(m), TILE):
                    d = 1.0 - own @ m[lo : lo + TILE].T
                    d[:, norm[lo : lo + TILE].ravel() == 0] = 1.0
                    # What is not farther than the k-th nearest, ties and all, before the sort.
                    near = limit
                    if d.shape[1] > k and np.isinf(limit).any():
                        near = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
                    q, i = np.nonzero(d <= near[:, None] + CLOSE)
                    if not len(q):
                        continue
                    # Rounded, so that copies tie wherever they stand in a tile, and the key decides.
                    found = (q, np.round(d[q, i], DIGITS), every[lo + i])
                    q, far, keys = (np.concatenate(x) if best[2] is not None else x[1] for x in zip(best, found, strict=True))
                    order = np.lexsort((keys, far, q))
                    q, far, keys = q[order], far[order], keys[order]
                    start = np.searchsorted(q, np.arange(n))
                    kept = np.arange(len(q)) - start[q] < k
                    best = (q[kept], far[kept], keys[kept])
                    full = np.bincount(best[0], minlength=n) >= k
                    limit[full] = best[1][np.searchsorted(best[0], np.arange(n)[full], "right") - 1]
            if best[2] is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names)[best[0]]), pa.array(best[2]), pa.array(best[1])], ["query_id", "k", "score"])

        return run

    kinds = dict(chunks.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = f"query_id {kinds['query_id']}, k {kinds[key]}, score double"
    parts = [chunks.select(F.col(key).alias("k"), F.col(embedding).alias("e")).mapInArrow(search(lo), schema) for lo in range(0, max(1, len(ids)), block)]
    best = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "k"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("k", key)


# ---------------------------------------------------------------- lexical search


def lexical_text(title: str = "title", heading: str = "heading_path", content: str = "content") -> Column:
    return F.concat_ws("\n", C.text(title), C.text(heading), C.text(content))


POSTED = 1 << 18  # postings that go to Spark at once, and those of one row more
PART = 1 << 20  # bytes of text that are counted at once, and those of one text more
HELD = 1 << 20  # postings of which an index's lists are made
HELD_BYTES = 32 << 20  # bytes of terms and ids of which they are made, and those of one part more

_INSIDE = np.array([i >= 128 or chr(i).isalnum() or chr(i) in "._/-" for i in range(256)])
_EDGE = np.array([chr(i) in "._-" for i in range(256)])


@lru_cache(1 << 16)
def _separates(point: int) -> bool:
    return not _IDENTIFIER.fullmatch(chr(point))


def found_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, identifier without the marks at its ends) in the order of the texts: as ``identifiers``, told from the bytes."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _INSIDE[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):  # characters beyond ASCII, each kind of which is looked up once
        size = 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
        point = raw[lead].astype(np.int64) & (0xFF >> (size + 1))
        for j in (1, 2, 3):
            more = size > j
            point[more] = point[more] << 6 | (raw[lead[more] + j] & 0x3F)
        kinds, which = np.unique(point, return_inverse=True)
        apart = np.array([_separates(int(x)) for x in kinds])[which]
        lead, size = lead[apart], size[apart]
        for j in range(4):
            inside[lead[size > j] + j] = False
    bound = np.zeros(len(raw) + 1, bool)
    bound[ends] = True

    def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of a mask start and stop; none goes on from one text to the next."""
        first, last = mask.copy(), mask.copy()
        first[1:] &= ~mask[:-1] | bound[1:-1]
        last[:-1] &= ~mask[1:] | bound[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    start, stop = runs(inside)
    edge = _EDGE[raw]
    left, right = edge[start], edge[stop - 1]
    if left.any() or right.any():
        firsts, lasts = runs(inside & ~edge)
        low, high = np.append(firsts, len(raw)), np.insert(lasts, 0, 0)
        trimmed_start, trimmed_stop = start.copy(), stop.copy()
        trimmed_start[left] = np.minimum(low[np.searchsorted(firsts, start[left])], stop[left])
        trimmed_stop[right] = np.maximum(high[np.searchsorted(lasts, stop[right], "right")], start[right])
        some = trimmed_start < trimmed_stop
        start, stop = trimmed_start[some], trimmed_stop[some]
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, ends)))
    step = np.zeros(len(raw) + 1, np.int8)
    step[start] += 1
    step[stop] -= 1
    places = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    kept = raw[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    return row, pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(places), pa.py_buffer(kept)])


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(first text, number of texts, row, code, terms) in parts of bounded size: a row and a code for each term that occurs."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :] if len(texts) else []
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets[: len(texts) + 1], offsets[lo] + PART, "right")) - 1)
        row, found = found_in(texts.slice(lo, hi - lo))
        words = found.dictionary_encode()
        every = words.dictionary
        lower = pc.ascii_lower(every)
        # ASCII words of small letters after the first are one term each; the others go to the rule.
        plain = pc.and_(pc.ascii_is_alpha(every), pc.or_(pc.equal(every, lower), pc.equal(every, pc.ascii_capitalize(every))))
        flat: list[str] = []
        sizes: list[int] = []
        for w in every.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist():
            own = _terms(w)
            flat += own
            sizes.append(len(own))
        term = pa.concat_arrays([lower.filter(plain), pa.array(flat, pa.string())]).dictionary_encode()
        # Where an identifier's terms begin, and how many they are.
        one = plain.to_numpy(zero_copy_only=False)
        n, size, begin = int(one.sum()), np.ones(len(every), np.int64), np.zeros(len(every), np.int64)
        begin[one], size[~one] = np.arange(n), sizes
        begin[~one] = n + np.cumsum(size[~one]) - size[~one]
        code = np.asarray(words.indices)
        times, first = size[code], begin[code]
        place = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
        yield lo, hi - lo, np.repeat(row, times), np.asarray(term.indices)[place], term.dictionary
        lo = hi


def counted(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(first text, row from there, code, tf, the texts' numbers of terms, terms) in parts of bounded size."""
    for lo, n, row, code, terms in tokens(texts):
        cell, tf = np.unique(row * max(1, len(terms)) + code, return_counts=True)
        own, which = np.divmod(cell, max(1, len(terms)))
        yield lo, own, which, tf, np.bincount(row, minlength=n), terms


def counted_terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(row, term, tf, the row's number of terms) of a batch of texts, in parts of bounded size."""
    for lo, own, code, tf, lengths, terms in counted(texts):
        for at in range(0, len(own), POSTED):
            part = slice(at, at + POSTED)
            yield lo + own[part], terms.take(pa.array(code[part])), tf[part], lengths[own[part]]


def postings(docs: DataFrame, key: str, text: Column | str, extra: tuple[str, ...] | None = None) -> DataFrame:
    """(key, term, tf) of every text; counted inside the document, so nothing is shuffled.

    With ``extra`` columns, also the text's number of terms as ``length``, and those columns.
    """
    kinds = dict(docs.dtypes)
    kept = [key, *(extra or ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, terms, tfs, lengths in counted_terms(b.column(len(kept))):
                columns = {"term": terms, "tf": pa.array(tfs)} | {k: b.column(i).take(pa.array(own)) for i, k in enumerate(kept)}
                if extra is not None:
                    columns["length"] = pa.array(lengths)
                yield pa.RecordBatch.from_pydict(columns)

    schema = "term string, tf long, " + ", ".join(f"{k} {kinds[k]}" for k in kept) + (", length long" if extra is not None else "")
    return spread(docs.select(*kept, C.col(text).alias("__text"))).mapInArrow(run, schema)


INDEX = "term string, chunk_ids array<string>, tfs array<int>, lengths array<int>, total long"


def index_lists(batches: Iterator[pa.RecordBatch], by: str, most: int = HELD, most_bytes: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``segments`` of batches (by, chunk_id, text), made from ``most`` postings at a time, or fewer long ones."""

    def lists(parts: list[tuple], n: int) -> Iterator[pa.RecordBatch]:
        term = pa.chunked_array([x[0] for x in parts]).unify_dictionaries().combine_chunks()
        doc, tf, lengths = (np.concatenate([x[i] for x in parts]) for i in (1, 2, 3))
        group, ids = (pa.concat_arrays([x[i] for x in parts]) for i in (4, 5))
        parts.clear()
        # By library, then term, as Spark is going to sort them: what is sorted already costs it little.
        names, by_name = pc.unique(group).drop_null(), pc.array_sort_indices(term.dictionary)
        names, known = names.take(pc.array_sort_indices(names)), term.dictionary.take(by_name)
        rank = np.empty(len(known), np.int64)
        rank[np.asarray(by_name)] = np.arange(len(known))
        lib = np.asarray(pc.index_in(group, names).fill_null(len(names))).astype(np.int64)
        cell = lib[doc] * len(known) + rank[np.asarray(term.indices)]
        order = np.argsort(cell * n + doc)
        cell, doc, tf = cell[order], doc[order], tf[order]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        total = np.add.reduceat(tf, starts, dtype=np.int64)
        lib, which = np.divmod(cell[starts], len(known))
        ends = np.append(starts, len(cell))
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + POSTED, "right")) - 1)
            rows, part = slice(lo, hi), slice(ends[lo], ends[hi])
            offsets = pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32))
            own = doc[part]
            columns = [pa.ListArray.from_arrays(offsets, x) for x in (ids.take(pa.array(own)), pa.array(tf[part]), pa.array(lengths[own]))]
            library = names.take(pa.array(lib[rows], mask=lib[rows] == len(names)))
            yield pa.RecordBatch.from_arrays([library, known.take(pa.array(which[rows])), *columns, pa.array(total[rows])], [by, "term", "chunk_ids", "tfs", "lengths", "total"])
            lo = hi

    parts: list[tuple] = []
    docs = postings = size = 0
    for b in batches:
        for lo, own, code, tf, lengths, terms in counted(b.column(2)):
            if not len(own):
                continue
            # Copies of the two short columns: a slice would keep the batch with its texts.
            group, ids = (b.column(i).take(pa.array(np.arange(lo, lo + len(lengths)))) for i in (0, 1))
            parts.append((pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), terms), (docs + own).astype(np.int32), tf.astype(np.int32), lengths.astype(np.int32), group, ids))
            docs, postings, size = docs + len(lengths), postings + len(own), size + terms.nbytes + group.nbytes + ids.nbytes
            if postings >= most or size >= most_bytes:
                yield from lists(parts, docs)
                docs = postings = size = 0
    if parts:
        yield from lists(parts, docs)


def segments(chunks: DataFrame, text: Column | str, by: str = "library_id", dealt: bool = False) -> DataFrame:
    """(by, term, chunk_ids, tfs, lengths, total): what an index stores, one row a term of some thousand texts.

    ``lengths`` are the chunks' numbers of terms, ``total`` is the sum of the tfs. Lists are built where the text is
    read, from HELD postings or HELD_BYTES at a time, so nothing is shuffled, and a term that every chunk has is many lists, not one.
    ``dealt`` says that the rows lie over all cores as they are.
    """
    rows = chunks.select(by, "chunk_id", C.col(text).alias("__text"))
    if dealt:
        bound_batches(rows.sparkSession)
    else:
        rows = spread(rows)
    return rows.mapInArrow(lambda batches: index_lists(batches, by), f"{by} string, {INDEX}")


def term_counts(docs: DataFrame, key: str, text: Column | str, terms: list[str]) -> DataFrame:
    """(key, length, tf): a document's number of terms, and its counts of the given ones."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(terms, pa.string())
        for b in batches:
            for lo, n, row, code, known in tokens(b.column(1)):
                tfs = np.zeros((n, len(terms)), np.int64)
                for i, c in enumerate(pc.index_in(asked, value_set=known).to_pylist()):
                    if c is not None:
                        tfs[:, i] = np.bincount(row[code == c], minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(terms), pa.int32()), pa.array(tfs.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(np.bincount(row, minlength=n)), lists], [key, "length", "tf"])

    return spread(docs.select(key, C.col(text).alias("__text"))).mapInArrow(run, f"{key} {kind}, length long, tf array<long>")


def bm25_topk(docs: DataFrame, query: str, key: str = "chunk_id", text: Column | str | None = None, k: int | None = LEXICAL_K) -> DataFrame:
    """(key, score) of the best k documents with a positive score, by score then key.

    One narrow scan counts lengths and query terms, once: its few numbers a document are settled. A one-row
    aggregate has the collection's statistics, and the score is an expression over both: no postings are shuffled.
    """
    terms = sorted(terms_of(query))
    counted = term_counts(docs, key, lexical_text() if text is None else text, terms)
    if terms:
        counted = settle(counted)
    df = [F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]
    stats = counted.agg(F.count("*").alias("n"), F.sum("length").alias("total"), *df)
    if not terms:
        return counted.select(key, F.lit(0.0).alias("score")).limit(0)
    # One row beside every document.
    both = counted.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    total, average = F.col("n").cast("double"), F.col("total").cast("double") / F.col("n")
    parts = [
        F.when(F.col("tf")[i] > 0, C.bm25_term(F.col("tf")[i].cast("double"), F.col(f"df{i}").cast("double"), total, F.col("length").cast("double"), average)).otherwise(F.lit(0.0))
        for i in range(len(terms))
    ]
    # Rounded, so that copies tie whatever the order of the sum, and the key decides.
    scored = both.select(key, F.round(reduce(lambda a, b: a + b, parts), 12).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k) if k else scored


def bm25_from_postings(posted: DataFrame, n_docs: Column | int, query: str, key: str = "chunk_id", k: int = LEXICAL_K) -> DataFrame:
    """The same ranking from a stored postings table (key, term, tf)."""
    spark = posted.sparkSession
    terms = spark.createDataFrame([(t,) for t in sorted(terms_of(query))], "term string")
    lengths = posted.groupBy(key).agg(F.sum("tf").alias("length"))
    hits = posted.join(F.broadcast(terms), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    total = posted.agg(F.sum("tf").alias("total")).withColumn("n", F.lit(n_docs))
    rows = hits.join(F.broadcast(df), "term").join(lengths, key).crossJoin(F.broadcast(total))
    score = C.bm25_term(F.col("tf").cast("double"), F.col("df").cast("double"), F.col("n").cast("double"), F.col("length").cast("double"), F.col("total") / F.col("n"))
    # Terms are added in their byte order, so the sum is the same in every run.
    parts = F.array_sort(F.collect_list(F.struct("term", score.alias("s"))))
    summed = rows.groupBy(key).agg(F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["s"]), 12).alias("score"))
    return summed.orderBy(F.desc("score"), key).limit(k)


def bm25_from_index(index: DataFrame, n: int, total: int, query: str, k: int | None = LEXICAL_K) -> DataFrame:
    """The same ranking, as (chunk_id, score), from an index's ``segments`` and the scope's numbers of chunks and terms.

    The query's terms are pushed to the scan; nothing else is read.
    """
    terms, key = sorted(terms_of(query)), "chunk_id"
    if not terms or not n or not total:
        return index.select(F.lit("").alias(key), F.lit(0.0).alias("score")).limit(0)
    found = index.where(F.col("term").isin(terms)).select("term", F.explode(F.arrays_zip("chunk_ids", "tfs", "lengths")).alias("x"))
    hits = found.select(F.col("x.chunk_ids").alias(key), "term", F.col("x.tfs").alias("tf"), F.col("x.lengths").alias("length"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row a query term
    rows = hits.join(F.broadcast(df), "term")
    score = C.bm25_term(F.col("tf").cast("double"), F.col("df").cast("double"), F.lit(float(n)), F.col("length").cast("double"), F.lit(float(total)) / F.lit(float(n)))
    # Terms are added in their byte order, so the sum is the same in every run.
    parts = F.array_sort(F.collect_list(F.struct("term", score.alias("s"))))
    summed = rows.groupBy(key).agg(F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["s"]), 12).alias("score"))
    return summed.orderBy(F.desc("score"), key).limit(k) if k else summed


# ---------------------------------------------------------------- fusion and trimming


def ranked(hits: DataFrame, *order: Column | str) -> DataFrame:
    """Add a rank from 1 to a bounded candidate list."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def rrf(lists: list[DataFrame], key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of lists (key, rank): (key, score), the best first.

    A key that stands twice in a list counts at its first place.
    """
    firsts = [x.groupBy(key).agg(F.min("rank").alias("rank")) for x in lists]
    terms = reduce(DataFrame.unionByName, [x.select(key, C.rrf_term(F.col("rank")).alias("s")) for x in firsts])
    return terms.groupBy(key).agg(F.sum("s").alias("score")).orderBy(F.desc("score"), key)


def trimmed(hits: DataFrame, limit: int = FINAL, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranked hits without repeats of content, at most two of an adjacent run first, then the rest.

    ``hits`` has rank, chunk_index, source_id, document_id, heading_path and content, and is a bounded
    candidate list for each value of ``by``. Runs are found among all hits before repeats go: chunks
    of one heading of one document whose indexes follow each other. A group with an index that stands
    twice, a negative one or a blank name has no runs.
    """
    group = ["source_id", "document_id", "heading_path"]
    named = reduce(lambda a, b: a & b, [C.text(g) != "" for g in group]) & (F.col("chunk_index") >= 0)
    place = Window.partitionBy(*by, *group, "__named").orderBy("chunk_index", "rank")
    whole = Window.partitionBy(*by, *group, "__named")
    cell = Window.partitionBy(*by, *group, "__named", "chunk_index")
    x = hits.withColumn("__named", named)
    x = x.withColumn("__n", F.count("*").over(cell)).withColumn("__island", F.col("chunk_index") - F.row_number().over(place))
    x = x.withColumn("__run", F.col("__named") & (F.max("__n").over(whole) == 1))
    # Content that was seen at a better rank, or is blank, goes.
    x = x.withColumn("__norm", C.normal_content("content")).where("__norm <> ''")
    x = x.withColumn("__seen", F.row_number().over(Window.partitionBy(*by, "__norm").orderBy("rank"))).where("__seen = 1")
    within = Window.partitionBy(*by, *group, "__run", "__island").orderBy("rank")
    x = x.withColumn("deferred", F.col("__run") & (F.row_number().over(within) > RUN_CAP))
    out = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    x = x.withColumn("position", F.row_number().over(out.orderBy("deferred", "rank"))).where(F.col("position") <= limit)
    return x.select(*hits.columns, "position").orderBy(*by, "position")


def search(
    chunks: DataFrame, query: str, vector: list[float], library_id: str = "", version: str = "", final: int = FINAL, candidates: int = DENSE_K, lexical: DataFrame | None = None
) -> DataFrame:
    """The sections that answer a query: dense hits, fused with BM25 only for technical queries.

    ``candidates`` are how many dense hits there are before trimming; ``lexical`` (chunk_id, score) is the
    scope's lexical ranking where an index has it, or the chunks' texts are counted.
    """
    scope = scoped(chunks, library_id=library_id, version=version)
    meta = ["chunk_id", "source_id", "library_id", "version", "document_id", "url", "title", "heading_path", "chunk_index", "content"]
    dense = ranked(dense_topk(scope, vector, candidates).select(*meta, "score"), "score", "chunk_id")
    if not is_technical(query):
        return trimmed(dense, final)
    lexical = ranked(bm25_topk(scope, query) if lexical is None else lexical, F.desc("score"), "chunk_id")
    fused = ranked(rrf([dense.select("chunk_id", "rank"), lexical.select("chunk_id", "rank")]), F.desc("score"), "chunk_id")
    hits = scope.select(*meta).join(F.broadcast(fused), "chunk_id")  # two short lists at most
    return trimmed(hits, final)


_TECHNICAL = regex.compile(r"/[\p{L}\p{Nd}]|(?<=[\p{L}\p{Nd}])[.-][\p{L}\p{Nd}]|\p{Ll}\p{Lu}")
_LOWER = regex.compile(r"\p{Ll}")


def is_technical(query: str) -> bool:
    """``has_technical_identifier`` for one query."""
    if _TECHNICAL.search(query):
        return True
    letters = [[c for c in t if c.isalpha()] for t in _IDENTIFIER.findall(query)]
    return bool(_LOWER.search(query)) and any(len(t) >= 2 and all(c.isupper() for c in t) for t in letters)
