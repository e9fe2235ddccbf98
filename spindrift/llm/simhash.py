"""Near-duplicate documents by SimHash with pigeonhole blocks.

Links are Hamming distance 3 or less between 64-bit fingerprints. The 64 bits are cut into five
blocks; two fingerprints that differ in at most three bits agree on at least two whole blocks, so
each fingerprint is posted under its ten pairs of blocks (25 or 26 bits each) and only equal
postings are compared. Equal fingerprints are folded before, so a group of exact copies is one node.
A posting list is walked as a breadth-first forest, which keeps all connectivity and emits fewer
links than it has members. A long list is dealt once more by four blocks of its other bits, of which
close fingerprints again share one; what is still long is cut into chunks and every pair of chunks is a
unit of its own, so no task holds an unbounded list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, components, fresh, map_arrow, settle, texts

MAX_BITS = 3
CHUNK = 4096
# First bit and width of each block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))

_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: str) -> int:
    """Majority bits of XXH64 over 3-word shingles; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= 3:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-3]]).tolist()
    hashes = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, (ends[2:] - 1).tolist(), strict=True)], np.uint64, n - 2)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n - 2, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        fps = np.array([fingerprint(t) for t in texts(rows.column("text"))], np.uint64).view(np.int64)
        yield batch(_FP, doc_id=rows.column("doc_id"), fp=fps)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row."""
    return map_arrow(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long")


def forest(fps: np.ndarray, reach: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph 'at most ``reach`` bits apart' over distinct values."""
    left, parents, children = np.asarray(fps, np.uint64), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= reach
            if near.any():
                found = left[near]
                left = left[~near]
                parents.append(np.full(len(found), at, np.uint64))
                children.append(found)
                queue.extend(found)
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(parents), np.concatenate(children)) if parents else (empty, empty)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk rows sorted by (key, unit); a unit is at most two chunks long."""

    def flush(key: np.ndarray, unit: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        sizes = hi - lo
        us, vs = [], []
        two = lo[sizes == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS
        us.append(fp[two][near])
        vs.append(fp[two + 1][near])
        for a, b in zip(lo[sizes > 2].tolist(), hi[sizes > 2].tolist(), strict=True):
            u, v = forest(fp[a:b])
            us.append(u)
            vs.append(v)
        yield batch(_EDGE, u=np.concatenate(us).view(np.int64), v=np.concatenate(vs).view(np.int64))

    held: list[tuple[np.ndarray, ...]] = []
    for rows in batches:
        if not rows.num_rows:
            continue
        now = tuple(rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "unit", "fp"))
        held.append((now[0], now[1], now[2].view(np.uint64)))
        key, unit, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        last = np.flatnonzero((key != key[-1]) | (unit != unit[-1]))
        if len(last):
            done = last[-1] + 1
            yield from flush(key[:done], unit[:done], fp[:done])
            key, unit, fp = key[done:], unit[done:], fp[done:]
        held = [(key, unit, fp)]
    if held and len(held[0][0]):
        yield from flush(*held[0])


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) that connect everything within ``MAX_BITS`` among distinct fingerprints ``fp``."""

    def posting(i: int, pair: tuple[tuple[int, int], tuple[int, int]]) -> F.Column:
        (a, wa), (b, wb) = pair
        bits = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in ((a, wa), (b, wb))]
        return F.lit(i << 32).bitwiseOR(F.shiftleft(bits[0], 13)).bitwiseOR(bits[1])

    pairs = list(combinations(BLOCKS, 2))
    keys = distinct.select("fp", F.explode(F.array(*[posting(i, p) for i, p in enumerate(pairs)])).alias("key"))
    # Counts are settled before they are joined: a join of two plain exchanges can split a hot key.
    posted = keys.join(settle(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")), "key")
    short = posted.where(F.col("n") <= chunk).select("key", F.lit(0).cast("long").alias("unit"), "fp")

    # The 39 bits at most beside a pair of blocks, in four blocks of their own.
    def others(pair: tuple) -> F.Column:
        bits = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in BLOCKS if (s, w) not in pair]
        return F.shiftleft(bits[0], 26).bitwiseOR(F.shiftleft(bits[1], 13)).bitwiseOR(bits[2])

    rest = F.element_at(F.array(*[others(p) for p in pairs]), F.shiftright("key", 32).cast("int") + 1)
    finer = [F.col("key").bitwiseOR(F.lit(j + 1 << 36)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(rest, 10 * j).bitwiseAND(F.lit(1023)), 40)) for j in range(4)]
    long = posted.where(F.col("n") > chunk).select("fp", F.explode(F.array(*finer)).alias("key"))
    long = long.join(settle(long.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")), "key")
    long = long.withColumn("m", F.ceil(F.col("n") / F.lit(chunk)).cast("long")).withColumn("c", F.pmod(F.xxhash64("fp"), "m"))
    # Chunk c takes part in the units (i, c) for i <= c and (c, j) for j > c.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    units = long.select("key", "fp", "m", "c", other.alias("o")).select("key", (F.least("c", "o") * F.col("m") + F.greatest("c", "o")).alias("unit"), "fp")
    dealt = short.unionByName(units).repartition("key", "unit").sortWithinPartitions("key", "unit", "fp")
    return map_arrow(dealt, _links, "u long, v long").distinct()


def groups(fps: DataFrame) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of (doc_id, fp); the id is the least doc_id reached."""
    distinct = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Settled, so that a giant component can be split in the join.
    named = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return rooted.join(named, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups of documents (doc_id, text).

    Returns one row per input row: doc_id, fingerprint (16 hex digits), component_id. Empty and null
    texts have fingerprint zero and link like any other; a null doc_id is never a component's id
    unless its component holds nothing else; repeated rows come back repeated; no rows, no rows.
    """
    fps = settle(fingerprints(docs))
    return fps.join(groups(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group: the one that has the least (doc_id, text hash).

    All columns come back as they are. Rows that repeat the kept row in doc_id and text count once.
    """
    fps = settle(map_arrow(docs.select("doc_id", "text"), _keyed, "doc_id long, fp long, h long"))
    grouped = fps.join(groups(fps.select("doc_id", "fp")), "fp")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("h"))
    low, (k, h) = F.lit(-(1 << 63)), fresh(docs, "k", "h")
    best = grouped.groupBy("component_id").agg(F.min(rank).alias("b")).select(F.coalesce("b.d", low).alias(k), F.col("b.h").alias(h))
    numbered = docs.withColumns({h: F.xxhash64(F.coalesce("text", F.lit(""))), k: F.coalesce(F.col("doc_id").cast("long"), low)})
    return numbered.join(settle(best.distinct()), [k, h], "left_semi").dropDuplicates([k, h]).select(*[F.col(f"`{c}`") for c in docs.columns])


_KEYED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("h", pa.int64())])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        all_texts = texts(rows.column("text"))
        fps = np.array([fingerprint(t) for t in all_texts], np.uint64).view(np.int64)
        h = np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in all_texts], np.uint64).view(np.int64)
        yield batch(_KEYED, doc_id=rows.column("doc_id"), fp=fps, h=h)
