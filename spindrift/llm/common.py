"""Shared plumbing of the training-data operators.

Every operator reads only the columns it names, so extra columns never clash. A null text counts
as the empty text and a null document id as an id of its own that sorts after every other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, forget, settle, ship, table

__all__ = ["Rolling", "batch", "components", "forget", "fresh", "key_filter", "map_arrow", "may_be_in", "merge", "mix", "settle", "ship", "table", "texts"]

def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bound_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


# ---------------------------------------------------------------- membership by a filter of fixed size

FILTER_BITS = 26  # 8 MB, whatever the data's size


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter over the long column ``g``; a fuller filter lets more pass, never less."""
    low = F.lit((1 << FILTER_BITS) - 1).cast("long")
    place = F.explode(F.array(F.col("g").bitwiseAND(low), F.shiftrightunsigned("g", FILTER_BITS).bitwiseAND(low))).alias("p")
    bits = keys.select(place).select(F.shiftright("p", 6).alias("i"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    words = bits.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("i").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def may_be_in(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which of the longs may be among the filter's keys; none of its keys is left out."""
    g, low = g.view(np.uint64), np.uint64((1 << FILTER_BITS) - 1)
    first, second = g & low, (g >> np.uint64(FILTER_BITS)) & low
    has = lambda p: (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)
    return (has(first) & has(second)).astype(bool)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that ``df`` has no column of, whatever the case: for what is added on the way."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__sd_{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def texts(column: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


# ---------------------------------------------------------------- connected components


def _min_star(edges: DataFrame, larger_only: bool, held: list[DataFrame]) -> DataFrame:
    """One star contraction: link neighbours to the smallest node around each centre. Adds to ``held`` what it settles."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if larger_only else both.where("v <= u")
    # Settled: a join of two plain exchanges can split a hot centre, one with an aggregate cannot.
    least = settle(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    held.append(least)
    linked = around.join(least, "u")
    if larger_only:
        pairs = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (u, v) by alternating large and small stars.

    Returns (u, root), one row per node that has an edge; root is the smallest node. Each
    contraction is a map-side-combined minimum, settled, and an equi-join of two plain exchanges that AQE
    can split, so a node with a third of all edges does not end in one task, and nothing is gathered on
    the driver. More than ``most_rounds`` rounds are an error.
    """
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        held = [now]
        nxt = settle(_min_star(_min_star(now, True, held), False, held))
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in held:
            forget(old)
        now = nxt
        if tuple(mark) == seen:
            return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        seen = tuple(mark)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


# ---------------------------------------------------------------- word-sequence hashes

_ODD, _SEED2, _HALF, _LESS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32), np.uint64(29)


class Rolling:
    """64-bit hashes of any word range of a text, in constant time each.

    The words joined by single spaces are hashed as a polynomial over their bytes modulo 2^64, so a
    range's hash is a difference of prefix sums times a power of the inverse of the odd base.
    """

    def __init__(self, base: int = 0x2545F4914F6CDD1D):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(n, self.base, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(n, self.inverse, np.uint64)]), dtype=np.uint64)
        self.size = n

    def load(self, joined: bytes) -> np.ndarray:
        """Take the space-joined words; return where each word starts, and one end mark."""
        raw = np.frombuffer(joined, np.uint8)
        if len(raw) + 2 > self.size:
            self._grow(2 * len(raw) + 2)
        # Unsigned arrays wrap around, as the modulus wants it.
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        terms = raw.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self.up[: len(raw)]
        np.cumsum(terms, out=self.sums[1:])
        self.starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(raw == 32) + 1, np.full(1, len(raw) + 1, np.int64)])
        return self.starts

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Mixed hashes of the word ranges [first, last)."""
        a, b = self.starts[first], self.starts[last] - 1
        return mix((self.sums[b] - self.sums[a]) * self.down[a])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _HALF)
    h *= _ODD
    h ^= h >> _LESS
    h *= _SEED2
    h ^= h >> _HALF
    return h


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint ascending ones."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    start = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[start], hi[np.concatenate([start[1:], [True]])]


def batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema)
