"""Benchmark decontamination: CGK walks, bit-sampling LSH over item-sized windows, exact verification.

Texts and items are sequences of lower-case words. An item is held by a document when some stretch of
the document is within an edit distance d of a fifth of the item's n words. Such a stretch keeps at
least n + 1 - q (d + 1) of the item's runs of q words, each at most d words out of place, so windows
are taken only where a document has that many of an item's runs close together; this loses nothing.
Each item-sized window there is embedded by CGK random walks, which turn edit distance into Hamming
distance, and looked up in hash tables of sampled coordinates; what collides is verified by the exact
edit distance.

The items are the stated query set. They are read in blocks of bounded number and bytes, each against
all rows. Runs that meet, windows and walks are worked on in blocks as well, so that memory doesn't grow
with a document's or an item's length times the windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, batch, fresh, map_arrow, merge, mix, settle, texts
from .licenses import normalise

DISTANCE = 0.2  # of the item's words
PIECE = 4  # words of a run that is looked for, at most
WALKS = 6  # independent random walks
TABLES = 16  # of each walk
SAMPLED = 4  # coordinates of a table
BLOCK, BLOCK_BYTES = 20_000, 64 << 20  # items taken at a time, and bytes of their texts
HITS = 1 << 21  # runs that meet, at a time
WINDOWS = 20_000  # windows at a time
STEPS = 1 << 21  # steps of walks at a time
SEED = 11


def reach(n: int) -> int:
    """Edits that an item of n words allows."""
    return int(DISTANCE * n)


def piece(n: int) -> int:
    return max(1, min(PIECE, n // (reach(n) + 1)))


@dataclass
class Index:
    """Runs and hash tables of one block of items; bounded by BLOCK."""

    items: list[tuple[int, np.ndarray]]  # (item_id, word hashes)
    sizes: np.ndarray  # words of each item
    least: np.ndarray  # runs that a stretch keeps at least
    runs: dict[int, tuple[np.ndarray, ...]]  # run length: sorted hashes, their items and offsets
    gate: np.ndarray  # which 16-bit ends of hashes occur
    coordinates: np.ndarray  # walk x table x sample
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # item length: sorted keys and items


def _steps(symbols: np.ndarray, walk: int, step: int) -> np.ndarray:
    """The walk's coin for these symbols at this step."""
    salt = np.uint64((walk * 1_000_003 + step * 7919 + SEED) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mix(symbols ^ salt) >> np.uint64(63)).astype(np.int64)


def embed(words: np.ndarray, starts: np.ndarray, longest: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """CGK walks of all windows at ``starts``: the position within the window, and the word there, by step."""
    at = np.zeros(len(starts), np.int64)
    places, symbols = np.empty((3 * longest, len(starts)), np.int64), np.empty((3 * longest, len(starts)), np.uint64)
    for j in range(3 * longest):
        here = np.minimum(starts + at, len(words) - 1)
        symbols[j], places[j] = words[here], np.where(starts + at < len(words), at, longest)
        at += _steps(symbols[j], walk, j)
    return places, symbols


def keys(places: np.ndarray, symbols: np.ndarray, coordinates: np.ndarray, n: int, walk: int) -> np.ndarray:
    """Table keys (table x window) of windows of n words: coordinates behind the window's end are blank."""
    own = coordinates % (3 * n)
    out = np.zeros((len(own), places.shape[1]), np.uint64)
    with np.errstate(over="ignore"):
        for s in range(own.shape[1]):
            picked = np.where(places[own[:, s]] < n, symbols[own[:, s]], np.uint64(0))
            out = mix(out * np.uint64(3) + picked)
        return out ^ mix(np.arange(len(own), dtype=np.uint64)[:, None] + np.uint64(1000 * walk + 1))


def walk_keys(coordinates: np.ndarray, words: np.ndarray, starts: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(which of the windows of n words, their table keys) of every walk, for as many windows as STEPS allows at a time."""
    step = max(1, STEPS // (3 * n))
    for lo in range(0, len(starts), step):
        part = slice(lo, lo + step)
        for w in range(WALKS):
            places, symbols = embed(words, starts[part], n, w)
            yield part, keys(places, symbols, coordinates[w], n, w)


def _words(rolling: Rolling, words: list[bytes]) -> np.ndarray:
    rolling.load(b" ".join(words))
    at = np.arange(len(words))
    return rolling.between(at, at + 1)


def build(items: list[tuple[int, str]]) -> Index:
    rng, rolling = np.random.default_rng(SEED), Rolling()
    kept, runs = [], {}
    for item_id, text in items:
        words = normalise(text or "")
        if words:
            hashes = _words(rolling, words)
            q = piece(len(words))
            at = np.arange(len(words) - q + 1)
            runs.setdefault(q, []).append((rolling.between(at, at + q), np.full(len(at), len(kept)), at))
            kept.append((item_id, hashes))
    sizes = np.array([len(h) for _, h in kept], np.int64)
    gate = np.zeros((PIECE + 1, 1 << 16), bool)
    for q, parts in runs.items():
        h, who, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        runs[q] = (h[order], who[order], at[order])
        gate[q, (h >> np.uint64(48)).astype(np.int64)] = True
    coordinates = rng.integers(0, 1 << 30, (WALKS, TABLES, SAMPLED))
    tables = {}
    for n in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == n)
        words = np.concatenate([kept[i][1] for i in mine])
        found = list(walk_keys(coordinates, words, np.arange(len(mine)) * n, n))
        k, who = np.concatenate([x.ravel() for _, x in found]), np.concatenate([np.tile(mine[part], TABLES) for part, _ in found])
        order = np.argsort(k, kind="stable")
        tables[n] = (k[order], who[order])
    least = np.array([max(1, n + 1 - piece(n) * (reach(n) + 1)) for n in sizes.tolist()], np.int64)
    return Index(kept, sizes, least, runs, gate, coordinates, tables)


def best_stretch(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to any stretch of the words, where that stretch ends)."""
    along = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, symbol in enumerate(item):
        nxt = np.empty_like(row)
        nxt[0] = i + 1
        nxt[1:] = np.minimum(row[:-1] + (words != symbol), row[1:] + 1)
        row = np.minimum.accumulate(nxt - along) + along
    end = int(row.argmin())
    return int(row[end]), end


def _met(looked: list[tuple[np.ndarray, ...]], part: int, parts: int) -> tuple[np.ndarray, ...]:
    """(place, item, offset) of the runs that meet, for one of ``parts`` shares of the items; expanded HITS at a time."""
    out = []
    for at, lo, count, items, offsets in looked:
        ends = np.cumsum(count)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, side="right")))
            c = count[a:b]
            each = np.repeat(lo[a:b] - np.cumsum(c) + c, c) + np.arange(c.sum())
            mine = items[each] % parts == part
            out.append((np.repeat(at[a:b], c)[mine], items[each[mine]], offsets[each[mine]]))
            a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windows(index: Index, rolling: Rolling, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, from, to): disjoint ranges of the starts of windows of the loaded text of n words that can hold an item."""
    looked, total = [], 0
    for q, (known, items, offsets) in index.runs.items():
        if n < q:
            continue
        at = np.arange(n - q + 1)
        h = rolling.between(at, at + q)
        maybe = np.flatnonzero(index.gate[q][(h >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(known, h[maybe], side="left"), np.searchsorted(known, h[maybe], side="right")
        some = hi > lo
        if some.any():
            looked.append((maybe[some], lo[some], (hi - lo)[some], items, offsets))
            total += int((hi - lo).sum())
    none = np.zeros(0, np.int64)
    lows, highs = [none], [none]
    width = n + 2  # ranges of a size don't touch those of the next
    parts = -(-total // HITS)
    for part in range(parts):
        pos, who, off = _met(looked, part, parts)
        if not len(pos):
            continue
        order = np.lexsort((pos, who))
        pos, who, off = pos[order], who[order], off[order]
        # Enough runs of the item within a stretch.
        need, size = index.least[who] - 1, index.sizes[who]
        slack = (DISTANCE * size).astype(np.int64)
        last = np.minimum(np.arange(len(pos)) + need, len(pos) - 1)
        first = np.flatnonzero((np.arange(len(pos)) + need < len(pos)) & (who[last] == who) & (pos[last] - pos <= size + slack))
        if not len(first):
            continue
        mark = np.zeros(len(pos) + 1, np.int64)
        np.add.at(mark, first, 1)
        np.add.at(mark, last[first] + 1, -1)
        good = np.cumsum(mark)[:-1] > 0
        pos, size, off, slack = pos[good], size[good], off[good], slack[good]
        lo, hi = size * width + np.clip(pos - off - slack, 0, n - 1), size * width + np.clip(pos - off + slack, 0, n - 1) + 1
        lo, hi = merge(np.concatenate([lows.pop(), lo]), np.concatenate([highs.pop(), hi]))
        lows.append(lo)
        highs.append(hi)
    size = lows[0] // width
    return size, lows[0] - size * width, highs[0] - size * width


def collide(index: Index, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(window, item) pairs that share a table key."""
    out = []
    for n in np.unique(size).tolist():
        mine = np.flatnonzero(size == n)
        known, who = index.tables[n]
        for part, k in walk_keys(index.coordinates, words, start[mine], n):
            lo = np.searchsorted(known, k.ravel(), side="left")
            hit = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == k.ravel())
            window = np.tile(mine[part], TABLES)[hit]
            at = lo[hit]
            while len(at):
                out.append(np.stack([window, who[at]], axis=1))
                more = np.flatnonzero((at + 1 < len(known)) & (known[np.minimum(at + 1, len(known) - 1)] == known[at]))
                at, window = at[more] + 1, window[more]
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def search(index: Index, docs: list[list[bytes]], rolling: Rolling) -> list[tuple[int, int, int, int]]:
    """(document, item number, edit distance, end word) of every item that a document of words holds."""
    areas, starts, sizes, owners, places = [], [], [], [], []
    longest = int(index.sizes.max()) if len(index.sizes) else 0
    base, found = 0, {}

    def verify() -> None:
        nonlocal base
        if not starts:
            return
        words, start, size = np.concatenate(areas), np.concatenate(starts), np.concatenate(sizes)
        owner, shift = np.concatenate(owners), np.concatenate(places)
        done: dict[tuple[int, int], int] = {}
        for window, item in collide(index, words, start, size).tolist():
            d, s = int(owner[window]), int(start[window])
            n = int(index.sizes[item])
            key = (d, item)
            if s < done.get(key, -1):  # a stretch around this start was compared with the item before
                continue
            a, b = max(int(shift[window]), s - n), s + 3 * n
            distance, end = best_stretch(index.items[item][1], words[a:b])
            done[key] = s + n
            if distance <= reach(n) and (key not in found or distance < found[key][0]):
                found[key] = (distance, a + end - int(shift[window]))
        for x in (areas, starts, sizes, owners, places):
            x.clear()
        base = 0

    for d, words in enumerate(docs):
        n = len(words)
        if not n or not longest:
            continue
        rolling.load(b" ".join(words))
        size, lo, hi = windows(index, rolling, n)
        if not len(size):
            continue
        at = np.arange(n)
        # Words of no item keep apart what stands side by side.
        area = np.concatenate([rolling.between(at, at + 1), np.zeros(3 * longest, np.uint64)])
        ends = np.cumsum(hi - lo)
        for a in range(0, int(ends[-1]), WINDOWS):
            flat = np.arange(a, min(a + WINDOWS, int(ends[-1])))
            own = np.searchsorted(ends, flat, side="right")
            areas.append(area)
            starts.append(hi[own] - (ends[own] - flat) + base)
            sizes.append(size[own])
            owners.append(np.full(len(flat), d))
            places.append(np.full(len(flat), base))
            base += len(area)
            if sum(map(len, starts)) >= WINDOWS:
                verify()
    verify()
    return sorted((d, i, *v) for (d, i), v in found.items())


_HIT = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("item_words", pa.int64()), ("end_word", pa.int64())])


def _searcher(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for rows in batches:
            ids, h = rows.column("doc_id").to_pylist(), rows.column("h").to_pylist()
            hits = search(index, [normalise(t) for t in texts(rows.column("text"))], rolling)
            out = [(ids[d], h[d], index.items[i][0], k, int(index.sizes[i]), e) for d, i, k, e in hits]
            if out:
                yield batch(_HIT, **dict(zip(_HIT.names, map(list, zip(*out, strict=True)), strict=True)))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, h, item_id, distance, item_words, end_word): every item that a row of ``docs`` holds.

    h is the hash of the row's text. Null, empty and wordless texts and items hold and are nothing; a
    null doc_id or item_id is passed on; repeated rows come back repeated; without items or documents
    there are no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(n / block), math.ceil((size or 0) / BLOCK_BYTES))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(build([(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()]))
        hits = map_arrow(keyed, _late(index), "doc_id long, h long, item_id long, distance long, item_words long, end_word long")
        found = hits if found is None else found.unionByName(hits)
    return found


def _late(index):
    return lambda batches: _searcher(index.value)(batches)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    low = F.lit(-(1 << 63))
    k, h = fresh(docs, "k", "h")
    # Settled, so that many rows of one key, as null ids are, can be split in the join.
    bad = settle(contaminated(docs, benchmark).select(F.coalesce("doc_id", low).alias(k), F.col("h").alias(h)).distinct())
    keyed = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), low), h: F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(bad, [k, h], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
