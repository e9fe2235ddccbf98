"""Removal of lines and passages that stand before, by winnowing over line hashes.

Two kinds of lines are hashed in one pass over each text. A text line, its white space folded, is a
unit of its own: every one is selected, and a match is the line as a whole. Shared passages also begin
and end inside text lines, so for them the lines are wrapped ones: ten words, one starting at every
word. In each window of 41 wrapped lines the least hash is selected; a run of 50 equal words holds a
whole window and therefore the same selected line in both copies. Selected lines are joined by hash,
and a match is extended both ways over the windows that selected it.

Result, exactly: a word is removed if and only if its whole text line stands at an earlier (doc_id,
position), or it lies in a run of 50 words that does. A line may be of any length. Equality of lines is
that of a 128-bit hash, equality of runs that of two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, batch, fresh, key_filter, map_arrow, may_be_in, merge, mix, settle, texts

LINE = 10  # words of a wrapped line
WINDOW = 41  # line hashes of a window
SPAN = LINE + WINDOW - 1  # words of the shortest run that is removed
PART = 1 << 20  # bytes of text that are hashed at a time; a longer text is a part of its own

RUN, TEXT_LINE, INSIDE = 0, 1, 2  # kinds of marks
_MARK = pa.schema([("kind", pa.int32()), ("fp", pa.int64()), ("whole", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("pos", pa.int64()), ("n", pa.int64())])
_WINDOW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("pos", pa.int64())])
_LAST = (1 << 63) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first least value of each window is; windows are doubled until they are wide enough."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        n = len(values) - step
        later = values[step:] < values[:n]
        values, at = np.where(later, values[step:], values[:n]), np.where(later, at[step:], at[:n])
        size += step
    return at


def select_lines(rolling: Rolling, words: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Selected wrapped lines of texts that stand one after the other, each up to its place in ``ends``.

    Returns the line's start, its hash, the first and last window that selected it, and its text's number.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none.view(np.uint64), none, none, none
    rolling.load(b" ".join(words))
    at = np.arange(n - LINE + 1)
    lines = rolling.between(at, at + LINE)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: n - SPAN + 1]
    window = np.flatnonzero(np.arange(len(owner)) + SPAN <= ends[owner])
    if not len(window):
        return none, none.view(np.uint64), none, none, none
    picked = leftmost_least(lines, WINDOW)[window]
    first = np.concatenate([[0], np.flatnonzero(picked[1:] != picked[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(picked) - 1]])
    return picked[first], lines[picked[first]], window[first], window[last], owner[window[first]]


def _marks(rolling: Rolling, held: list[bytes], k: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """Marks of the texts ``held``.

    Of a run: hash of the selected line, hash of all that its windows cover, and the packed place
    q << 12 | (q - first window) << 6 | (q - last window). Of a text line: both halves of its hash, where
    it begins, its words. Of a run that repeats inside its text: where it begins, its words.
    """
    words: list[bytes] = []
    ends, digests, line_text, line_at = [], [], [], [0]
    for i, raw in enumerate(held):
        for line in raw.split(b"\n"):
            if own := line.split():
                words += own
                digests.append(xxhash.xxh3_128_digest(b" ".join(own)))
                line_text.append(i)
                line_at.append(len(words))
        ends.append(len(words))
    ends = np.array(ends, np.int64)
    base = np.concatenate([[0], ends[:-1]])
    out: list[tuple] = []

    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    who, at = np.array(line_text, np.int64), np.array(line_at, np.int64)
    out.append((np.full(len(who), TEXT_LINE), halves[:, 0], halves[:, 1], who, at[:-1] - base[who], np.diff(at)))

    q, fp, first, last, who = select_lines(rolling, words, ends)
    if len(q):
        whole = mix(rolling.between(first, last + SPAN) ^ mix(((q - first) << 6 | (q - last)).astype(np.uint64)))
        order = np.lexsort((first, whole, who))
        again = np.zeros(len(q), bool)
        again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (who[order[1:]] == who[order[:-1]])
        new = ~again
        own = q[new] - base[who[new]]
        out.append((np.full(len(own), RUN), _signed(fp[new]), _signed(whole[new]), who[new], own << 12 | (q - first)[new] << 6 | (q - last)[new], np.zeros(len(own), np.int64)))
        if again.any():
            # Shifted by the text's number, so that runs of neighbouring texts don't touch.
            lo, hi = merge(first[again] + who[again], last[again] + SPAN + who[again])
            mine = np.searchsorted(ends + np.arange(len(ends)), lo, side="right")
            out.append((np.full(len(lo), INSIDE), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64), mine, lo - mine - base[mine], hi - lo))
    kind, fp, whole, who, pos, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return batch(_MARK, kind=kind.astype(np.int32), fp=fp, whole=whole, k=k[who], h=h[who], pos=pos, n=n)


def _parts(rows: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts of a batch in parts of about PART bytes, and their row numbers."""
    held: list[bytes] = []
    start = size = 0
    for i, t in enumerate(texts(rows.column("text"))):
        held.append(t.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= PART:
            yield held, np.arange(start, i + 1)
            held, size, start = [], 0, i + 1
    if held:
        yield held, np.arange(start, start + len(held))


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    for rows in batches:
        k, h = rows.column("k").to_numpy(), rows.column("h").to_numpy()
        for held, at in _parts(rows):
            yield _marks(rolling, held, k[at], h[at])


def _spread_out(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of each start, n of them."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every 50-word window of the marked places, by two hashes."""
    one, two = Rolling(), Rolling(0x9FB21C651E98DF25)
    for rows in batches:
        k, h, marks = rows.column("k").to_numpy(), rows.column("h").to_numpy(), rows.column("marks")
        for held, at in _parts(rows):
            split = [raw.split() for raw in held]
            base = np.concatenate([[0], np.cumsum([len(w) for w in split])[:-1]])
            own = marks.slice(int(at[0]), len(at))
            who = np.repeat(np.arange(len(at)), np.diff(own.offsets.to_numpy()))
            pos = own.flatten().to_numpy(zero_copy_only=False)
            q = pos >> 12
            first, last = q - (pos >> 6 & 63) + base[who], q - (pos & 63) + base[who]
            p = np.unique(_spread_out(first, last - first + 1))
            who = np.searchsorted(base, p, side="right") - 1
            joined = b" ".join(w for words in split for w in words)
            one.load(joined)
            two.load(joined)
            yield batch(_WINDOW, a=_signed(one.between(p, p + SPAN)), b=_signed(two.between(p, p + SPAN)), k=k[at][who], h=h[at][who], pos=p - base[who])


def cut(text: str, lo: np.ndarray, hi: np.ndarray) -> tuple[str, int, int]:
    """The text without the word runs [lo, hi), its words and how many went.

    A run goes with the white space after it; what is left is trimmed where something was cut.
    """
    raw = text.encode("utf-8", "surrogatepass")
    edge = np.diff(_SPACE[np.frombuffer(raw, np.uint8)].astype(np.int8), prepend=1, append=1)
    starts = np.flatnonzero(edge == -1)
    if not len(lo):
        return text, len(starts), 0
    lo, hi = merge(lo, hi)
    starts = np.concatenate([starts, [len(raw)]])
    parts, done = [], 0
    for a, b in zip(starts[lo].tolist(), starts[hi].tolist(), strict=True):
        parts.append(raw[done:a])
        done = b
    parts.append(raw[done:])
    return b"".join(parts).strip().decode("utf-8", "surrogatepass"), len(starts) - 1, int((hi - lo).sum())


def _only(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``keyed`` that may be in ``wanted``, told by a filter of fixed size: only their texts are shuffled."""
    spark = keyed.sparkSession
    bits = spark.sparkContext.broadcast(key_filter(wanted.select(F.xxhash64("k", "h").alias("g"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            mask = may_be_in(bits.value, rows.column("g").to_numpy())
            if mask.any():
                yield rows.filter(pa.array(mask)).drop_columns(["g"])

    return map_arrow(keyed.select("k", "h", F.xxhash64("k", "h").alias("g"), "text"), run, "k long, h long, text string")


def repeated_runs(slim: DataFrame) -> DataFrame:
    """(k, h, runs): the word runs [from, to) to remove from each document (k, h, text) that has any."""
    every = settle(map_arrow(slim, _select, "kind int, fp long, whole long, k long, h long, pos long, n long"))
    place = F.struct("k", "h", "pos")
    span = ["k", "h", F.col("pos").alias("s"), (F.col("pos") + F.col("n")).alias("e")]
    # Counts are settled before they are joined: a join of two plain exchanges can split a hot hash.
    lines = every.where(F.col("kind") == TEXT_LINE)
    firsts = settle(lines.groupBy("fp", "whole").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1"))
    whole_lines = lines.join(firsts, ["fp", "whole"]).where(place != F.col("f")).select(*span)

    marks = every.where(F.col("kind") == RUN)
    often = settle(marks.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"))
    again = settle(marks.join(often, "fp").select("fp", "whole", "k", "h", "pos"))
    spans = settle(again.groupBy("fp", "whole").agg(F.min(place).alias("f"), F.count("*").alias("c")))
    # Whole spans that stand earlier too.
    later = again.join(spans.where("c > 1"), ["fp", "whole"]).where(place != F.col("f"))
    q = F.shiftright("pos", 12)
    later = later.select("k", "h", (q - F.shiftright("pos", 6).bitwiseAND(F.lit(63))).alias("s"), (q - F.col("pos").bitwiseAND(F.lit(63)) + SPAN).alias("e"))
    inside = every.where(F.col("kind") == INSIDE).select(*span)
    # Where one line stands in different spans, the spans' windows are compared one by one.
    several = settle(spans.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"))
    asked = settle(spans.join(several, "fp").select("f.k", "f.h", "f.pos").groupBy("k", "h").agg(F.collect_set("pos").alias("marks")))
    windows = settle(map_arrow(_only(slim, asked).join(asked, ["k", "h"]), _extend, "a long, b long, k long, h long, pos long"))
    least = settle(windows.groupBy("a", "b").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1"))
    single = windows.join(least, ["a", "b"]).where(place != F.col("f")).select("k", "h", F.col("pos").alias("s"), (F.col("pos") + SPAN).alias("e"))
    runs = later.unionByName(inside).unionByName(single).unionByName(whole_lines)
    # A set, so that rows that repeat a document add nothing.
    return runs.groupBy("k", "h").agg(F.collect_set(F.struct("s", "e")).alias("runs"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with later repeats cut from ``text``.

    Adds __sd_words and __sd_gone (words before, words removed); columns of these names must not be
    there. A document is named by doc_id and text: rows that repeat both are one document and are cut
    alike; a null doc_id comes after every other; null and empty texts stay as they are; a text of
    which all lines stand before becomes empty; no rows, no rows.
    """
    k, h = fresh(docs, "k", "h")
    keyed = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), h: F.xxhash64("text")})
    slim = keyed.select(F.col(k).alias("k"), F.col(h).alias("h"), "text")
    runs = settle(repeated_runs(slim).withColumnsRenamed({"k": k, "h": h}))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in kept] + ["text", "__sd_words", "__sd_gone"]
    column = fresh(docs, "runs")[0]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lo, hi = (x.to_numpy() for x in rows.column(column).flatten().flatten())
            ends = np.cumsum(pc.fill_null(pc.list_value_length(rows.column(column)), 0).to_numpy())
            done, a = [], 0
            for t, b in zip(rows.column("text").to_pylist(), ends.tolist(), strict=True):
                done.append((t, 0, 0) if t is None else cut(t, lo[a:b], hi[a:b]))
                a = b
            new, words, gone = (list(x) for x in zip(*done, strict=True)) if done else ([], [], [])
            yield pa.RecordBatch.from_arrays([rows.column(f.name) for f in kept] + [pa.array(new, pa.string()), pa.array(words, pa.int64()), pa.array(gone, pa.int64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string, __sd_words long, __sd_gone long"
    return map_arrow(keyed.join(runs.withColumnRenamed("runs", column), [k, h], "left"), rewrite, schema)
