"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration.

A document becomes a vector of statistics of its whole text. A fixed seeded projection of the
standardised vector to cosines approximates a Gaussian kernel. Each partition sums its own normal
equations by fold, Spark adds them up, and the driver solves one small system of a size that does
not depend on the data. Products are summed over values rounded to 1/4096, so the sums are exact and
come out the same in any order and after any retry. A fold is scored by the model of the other
folds; those scores, counted in a fixed number of bins, give the isotonic map to probabilities.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fresh, map_arrow, settle, texts

N_COSINES = 160
WIDTH = 4.0  # of the Gaussian kernel, in standardised units
RIDGE = 1e-3  # relative to the number of rows
BINS = 1024
ACCEPT = 0.7
HELD_OUT = 2
FOLDS = 4
SEED = 20240501

NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "space", "newline", "high", "sentence_marks", "quotes", "symbols",
    "bars", "bangs", "byte_entropy", "distinct_words", "log_distinct", "top_word", "top5_words", "same_as_before", "same_as_second_before",
    "line_words", "distinct_lines", "compressed", "short_words", "long_words", "bare_words", "marked_ends", "word_entropy", "upper_words",
)
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "newline": (10, 13), "high": range(128, 256),
    "sentence_marks": b".,;:?", "quotes": b"'\"()-", "symbols": b"#$%&*+/<=>@[\\]^_`{}~", "bars": b"|", "bangs": b"!",
}
_TABLE = np.zeros((len(_CLASSES), 256))
for _i, _c in enumerate(_CLASSES.values()):
    _TABLE[_i, list(_c)] = 1
_MARKED = frozenset(b"#$%&*!|@^~")


def statistics(text: str) -> list[float]:
    """The document's statistics, all of them finite, also for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (_TABLE @ counts) / max(n, 1)
    p = counts[counts > 0] / max(n, 1)
    words = raw.split()
    w = max(len(words), 1)
    often = Counter(words)
    top = [c for _, c in often.most_common(5)]
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    word_counts = np.fromiter(often.values(), np.float64, len(often)) / w
    before = sum(map(bytes.__eq__, words, words[1:]))
    second = sum(map(bytes.__eq__, words, words[2:]))
    marked = sum(x[-1] in _MARKED for x in words)
    bare = sum(x in (b"|", b"-", b"*") for x in words)
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(n / w), *shares.tolist(), float(-(p * np.log2(p)).sum()) if n else 0.0,
        len(often) / w, math.log1p(len(often)), (top[0] if top else 0) / w, sum(top) / w, before / w, second / w,
        math.log1p(len(words) / len(lines)), len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / (n + 12),
        float((lengths <= 2).sum()) / w, float((lengths >= 13).sum()) / w, bare / w, marked / w,
        float(-(word_counts * np.log2(word_counts)).sum()) / math.log2(w + 1) if words else 0.0, sum(map(bytes.isupper, words)) / w,
    ]


_FEATURES = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("x", pa.list_(pa.float64()))])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        x = [statistics(t) for t in texts(rows.column("text"))]
        yield batch(_FEATURES, doc_id=rows.column("doc_id"), h=rows.column("h"), x=x)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, h, x): the text hash names a row beside its id; both are never inputs of a score."""
    return map_arrow(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text"), _featurize, "doc_id long, h long, x array<double>")


def fold_of(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def _projection(d: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(0.0, 1.0 / WIDTH, (d, N_COSINES)), rng.uniform(0.0, 2 * math.pi, N_COSINES)


def cosines(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features with a constant, rounded to 1/4096."""
    w, b = _projection(x.shape[1])
    z = math.sqrt(2.0) * np.cos(np.clip((x - mean) / scale, -6, 6) @ w + b)
    return np.round(np.hstack([z, np.ones((len(x), 1))]) * 4096) / 4096


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _gram(mean: np.ndarray, scale: np.ndarray):
    width = N_COSINES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            if not rows.num_rows:
                continue
            z, y, fold = cosines(_matrix(rows.column("x")), mean, scale), rows.column("y").to_numpy(), rows.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                zf = z[fold == f]
                full = np.hstack([zf.T @ zf, (zf.T @ y[fold == f])[:, None]])
                sums[f] = sums[f] + full if f in sums else full
        for f, s in sums.items():
            columns = [pa.array(np.full(width, f, np.int32)), pa.array(np.arange(width, dtype=np.int32)), *[pa.array(c) for c in s.T.copy()]]
            yield pa.RecordBatch.from_arrays(columns, ["fold", "i", *[f"c{j}" for j in range(width + 1)]])

    return run, "fold int, i int, " + ", ".join(f"c{j} double" for j in range(width + 1))


def _solve(s: np.ndarray) -> np.ndarray:
    rows = max(s[-1, -2], 1.0)  # the constant's square counts the rows
    return np.linalg.solve(s[:, :-1] + RIDGE * rows * np.eye(len(s)), s[:, -1])


def isotonic(bins: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and rising values through them."""
    blocks: list[list[float]] = []
    for at, g, n in zip(bins.tolist(), good.tolist(), total.tolist(), strict=True):
        blocks.append([at * n, g, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1.0) for b in blocks])


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)


def fit(train: DataFrame) -> dict | None:
    """Fit from (x, y, fold); None without rows. Only sums of fixed size reach the driver."""
    width = N_COSINES + 1
    d = len(NAMES)
    moments = train.agg(F.count("*"), *[F.sum(F.round(F.col("x")[j], 6).cast("decimal(38,6)")) for j in range(d)], *[F.sum(F.round(F.col("x")[j] * F.col("x")[j], 6).cast("decimal(38,6)")) for j in range(d)]).first()
    n = moments[0]
    if not n:
        return None
    one, two = np.array(moments[1 : d + 1], float) / n, np.array(moments[d + 1 :], float) / n
    mean, scale = one, np.sqrt(np.maximum(two - one**2, 0))
    scale[scale < 1e-4] = 1.0
    run, schema = _gram(mean, scale)
    cells = map_arrow(train.select("x", "y", "fold"), run, schema).groupBy("fold", "i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width + 1)])
    by_fold: dict[int, np.ndarray] = {}
    for r in cells.collect():
        by_fold.setdefault(r[0], np.zeros((width, width + 1)))[r[1]] = r[2:]
    total = sum(by_fold.values())
    weights = {f: _solve(total - s) if len(by_fold) > 1 else _solve(total) for f, s in by_fold.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, every = np.zeros(BINS), np.zeros(BINS)
        for rows in batches:
            if rows.num_rows:
                z, fold, y = cosines(_matrix(rows.column("x")), mean, scale), rows.column("fold").to_numpy(), rows.column("y").to_numpy()
                at = _bin(np.array([z[i] @ weights[f] for i, f in enumerate(fold.tolist())]))
                good += np.bincount(at, weights=y, minlength=BINS)
                every += np.bincount(at, minlength=BINS)
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(good[some]), pa.array(every[some])], ["bin", "good", "n"])

    counted = map_arrow(train.select("x", "y", "fold"), count, "bin int, good double, n double").groupBy("bin").agg(F.sum("good"), F.sum("n")).orderBy("bin").collect()
    b, g, m = (np.array(x, float) for x in zip(*counted, strict=True))
    knots, values = isotonic((b + 0.5) * 2 / BINS - 0.5, g, m)
    return {"mean": mean, "scale": scale, "w": _solve(total), "knots": knots, "values": values}


_SCORE = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("score", pa.float64())])


def _scorer(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            if model is None:
                score = np.full(rows.num_rows, 0.5)
            else:
                raw = cosines(_matrix(rows.column("x")), model["mean"], model["scale"]) @ model["w"]
                # The last thousandth keeps the order inside a flat stretch of the isotonic map.
                score = 0.999 * np.interp(raw, model["knots"], model["values"]) + 0.001 / (1 + np.exp(-4 * (raw - 0.5)))
            yield batch(_SCORE, doc_id=rows.column("doc_id"), h=rows.column("h"), score=np.round(score, 9))

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, h, score), one row per row of ``docs``; h is the hash of its text."""
    x = settle(features(docs))
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    train = x.where(fold_of(F.col("doc_id")) != HELD_OUT).join(truth, "doc_id").withColumn("fold", fold_of(F.col("doc_id")))
    return map_arrow(x, _scorer(fit(settle(train.select("x", "y", "fold")))), "doc_id long, h long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.7 on) for every row of ``docs``.

    Labels of held-out ids are never read. A null or empty text gets the score of its statistics (all
    zero counts); a null doc_id is never trained on; a doc_id that is labelled twice counts as its
    better label; without any label every score is 0.5; no rows, no rows.
    """
    fold = fold_of(F.col("doc_id"))
    return scored(docs, labels).select("doc_id", (fold == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose predicted quality is 1, with all their columns."""
    low, (k, h) = F.lit(-(1 << 63)), fresh(docs, "k", "h")
    # Settled, so that many rows of one key, as null ids are, can be split in the join.
    good = settle(scored(docs, labels).where(F.col("score") >= ACCEPT).select(F.coalesce("doc_id", low).alias(k), F.col("h").alias(h)).distinct())
    keyed = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), low), h: F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(good, [k, h], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
