"""Mixing sources to target weights with soft membership.

A classifier fitted on the labelled rows gives each document a posterior over domains (here the
language of a labelled document). The rate of a document is how often it should be read; rates are the
nonnegative numbers nearest to 1, weighted by tokens, for which the expected tokens of each domain
meet their targets. Only proportions are asked for, so the total is by default the least one at which
no domain has to be thinned: the scarce are repeated and clean documents stay. Rates are found by
projected gradient on least squares, preconditioned by the domains' Gram matrix over the documents whose
rate is not held at zero, until the targets
are met or a step gains nothing more; what is then still missing is given as the residual. A step changes a rate only through the domains' residuals, so the driver
keeps one short vector for each step and every document replays the steps from its own posterior;
nothing but sums over the domains leaves the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fresh, map_arrow, settle, texts

#: Shares of the mixed tokens; a domain that is not named shares what is left in proportion.
TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15}
FIT_ROWS = 20_000  # labelled rows that the classifier is fitted on, at most; the least id hashes
BUCKETS = 4096
# The words' log-likelihood counts as that of STRENGTH * n / (n + HALF) words: nearly all of it in a short
# text, never more than STRENGTH words' worth in a long one, so that mixed texts keep several domains.
STRENGTH, HALF = 16.0, 64.0
STEPS = 200  # at most; each is one pass over short vectors
CLOSE = 1e-6  # residual, as a share of all tokens, that ends the search
GAIN = 1e-3  # share of the residual that PATIENCE steps must take away
PATIENCE = 8


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class _Buckets(dict):
    """Bucket of each word seen; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = b = _bucket(word)
        return b


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    buckets = _Buckets()
    for rows in batches:
        for domain, t in zip(rows.column("domain").to_pylist(), texts(rows.column("text")), strict=True):
            own = sums.setdefault(domain, np.zeros(BUCKETS, np.int64))
            words = t.encode("utf-8", "surrogatepass").lower().split()
            own += np.bincount(np.fromiter((buckets[w] for w in words), np.int64, len(words)), minlength=BUCKETS)
    for domain, own in sums.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([domain] * len(some), pa.string()), pa.array(some), pa.array(own[some])], ["domain", "bucket", "n"])


def fit(docs: DataFrame, labels: DataFrame, domain: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(domains, log-likelihood of each bucket, log-prior) from at most FIT_ROWS labelled rows; every domain of theirs is one."""
    ids = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.select("doc_id", F.coalesce(F.col(domain).cast("string"), F.lit("other")).alias("domain"), "text").join(F.broadcast(ids), "doc_id")
    cells = map_arrow(rows.select("domain", "text"), _counts, "domain string, bucket long, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n"))
    cells = settle(cells)
    table: dict[str, np.ndarray] = {}
    for d, b, n in cells.collect():
        table.setdefault(d, np.zeros(BUCKETS))[b] = n
    names = sorted(table) or ["other"]
    counts = np.stack([table.get(d, np.zeros(BUCKETS)) for d in names])
    like = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS))
    prior = np.log((counts.sum(axis=1) + 1) / (counts.sum() + len(names)))
    return names, like, prior


_POSTERIOR = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])


def _posteriors(like: np.ndarray, prior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for rows in batches:
            ps, ns = [], []
            for t in texts(rows.column("text")):
                words = t.encode("utf-8", "surrogatepass").lower().split()
                n = len(words)
                score = prior.copy()
                if n:
                    counts = np.bincount(np.fromiter((buckets[w] for w in words), np.int64, n), minlength=BUCKETS)
                    score += STRENGTH / (n + HALF) * (like @ counts)
                e = np.exp(score - score.max())
                # Multiples of 2^-20, so that sums over documents are the same in any order.
                p = np.round(e / e.sum() * (1 << 20)) / (1 << 20)
                ps.append((p / p.sum()).tolist())
                ns.append(n)
            yield batch(_POSTERIOR, doc_id=rows.column("doc_id"), h=rows.column("h"), n_tokens=ns, p=ps)

    return run


def _rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(r - p @ s, 0.0)
    return r


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _sum_rows(df: DataFrame, per_batch, width: int) -> np.ndarray:
    """Sums over all rows of the ``width`` numbers that ``per_batch`` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for rows in batches:
            if rows.num_rows:
                total += per_batch(_matrix(rows.column("p")), rows.column("n_tokens").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{i}" for i in range(width)])

    got = map_arrow(df.select("p", "n_tokens"), run, ", ".join(f"s{i} double" for i in range(width))).agg(*[F.sum(f"s{i}") for i in range(width)]).first()
    return np.array([x or 0.0 for x in got])


def solve(posteriors: DataFrame, names: list[str], targets: dict[str, float], total: float | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float]:
    """(steps, target tokens, expected tokens, residual) of the projected gradient search.

    The residual is the greatest distance of a domain to its target, as a share of all target tokens.
    """
    k = len(names)

    steps: list[np.ndarray] = []

    def moments(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        rate = _rates(p, steps)
        free = p[rate > 0]
        return np.concatenate([p.T @ (n * rate), (free.T @ (free * n[rate > 0, None])).ravel()])

    def tokens() -> tuple[np.ndarray, np.ndarray]:
        both = _sum_rows(posteriors, moments, k + k * k)
        return both[:k], both[k:].reshape(k, k)

    now, gram = tokens()
    seen = now.sum()
    share = np.array([targets.get(d, -1.0) for d in names])
    left, rest = max(0.0, 1 - share[share >= 0].sum()), now * (share < 0)
    share = np.where(share >= 0, share, left * rest / max(rest.sum(), 1e-12))
    share = share / max(share.sum(), 1e-12)
    if total is None:
        total = float((now[share > 0] / share[share > 0]).max(initial=0.0))
    target = share * total
    if not seen or not total:
        return steps, target, now, 0.0
    history = [float(np.abs(now - target).max() / total)]
    while history[-1] > CLOSE and len(steps) < STEPS:
        if len(history) > PATIENCE and history[-1] > (1 - GAIN) * history[-1 - PATIENCE]:
            break
        steps.append(np.round(np.linalg.solve(gram + 1e-9 * seen * np.eye(k), now - target), 12))
        now, gram = tokens()
        history.append(float(np.abs(now - target).max() / total))
    return steps, target, now, history[-1]


_MIX = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_tokens", pa.int64()), ("domain", pa.string()), ("share", pa.float64()), ("rate", pa.float64()), ("copies", pa.int64()), ("residual", pa.float64())])


def _mixer(names: list[str], steps: list[np.ndarray], residual: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            p = _matrix(rows.column("p"))
            rate = np.round(_rates(p, steps), 6)
            # Copies have the rate as their mean; the coin is the document's own.
            coins = np.array([xxhash.xxh64_intdigest(f"{d}:{h}".encode(), 7) / 2**64 for d, h in zip(rows.column("doc_id").to_pylist(), rows.column("h").to_pylist(), strict=True)])
            best = p.argmax(axis=1)
            yield batch(_MIX, doc_id=rows.column("doc_id"), h=rows.column("h"), n_tokens=rows.column("n_tokens"), domain=[names[i] for i in best], share=np.round(p[np.arange(len(p)), best], 6), rate=rate, copies=np.floor(rate + coins).astype(np.int64), residual=np.full(len(p), round(residual, 9)))

    return run


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang") -> DataFrame:
    """(doc_id, h, n_tokens, domain, share, rate, copies, residual) for every row of ``docs``; h hashes its text.

    ``domain`` and ``share`` are the likeliest domain and its posterior; ``residual`` is that of ``solve``
    and stands in every row: over CLOSE, the targets can't be met. A null or empty text has no tokens, the
    prior as posterior and the rate that follows from it; a null doc_id is passed on; repeated rows get
    equal rates; a null domain is "other"; without labels there is one domain, "other", and every rate is
    1; no rows, no rows. A target that is given for a domain of no labelled row is an error; of the default
    TARGETS those are left out, and the others keep their proportions.
    """
    names, like, prior = fit(docs, labels, domain)
    if targets and (unknown := set(targets) - set(names)):
        raise ValueError(f"no labelled row of the domains {', '.join(sorted(unknown))}")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    posteriors = settle(map_arrow(keyed, _posteriors(like, prior), "doc_id long, h long, n_tokens long, p array<double>"))
    steps, _, _, residual = solve(posteriors, names, targets or {d: t for d, t in TARGETS.items() if d in names})
    return map_arrow(posteriors, _mixer(names, steps, residual), "doc_id long, h long, n_tokens long, domain string, share double, rate double, copies long, residual double")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their columns, rate and copies (1 or more).

    Where ``docs`` has a column of that name, mix_ stands before the new one, as often as it takes.
    """
    low, (k, h, rate, copies) = F.lit(-(1 << 63)), fresh(docs, "k", "h", "rate", "copies")
    rates = mixing_rates(docs, labels, targets).where("copies > 0")
    rates = rates.select(F.coalesce("doc_id", low).alias(k), F.col("h").alias(h), F.col("rate").alias(rate), F.col("copies").alias(copies))
    # Settled, so that many rows of one key, as null ids are, can be split in the join.
    rates = settle(rates.dropDuplicates([k, h]))
    keyed = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), low), h: F.xxhash64(F.coalesce("text", F.lit("")))})
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("rate", "copies"):
        while name in taken:
            name = f"mix_{name}"
        names.append(name)
    return keyed.join(rates, [k, h]).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(rate).alias(names[0]), F.col(copies).alias(names[1]))
