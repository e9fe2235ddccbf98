"""Dense and lexical search, fusion, trimming, resolution, metrics."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.functions import columns as C
from spindrift.operators import diff, embed, resolve, retrieval

HIT = "chunk_id string, source_id string, document_id string, heading_path string, chunk_index int, content string, rank int"


def test_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    got = {r.chunk_id: round(r.score, 6) for r in retrieval.dense_topk(df, [3.0, 0.0], 10).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0}
    assert [r.chunk_id for r in retrieval.dense_topk(df, [3.0, 0.0], 3).collect()] == [1, 2, 3]
    assert retrieval.dense_topk(df, [], 3).count() == 0
    assert [r.v for r in df.select(C.is_valid_vector("embedding", 2).alias("v")).collect()] == [True, True, True, False, True]
    plan = retrieval.dense_topk(df, [3.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_terms():
    t = retrieval.terms_of
    assert set(t("oauth.clientName")) == {"oauth.clientname", "oauth", "clientname", "client", "name"}
    assert set(t("HTTPServer")) == {"httpserver", "http", "server"}
    assert t("Go go -x-.") == {"go": 2, "x": 1}
    assert set(t("/reload")) == {"/reload", "reload"}
    assert set(t("x²y")) == {"x", "y"}
    assert t("") == {} and t(None) == {}


@pytest.mark.parametrize("q", ["oauth.clientName", "defaultTools", "query-docs", "resolve-library-id", "/reload", "use the API here"])
def test_technical(spark, q):
    assert retrieval.is_technical(q)
    assert spark.range(1).select(C.has_technical_identifier(F.lit(q))).first()[0]


@pytest.mark.parametrize("q", ["How do I authenticate?", "What commands are available.", "codemode", "CLIENT NAME", "A word", ""])
def test_prose(spark, q):
    assert not retrieval.is_technical(q)
    assert not spark.range(1).select(C.has_technical_identifier(F.lit(q))).first()[0]


def test_bm25_both_ways(spark):
    rows = [("a", "alpha beta beta"), ("b", "alpha"), ("c", ""), ("d", "gamma alpha alpha beta"), ("e", "beta alpha beta"), ("f", None)]
    df = spark.createDataFrame(rows, "chunk_id string, t string")
    one = [(r.chunk_id, r.score) for r in retrieval.bm25_topk(df, "beta gamma", text="t").collect()]
    two = [(r.chunk_id, r.score) for r in retrieval.bm25_from_postings(retrieval.postings(df, "chunk_id", "t"), 6, "beta gamma").collect()]
    assert one == two
    assert [k for k, _ in one] == ["d", "a", "e"]
    assert retrieval.bm25_topk(df, "!!", text="t").count() == 0


def test_rrf(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "chunk_id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "chunk_id string, rank int")
    got = [(r.chunk_id, round(r.score, 9)) for r in retrieval.rrf([a, b]).collect()]
    assert got == [("y", round(1 / 62 + 1 / 61, 9)), ("x", round(1 / 61, 9)), ("z", round(1 / 62, 9))]


def _trim(rows, limit):
    """The rule, one row after the other."""
    groups = {}
    for r in rows:
        if r[1] and r[2] and r[3] and r[4] >= 0:
            groups.setdefault(r[1:4], []).append(r)
    run = {}
    for g, members in groups.items():
        at = sorted(m[4] for m in members)
        if len(set(at)) == len(at):
            n = 0
            for i, m in enumerate(sorted(members, key=lambda m: m[4])):
                n += i > 0 and at[i] - at[i - 1] > 1
                run[m[0]] = (g, n)
    seen, used, out, late = set(), {}, [], []
    for r in sorted(rows, key=lambda r: r[6]):
        norm = " ".join(r[5].lower().split())
        if not norm or norm in seen:
            continue
        seen.add(norm)
        k = run.get(r[0])
        if k is not None and used.get(k, 0) >= 2:
            late.append(r[0])
            continue
        used[k] = used.get(k, 0) + 1
        out.append(r[0])
    return (out + late)[:limit]


def test_trim_named_case(spark):
    rows = [(f"run-{i}", "s", "d", "Guide", i, f"text {i}", i + 1) for i in range(4)] + [("overview", "s", "d", "Overview", 9, "over", 5)]
    got = [r.chunk_id for r in retrieval.trimmed(spark.createDataFrame(rows, HIT), 5).collect()]
    assert got == ["run-0", "run-1", "overview", "run-2", "run-3"]


def test_trim_random(spark):
    rng = random.Random(4)
    every, want = [], {}
    for q in range(60):
        rows = []
        for i in range(rng.randint(0, 14)):
            rows.append((f"{q}-{i}", rng.choice(["s", "s", ""]), "d", rng.choice(["h", "g", ""]), rng.choice([-1, *range(8)]), rng.choice(["", "A  b", "a b", *map(str, range(9))]), i + 1))
        want[q] = _trim(rows, 6)
        every += [(q, *r) for r in rows]
    df = spark.createDataFrame(every, "q int, " + HIT)
    got = {q: [] for q in want}
    for r in retrieval.trimmed(df, 6, ("q",)).collect():
        got[r.q].append(r.chunk_id)
    assert got == want


LIBRARIES = [
    ("/local/pi", "Pi", "", "Terminal coding agent", "b"),
    ("/local/pi/0.9", "Pi", "0.9", "Terminal coding agent", "b"),
    ("/local/pi/1.0", "Pi", "1.0", "Terminal coding agent", "b"),
    ("/local/pi-sdk", "Pi SDK", "", "Library for agents", "b"),
    ("/local/pico-css", "PicoCSS", "", "Minimal styles", "b"),
]


@pytest.fixture
def libraries(spark):
    return spark.createDataFrame(LIBRARIES, "library_id string, name string, version string, description string, base_url string")


def test_resolve(spark, libraries):
    ids = lambda name, q="": [r.library_id for r in resolve.resolve(libraries, name, q).collect()]
    assert ids("pi")[:3] == ["/local/pi", "/local/pi/0.9", "/local/pi/1.0"]
    assert ids("pi", "sdk in v1.0")[0] == "/local/pi/1.0"
    assert ids("pico css") == ["/local/pico-css", "/local/pi", "/local/pi/0.9", "/local/pi/1.0"]
    assert ids("zzz", "coding") == ["/local/pi", "/local/pi/0.9", "/local/pi/1.0"]
    assert ids("zzz", "nothing") == []
    assert len(ids("!!!")) == 5
    assert ids("/local/pi-sdk") == ["/local/pi-sdk"]
    with pytest.raises(resolve.LibraryNotFound):
        ids("/local/none")
    with pytest.raises(ValueError, match="required"):
        ids("  ")
    counts = spark.createDataFrame([("/local/pi-sdk", 3)], "library_id string, chunks long")
    assert [(r.library_id, r.indexed_chunks) for r in resolve.resolve(libraries, "pi", "", counts).collect()] == [("/local/pi-sdk", 3)]
    assert {r.library_id: r.others for r in resolve.siblings(libraries).collect()}["/local/pi"] == ["/local/pi/1.0", "/local/pi/0.9"]


def test_metrics(spark):
    got = diff.retrieval_metrics(spark.createDataFrame([(1,), (2,), (5,)], "rank int")).first()
    assert (round(got.top1, 3), round(got.top3, 3), got.top5, round(got.mrr, 3), got.recall5) == (0.333, 0.667, 1.0, 0.567, 1.0)
    assert diff.retrieval_metrics(spark.createDataFrame([(None,)], "rank int")).first().mrr == 0


def test_diff(spark):
    shape = "chunk_id string, content_hash string, title string, heading_path string, url string"
    old = spark.createDataFrame([("same", "1", "t", "h", "u"), ("hash", "1", "t", "h", "u"), ("title", "1", "t", "h", "u"), ("gone", "1", "t", "h", "u")], shape)
    new = spark.createDataFrame([("same", "1", "t", "h", "u"), ("hash", "2", "t", "h", "u"), ("title", "1", "T", "h", "u"), ("new", "1", "t", "h", "z"), ("new", "9", "t", "h", "a")], shape)
    one = diff.one_of_each(new)
    statuses = diff.diff(one, old)
    assert {r.chunk_id: r.status for r in statuses.collect()} == {"same": "unchanged", "hash": "updated", "title": "updated", "gone": "removed", "new": "added"}
    assert diff.report(statuses, 3, 1).first().asDict() == {"discovered": 4, "fetched": 3, "skipped": 1, "indexed": 3, "added": 1, "updated": 2, "unchanged": 1, "removed": 1}
    after = diff.apply(old, one, statuses)
    assert sorted((r.chunk_id, r.content_hash) for r in after.collect()) == [("hash", "2"), ("new", "9"), ("same", "1"), ("title", "1")]


def test_embedding_text(spark):
    rows = [("T", "t", "c"), ("T", "H", " c "), (None, "H", ""), ("", "", None)]
    df = spark.createDataFrame(rows, "t string, h string, c string")
    assert [r.e for r in df.select(C.embedding_text("t", "h", "c").alias("e")).collect()] == ["T\n\nc", "T\n\nH\n\nc", "H", ""]


def test_providers(spark):
    assert embed.fnv1a(b"hello") == 0x4F9F2CAB
    v = embed.fake_vector("a b a")
    assert len(v) == 256 and round(sum(x * x for x in v), 6) == 1
    asked = []

    def answer(url, body, headers, timeout):
        asked.append(body)
        return {"data": [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(len(body["input"])))]}

    assert embed.OpenAI("m", "key", post=answer).embed(["x", "y"]) == [[0.0, 1.0], [1.0, 1.0]]
    for rows in ([{"index": 0, "embedding": [1.0]}], [{"index": 0, "embedding": [1.0]}] * 2, [{"index": 0, "embedding": [1.0]}, {"index": 7, "embedding": [1.0]}]):
        with pytest.raises(embed.EmbeddingError):
            embed.OpenAI("m", "key", post=lambda *a, r=rows: {"data": r}).embed(["x", "y"])

    def broken(*a):
        raise OSError("bad key-123 here")

    with pytest.raises(embed.EmbeddingError, match=r"\[redacted\]"):
        embed.OpenAI("m", "key-123", post=broken).embed(["x"])
    long = ["k" * 300, "k" * 301, "é" * 150, "é" * 151, "a" + "é" * 150, "ab" + "😀" * 75, "😀" * 76, "key-1" * 100, "", "�" * 101]
    cut = [embed.redact(x, "key-1") for x in long]
    assert cut[:7] == ["k" * 300, "k" * 300 + "...", "é" * 150, "é" * 150 + "...", "a" + "é" * 149 + "...", "ab" + "😀" * 74 + "...", "😀" * 75 + "..."]
    assert cut[7:] == ["[redacted]" * 30 + "...", "", "�" * 100 + "..."]
    asked = spark.createDataFrame(list(enumerate(long)), "i int, t string").select(C.redact("t", "key-1").alias("m"), "i")
    assert [r.m for r in asked.orderBy("i").collect()] == cut
    assert embed.Ollama("m", post=lambda *a: {"embedding": [1.0]}).embed(["x", "y"]) == [[1.0], [1.0]]
    for bad in ([[1.0]], [[1.0], [1.0, 2.0]], [[1.0], [float("nan")]], [[], []]):
        with pytest.raises(embed.EmbeddingError):
            embed.check(bad, 2, 0)
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string")
    assert [len(r.embedding) for r in embed.embed(df, "t", embed.Fake()).collect()] == [256, 256]


def test_identity():
    p = embed.Fake(dims=4)
    assert embed.identity(p) == "fake/fake-model/4/title-heading-v1"
    ok = embed.compatible
    assert ok("fake/fake-model/4/title-heading-v1", p)
    for bad in ("fake/fake-model/5/title-heading-v1", "fake/other/4/title-heading-v1", "fake/fake-model/04/title-heading-v1", "fake/fake-model/4", "x"):
        assert not ok(bad, p)
    unknown = embed.Fake(dims=0)
    assert ok("fake/fake-model/9/title-heading-v1", unknown) and not ok("fake/fake-model/0/title-heading-v1", unknown)


def test_batches_are_bounded(spark):
    """Python gets few rows and few bytes at once, however many rows and long texts a task has."""
    import pyarrow as pa

    from spindrift.session import BATCH_BYTES, BATCH_ROWS, spread

    sizes = lambda bs: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in bs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for n, long in ((20_000, 1), (60, 1 << 20)):
        got = spread(spark.range(n).coalesce(1).select(F.repeat(F.lit("x"), long).alias("t"))).mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in got) == n and max(r.rows for r in got) <= BATCH_ROWS and max(r.bytes for r in got) < 2 * BATCH_BYTES
    words = pa.array([" ".join(f"{x}{i}" for i in range(1000)) for x in "ab" * 400])
    parts = list(retrieval.counted_terms(words))
    assert len(parts) > 1 and max(len(p[1]) for p in parts) < retrieval.POSTED + 1000
    assert sum(len(p[1]) for p in parts) == 800_000 and all(n == 1000 for p in parts for n in set(p[3]))


def test_bm25_counts_texts_once(spark):
    """The statistics and the scores read what one scan has counted; no text is tokenised again for either."""
    df = spark.createDataFrame([("a", "alpha beta"), ("b", "beta")], "chunk_id string, t string")
    plan = retrieval.bm25_topk(df, "beta", text="t")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "settled-" in plan


def test_dense_batch_in_tiles(spark):
    """Nearest of many queries over several tiles and batches, with copies: as by a full sort."""
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 16)).astype(np.float32)
    v[1000:1400], v[4100:4130], v[7] = v[5], v[9], 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").coalesce(2)
    asked = rows.where("vec_id % 100 = 5 or vec_id in (7, 9)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    w = v.astype(np.float64)
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    want = set()
    for q in [*range(5, 6000, 100), 7, 9]:
        order = sorted((round(1.0 - float(x), 12), i) for i, x in enumerate(w @ w[q]))[:10]
        want |= {(q, i, r + 1) for r, (_, i) in enumerate(order)}
    for block in (1024, 20):
        got = retrieval.dense_topk_batch(rows, asked, 10, "vec_id", block=block).collect()
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_terms_of_batches(spark):
    """A batch's terms, told from its bytes, are those of its texts one by one; long batches come in parts."""
    import random

    import pyarrow as pa

    rng = random.Random(5)
    signs = "aB.-_/ \u00e9\u65e5\U0001f600\u00b2\u0301\uff21\u201c\u01c5\n1\u0663\u0130\x00\x85"
    texts = ["", None, "...", "Go go -x-.", "oauth.clientName", "HTTPServer /reload x\u00b2y", "-" * 5000 + "a" + "." * 3000, "A", "x" * 70_000]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["word " * (retrieval.PART // 8)] * 4
    whole = pa.array(texts, pa.string())
    for part, first in ((whole, 0), (whole.slice(5, 900), 5), (whole.slice(0, 0), 0), (whole.cast(pa.large_string()), 0)):
        got = [{} for _ in range(len(part))]
        for own, terms, tfs, lengths in retrieval.counted_terms(part):
            for i, t, tf, n in zip(own, terms.to_pylist(), tfs, lengths, strict=True):
                got[i][t] = int(tf)
                assert i >= 50 or n == retrieval.terms_of(texts[first + i]).total()
        assert got == [dict(retrieval.terms_of(t)) for t in texts[first : first + len(part)]]
    assert len(list(retrieval.tokens(whole))) >= 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:60])], "doc_id long, t string")
    asked = ["a", "b", "nothing", "client"]
    counts = {r.doc_id: (r.length, r.tf) for r in retrieval.term_counts(df, "doc_id", "t", asked).collect()}
    one = [retrieval.terms_of(t) for t in texts[:60]]
    assert counts == {i: (c.total(), [c[t] for t in asked]) for i, c in enumerate(one)}


def test_index_lists_are_bounded():
    """What a task holds does not grow with its batches; the lists made at each step are whole and sorted."""
    import pyarrow as pa

    def batch(i):
        rows = [(None if j % 9 == 0 else f"l{j % 3}", f"c{i}-{j}", "common " * (j % 3 + 1) + " ".join(f"w{(i * j + k) % 700}" for k in range(60))) for j in range(200)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["library_id", "chunk_id", "t"])

    def run(n):
        got, most, before = [], 0, pa.total_allocated_bytes()
        for b in retrieval.index_lists((batch(i) for i in range(n)), "library_id", 20_000):
            most = max(most, pa.total_allocated_bytes() - before)
            got.append(b.to_pylist())
        return got, most

    run(2)
    (few, small), (many, large) = run(4), run(24)
    assert large < 1.5 * small and len(many) > 2 * len(few)
    for part in many:
        keys = [(r["library_id"] is None, r["library_id"], r["term"].encode()) for r in part]
        assert all(a < b for a, b in zip(keys, keys[1:]) if a[1] == b[1] or not (a[0] or b[0]))
        assert all(r["total"] == sum(r["tfs"]) for r in part)
    found = {(r["library_id"], r["term"], c): (tf, n) for part in many for r in part for c, tf, n in zip(r["chunk_ids"], r["tfs"], r["lengths"], strict=True)}
    want = {}
    for i in range(24):
        for r in batch(i).to_pylist():
            c = retrieval.terms_of(r["t"])
            want |= {(r["library_id"], t, r["chunk_id"]): (tf, c.total()) for t, tf in c.items()}
    assert found == want


def test_index_lists_of_long_words_are_bounded():
    """Words of thousands of letters, none of them twice: a task holds them by their bytes, not by their number."""
    import pyarrow as pa

    def run(n):
        rows = lambda i: [" ".join(f"{i}x{j}x{k}".ljust(4000, "x") for k in range(250)) for j in range(8)]
        batches = (pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (["l"] * 8, [f"c{i}-{j}" for j in range(8)], rows(i))], ["library_id", "chunk_id", "t"]) for i in range(n))
        most, before, terms = 0, pa.total_allocated_bytes(), 0
        for b in retrieval.index_lists(batches, "library_id"):
            most, terms = max(most, pa.total_allocated_bytes() - before), terms + b.num_rows
        return most, terms

    (small, few), (large, many) = run(6), run(20)
    assert (few, many) == (6 * 2000, 20 * 2000) and large < 1.5 * small


def test_ranking_from_lists_of_bounded_bytes(spark):
    """A ranking from an index whose lists end at their bytes, many to a term, is the one that counts the texts."""
    import pyarrow as pa

    docs = [("l", f"c{i:03d}", "beta " * (i % 4) + "alpha " * (i % 3) + f"word{i}".ljust(3000, "x")) for i in range(300)]
    batches = (pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*docs[i : i + 10], strict=True)], ["library_id", "chunk_id", "t"]) for i in range(0, 300, 10))
    lists = [r for b in retrieval.index_lists(batches, "library_id", most_bytes=100_000) for r in b.to_pylist()]
    assert sum(r["term"] == "alpha" for r in lists) > 5
    index = spark.createDataFrame([tuple(r.values()) for r in lists], f"library_id string, {retrieval.INDEX}")
    table = spark.createDataFrame(docs, "library_id string, chunk_id string, t string")
    got = retrieval.bm25_from_index(index, 300, sum(r["total"] for r in lists), "alpha beta", 50).collect()
    want = retrieval.bm25_topk(table, "alpha beta", text="t", k=50).collect()
    assert len(got) == 50 and [(r.chunk_id, round(r.score, 9)) for r in got] == [(r.chunk_id, round(r.score, 9)) for r in want]
