"""The store, the registry, settings, the verbs and the two tools, end to end."""

import pytest

from spindrift.operators import embed
from spindrift.plans.library import IdentityMismatch, Library, argument, call_tool
from spindrift.sources.store import ChunkNotFound, ChunkStore, CommitConflict, InvalidChunk, Registry, Source, load_config, new_library_id, parse_library_id
from spindrift.streaming import ingest

SITE = {
    "/docs": '<main><h1>Start</h1><p>Welcome to the guide.</p><a href="/docs/auth">auth</a><a href="/docs/tools">tools</a></main>',
    "/docs/auth": "<main><h1>Auth</h1><p>Send oauth.clientName with every request.</p><h2>Keys</h2><p>Keys rotate.</p></main>",
    "/docs/tools": "<main><h1>Tools</h1><p>The defaultTools setting lists tools.</p></main>",
}


def site(spark, pages):
    return spark.createDataFrame([(f"https://s.test{p}", h) for p, h in pages.items()], "url string, html string")


@pytest.fixture
def library(spark, tmp_path):
    lib = Library(spark, str(tmp_path), embed.Fake())
    lib.report = lib.add("Acme Docs", "https://s.test/docs", site(spark, SITE), description="Guide of acme")
    return lib


def test_add_sync_remove(spark, library):
    assert library.report == {"discovered": 3, "fetched": 3, "skipped": 0, "indexed": 4, "added": 4, "updated": 0, "unchanged": 0, "removed": 0}
    again = library.sync("/local/acme-docs", site(spark, SITE))
    assert (again["unchanged"], again["indexed"], again["removed"]) == (4, 0, 0)
    changed = SITE | {"/docs/tools": SITE["/docs/tools"].replace("lists", "names"), "/docs/auth": "<main><h1>Auth</h1><p>Send oauth.clientName with every request.</p></main>"}
    third = library.sync("/local/acme-docs", site(spark, changed))
    assert (third["added"], third["updated"], third["unchanged"], third["removed"]) == (0, 1, 2, 1)
    row = library.list().first()
    assert (row.library_id, row.chunks, row.pages) == ("/local/acme-docs", 3, 3)
    assert library.find("acme docs").library_id == "/local/acme-docs"
    library.remove("/local/acme-docs")
    assert library.store.read().count() == 0 and library.store.identity == ""
    with pytest.raises(LookupError):
        library.find("acme docs")


def test_other_parts(spark, tmp_path):
    """A crawler, a parser, a chunker and a store of one's own take the places of the built-in ones."""
    from pyspark.sql import functions as F

    from spindrift.operators.chunking import chunk
    from spindrift.operators.html_markdown import parse_pages

    calls = []

    def crawler(spark, pages, start, includes, excludes, robots, sitemap, **limits):
        calls.append((start, limits))
        return pages.select("url", "html").withColumn("depth", F.lit(0))

    def parser(pages):
        return parse_pages(pages).withColumn("title", F.upper("title"))

    def chunker(documents, source_id, library_id, version):
        return chunk(documents, source_id, library_id, version).where("chunk_index = 0")

    store = ChunkStore(spark, str(tmp_path / "elsewhere"))
    lib = Library(spark, str(tmp_path / "own"), embed.Fake(), crawler=crawler, parser=parser, chunker=chunker, store=store, max_pages=7)
    report = lib.add("Acme Docs", "https://s.test/docs", site(spark, SITE))
    assert report["fetched"] == 3 and calls == [("https://s.test/docs", {"max_pages": 7})]
    rows = store.read().collect()
    assert rows and {r.chunk_index for r in rows} == {0} and all(r.title == r.title.upper() for r in rows)
    assert lib.reindex("/local/acme-docs", site(spark, SITE)) == {"indexed": len(rows)} and len(calls) == 2


def test_add_without_pages_leaves_nothing(spark, library):
    with pytest.raises(LookupError, match="no page"):
        library.add("Other", "https://none.test/docs", site(spark, SITE))
    assert [s.library_id for s in library.registry.list()] == ["/local/acme-docs"]
    with pytest.raises(ValueError, match="registered"):
        library.add("Acme Docs", "https://s.test/docs", site(spark, SITE))


def test_identity_guard(spark, library):
    library.provider = embed.Fake(model="other")
    with pytest.raises(IdentityMismatch):
        library.sync("/local/acme-docs", site(spark, SITE))
    assert library.store.read().count() == 4
    assert library.reindex("/local/acme-docs", site(spark, SITE)) == {"indexed": 4}
    assert library.store.identity == "fake/other/256/title-heading-v1"


def test_failed_embedding_keeps_the_old_table(spark, library):
    class Broken(embed.Fake):
        def embed(self, texts):
            return [[float("nan")] * 256 for _ in texts]

    library.provider = Broken()
    with pytest.raises(Exception):  # noqa: B017
        library.sync("/local/acme-docs", site(spark, SITE | {"/docs/tools": "<main><p>new</p></main>"}))
    assert library.store.read().where("content like '%defaultTools%'").count() == 1


def test_tools(library):
    text, error = call_tool(library, "query-docs", {"libraryID": "/local/acme-docs", "q": "oauth.clientName"})
    assert not error
    assert text.startswith("### Auth\n\nSource: https://s.test/docs/auth\nLibrary: /local/acme-docs\n\n# Auth")
    assert "\n---\n\n### " in text and "chunk" not in text
    text, error = call_tool(library, "resolve-library-id", {"libraryName": "acme docs", "query": "guide"})
    assert (text, error) == ("Available Libraries:\n\n- Library ID: /local/acme-docs\n  Name: Acme Docs\n  Description: Guide of acme\n  Indexed Chunks: 4", False)
    assert call_tool(library, "resolve-library-id", {"libraryName": "zzz", "query": "q"}) == ("No indexed libraries match that name.", False)
    assert call_tool(library, "query-docs", {"query": "x"}) == ("libraryId is required", True)
    assert call_tool(library, "query-docs", {"libraryId": "/local/none", "query": "x"})[1]
    assert call_tool(library, "query-docs", {"libraryId": "none", "query": "x"})[1]
    assert argument({"query": "a", "q": "b"}, "query") == "a"


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"))
    row = lambda i, **k: {"chunk_id": i, "source_id": "s", "library_id": "/local/a", "version": "", "document_id": "d", "url": "u", "title": "", "heading_path": "", "chunk_index": 0, "content": "c", "content_hash": "h", "embedding": [1.0]} | k
    frame = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], store.read().schema)
    assert store.read().count() == 0
    store.upsert(frame(row("1"), row("2")))
    store.upsert(frame(row("2", content="new"), row("3", source_id="t", library_id="/local/b")))
    assert sorted((r.chunk_id, r.content) for r in store.read().collect()) == [("1", "c"), ("2", "new"), ("3", "c")]
    assert store.get("2")["content"] == "new"
    with pytest.raises(ChunkNotFound):
        store.get("9")
    with pytest.raises(InvalidChunk):
        store.upsert(frame(row(" ")))
    reader = store.read()
    store.delete(["1", "missing"])
    assert sorted(r.chunk_id for r in store.read().collect()) == ["2", "3"]
    assert reader.count() == 3  # the snapshot that was resolved before
    store.delete_source("t")
    assert [r.chunk_id for r in store.read().collect()] == ["2"]
    plan = store.read().where("library_id = '/local/a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(library_id" in plan


def test_registry(spark, tmp_path):
    reg = Registry(spark, str(tmp_path))
    assert reg.list() == []
    first = reg.add(Source("/local/b", "B", "https://b.test/x"))
    reg.add(Source("/local/a", "A", "https://a.test/x", includes=["/x/**"]))
    assert [s.library_id for s in reg.list()] == ["/local/a", "/local/b"]
    assert reg.update(Source("/local/b", "B2", "https://b.test/x")).created_at == first.created_at
    assert reg.table().count() == 2
    reg.delete("/local/a")
    with pytest.raises(LookupError):
        reg.get("/local/a")
    assert (new_library_id("Pico CSS!", "1.0"), parse_library_id("/org/x/2")) == ("/local/pico-css/1.0", ("org", "x", "2"))
    for bad in ("/org/x", "x", "/local/", "/a/b/c/d"):
        with pytest.raises(ValueError, match="no library id"):
            parse_library_id(bad)


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("SPINDRIFT_API_KEY", " secret ")
    f = tmp_path / "c.toml"
    f.write_text('[data]\npath = "/x"\n[crawler]\nmax_pages = 5\n[embedding]\nprovider = "openai"\nmodel = "m"\napi_key = "leak"\n')
    c = load_config(str(f), max_depth=3)
    assert (c.data_path, c.max_pages, c.max_depth, c.api_key, c.concurrency) == ("/x", 5, 3, "secret", 4)
    assert load_config(str(tmp_path / "none.toml")).max_pages == 1000
    for bad in ({"max_pages": 0}, {"provider": "ollama", "model": ""}, {"provider": "nope"}, {"zzz": 1}):
        with pytest.raises(ValueError):
            load_config("", **bad)


def test_stream_batch(spark, tmp_path):
    store, source = ChunkStore(spark, str(tmp_path / "c")), Source("/local/s", "S", "https://s.test/docs", id="sid")
    first = ingest.apply_batch(store, source, embed.Fake(), site(spark, SITE))
    assert (first["added"], first["removed"]) == (4, 0)
    assert ingest.apply_batch(store, source, embed.Fake(), site(spark, SITE))["unchanged"] == 4
    page = {"/docs/auth": "<main><h1>Auth</h1><p>Changed.</p></main>"}
    second = ingest.apply_batch(store, source, embed.Fake(), site(spark, page))
    assert (second["updated"], second["removed"], store.read().count()) == (1, 1, 3)
    # A page that has become empty loses its chunks; vectors of another kind are refused.
    third = ingest.apply_batch(store, source, embed.Fake(), site(spark, {"/docs/tools": "<main></main>"}))
    assert (third["removed"], store.read().count()) == (1, 2)
    with pytest.raises(IdentityMismatch):
        ingest.apply_batch(store, source, embed.Fake(model="other"), site(spark, page))


def test_stream_with_a_width_of_its_own(spark, tmp_path):
    """A provider that tells its width only by answering is recorded with that width, and may go on."""

    class Silent(embed.Fake):
        def embed(self, texts):
            return [embed.fake_vector(t, 8) for t in texts]

    store, source = ChunkStore(spark, str(tmp_path / "c")), Source("/local/s", "S", "https://s.test/docs", id="sid")
    ingest.apply_batch(store, source, Silent(dims=0), site(spark, SITE))
    assert store.identity == "fake/fake-model/8/title-heading-v1"
    assert ingest.apply_batch(store, source, Silent(dims=0), site(spark, SITE))["unchanged"] == 4


def test_stream(spark, tmp_path):
    folder, store = tmp_path / "in", ChunkStore(spark, str(tmp_path / "c"))
    site(spark, SITE).write.json(str(folder))
    pages = spark.readStream.schema("url string, html string").json(str(folder))
    q = ingest.stream(pages, store, Source("/local/s", "S", "https://s.test/docs", id="sid"), embed.Fake(), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert store.read().count() == 4


def test_store_writes_only_what_changes(spark, tmp_path):
    """A commit of one library leaves the others' folders; of two writers on one library, one fails and is not seen."""
    store = ChunkStore(spark, str(tmp_path / "c"))
    row = lambda i, lib, content="alpha beta": (i, lib, f"/local/{lib}", "", "d", "u", "", "", 0, content, "h", [1.0])
    frame = lambda *rows: spark.createDataFrame(list(rows), store.read().schema)
    store.commit(frame(row("1", "a"), row("2", "b"), row("3", "b", "beta beta gamma")), "id")
    before = store._state()["libraries"]
    base = store.version
    store.commit(frame(row("1", "a", "delta")), None, ["/local/a"], base)
    after = store._state()["libraries"]
    assert after["/local/b"] == before["/local/b"] and after["/local/a"] != before["/local/a"]
    store.commit(frame(row("2", "b", "epsilon")), None, ["/local/b"], base)  # other libraries moved on: no conflict
    with pytest.raises(CommitConflict):
        store.commit(frame(row("9", "a")), None, ["/local/a"], base)
    assert sorted((r.chunk_id, r.content) for r in store.read().collect()) == [("1", "delta"), ("2", "epsilon")]
    assert store.files.create(f"manifests/{store.version:012d}.json", "{}") is False  # whoever comes second
    assert store.delete(["1"]) and "/local/a" not in store._state()["libraries"] and store.read("/local/a").count() == 0
    # Vectors that are given go before the chunks' own.
    given = spark.createDataFrame([("7", [5.0, 6.0]), ("8", [])], "chunk_id string, embedding array<float>")
    store.upsert(frame(row("7", "c"), row("8", "c")), vectors=given)
    assert {r.chunk_id: r.embedding for r in store.listing(library_id="/local/c").collect()} == {"7": [5.0, 6.0], "8": [1.0]}
    for _ in range(4):
        store.upsert(frame(row("7", "c")))
    assert len(store.files.list("manifests")) == 2 and len(store.files.list("chunks/")) <= 7


def test_stored_postings(spark, tmp_path):
    """The index ranks as the texts do, and a search with it reads no text to score."""
    from spindrift.operators import retrieval

    store = ChunkStore(spark, str(tmp_path / "c"))
    contents = ["alpha beta beta", "alpha", "", "gamma alpha alpha beta oauth.clientName", "beta alpha beta", None]
    rows = [(str(i), "s", "/local/a", "", "d", "u", "T", "H", i, c, "h", [1.0, float(i)]) for i, c in enumerate(contents)] + [("x", "t", "/local/b", "", "d", "u", "", "", 0, "beta " * 9, "h", [1.0, 0.0])]
    store.commit(spark.createDataFrame(rows, store.read().schema), "id")
    for q in ("beta gamma", "oauth.clientName", "t h", "nothing", "!!"):
        want = [(r.chunk_id, r.score) for r in retrieval.bm25_topk(store.read("/local/a"), q).collect()]
        lexical = store.lexical("/local/a", q)
        assert [(r.chunk_id, r.score) for r in lexical.collect()] == want
        plan = lexical._jdf.queryExecution().executedPlan().toString()
        assert "content" not in plan and "Python" not in plan and "Arrow" not in plan
    plan = store.lexical("/local/a", "beta gamma")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan
    one = retrieval.search(store.read("/local/a"), "oauth.clientName", [1.0, 0.0]).collect()
    assert one == retrieval.search(store.read("/local/a"), "oauth.clientName", [1.0, 0.0], lexical=store.lexical("/local/a", "oauth.clientName")).collect()
    assert store.lexical("/local/none", "beta").count() == 0


def test_one_canonical_url(spark, tmp_path):
    """Of pages with one canonical URL, the one of the smallest page URL gives the chunks, in every run."""
    link = '<link rel=canonical href="https://s.test/docs/main">'
    pages = {"/docs": '<a href="/docs/b">b</a><a href="/docs/a">a</a><p>Start.</p>', "/docs/b": f"{link}<main><h1>T</h1><p>From b.</p></main>", "/docs/a": f"{link}<main><h1>T</h1><p>From a.</p></main>"}
    lib = Library(spark, str(tmp_path), embed.Fake())
    lib.add("Acme", "https://s.test/docs", site(spark, pages))
    assert [r.content for r in lib.store.read().where("url like '%main'").collect()] == ["# T\n\nFrom a."]


def test_default_provider(tmp_path, monkeypatch):
    monkeypatch.setenv(embed.MODEL_VARIABLE, str(tmp_path))
    with pytest.raises(embed.EmbeddingError, match="model.onnx and tokenizer.json"):
        embed.default()
    for f in ("model.onnx", "tokenizer.json"):
        (tmp_path / f).write_text("")
    assert embed.default().name == "local"


def test_command_line(spark, tmp_path):
    import io
    import json

    from spindrift.__main__ import main

    site(spark, SITE).write.parquet(str(tmp_path / "pages"))
    (tmp_path / "config.toml").write_text('[embedding]\nprovider = "fake"\n[search]\nfinal_chunks = 1\n')

    def run(*args, lines=None):
        out = io.StringIO()
        code = main(["--config", str(tmp_path / "config.toml"), "--data", str(tmp_path / "data"), *args], spark, out, lines)
        return code, out.getvalue()

    assert run("version")[1] == "0.1.0\n"
    code, text = run("add", "https://s.test/docs", "--name", "Acme", "--pages", str(tmp_path / "pages"))
    assert (code, json.loads(text)["added"]) == (0, 4)
    assert "/local/acme\tAcme\t4 chunks\t3 pages" in run("list")[1]
    assert "Source: https://s.test/docs/auth" in run("search", "acme", "oauth.clientName")[1]
    calls = [json.dumps({"tool": "query-docs", "arguments": {"libraryId": "/local/acme", "query": "Keys"}}), json.dumps({"tool": "none"})]
    answers = [json.loads(x) for x in run("serve", lines=calls)[1].splitlines()]
    assert not answers[0]["error"] and answers[1]["error"]
    assert run("info", "acme")[0] == 0 and run("remove", "acme")[0] == 0 and run("info", "acme")[0] == 1


def test_crawl_over_http(spark):
    import functools
    import http.server
    import threading

    from spindrift.sources import web

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/docs/away":
                self.send_response(302)
                self.send_header("Location", "http://localhost.test/x")
                self.end_headers()
                return
            maps = {"/robots.txt": f"User-agent: *\nDisallow: /docs/tools\nSitemap: {base}/index.xml", "/index.xml": f"<sitemapindex><sitemap><loc>{base}/s.xml</loc></sitemap></sitemapindex>", "/s.xml": f"<urlset><url><loc>{base}/docs/only</loc></url></urlset>"}
            body = (SITE | maps | {"/docs/only": "<p>only in the map</p>"}).get(self.path)
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(((body or "") + ('<a href="/docs/away">x</a>' if self.path in SITE else "")).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        got = web.crawl(spark, web.from_web(concurrency=2), f"{base}/docs").collect()
        assert [r.url.removeprefix(base) for r in got] == ["/docs", "/docs/auth", "/docs/tools"]
        robots, urls = web.discover(f"{base}/docs")
        assert urls == [f"{base}/docs/only"] and not robots.allows("/docs/tools")
        got = web.crawl(spark, web.from_web(concurrency=2), f"{base}/docs", robots=robots, sitemap=urls).collect()
        assert [r.url.removeprefix(base) for r in got] == ["/docs", "/docs/auth", "/docs/only"]
        with pytest.raises(web.FetchError, match="redirect"):
            web.fetch(f"{base}/docs/away")
        with pytest.raises(web.FetchError, match="more than 5"):
            web.fetch(f"{base}/docs", most=5)
        with pytest.raises(web.FetchError, match="404"):
            web.fetch(f"{base}/none")
        spark.dataSource.register(web.WebPages)
        rows = spark.read.format("web_pages").option("urls", f"{base}/docs {base}/docs/auth {base}/none").load().collect()
        assert sorted(r.url.removeprefix(base) for r in rows) == ["/docs", "/docs/auth"]
        assert functools.reduce(lambda a, r: a and r.status == 200, rows, True)
    finally:
        server.shutdown()


def test_index_segments(spark, tmp_path):
    """A commit shuffles no lists; those of several libraries, batches and an unknown library are whole."""
    from spindrift.operators import retrieval

    docs = [(f"/local/{i % 3}" if i % 7 else None, f"c{i:04d}", "common " * (i % 4 + 1) + f"w{i % 50} {'' if i % 11 else 'rare'}") for i in range(5000)]
    lists = retrieval.segments(spark.createDataFrame(docs, "library_id string, chunk_id string, t string"), "t")
    plan = lists.sortWithinPartitions("library_id", "term")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "hashpartitioning" not in plan  # a small table is dealt out before the Python work
    got = {(r.library_id, r.term, c, tf, n) for r in lists.collect() for c, tf, n in zip(r.chunk_ids, r.tfs, r.lengths, strict=True)}
    assert got == {(lib, term, c, tf, retrieval.terms_of(t).total()) for lib, c, t in docs for term, tf in retrieval.terms_of(t).items()}
    assert lists.count() < 5000 < len(got)


def test_index_has_few_lists(spark, tmp_path):
    """A task makes one list of a term and a library from all its batches, and the commit adds up no lists."""
    from spindrift.operators import retrieval

    docs = [(f"/local/{i % 2}", f"c{i:05d}", "common " * (i % 3 + 1)) for i in range(30_000)]
    lists = retrieval.segments(spark.createDataFrame(docs, "library_id string, chunk_id string, t string"), "t")
    got = lists.collect()
    assert len(got) <= 2 * spark.sparkContext.defaultParallelism
    assert sum(len(r.chunk_ids) for r in got) == 30_000 and sum(r.total for r in got) == sum(i % 3 + 1 for i in range(30_000))
    store = ChunkStore(spark, str(tmp_path / "c"))
    row = lambda i, content: (i, "s", "/local/a", "", "d", "u", "", "", 0, content, "h", [1.0])
    store.commit(spark.createDataFrame([row("1", "alpha beta beta"), row("2", ""), row("3", "beta")], store.read().schema))
    assert store._state()["libraries"]["/local/a"]["total"] == 4 and store._state()["libraries"]["/local/a"]["n"] == 3


def test_index_of_many_files_is_not_dealt_out(spark, tmp_path, monkeypatch):
    """A commit deals texts over the cores where they lie in few files; of many it shuffles none, and its index is whole."""
    from pyspark.sql import functions as F

    from spindrift.operators import retrieval

    dealt, spread = [], retrieval.spread
    monkeypatch.setattr(retrieval, "spread", lambda df: dealt.append(1) or spread(df))
    row = lambda i, lib: (f"c{i:03d}", "s", lib, "", "d", "u", "", "", 0, f"alpha word{i} " + "beta " * (i % 3), "h", [1.0])
    for libraries, parts, times in ((1, 1, 1), (20, 8, 0)):
        store, before = ChunkStore(spark, str(tmp_path / f"c{libraries}")), len(dealt)
        store.commit(spark.createDataFrame([row(i, f"/local/{i % libraries}") for i in range(400)], store.read().schema).repartition(parts))
        assert len(dealt) - before == times
        got = {r.chunk_id for r in store.lexical("/local/0", "alpha", 1000).collect()}
        assert got == {f"c{i:03d}" for i in range(0, 400, libraries)}
        assert spark.read.parquet(str(tmp_path / f"c{libraries}/index/*/*")).agg(F.sum("total")).first()[0] == sum(2 + i % 3 for i in range(400))
