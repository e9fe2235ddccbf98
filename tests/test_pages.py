"""URLs, sitemaps, robots, HTML to Markdown, chunks."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import columns as C
from spindrift.functions import urls as U
from spindrift.operators import chunking
from spindrift.operators.html_markdown import extract_links, links_of, parse_pages, to_markdown
from spindrift.sources import web

BASE = "https://docs.acme.test/latest/guide"


@pytest.mark.parametrize(
    ("raw", "base", "want"),
    [
        ("HTTPS://Docs.Acme.TEST//a//b/", "", "https://docs.acme.test/a/b"),
        ("https://a.test/", "", "https://a.test"),
        ("https://a.test/x#frag", "", "https://a.test/x"),
        ("https://a.test/x?b=2&a=1&utm_source=z&GCLID=1", "", "https://a.test/x?a=1&b=2"),
        ("https://a.test/x?trkCampaign=1&utm_=2", "", "https://a.test/x?trkCampaign=1&utm_=2"),
        ("../api", BASE, "https://docs.acme.test/api"),
        ("api?q", BASE, "https://docs.acme.test/latest/api?q="),
        ("/x/./y/../z", BASE, "https://docs.acme.test/x/z"),
        ("#top", BASE, BASE),
        ("https://a.test/x/../y", "", "https://a.test/x/../y"),
    ],
)
def test_normalize(raw, base, want):
    assert U.normalize(raw, base) == want


@pytest.mark.parametrize(("raw", "base"), [("", ""), ("mailto:a@b.c", BASE), ("javascript:x()", BASE), ("/rel", ""), ("  ", BASE)])
def test_normalize_refuses(raw, base):
    with pytest.raises(U.UnsupportedUrl):
        U.normalize(raw, base)


def test_normalized_column_agrees(spark):
    urls = ["HTTPS://Docs.Acme.TEST//a//b/", "https://a.test/", "https://a.test/x?b=2&a=1&utm_source=z&GCLID=1#f", "http://a.test/p?z=1&z=0", "ftp://a.test/x", None, ""]
    urls += ["https://a.test/docs/é", "https://a.test/a b/c+d;e", "https://a.test/x?q=a%20b&p=c+d", "https://a.test/x?a=1;b=2&c=3", "https://a.test/100%25/%C3%A9", "https://a.test/x?k=%zz&é=ü*~", "https://a.test/x?b&a=&a=1=2", "https://a.test/~u/(x)!$&',:@*=", "https://a.test/x?utm%5Fsource=1&q=%26"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.normalized("u").alias("n")).collect()
    for r in rows:
        try:
            want = U.normalize(r.u or "")
        except U.UnsupportedUrl:
            want = None
        assert r.n == want


def test_scope(spark):
    urls = ["https://a.test/docs/latest", "https://a.test/docs/latest/x", "https://a.test/docs/latestness", "https://b.test/docs/latest/x", "https://a.test/docs/latest/old/y", "http://a.test/docs/latest/x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.s for r in df.select(U.in_scope("u", "https://a.test/docs/latest").alias("s")).collect()] == [True, True, False, False, True, False]
    assert [r.s for r in df.select(U.in_scope("u", "https://a.test/docs/latest", ["docs/latest/**"], ["/docs/latest/old/**"]).alias("s")).collect()] == [True, True, False, False, False, False]


@pytest.mark.parametrize(("glob", "yes", "no"), [("/a/**", ["/a", "/a/b/c"], ["/ab"]), ("/a/*", ["/a/b"], ["/a/b/c"]), ("/**/x", ["/x", "/a/b/x"], ["/ax"]), ("/[ab]/{c,d}?", ["/a/c1", "/b/d2"], ["/c/c1", "/a/c"])])
def test_glob(glob, yes, no):
    import re

    r = re.compile(U.glob_regex(glob))
    assert all(r.search(x) for x in yes)
    assert not any(r.search(x) for x in no)


def test_base_url():
    assert U.base_url("https://A.test/docs/?x=1#y") == "https://a.test/docs"
    for bad in ("https://a.test/", "ftp://a.test/x", "x"):
        with pytest.raises(U.UnsupportedUrl):
            U.base_url(bad)


def test_sitemaps(spark):
    good = '<?xml version="1.0"?><urlset xmlns="http://x.test/s"><url><loc>https://a.test/1</loc><lastmod>2024-01-02T03:04:05+00:00</lastmod></url><url><loc> </loc></url></urlset>'
    index = "<sitemapindex><sitemap><loc>https://a.test/s.xml</loc></sitemap></sitemapindex>"
    rows = [good, index, "<urlset></urlset>", "<urlset><url><loc>x</url></urlset>", "<html/>", None]
    got = [r.e for r in spark.createDataFrame([(x,) for x in rows], "b string").select(web.sitemap_entries("b").alias("e")).collect()]
    assert [[tuple(x) for x in e] if e is not None else None for e in got] == [[("https://a.test/1", "2024-01-02T03:04:05+00:00")], None, [], None, None, None]
    assert web.parse_sitemap(good) == [("https://a.test/1", "2024-01-02T03:04:05+00:00")]
    assert web.parse_sitemap(index, "sitemapindex") == [("https://a.test/s.xml", "")]
    for bad in (index, "<urlset><url>"):
        with pytest.raises(Exception):  # noqa: B017
            web.parse_sitemap(bad)
    assert web.sitemap_candidates("https://a.test/docs", "Sitemap: https://a.test/m.xml") == ["https://a.test/m.xml"]
    assert web.sitemap_candidates("https://a.test/docs") == ["https://a.test/sitemap.xml", "https://a.test/sitemap_index.xml"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /docs/secret/\nAllow: /docs/secret/open\nDisallow: /*.pdf$\nCrawl-delay: 2\n\nUser-agent: spindrift\nUser-agent: x\nDisallow: /private"
    general, own = web.parse_robots(text, "other"), web.parse_robots(text)
    cases = {"/docs/secret/a": False, "/docs/secret": True, "/docs/secret/open/b": True, "/x.pdf": False, "/x.pdf.html": True}
    assert {p: general.allows(p) for p in cases} == cases
    assert general.delay == 2
    assert not own.allows("/private/x") and own.allows("/docs/secret/a")
    assert web.parse_robots("").allows("/any") and web.parse_robots("<html>nothing").allows("/any")
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.a for r in df.select("p", web.robots_allowed(F.col("p"), general).alias("a")).collect()} == cases


PAGE = """<!doctype html><html><head><title>Tokens - Docs</title><link rel=canonical href=/first><link rel="canonical" href="https://d.test/guide/tokens"></head>
<body><nav><a href="/">Home</a></nav><main><article><h1>Tokens <a class=anchor href="#tokens">#</a></h1>
<details><summary>Menu</summary><nav>x</nav></details><details><summary>More</summary><p>Kept text.</p></details>
<p>Use <code>a_b</code> and <b>bold</b> with
 snake_case &lt;tag&gt;.</p><div hidden>gone</div><div aria-hidden="true">gone</div><span role=presentation>gone</span>
<pre><code class="language-bash">curl \\
  -d x

end
</code></pre><ul><li>One<li>Two <ul><li>Deep</ul></ul><ol start=3><li>Three</ol>
<table><tr><th>K<th>V<tr><td>a|b<td>&lt;c&gt;</table><p>See <a href="../api?x=1">the <i>API</i></a> and <a href="/guide/tokens#s">Copied</a>.
</article></main><footer>f</footer><script>s()</script></body></html>"""


def test_markdown():
    title, canonical, body = to_markdown(PAGE, "https://d.test/guide/tokens")
    assert canonical == "https://d.test/guide/tokens"
    assert title.startswith("Tokens")
    assert body == (
        "# Tokens\n\nMore\n\nKept text.\n\nUse `a_b` and **bold** with snake\\_case &lt;tag&gt;.\n\n```bash\ncurl \\\n  -d x\n\nend\n```\n\n"
        "- One\n- Two\n  - Deep\n\n3. Three\n\n| K | V |\n|---|---|\n| a\\|b | &lt;c&gt; |\n\nSee [the *API*](https://d.test/api?x=1) and .\n"
    )


GOLDEN = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Authentication — Acme Docs</title>
<link rel="canonical" href="https://docs.acme.test/latest/auth"></head><body><nav><a href="/latest/">Home</a></nav>
  <main>
    <article>
      <h1>Authentication</h1>

      <p>The Acme API uses OAuth 2.0 bearer tokens. Send the token in the
      <code>Authorization</code> header of every request.</p>

      <h2>Obtaining a token</h2>
      <pre><code class="language-bash">curl -X POST https://api.acme.test/oauth/token \\
  -d client_id="$ACME_CLIENT_ID"
</code></pre>
      <p>The response contains a <code>access_token</code> valid for one hour.</p>
      <ul>
        <li>Keys are scoped per environment.</li>
        <li>Revoking a key takes effect within 60 seconds.</li>
      </ul>
      <p>See the
      <a href="/latest/api">API reference</a> for header formats.</p>
      <table>
        <tr><th>Header</th><th>Value</th></tr>
        <tr><td>Authorization</td><td>Bearer &lt;token&gt;</td></tr>
      </table>
    </article>
  </main>
  <aside class="sidebar"><p>On this page</p></aside><footer><p>&copy; 2026</p></footer></body></html>"""


def test_markdown_byte_for_byte():
    title, canonical, body = to_markdown(GOLDEN, "https://docs.acme.test/latest/auth?utm_source=newsletter")
    assert (title, canonical) == ("Authentication", "https://docs.acme.test/latest/auth")
    assert body == (
        "# Authentication\n\nThe Acme API uses OAuth 2.0 bearer tokens. Send the token in the `Authorization` header of every request.\n\n## Obtaining a token\n\n"
        '```bash\ncurl -X POST https://api.acme.test/oauth/token \\\n  -d client_id="$ACME_CLIENT_ID"\n```\n\nThe response contains a `access_token` valid for one hour.\n\n'
        "- Keys are scoped per environment.\n- Revoking a key takes effect within 60 seconds.\n\nSee the [API reference](https://docs.acme.test/latest/api) for header formats.\n\n"
        "| Header | Value |\n|---|---|\n| Authorization | Bearer &lt;token&gt; |\n"
    )


@pytest.mark.parametrize("tag", ["div", "b", "ul><li", "blockquote", "a href=x", "section", "details", "p", "table><tr><td", "em"])
def test_markdown_of_deep_markup(tag):
    """Nesting of any depth neither fails nor takes long."""
    import time

    began = time.perf_counter()
    found = to_markdown("<main>" + f"<{tag}>" * 5000 + "deep text", "https://a.test/x")
    assert "deep text" in found[2] and time.perf_counter() - began < 10
    assert to_markdown("<main>" + "<b>" * 3000 + "x" + "</i>" * 20_000, "https://a.test/x")[2].count("x") == 1
    assert len(links_of("<div>" * 5000 + "<a href=y>", "https://a.test/x")) == 1


def test_markdown_empty_and_roots():
    assert to_markdown("", "https://a.test/x") is None
    assert to_markdown("<body><nav>only</nav></body>", "https://a.test/x") is None
    assert to_markdown("<body><div role=main>in</div><p>also</p></body>", "https://a.test/x")[2] == "in\n\nalso\n"
    assert to_markdown("<article>a</article><main>m</main>", "https://a.test/x")[2] == "m\n"
    assert links_of('<a href="x#f">1</a><a href="mailto:q@r.s">2</a><a href="x">3</a>', "https://a.test/d/i") == ["https://a.test/d/x", "https://a.test/d/x"]


def test_parse_pages(spark):
    rows = [("https://d.test/guide/tokens", PAGE), ("https://d.test/blank", "  "), ("https://d.test/null", None)]
    got = parse_pages(spark.createDataFrame(rows, "url string, html string")).collect()
    assert [r.url for r in got] == ["https://d.test/guide/tokens"]
    import hashlib

    assert got[0].document_id == hashlib.sha256(b"https://d.test/guide/tokens").hexdigest()[:16]
    with pytest.raises(Exception, match="no URL"):
        parse_pages(spark.createDataFrame([(None, PAGE)], "url string, html string")).collect()
    assert extract_links(spark.createDataFrame(rows, "url string, html string")).count() == 4


MARKDOWN = "Lead.\n\n# Top\n\nIntro.\n\n### Deep\n\nText.\n\n```bash\n# no heading\n```\n\nSetext\n------\n\nBody.\n\n## Only heading\n\n# Next\n\n> ## Quoted\n> words\n"


def test_sections():
    got = chunking.sections(MARKDOWN)
    assert [p for p, _ in got] == ["", "Top", "Top > Deep", "Top > Setext", "Next > Quoted"]
    assert got[2][1] == "### Deep\n\nText.\n\n```bash\n# no heading\n```"
    assert chunking.sections("plain") == [("", "plain")]
    assert chunking.split("  \n") == []


def test_pieces():
    long = "\n\n".join(["word " * 200] * 4)
    assert [chunking.estimated_tokens(p) for p in chunking.pieces(long)] == [260, 260, 260, 260]
    assert chunking.pieces("word " * 385) == ["word " * 385]
    fence = "```\n" + "x \n\n" * 600 + "```"
    assert chunking.pieces(fence) == [fence]
    # A labelled fence is ended by a line like its opening one, not by a bare one.
    assert chunking.blocks("```bash\na\n```\n\nb") == ["```bash\na\n```\n\nb"]
    assert chunking.blocks("```\na\n\nb\n```\n\nc") == ["```\na\n\nb\n```", "c"]


def test_hashes():
    h = chunking.content_hash
    assert h("a  \nb\n\n\n\nc") == h("a\nb\n\nc\n")
    assert h("a b") != h("a\nb")
    assert h("```\na  \n```") != h("```\na\n```")


def test_chunks(spark):
    docs = parse_pages(spark.createDataFrame([("https://d.test/guide/tokens", PAGE)], "url string, html string"))
    rows = chunking.chunk(docs, "src", "/local/d", "1.0").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    import hashlib

    r = rows[0]
    assert r.chunk_id == hashlib.sha256(f"src{r.url}{r.heading_path}0".encode()).hexdigest()
    with pytest.raises(ValueError, match="source id"):
        chunking.chunk(docs, " ", "/local/d")


def test_crawl(spark):
    site = {
        "/docs/start": '<a href="a">a</a><a href="/docs/x/b">b</a><a href="https://other.test/docs/y">y</a><a href="/blog/z">z</a>',
        "/docs/a": '<a href="c">c</a><a href="start">s</a>',
        "/docs/x/b": "<p>b</p>",
        "/docs/c": '<a href="d">d</a>',
        "/docs/d": "<p>d</p>",
        "/blog/z": "<p>z</p>",
    }
    pages = spark.createDataFrame([(f"https://s.test{p}", h) for p, h in site.items()], "url string, html string")
    got = web.crawl(spark, pages, "https://s.test/docs/start", max_depth=2).collect()
    # The base of this crawl is the start page's own path, so nothing beside it is in scope.
    assert [r.url for r in got] == ["https://s.test/docs/start"]
    more = {"/docs": site["/docs/start"].replace('"a"', '"/docs/a"'), **site}
    pages = spark.createDataFrame([(f"https://s.test{p}", h) for p, h in more.items()], "url string, html string")
    got = web.crawl(spark, pages, "https://s.test/docs", excludes=["/docs/x/**"], robots=web.parse_robots("User-agent: *\nDisallow: /docs/d"))
    assert [(r.url.removeprefix("https://s.test"), r.depth) for r in got.collect()] == [("/docs", 0), ("/docs/a", 1), ("/docs/c", 2), ("/docs/start", 2)]
    assert web.crawl(spark, pages, "https://s.test/docs", max_pages=2).count() == 2


def test_crawl_max_pages(spark):
    """The first by depth and URL stay; without a limit all do."""
    site = {"/d": '<a href="/d/z">z</a><a href="/d/b">b</a>', "/d/z": '<a href="/d/a">a</a>', "/d/b": "", "/d/a": ""}
    pages = spark.createDataFrame([(f"https://s.test{p}", h) for p, h in site.items()], "url string, html string")
    got = lambda n: [(r.url.removeprefix("https://s.test"), r.depth) for r in web.crawl(spark, pages, "https://s.test/d", max_pages=n).collect()]
    assert got(2) == [("/d", 0), ("/d/b", 1)] and got(3) == [("/d", 0), ("/d/b", 1), ("/d/z", 1)]
    assert got(None) == got(1000) == [("/d", 0), ("/d/a", 2), ("/d/b", 1), ("/d/z", 1)]


def test_crawl_levels_keeps_every_page(spark, tmp_path):
    from spindrift.plans import catalogue

    n = web.MAX_PAGES + 100
    spark.range(n).select(F.col("id").alias("page_id"), F.format_string("https://h.test/p%06d", "id").alias("url"), F.lit("<p>x</p>").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    got = catalogue.queries()["crawl_levels"](spark, str(tmp_path))
    assert got.count() == n and got.select("url").distinct().count() == n


def test_content_type(spark):
    df = spark.createDataFrame([("text/html; charset=x",), ("",), (None,), ("application/pdf",), ("Application/XHTML+xml",)], "t string")
    assert [r.k for r in df.select(U.is_document_type("t").alias("k")).collect()] == [True, True, True, False, True]


def test_identities(spark):
    ids = ["/local/a", "/local/a/1.2", "/org/a/2", "/org/a", "local/a", "/local//x", "/local/a/b/c", None]
    got = [r.p for r in spark.createDataFrame([(i,) for i in ids], "i string").select(C.library_id_parts("i").alias("p")).collect()]
    assert [tuple(p) if p else None for p in got] == [("local", "a", ""), ("local", "a", "1.2"), ("org", "a", "2"), None, None, None, None, None]
