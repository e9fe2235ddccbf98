"""Every query of the catalogue against its SQL, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from spindrift.plans import catalogue

FOLDER = Path("/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    with duckdb.connect() as c:
        for f in FOLDER.glob("*.parquet"):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        yield c


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, tables, name):
    got = catalogue.queries()[name](spark, str(FOLDER))
    want = tables.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(names, want.fetchall()) == rows(got.columns, map(tuple, got.collect()))


def test_queries_without_sql_give_rows(spark):
    without = {name: f for name, f in catalogue.queries().items() if name not in SQL}
    assert set(without) == {"html_to_markdown", "section_chunks"}
    assert all(not f(spark, str(FOLDER)).isEmpty() for f in without.values())


def same_as_sql(spark, folder, name, **made):
    """Whether a query over made tables gives its SQL's rows."""
    with duckdb.connect() as c:
        for table, frame in made.items():
            frame.write.parquet(f"{folder}/{table}.parquet")
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        got, want = catalogue.queries()[name](spark, str(folder)), c.execute(SQL[name])
        names = [d[0] for d in want.description]
        return rows(names, want.fetchall()) == rows(got.columns, map(tuple, got.collect()))


def test_links_of_pages_with_one_url(spark, tmp_path):
    pages = [(1, "https://a.test/x", '<a href="/b">b</a>'), (2, "https://a.test/x", '<a href="/b">b</a><a href="/c">c</a>'), (3, "https://a.test/y", "<p>none</p>"), (4, "https://a.test/x", ""), (5, "https://a.test/x", None)]
    assert same_as_sql(spark, tmp_path, "page_links", pages=spark.createDataFrame(pages, "page_id long, url string, html string"))


def test_sections_of_texts_with_marks(spark, tmp_path):
    """Texts of documents are no Markdown: lines like headings, fences and blank lines in them are text."""
    long = "word " * 400
    texts = ["### one\ntwo", "a\n=\nb", "a\n---\nb", "#", "# only", "```\na  \nb", f"a\n\n{long}\n\nb", f"```x\n{long}", f"{long}\n# end", "a \t\n\n\n\nb \n", " ", "", None, "\u00a0", "a\u00a0b\x85c " * 200, "x\u2028# y", "1. # z", "w " * 383, "w " * 384, "a \r\nb\x0b"]
    docs = spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert same_as_sql(spark, tmp_path, "document_sections", documents=docs)


def test_hybrid_search_embeds_once(spark):
    """What is searched is a stored table: no part of the search embeds or tokenises the texts again."""
    plan = catalogue.queries()["hybrid_search"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "settled-" in plan
