"""The catalogue: one query for each operator, over whole tables, and SQL with the same rows.

Floats are rounded and every ranking ends on a unique key, so results are the same everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import urls as U
from ..operators import chunking, diff, embed, resolve, retrieval
from ..operators.html_markdown import extract_links, link_lists, parse_pages
from ..session import settle, shared_folder, table
from ..sources import web
from ..sources.store import ChunkStore, Registry, Source
from .library import Library

QUERY = "the tionlyble heati of Thntblere reing"
HOST, SCOPE = "thththth.example.org", "/en"
NAME, ASKED = "Brand#1", "brand steel 1.2 economy"



def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query's own store, gone when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def _chunks_of(docs: DataFrame) -> DataFrame:
    """Documents as chunks: the source is the library, the text the content."""
    blank, key = F.lit(""), F.format_string("%012d", "doc_id")
    return docs.select(
        key.alias("chunk_id"), F.col("source").alias("source_id"), F.col("source").alias("library_id"), blank.alias("version"), key.alias("document_id"), key.alias("url"), blank.alias("title"), F.col("lang").alias("heading_path"),
        F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.array(F.lit(1.0).cast("float")).alias("embedding"),
    )


def _store(spark: SparkSession, d: str) -> ChunkStore:
    store = ChunkStore(spark, _folder(spark, "chunks"))
    store.commit(_chunks_of(table(spark, d, "documents")), "made/of/1/documents")
    return store


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- dense search


def _vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


_DISTANCE = "round(1 - list_cosine_similarity(e.embedding::double[], q.v), 6)"
_Q = "q AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0)"


@query(f"WITH {_Q} SELECT vec_id, round(1 - list_cosine_similarity(e.embedding::double[], q.v), 6) AS score FROM embeddings e, q ORDER BY 1 - list_cosine_similarity(e.embedding::double[], q.v), vec_id LIMIT 20")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.dense_topk(table(spark, d, "embeddings"), _vector(spark, d), 20, "vec_id")
    return hits.select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_Q} SELECT vec_id, {_DISTANCE} AS score FROM embeddings e, q WHERE label = 3 ORDER BY 1 - list_cosine_similarity(e.embedding::double[], q.v), vec_id LIMIT 20")
def dense_topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "embeddings").withColumn("library_id", F.col("label").cast("string"))
    hits = retrieval.dense_topk(retrieval.scoped(chunks, library_id="3"), _vector(spark, d), 20, "vec_id")
    return hits.select("vec_id", F.round("score", 6).alias("score"))


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding::double[] AS v FROM embeddings WHERE vec_id % 100 = 0), "
    "s AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(e.embedding::double[], q.v) AS d FROM embeddings e, q) "
    "SELECT query_id, vec_id, round(d, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s) WHERE rank <= 10"
)
def dense_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = retrieval.dense_topk_batch(rows, asked, 10, "vec_id")
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS valid, "
    "round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 6) AS mean_norm FROM embeddings GROUP BY label"
)
def vector_validate(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    rows = table(spark, d, "embeddings").groupBy("label")
    return rows.agg(F.count("*").alias("n"), F.count_if(C.is_valid_vector("embedding", 64)).alias("valid"), F.round(F.avg(F.sqrt(C.dot(v, v))), 6).alias("mean_norm"))


# ---------------------------------------------------------------- lexical search

_TERMS = r"""
ids AS (SELECT doc_id, trim(x, '._-') AS whole FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{Nd}._/-]+')) AS x FROM documents)),
cut AS (SELECT doc_id, whole, list_filter(string_split_regex(whole, '[._/-]+'), lambda p: p <> '') AS parts FROM ids WHERE whole <> ''),
pieces AS (SELECT doc_id, list_concat([whole], parts, list_filter(string_split(regexp_replace(regexp_replace(array_to_string(parts, ' '), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), ' '), lambda p: p <> '')) AS terms FROM cut),
posted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_distinct(list_transform(terms, lambda t: lower(t)))) AS term FROM pieces) GROUP BY doc_id, term)
"""


@query(f"WITH {_TERMS} SELECT doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS length, max(tf) AS most FROM posted GROUP BY doc_id")
def technical_tokens(spark: SparkSession, d: str) -> DataFrame:
    posted = retrieval.postings(table(spark, d, "documents"), "doc_id", "text")
    return posted.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("length"), F.max("tf").alias("most"))


_WORDS = ", ".join(f"'{w}'" for w in sorted(retrieval.terms_of(QUERY)))
_BM25 = f"""
{_TERMS.strip()},
lens AS (SELECT doc_id, sum(tf) AS len FROM posted GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, sum(len) AS total FROM lens),
dfs AS (SELECT term, count(*) AS df FROM posted WHERE term IN ({_WORDS}) GROUP BY term),
bm25 AS (SELECT p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (total / n)))), 12) AS score
  FROM posted p JOIN dfs USING (term) JOIN lens USING (doc_id), stats GROUP BY p.doc_id)
"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 9) AS score FROM bm25 ORDER BY bm25.score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.bm25_topk(table(spark, d, "documents"), QUERY, "doc_id", "text")
    return hits.select("doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 9) AS score FROM bm25 ORDER BY bm25.score DESC, doc_id LIMIT 20")
def bm25_postings_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    posted = settle(retrieval.postings(docs, "doc_id", "text"))
    hits = retrieval.bm25_from_postings(posted, docs.count(), QUERY, "doc_id")
    return hits.select("doc_id", F.round("score", 9).alias("score"))


@query(
    f"WITH {_BM25}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 20), "
    "b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20) "
    "SELECT doc_id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score FROM a FULL OUTER JOIN b USING (doc_id)"
)
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lexical = retrieval.ranked(retrieval.bm25_topk(docs, QUERY, "doc_id", "text"), F.desc("score"), "doc_id")
    longest = retrieval.ranked(docs.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20), F.desc("n_chars"), "doc_id")
    fused = retrieval.rrf([lexical.select("doc_id", "rank"), longest.select("doc_id", "rank")], "doc_id")
    return fused.select("doc_id", F.round("score", 9).alias("score"))


@query(
    r"WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM documents) "
    "SELECT doc_id, copies FROM (SELECT doc_id, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY norm) AS copies FROM n WHERE norm <> '') WHERE r = 1"
)
def dedup_content(spark: SparkSession, d: str) -> DataFrame:
    # First of each content as an aggregate: a content with many copies is combined before the shuffle.
    rows = table(spark, d, "documents").select("doc_id", F.sha2(C.normal_content("text"), 256).alias("norm"), (C.normal_content("text") == "").alias("blank"))
    return rows.where("not blank").groupBy("norm").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


_TRIM = r"""
WITH h AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, role) AS rank FROM conversations),
m AS (SELECT *, (role <> '' AND turn >= 0) AS named FROM h),
i AS (SELECT *, count(*) OVER (PARTITION BY conv_id, role, named, turn) AS n, turn - row_number() OVER (PARTITION BY conv_id, role, named ORDER BY turn, rank) AS island FROM m),
r AS (SELECT *, named AND max(n) OVER (PARTITION BY conv_id, role, named) = 1 AS run, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM i),
s AS (SELECT * FROM r WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, norm ORDER BY rank) = 1),
x AS (SELECT *, run AND row_number() OVER (PARTITION BY conv_id, role, run, island ORDER BY rank) > 2 AS deferred FROM s)
SELECT conv_id, turn, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY deferred, rank) AS position FROM x) WHERE position <= 6
"""


@query(_TRIM)
def adjacent_trim(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn", "role")
    hits = table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("turn").alias("chunk_index"), F.lit("s").alias("source_id"), F.col("conv_id").cast("string").alias("document_id"), F.col("role").alias("heading_path"),
        F.col("text").alias("content"), F.row_number().over(order).alias("rank"),
    )
    return retrieval.trimmed(hits, 6, ("conv_id",)).select("conv_id", "turn", "position")


@query(
    r"SELECT doc_id, (regexp_matches(t, '/[\p{L}\p{Nd}]|[\p{L}\p{Nd}][.-][\p{L}\p{Nd}]|\p{Ll}\p{Lu}') OR (regexp_matches(t, '\p{Ll}') AND len(list_filter(regexp_extract_all(t, '[\p{L}\p{Nd}._/-]+'), "
    r"lambda x: regexp_matches(x, '\p{Lu}[^\p{L}]*\p{Lu}') AND NOT regexp_matches(x, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]'))) > 0)) AS technical FROM (SELECT doc_id, text AS t FROM documents)"
)
def technical_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.has_technical_identifier("text").alias("technical"))


# ---------------------------------------------------------------- incremental state

_DIFF = r"""
WITH old AS (SELECT doc_id, sha256(text) AS h, source AS title FROM documents WHERE doc_id % 11 <> 0),
new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS h, CASE WHEN doc_id % 13 = 0 THEN 'renamed' ELSE source END AS title FROM documents WHERE doc_id % 10 <> 0),
s AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN n.h = o.h AND n.title = o.title THEN 'unchanged' ELSE 'updated' END AS status
  FROM new n FULL OUTER JOIN old o ON n.doc_id = o.doc_id)
"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    # Two states of one table: what the rows left out of each make are the added and removed ones.
    docs = table(spark, d, "documents").withColumn("heading_path", F.lit(""))
    hashed = lambda t: F.sha2(t, 256).alias("content_hash")
    old = docs.where("doc_id % 11 <> 0").select("doc_id", hashed(F.col("text")), F.col("source").alias("title"), "heading_path")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    title = F.when(F.col("doc_id") % 13 == 0, F.lit("renamed")).otherwise(F.col("source"))
    new = docs.where("doc_id % 10 <> 0").select("doc_id", hashed(edited), title.alias("title"), "heading_path")
    return diff.diff(new, old, "doc_id")


@query(f"{_DIFF} SELECT doc_id, status FROM s")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d)


@query(
    f"{_DIFF} SELECT (SELECT count(*) FROM documents) AS discovered, (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0) AS fetched, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS skipped, count(*) FILTER (status IN ('added', 'updated')) AS indexed, count(*) FILTER (status = 'added') AS added, "
    "count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed FROM s"
)
def sync_report(spark: SparkSession, d: str) -> DataFrame:
    """Every document is a page that was found; the tenth ones were skipped."""
    skipped, n = table(spark, d, "documents").agg(F.count_if(F.col("doc_id") % 10 == 0), F.count("*")).first()
    return diff.report(_states(spark, d), n - skipped, skipped)


@query("SELECT source AS library_id, count(*) AS chunks, count(DISTINCT nullif(lang, '')) AS pages FROM documents GROUP BY source")
def library_counts(spark: SparkSession, d: str) -> DataFrame:
    return diff.library_counts(table(spark, d, "documents").select(F.col("source").alias("library_id"), F.col("lang").alias("url")))


# ---------------------------------------------------------------- URLs and identities

_TRACK = ", ".join(f"'{x}'" for x in U.TRACKING if x == x.lower())
_URL = rf"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1)) AS scheme, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2)) AS host,
  regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) AS path, regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace('/' || path, '/+', '/', 'g'), '/$', '') AS clean, list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT (lower(split_part(x, '=', 1)) IN ({_TRACK}) OR regexp_matches(lower(split_part(x, '=', 1)), '^utm_.'))),
  lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS kept FROM p)
"""


@query(f"{_URL} SELECT page_id, CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || host || clean || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url FROM c")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.normalized("url").alias("url"))


@query(
    rf"""{_URL} SELECT page_id, (scheme = 'https' AND host = '{HOST}' AND (path = '{SCOPE}' OR starts_with(path, '{SCOPE}/')) AND regexp_matches(path, '^/en/[0-9][^/]*/?$')
  AND NOT regexp_matches(path, '^/en/1(?:/.*)?$|^/en/[^/]*7[^/]*$')) AS in_scope FROM c"""
)
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    rule = U.in_scope("url", f"https://{HOST}{SCOPE}", ["/en/[0-9]*", "/en/[0-9]*/"], ["en/1/**", "/en/*7*"])
    return table(spark, d, "pages").select("page_id", rule.alias("in_scope"))


@query("SELECT page_id, substring(sha256(url), 1, 16) AS document_id, sha256(concat('0123456789abcdef', url, 'Guide > Start', CAST(page_id % 5 AS VARCHAR))) AS chunk_id FROM pages")
def document_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", C.short_sha("url").alias("document_id"), C.chunk_id(F.lit("0123456789abcdef"), "url", F.lit("Guide > Start"), F.col("page_id") % 5).alias("chunk_id"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '^\s+', ''), '\s+$', '')) AS content_hash FROM documents")
def document_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.document_hash("text").alias("content_hash"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, '/local/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS library_id FROM part")
def library_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.slug("p_name").alias("slug"), F.concat(F.lit("/local/"), C.slug("p_name")).alias("library_id"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'local' WHEN c_custkey % 4 = 1 THEN 'docs' END AS namespace, CASE WHEN c_custkey % 4 < 2 THEN c_name END AS name, "
    "CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '1.2' END AS version FROM customer"
)
def library_id_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    made = F.when(k == 0, F.concat(F.lit("/local/"), "c_name")).when(k == 1, F.concat(F.lit("/docs/"), "c_name", F.lit("/1.2"))).when(k == 2, F.concat(F.lit("/docs/"), "c_name")).otherwise(F.concat(F.lit("local//"), "c_name"))
    return table(spark, d, "customer").select("c_custkey", C.library_id_parts(made).alias("p")).select("c_custkey", "p.*")


@query("SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(source, ''), CASE WHEN lower(lang) <> lower(source) THEN lang END, nullif(trim(text), '')) AS embedding_text FROM documents")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.embedding_text("source", "lang", "text").alias("embedding_text"))


@query(r"SELECT doc_id, CAST(floor(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 1.3) AS INT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.estimated_tokens("text").alias("tokens"))


# ---------------------------------------------------------------- resolution

_NORM = r"trim(regexp_replace(lower(regexp_replace(trim({x}), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_RESOLVE = rf"""
WITH l AS (SELECT p_partkey, p_brand AS name, p_type AS description, CASE WHEN p_size % 3 = 0 THEN '' ELSE '1.' || CAST(p_size % 4 AS VARCHAR) END AS version FROM part),
w AS (SELECT *, {_NORM.format(x="name")} AS own, list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS nw, list_filter(string_split_regex(lower(description), '[^a-z0-9]+'), lambda x: x <> '') AS dw,
  {_NORM.format(x=f"'{NAME}'")} AS want, list_filter(string_split_regex(lower('{ASKED}'), '[^a-z0-9]+'), lambda x: x <> '') AS asked FROM l),
o AS (SELECT *, list_sum(list_transform(asked, lambda x: CASE WHEN list_contains(nw, x) THEN 10 WHEN list_contains(dw, x) THEN 3 ELSE 0 END)) AS points, len(list_filter(asked, lambda x: list_contains(dw, x))) AS described FROM w)
SELECT p_partkey, CAST(score AS INT) AS score FROM (SELECT p_partkey, CASE WHEN own = want THEN 1000 + CASE WHEN version = '' THEN 20 ELSE 0 END + CASE WHEN version = '1.2' THEN 200 ELSE 0 END + points
  WHEN starts_with(own, want) OR starts_with(want, own) THEN 600 + points WHEN contains(own, want) OR contains(want, own) THEN 400 + points WHEN described > 0 THEN 100 + described END AS score FROM o) WHERE score IS NOT NULL
"""


@query(_RESOLVE)
def resolve_score(spark: SparkSession, d: str) -> DataFrame:
    version = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("1."), (F.col("p_size") % 4).cast("string")))
    score = resolve.library_score(F.col("p_brand"), F.col("p_type"), version, F.lit(NAME), F.lit(ASKED))
    return table(spark, d, "part").select("p_partkey", score.alias("score")).where("score is not null")


@query(
    "SELECT n_nationkey AS library_id, array_to_string(list_sort(list(o ORDER BY o), 'DESC'), ',') AS others FROM (SELECT a.n_nationkey, b.n_nationkey AS o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey) GROUP BY n_nationkey"
)
def version_siblings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("library_id"), F.col("n_regionkey").alias("name"))
    return resolve.siblings(rows).select("library_id", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@query(
    f"WITH {_Q}, r AS (SELECT vec_id, label, row_number() OVER (ORDER BY 1 - list_cosine_similarity(e.embedding::double[], q.v), vec_id) AS rank FROM embeddings e, q), f AS (SELECT label, min(rank) AS rank FROM r GROUP BY label) "
    "SELECT count(*) AS queries, round(avg((rank <= 1)::int), 9) AS top1, round(avg((rank <= 3)::int), 9) AS top3, round(avg((rank <= 5)::int), 9) AS top5, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr, round(avg((rank <= 5)::int), 9) AS recall5 FROM f"
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    # How high each label's best vector stands for one query: ranks by counting what is nearer.
    rows = table(spark, d, "embeddings")
    scored = rows.select("vec_id", "label", C.cosine_distance_to("embedding", _vector(spark, d)).alias("score"))
    best = scored.groupBy("label").agg(F.min(F.struct("score", "vec_id")).alias("b"))
    # One row a label: a bounded broadcast.
    nearer = scored.drop("label").join(F.broadcast(best), F.struct("score", "vec_id") <= F.col("b")).groupBy("label").agg(F.count("*").alias("rank"))
    metrics = diff.retrieval_metrics(nearer)
    return metrics.select("queries", *[F.round(c, 9).alias(c) for c in ("top1", "top3", "top5", "mrr", "recall5")])


# ---------------------------------------------------------------- pages


@query(r"SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    # By page: two pages may have one URL.
    return link_lists(table(spark, d, "pages"), kept=("page_id",)).select("page_id", F.array_size("links").cast("long").alias("links"))


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return parse_pages(table(spark, d, "pages"))


@query()
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(parse_pages(table(spark, d, "pages")), "0123456789abcdef", "/local/pages")


_FNV = r"""
words AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id, w),
bytes AS (SELECT w, list_transform(range(1, length(x) + 1, 2), lambda i: CAST('0x' || substring(x, i, 2) AS BIGINT)) AS b FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words))),
hashed AS (SELECT w, list_reduce(list_prepend(2166136261, b), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 256 AS position FROM bytes),
cells AS (SELECT doc_id, position, sum(n) AS n FROM words JOIN hashed USING (w) GROUP BY doc_id, position),
norms AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM cells GROUP BY doc_id)
"""


@query(f"WITH {_FNV} SELECT doc_id, CAST(position AS INT) AS position, round(CAST(CAST(n / norm AS FLOAT) AS DOUBLE), 6) AS value FROM cells JOIN norms USING (doc_id)")
def fake_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Every component over 0 of every document's vector."""
    rows = embed.embed(table(spark, d, "documents").select("doc_id", "text"), "text", embed.Fake())
    return rows.select("doc_id", F.posexplode("embedding").alias("position", "v")).where("v > 0").select("doc_id", "position", F.round(F.col("v").cast("double"), 6).alias("value"))


ASKED_TECHNICALLY = "theHeati query-docs " + QUERY
_ASKED_VECTOR = ", ".join(f"({i}, {v!r}::double)" for i, v in enumerate(embed.fake_vector(QUERY)) if v)
_HYBRID = rf"""
WITH lexical AS (SELECT doc_id, chr(10) || lang || chr(10) || text AS text FROM documents),
{_BM25.replace("FROM documents)),", "FROM lexical)),", 1).replace(_WORDS, ", ".join(f"'{w}'" for w in sorted(retrieval.terms_of(ASKED_TECHNICALLY)))).strip()},
{_FNV.strip()},
asked(position, v) AS (VALUES {_ASKED_VECTOR}),
unit AS (SELECT doc_id, position, CAST(CAST(n / norm AS FLOAT) AS DOUBLE) AS v FROM cells JOIN norms USING (doc_id)),
lengths AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM unit GROUP BY doc_id),
dots AS (SELECT doc_id, sum(u.v * a.v) AS dot FROM unit u JOIN asked a USING (position) GROUP BY doc_id),
near AS (SELECT doc_id, round(1 - coalesce(dot / len, 0) / (SELECT sqrt(sum(v * v)) FROM asked), 12) AS distance FROM documents LEFT JOIN dots USING (doc_id) LEFT JOIN lengths USING (doc_id)),
lists AS (
  SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS place FROM near QUALIFY place <= 20
  UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM bm25 QUALIFY place <= 20),
fused AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, sum(1.0 / (60 + place)) AS score FROM lists GROUP BY doc_id)),
i AS (SELECT *, doc_id - row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS island, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM fused JOIN documents USING (doc_id)),
s AS (SELECT * FROM i WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY norm ORDER BY rank) = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY source, lang, island ORDER BY rank) > 2 AS deferred FROM s)
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS chunk_id, 's' AS source_id, '/local/docs' AS library_id, '' AS version, source AS document_id, source AS url, '' AS title, lang AS heading_path,
  CAST(doc_id AS INT) AS chunk_index, text AS content, round(score, 9) AS score, CAST(rank AS INT) AS rank, CAST(position AS INT) AS position
FROM (SELECT *, row_number() OVER (ORDER BY deferred, rank) AS position FROM x) WHERE position <= 6
"""


@query(_HYBRID)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"), F.lit("s").alias("source_id"), F.lit("/local/docs").alias("library_id"), F.lit("").alias("version"), F.col("source").alias("document_id"),
        F.col("source").alias("url"), F.lit("").alias("title"), F.col("lang").alias("heading_path"), F.col("doc_id").cast("int").alias("chunk_index"), F.col("text").alias("content"),
    )
    provider = embed.Fake()
    # Stored, as a chunk table is: the search reads it three times, and nothing is embedded twice.
    chunks = settle(embed.embed(docs, "content", provider))
    hits = retrieval.search(chunks, ASKED_TECHNICALLY, provider.embed([QUERY])[0], "/local/docs")
    return hits.withColumn("score", F.round("score", 9))


@query(f"{_URL} SELECT DISTINCT 'https://site.test/all' || clean || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url, 0 AS depth FROM c WHERE scheme IN ('http', 'https') AND NOT regexp_matches('/all' || clean, '[.]html$')")
def crawl_levels(spark: SparkSession, d: str) -> DataFrame:
    """The pages table as a web of its own, without a limit: every page is a seed, links lead on from there."""
    pages = table(spark, d, "pages")
    own = pages.select("html", F.regexp_replace(U.normalized("url"), "^https?://[^/]+", "https://site.test/all").alias("url"))
    return web.crawl(spark, own, "https://site.test/all", robots=web.parse_robots(_ROBOTS), sitemap=own.select("url"), max_pages=None).select("url", "depth")


@query(
    "SELECT 'https://tree.test/docs' AS url, 0 AS depth UNION ALL SELECT 'https://tree.test/docs/' || r_regionkey, 1 FROM region UNION ALL SELECT 'https://tree.test/docs/' || n_regionkey || '/' || n_nationkey, 2 FROM nation WHERE n_nationkey % 7 <> 3 "
    "UNION ALL SELECT 'https://tree.test/docs/' || n_regionkey || '/' || n_nationkey || '/' || s_suppkey, 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 7 <> 3 AND s_suppkey NOT IN (3, 10, 17, 24)"
)
def crawl_tree(spark: SparkSession, d: str) -> DataFrame:
    """A site of regions, nations and suppliers: links are followed level by level, past cycles and what robots close."""
    nations, regions, suppliers = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    base = F.lit("https://tree.test/docs")
    at = lambda *parts: F.concat_ws("/", base, *[F.col(p).cast("string") for p in parts])
    back = '<a href="/docs">top</a><a href="https://other.test/docs/x">away</a><a href="/blog">out</a>'
    edges = (
        regions.select(base.alias("url"), at("r_regionkey").alias("to"))
        .unionByName(nations.select(at("n_regionkey").alias("url"), at("n_regionkey", "n_nationkey").alias("to")))
        .unionByName(suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(at("n_regionkey", "n_nationkey").alias("url"), at("n_regionkey", "n_nationkey", "s_suppkey").alias("to")))
    )
    links = edges.groupBy("url").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<a href="'), "to", F.lit('">x</a>')))), "").alias("links"))
    every = edges.select(F.col("to").alias("url")).union(spark.range(1).select(base)).join(links, "url", "left").select("url", F.concat(F.coalesce("links", F.lit("")), F.lit(back)).alias("html"))
    closed = "".join(f"Disallow: /docs/*/{i}$\nDisallow: /docs/*/{i}/\n" for i in range(3, 25, 7))
    return web.crawl(spark, every, "https://tree.test/docs", robots=web.parse_robots(f"User-agent: *\n{closed}"), max_pages=None).select("url", "depth")


_LINK = r"unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))"


@query(f"WITH l AS (SELECT DISTINCT {_LINK} AS path FROM pages) SELECT path FROM l WHERE path NOT IN (SELECT '/' || r_name FROM region UNION SELECT '/The' UNION SELECT '/and')")
def unseen_links(spark: SparkSession, d: str) -> DataFrame:
    links = extract_links(table(spark, d, "pages")).select(U.path_of("link").alias("path"))
    # Escapes are undone to show the path as the page writes it.
    links = links.select(F.url_decode(F.regexp_replace("path", r"\+", "%2B")).alias("path")).distinct()
    seen = table(spark, d, "region").select(F.concat(F.lit("/"), "r_name").alias("path")).union(spark.createDataFrame([("/The",), ("/and",)], "path string")).dropDuplicates(["path"])
    return links.join(seen, "path", "left_anti")


@query(
    "SELECT page_id, (CASE WHEN page_id % 4 = 0 THEN 'text/html; charset=utf-8' WHEN page_id % 4 = 1 THEN '' WHEN page_id % 4 = 2 THEN 'Application/XHTML+xml' ELSE 'application/pdf' END) AS content_type, page_id % 4 <> 3 AS document, "
    "(page_id % 3 <> 0 AND page_id % 5 <> 0) AS same_site FROM pages"
)
def page_predicates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    kind = F.when(k == 0, "text/html; charset=utf-8").when(k == 1, "").when(k == 2, "Application/XHTML+xml").otherwise("application/pdf")
    moved = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^(https?)://", "$1://www.")).when(F.col("page_id") % 5 == 0, F.concat(F.lit("x"), "url")).otherwise(F.upper(F.regexp_extract("url", "^(https?://[^/]*)", 1)))
    rows = table(spark, d, "pages").select("page_id", "url", kind.alias("content_type"), moved.alias("final"))
    return rows.select("page_id", "content_type", U.is_document_type("content_type").alias("document"), U.same_site("url", "final").alias("same_site"))


@query("SELECT page_id, (page_id % 2 = 0 AND page_id % 3 <> 0) AS not_modified FROM pages")
def conditional_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Pages asked for again by what is known of them, over an opener in the place of the network."""
    known = table(spark, d, "pages").select("page_id", F.format_string("https://h.test/p/%d", "page_id").alias("url"), F.when(F.col("page_id") % 2 == 0, F.when(F.col("page_id") % 3 == 0, "old").otherwise("now")).alias("etag"), F.lit("").alias("last_modified"))
    got = web.refetch(known, opener=_answer).select("url", "not_modified")
    return known.join(got, "url").select("page_id", "not_modified")


def _answer(request, timeout: float):
    """A server whose pages all have the tag "now"."""
    import io
    import urllib.error
    from email.message import Message

    if request.get_header("If-none-match") == "now":
        raise urllib.error.HTTPError(request.full_url, 304, "not modified", Message(), None)
    answer = io.BytesIO(b"<p>page</p>")
    answer.headers, answer.status, answer.geturl = {"Content-Type": "text/html", "ETag": "now"}, 200, lambda: request.full_url
    return answer


@query(
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://c.test/' || page_id END AS citation, CASE WHEN page_id % 3 = 0 THEN 'Guide > ' || page_id WHEN page_id % 3 = 1 THEN 'Title' ELSE url END AS label FROM pages"
)
def citations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    canonical = F.when(i % 2 == 0, F.when(i % 4 == 0, F.lit(" "))).otherwise(F.concat(F.lit("https://c.test/"), i.cast("string")))
    heading, title = F.when(i % 3 == 0, F.concat(F.lit("Guide > "), i.cast("string"))).otherwise(""), F.when(i % 3 == 1, F.lit("Title"))
    return table(spark, d, "pages").select("page_id", C.citation_url(canonical, "url").alias("citation"), C.heading_label(heading, title, "url").alias("label"))


@query(
    rf"""SELECT p_partkey, {{norm}} AS name, array_to_string(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS words,
  regexp_extract('see v' || CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR) || ' now', '\bv?(\d+\.\d+(?:\.\d+)?)\b', 1) AS version FROM part""".replace("{norm}", r"trim(regexp_replace(lower(regexp_replace(trim(p_name), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g'))")
)
def name_functions(spark: SparkSession, d: str) -> DataFrame:
    mention = F.concat(F.lit("see v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(" now"))
    return table(spark, d, "part").select("p_partkey", C.normal_name("p_name").alias("name"), F.array_join(C.words("p_type"), " ").alias("words"), C.version_mention(mention).alias("version"))


@query(
    "WITH m AS (SELECT doc_id, replace(text, 'the', '[redacted]') AS m FROM documents), n AS (SELECT doc_id, m, list_max(list_filter(range(0, 301), lambda i: strlen(substring(m, 1, i)) <= 300)) AS n FROM m) "
    "SELECT doc_id, CASE WHEN strlen(m) <= 300 THEN m ELSE substring(m, 1, n) || '...' END AS message FROM n"
)
def redacted_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.redact("text", "the").alias("message"))


@query("SELECT doc_id AS chunk_id, source AS library_id FROM documents WHERE source = 'src3' ORDER BY doc_id")
def chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).listing(library_id="src3").select(F.col("chunk_id").cast("long").alias("chunk_id"), "library_id")


@query("SELECT doc_id AS chunk_id, n_chars FROM documents WHERE doc_id = 42")
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    chunk = _store(spark, d).get(f"{42:012d}")
    return spark.createDataFrame([(int(chunk["chunk_id"]), len(chunk["content"]))], "chunk_id long, n_chars long")


@query(
    "WITH new AS (SELECT doc_id, 'new' AS v FROM documents WHERE doc_id % 3 = 0), old AS (SELECT doc_id, 'old' AS v FROM documents WHERE doc_id % 2 = 0) "
    "SELECT doc_id, v FROM new UNION ALL SELECT doc_id, v FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)"
)
def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    state = lambda rows, v: _chunks_of(rows.withColumn("text", F.lit(v)))
    store = ChunkStore(spark, _folder(spark, "chunks"))
    store.commit(state(docs.where("doc_id % 2 = 0"), "old"))
    store.upsert(state(docs.where("doc_id % 3 = 0"), "new"))
    return store.read().select(F.col("chunk_id").cast("long").alias("doc_id"), F.col("content").alias("v"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND source <> 'src3'")
def chunk_delete(spark: SparkSession, d: str) -> DataFrame:
    """Deletes by id, then of one source."""
    store = _store(spark, d)
    store.delete(table(spark, d, "documents").where("doc_id % 5 = 0").select(F.format_string("%012d", "doc_id").alias("chunk_id")))
    store.delete_source("src3")
    return store.read().select(F.col("chunk_id").cast("long").alias("doc_id"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 9) AS score FROM bm25 ORDER BY bm25.score DESC, doc_id LIMIT 20")
def bm25_stored_index(spark: SparkSession, d: str) -> DataFrame:
    """The ranking from the postings that a commit has stored; no text is read."""
    store = ChunkStore(spark, _folder(spark, "chunks"))
    store.commit(_chunks_of(table(spark, d, "documents")).withColumns({"library_id": F.lit("/local/docs"), "heading_path": F.lit("")}))
    return store.lexical("/local/docs", QUERY).select(F.col("chunk_id").cast("long").alias("doc_id"), F.round("score", 9).alias("score"))


@query(
    r"""WITH t AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), E' \t\n\r\x0b\x0c') AS body, '## ' || lang AS head, CAST(floor((len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) + 2) * 1.3) AS INT) AS tokens FROM documents WHERE trim(text, E' \t\n\r') <> ''),
p AS (SELECT doc_id, source || ' > ' || lang AS heading_path, 0 AS chunk_index, CASE WHEN tokens > 500 THEN head ELSE head || chr(10) || chr(10) || body END AS content FROM t UNION ALL SELECT doc_id, source || ' > ' || lang, 1, body FROM t WHERE tokens > 500)
SELECT doc_id, heading_path, chunk_index, sha256(content) AS content_hash FROM p"""
)
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents as plain texts below two Markdown headings: sections with a body, long ones in pieces, hashes."""
    docs = table(spark, d, "documents")
    url = F.concat(F.lit("https://d.test/"), F.col("doc_id").cast("string"))
    markdown = F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang")
    pages = docs.select(C.short_sha(url).alias("document_id"), url.alias("url"), F.lit("").alias("canonical_url"), F.lit("").alias("title"), markdown.alias("markdown"), F.col("text").alias("plain"))
    return chunking.chunk(pages, "s", "/local/d").select(F.substring_index("url", "/", -1).cast("long").alias("doc_id"), "heading_path", "chunk_index", "content_hash")


_SNAPSHOT = r"""
old AS (SELECT doc_id, sha256(text) AS h, source AS title FROM documents WHERE doc_id % 11 <> 0),
new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS h, CASE WHEN doc_id % 13 = 0 THEN 'renamed' ELSE source END AS title FROM documents WHERE doc_id % 10 <> 0)
"""


@query(f"WITH {_SNAPSHOT} SELECT doc_id, h AS content_hash, title FROM new")
def snapshot_apply(spark: SparkSession, d: str) -> DataFrame:
    """The next snapshot from the old one, the new rows, unchanged ones among them, and their statuses."""
    docs = table(spark, d, "documents").withColumn("heading_path", F.lit(""))
    old = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("source").alias("title"), "heading_path")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    title = F.when(F.col("doc_id") % 13 == 0, F.lit("renamed")).otherwise(F.col("source"))
    new = docs.where("doc_id % 10 <> 0").select("doc_id", F.sha2(edited, 256).alias("content_hash"), title.alias("title"), "heading_path")
    return diff.apply(old, new, diff.diff(new, old, "doc_id"), "doc_id").select("doc_id", "content_hash", "title")


@query(
    "SELECT 1 AS step, n AS discovered, n AS indexed, n AS added, 0 AS updated, 0 AS unchanged, 0 AS removed FROM (SELECT count(*) + 1 AS n FROM nation) UNION ALL "
    "SELECT 2, count(*) FILTER (n_nationkey % 5 <> 0) + 1, count(*) FILTER (n_nationkey % 5 <> 0 AND n_nationkey % 3 = 0) + 1, 0, count(*) FILTER (n_nationkey % 5 <> 0 AND n_nationkey % 3 = 0) + 1, count(*) FILTER (n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0), count(*) FILTER (n_nationkey % 5 = 0) FROM nation"
)
def library_sync(spark: SparkSession, d: str) -> DataFrame:
    """A library is added from a site of nations, then some pages change and some go: the reports of both runs."""
    lib = Library(spark, _folder(spark, "library"), embed.Fake(), max_pages=1000)
    nations = table(spark, d, "nation")

    def site(rows: DataFrame) -> DataFrame:
        pages = rows.select(F.concat(F.lit("https://n.test/docs/"), F.col("n_nationkey").cast("string")).alias("url"), F.concat(F.lit("<main><h1>"), "n_name", F.lit("</h1><p>"), "words", F.lit("</p></main>")).alias("html"))
        links = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<a href="/docs/'), F.col("n_nationkey").cast("string"), F.lit('">x</a>')))), " ")
        return pages.unionByName(rows.agg(F.lit("https://n.test/docs").alias("url"), F.concat(F.lit("<main><p>Start</p><p>"), links, F.lit("</p></main>")).alias("html")))

    first = lib.add("Nations", "https://n.test/docs", site(nations.withColumn("words", F.lit("as it was"))))
    changed = nations.where("n_nationkey % 5 <> 0").withColumn("words", F.when(F.col("n_nationkey") % 3 == 0, "new words").otherwise("as it was"))
    second = lib.sync("/local/nations", site(changed))
    names = ("discovered", "indexed", "added", "updated", "unchanged", "removed")
    return spark.createDataFrame([(i + 1, *[r[n] for n in names]) for i, r in enumerate((first, second))], "step int, " + ", ".join(f"{n} long" for n in names))


@query("SELECT '/local/' || lower(replace(n_name, '_', '-')) AS library_id, n_name AS name, 'https://n.test/docs/' || n_nationkey AS base_url FROM nation WHERE n_nationkey % 4 <> 0")
def registry_table(spark: SparkSession, d: str) -> DataFrame:
    """Libraries that were registered, some of them deleted again, as a table."""
    registry = Registry(spark, _folder(spark, "registry"))
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows
    for r in rows:
        registry.add(Source("/local/" + r.n_name.lower().replace("_", "-"), r.n_name, f"https://n.test/docs/{r.n_nationkey}"))
    for r in rows:
        if r.n_nationkey % 4 == 0:
            registry.delete("/local/" + r.n_name.lower().replace("_", "-"))
    return registry.table().select("library_id", "name", "base_url")


@query(f"WITH ranked AS ({_RESOLVE.strip()}) SELECT 'l' || p_partkey AS library_id, CAST(p_partkey % 9 AS BIGINT) AS indexed_chunks, score FROM ranked WHERE p_partkey % 9 > 0")
def resolve_libraries(spark: SparkSession, d: str) -> DataFrame:
    """Which libraries a name and a question mean, of those that have chunks."""
    version = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("1."), (F.col("p_size") % 4).cast("string")))
    key = F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("library_id")
    parts = table(spark, d, "part")
    libraries = parts.select(key, F.col("p_brand").alias("name"), F.col("p_type").alias("description"), version.alias("version"), F.lit("").alias("base_url"))
    return resolve.resolve(libraries, NAME, ASKED, parts.select(key, (F.col("p_partkey") % 9).alias("chunks"))).select("library_id", "indexed_chunks", "score")


@query(
    "WITH f AS (SELECT g.conv_id, min(h.turn + 1) AS rank FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN conversations h ON g.conv_id = h.conv_id AND h.role = 'assistant' AND h.turn < 20 GROUP BY g.conv_id) "
    "SELECT count(*) AS queries, round(avg((coalesce(rank, 99) <= 1)::int), 9) AS top1, round(avg((coalesce(rank, 99) <= 3)::int), 9) AS top3, round(avg((coalesce(rank, 99) <= 5)::int), 9) AS top5, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM f"
)
def gold_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and MRR on the one page that answers: here, how early a conversation has its first answer."""
    turns = table(spark, d, "conversations")
    hits = turns.select(F.col("conv_id").alias("query_id"), F.col("role").alias("url"), (F.col("turn") + 1).alias("rank"))
    gold = turns.select(F.col("conv_id").alias("query_id")).distinct().withColumn("url", F.lit("assistant"))
    return diff.gold_metrics(hits, gold).select("queries", *[F.round(c, 9).alias(c) for c in ("top1", "top3", "top5", "mrr")])


@query(
    "WITH h AS (SELECT conv_id AS query_id, role AS topic, turn + 1 AS rank FROM conversations), w AS (SELECT DISTINCT conv_id AS query_id, r AS topic FROM conversations, (VALUES ('user'), ('assistant'), ('system'), ('tool')) AS t(r)) "
    "SELECT w.query_id, w.topic, min(h.rank) AS rank FROM w LEFT JOIN h ON w.query_id = h.query_id AND w.topic = h.topic AND h.rank <= 20 GROUP BY ALL"
)
def topic_recall(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    hits = turns.select(F.col("conv_id").alias("query_id"), F.col("role").alias("topic"), (F.col("turn") + 1).alias("rank"))
    wanted = turns.select(F.col("conv_id").alias("query_id")).distinct().withColumn("topic", F.explode(F.array(*map(F.lit, ("user", "assistant", "system", "tool")))))
    return diff.topic_recall(hits, wanted)


_SITEMAP = """<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.test/docs/one</loc><lastmod>2024-01-02</lastmod></url><url><loc> https://a.test/docs/two?x=1&amp;y=2 </loc></url><url><lastmod>2024</lastmod></url></urlset>"""


@query(
    "SELECT * FROM (VALUES ('https://a.test/docs/one', '2024-01-02'), ('https://a.test/docs/two?x=1&y=2', '')) AS t(loc, lastmod) "
    "UNION ALL SELECT trim(url), CASE WHEN page_id % 2 = 0 THEN '2024-01-0' || (page_id % 7 + 1) ELSE '' END FROM pages"
)
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap of each page, one of every case, and one that is broken."""
    rows = spark.createDataFrame([(_SITEMAP,), ("<urlset><url><loc>https://a.test/broken</url></urlset>",)], "body string")
    day = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<lastmod>2024-01-0"), F.col("page_id") % 7 + 1, F.lit("</lastmod>"))).otherwise("")
    url = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    own = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), url, F.lit(" </loc>"), day, F.lit("</url><url><lastmod>2024</lastmod></url></urlset>"))
    rows = rows.unionByName(table(spark, d, "pages").select(own.alias("body")))
    return rows.where(web.looks_like_sitemap("body")).select(F.explode(web.sitemap_entries("body")).alias("e")).select("e.*")


_ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\n\nUser-agent: other\nDisallow: /\n"


@query(
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '^/.*\.html$') AND NOT starts_with(path, '/en/') THEN false WHEN regexp_matches(path, '^/.*\.html$') THEN false WHEN starts_with(path, '/en/1') THEN true WHEN starts_with(path, '/en/') THEN false ELSE true END AS allowed FROM p"""
)
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", web.robots_allowed(U.path_of("url"), web.parse_robots(_ROBOTS)).alias("allowed"))
