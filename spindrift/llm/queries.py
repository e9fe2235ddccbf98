"""Queries of the training-data operators: one opN_<name> each, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, gif_media, html_extract, licenses, line_dedup, mixing, pii, quality, secrets, simhash
from .common import settle, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__sd_words").alias("n_words"), F.col("__sd_gone").alias("n_removed"), "text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "item_words", "end_word")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_digests(settle(gif_media.store_texts(table(spark, sf_dir, "documents"))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_html_extraction, op2_simhash_near_dedup, op3_line_dedup, op4_secret_scan, op5_quality_classifier,
            op6_benchmark_decontamination, op7_mixing, op8_gif_media, op9_pii, op10_license_scan,
        )
    }


# Places come from the lengths between the matches, entropies from each window counted anew.
OP4_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
rules(kind, pattern) AS (VALUES (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'), (3, '[A-Za-z0-9+/=_-]+')),
split AS (
  SELECT r, 0 AS kind, string_split_regex(text, '{assign}') AS gaps, regexp_extract_all(text, '{assign}', 0) AS found, regexp_extract_all(text, '{assign}', 2) AS v
  FROM docs
  UNION ALL
  SELECT r, kind, string_split_regex(text, pattern), regexp_extract_all(text, pattern, 0), regexp_extract_all(text, pattern, 0)
  FROM docs, rules),
placed AS (
  SELECT r, kind, v, len(found) AS n,
    sum(len(gap) + len(found)) OVER (PARTITION BY r, kind ORDER BY i) AS e
  FROM (SELECT r, kind, unnest(found) AS found, unnest(v) AS v, unnest(gaps[1:len(found)]) AS gap, unnest(range(len(found))) AS i FROM split)),
base AS (
  SELECT r, kind AS k, e - n AS s, e FROM placed
  WHERE (kind = 0 AND len(v) >= 6) OR (kind = 1 AND n >= 20) OR (kind = 2 AND n >= 24)),
candidates AS (
  SELECT r, v, e - n AS s, e,
    CASE WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN 3 WHEN regexp_full_match(v, '[A-Za-z0-9]+') THEN 4 ELSE 5 END AS k
  FROM placed
  WHERE kind = 3 AND n >= 20
    AND NOT regexp_full_match(v, '[A-Za-z]+')
    AND NOT regexp_full_match(v, '[0-9_/=+-]+')
    AND NOT regexp_full_match(v, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')
    AND NOT regexp_matches(lower(v), 'example|sample|placeholder|changeme|dummy|your[_-]?(key|token|secret)|redacted|xxxx')
    AND NOT regexp_matches(v, '0123456789|abcdefgh|ABCDEFGH|12345678')
    AND NOT regexp_full_match(v, '([A-Za-z]{1,12}[/_=-])+[A-Za-z]{0,12}')
    AND NOT list_bool_or(list_transform(range(1, n - 6), lambda i: substring(v, i, 8) = repeat(substring(v, i, 1), 8)))),
windows AS (SELECT v, unnest(range(1, len(v) - 18)) AS i FROM (SELECT DISTINCT v FROM candidates)),
letters AS (SELECT v, i, unnest(string_split(substring(v, i, 20), '')) AS c FROM windows),
counted AS (SELECT v, i, c, count(*) AS n FROM letters GROUP BY ALL),
bits AS (
  SELECT v, max(h) AS h
  FROM (SELECT v, i, log2(20) - sum(n * log2(n)) / 20 AS h FROM counted GROUP BY v, i) GROUP BY v),
added AS (
  SELECT c.r, c.k, c.s, c.e FROM candidates c JOIN bits USING (v)
  WHERE h >= CASE c.k WHEN 3 THEN 2.7 WHEN 4 THEN 3.4 ELSE 3.5 END
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND c.s >= b.s AND c.e <= b.e)),
spans AS (
  SELECT r, k, s, ['assign', 'access', 'hex', 'entropy_hex', 'entropy_alnum', 'entropy_base64'][k + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS shown
  FROM (FROM base UNION ALL FROM added)),
digests AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k > 2) AS n_added,
    coalesce(string_agg(shown, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(shown, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added
FROM docs LEFT JOIN digests USING (r)
""".replace("{assign}", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


def oracle_sql() -> dict[str, str]:
    """SQL of the one that SQL can express; for the other nine tests/llm holds brute-force versions."""
    return {"op4_secret_scan": OP4_SQL}
