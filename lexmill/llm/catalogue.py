"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, embedding, fixity, langid, lengths, linededup, mixing, pii, quality, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_decisions(_table(spark, sf_dir, "documents"))


def op2_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.length_histogram(_table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC files, and a replica in which one byte of every 97th page differs."""
    changed = F.when(F.pmod("page_id", F.lit(97)) == 13, F.expr("overlay(html placing '~' from 10 for 1)")).otherwise(F.col("html"))
    return fixity.audit(*fixity.page_archive(_table(spark, sf_dir, "pages"), changed=changed))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a key that anybody can read, as the texts are invented; whoever has something to hide brings a key of their own."""
    return pii.replace_documents(_table(spark, sf_dir, "documents"), b"key of the test tables").select("doc_id", "text", "n_entities", "entity_types")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint(out.fp).alias("fingerprint"), "component_id")


def op8_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embedding_links(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_token_lengths, op3_language_id, op4_fixity_audit, op5_surrogates, op6_line_dedup, op7_simhash, op8_embedding_links, op9_quality, op10_bpe)}


_OP4 = f"""
WITH page AS (
  SELECT page_id, coalesce(CAST(floor(page_id / {fixity.FILE_IDS}) AS BIGINT), -1) AS file,
    concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), 'none'), '>', chr(13), chr(10),
      'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ') AS head,
    coalesce(html, '') AS body,
    CASE WHEN page_id % 97 = 13 THEN concat(left(html, 9), '~', substr(html, 11)) ELSE html END AS changed,
    concat(chr(13), chr(10), chr(13), chr(10)) AS gap
  FROM pages),
record AS (
  SELECT file, concat(head, strlen(body), gap, body, gap) AS ours, concat(head, strlen(coalesce(changed, '')), gap, coalesce(changed, ''), gap) AS theirs
  FROM page),
laid AS (
  SELECT file, sha256(ours) AS expected, sha256(theirs) AS found, strlen(ours) AS length,
    sum(strlen(ours)) OVER (PARTITION BY file ORDER BY sha256(ours), sha256(theirs) ROWS UNBOUNDED PRECEDING) - strlen(ours) AS offset_
  FROM record)
SELECT file, CAST(offset_ AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, expected, found, 'corrupt' AS status
FROM laid WHERE expected <> found
"""

_OP6 = f"""
WITH line AS (
  SELECT doc_id, i - 1 AS idx, list_filter(string_split(translate(ls[i], concat(chr(9), chr(11), chr(12), chr(13)), '    '), ' '), lambda w: w <> '') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
again AS (SELECT doc_id, idx FROM line WHERE len(w) > 0 QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, idx) > 1),
long AS (SELECT doc_id, idx, w, len(w) AS n FROM line WHERE len(w) >= {linededup.NEAR_WORDS}),
half AS (
  SELECT doc_id, idx, w, n, 'first' AS side, w[1:h] AS k FROM (SELECT *, unnest(list_distinct([n // 2, (n + 1) // 2])) AS h FROM long)
  UNION ALL
  SELECT doc_id, idx, w, n, 'last' AS side, w[n - h + 1:n] AS k FROM (SELECT *, unnest(list_distinct([n // 2, (n + 1) // 2])) AS h FROM long)),
pair AS (
  SELECT DISTINCT b.doc_id, b.idx, a.w AS x, b.w AS y
  FROM half a JOIN half b ON a.side = b.side AND a.k = b.k AND abs(a.n - b.n) <= 1 AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.idx < b.idx)),
gone AS (
  SELECT doc_id, idx FROM again UNION
  SELECT doc_id, idx FROM pair
  WHERE len(x) = len(y) AND len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i])) = 1
    OR len(x) + 1 = len(y) AND len(list_filter(range(1, len(y) + 1), lambda i: list_concat(y[1:i - 1], y[i + 1:]) = x)) > 0
    OR len(x) = len(y) + 1 AND len(list_filter(range(1, len(x) + 1), lambda i: list_concat(x[1:i - 1], x[i + 1:]) = y)) > 0),
per_doc AS (SELECT doc_id, count(*) AS n, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS dropped FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_dropped, coalesce(p.dropped, '') AS dropped
FROM documents d LEFT JOIN per_doc p USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_fixity_audit": _OP4, "op6_line_dedup": _OP6}
