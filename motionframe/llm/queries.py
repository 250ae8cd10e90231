"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from motionframe.llm import byte_bpe, codebook, contamination, jaccard_join, license_scan, line_dedup, mixing, pii, quality, spelling, token_planes, toxicity, url_graph, workspace

BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(workspace.documents(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(workspace.documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(workspace.documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(workspace.documents(spark, sf_dir))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.verdicts(workspace.table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(workspace.documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(workspace.documents(spark, sf_dir), workspace.table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(workspace.documents(spark, sf_dir))


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.round_trip(workspace.documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(workspace.documents(spark, sf_dir), workspace.table(spark, sf_dir, "benchmark"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(workspace.documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(workspace.documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebook.report(workspace.table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_pii, op3_ngram_jaccard_join, op4_quality_rules, op5_url_filters, op6_line_dedup, op7_toxicity, op8_license_scan, op9_token_planes, op10_decontamination, op11_source_mixing, op12_spelling_variants, op13_vector_codes)}


OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM item_windows),
doc_arrays AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), doc_windows AS (
  SELECT doc_id, width, i AS start, array_to_string(w[i : i + width - 1], ' ') AS win
  FROM doc_arrays, widths, unnest(range(1, len(w) - width + 2)) AS t(i) WHERE len(w) >= width
), occurrences AS (SELECT d.doc_id, d.start, d.width, m.item_id FROM doc_windows d JOIN item_windows m ON d.width = m.width AND d.win = m.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + width)) AS p FROM occurrences) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM occurrences GROUP BY doc_id)
SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_arrays a LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filters": url_graph.sql(), "op8_license_scan": license_scan.sql(), "op10_decontamination": OP10_SQL, "op11_source_mixing": mixing.SQL, "op12_spelling_variants": spelling.SQL, "op13_vector_codes": codebook.sql()}
