"""Table functions for SQL over a view of embedded chunks. Spark inlines their bodies, so filters, pruning and limits
work through them as in a query written out.

The view has ``chunk_id, document_id, text, chunk_index, platform, case_id, evidence_id, embedding, created_at``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_SIMILARITY = """
CREATE OR REPLACE TEMPORARY FUNCTION vector_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
COMMENT 'Cosine similarity; 0 for vectors of other lengths and zero vectors'
RETURN CASE WHEN size(a) = size(b) AND exists(a, x -> x <> 0) AND exists(b, x -> x <> 0)
  THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
    / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))
  ELSE 0D END
"""

_MATCH = """
CREATE OR REPLACE TEMPORARY FUNCTION match_embeddings(
  query_embedding ARRAY<DOUBLE>, match_threshold DOUBLE DEFAULT 0.7D, match_count INT DEFAULT 10,
  filter_platform STRING DEFAULT NULL, filter_case_id STRING DEFAULT NULL, filter_evidence_id STRING DEFAULT NULL)
RETURNS TABLE (chunk_id STRING, document_id STRING, text STRING, similarity DOUBLE, metadata STRUCT<platform: STRING, case_id: STRING, evidence_id: STRING>, created_at TIMESTAMP_NTZ)
COMMENT 'The best chunks above a threshold, within the given scopes'
RETURN SELECT chunk_id, document_id, text, similarity, struct(platform, case_id, evidence_id), created_at FROM (
  SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS place FROM (
    SELECT *, vector_similarity(CAST(embedding AS ARRAY<DOUBLE>), query_embedding) AS similarity FROM {view}
    WHERE (filter_platform IS NULL OR platform = filter_platform) AND (filter_case_id IS NULL OR case_id = filter_case_id)
      AND (filter_evidence_id IS NULL OR evidence_id = filter_evidence_id)) AS scoped
  WHERE similarity > match_threshold) AS ranked
WHERE place <= match_count
"""

_DOCUMENT = """
CREATE OR REPLACE TEMPORARY FUNCTION get_document_embeddings(doc_id STRING)
RETURNS TABLE (chunk_id STRING, text STRING, chunk_index INT)
COMMENT 'The chunks of a document; sort by chunk_index'
RETURN SELECT chunk_id, text, chunk_index FROM {view} WHERE document_id = doc_id
"""

_STATS = """
CREATE OR REPLACE TEMPORARY FUNCTION get_case_embedding_stats(case_id_param STRING)
RETURNS TABLE (platform STRING, document_count BIGINT, chunk_count BIGINT, avg_chunk_length DOUBLE)
COMMENT 'Documents, chunks and mean chunk length of a case by platform'
RETURN SELECT platform, count(DISTINCT document_id), count(*), avg(length(text)) FROM {view} WHERE case_id = case_id_param GROUP BY platform
"""


def register_functions(spark: SparkSession, view: str) -> None:
    """Defines ``vector_similarity``, ``match_embeddings``, ``get_document_embeddings`` and ``get_case_embedding_stats`` for a session."""
    for body in (_SIMILARITY, _MATCH, _DOCUMENT, _STATS):
        spark.sql(body.replace("{view}", view))
