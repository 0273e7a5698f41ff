"""The tables that queries start from, and the same ones as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators import mentions as M
from spanloom.operators import segment as G


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tokens(documents(spark, sf_dir))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sentences(documents(spark, sf_dir))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rule_mentions(tokens(spark, sf_dir))


TOKENS = r"""
ln0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL),
ln1 AS (SELECT doc_id, line, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start FROM ln0),
ln AS (SELECT doc_id, line, line_start, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS sent_idx FROM ln1 WHERE regexp_matches(line, '\S')),
pc0 AS (SELECT doc_id, sent_idx, line_start, unnest(regexp_extract_all(line, '\s*\S+')) AS piece, unnest(range(1, len(regexp_extract_all(line, '\s*\S+')) + 1)) AS i FROM ln),
pc AS (SELECT doc_id, sent_idx, regexp_replace(piece, '^\s+', '') AS token, line_start + sum(length(piece)) OVER (PARTITION BY doc_id, sent_idx ORDER BY i) AS char_end, i FROM pc0),
tok AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, i) - 1 AS INTEGER) AS tok_idx, CAST(sent_idx AS INTEGER) AS sent_idx, token, CAST(char_end - length(token) AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end FROM pc),
sent AS (SELECT doc_id, sent_idx, min(tok_idx) AS start_token, max(tok_idx) + 1 AS end_token FROM tok GROUP BY doc_id, sent_idx)"""

MENTIONS = (
    TOKENS
    + r""",
tagged AS (SELECT doc_id, tok_idx, sent_idx, CASE WHEN regexp_matches(token, '^[^@]+@[^@]+$') THEN 'MAIL' WHEN regexp_matches(core, '^[0-9]+$') THEN 'NUM' WHEN regexp_matches(core, '^[A-Z][a-z]+$') THEN 'CAP' END AS tag
  FROM (SELECT *, regexp_replace(token, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') AS core FROM tok)),
isl AS (SELECT doc_id, sent_idx, tok_idx, tag, tok_idx - row_number() OVER (PARTITION BY doc_id, sent_idx, tag ORDER BY tok_idx) AS island FROM tagged WHERE tag IS NOT NULL),
runs AS (SELECT doc_id, sent_idx, tag AS type, min(tok_idx) AS start_token, max(tok_idx) + 1 AS end_token FROM isl GROUP BY doc_id, sent_idx, tag, island),
spans AS (SELECT DISTINCT * FROM (SELECT doc_id, sent_idx, type, start_token, end_token FROM runs UNION ALL SELECT doc_id, sent_idx, 'CTX', start_token, end_token + 2 FROM runs WHERE start_token % 2 = 0)),
ment AS MATERIALIZED (SELECT doc_id, 'T' || (ord + 1) AS ent_id, CAST(start_token AS INTEGER) AS start_token, CAST(end_token AS INTEGER) AS end_token, type, sent_idx, CAST(ord AS INTEGER) AS ord
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_token, end_token, type) - 1 AS ord FROM spans))"""
)


def oracle(select: str, base: str = TOKENS) -> str:
    """A whole statement: the base tables and then more of them or a query."""
    return f"WITH {base.strip()}{', ' if not select.lstrip().upper().startswith('SELECT') else ' '}{select.strip()}"
