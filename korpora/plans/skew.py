"""Queries on keys that hold most of the postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from korpora.operators.hotkeys import hot_keys, key_totals
from korpora.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(key_totals(table(spark, sf_dir, "postings"), pages=False))


def p1_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_totals(table(spark, sf_dir, "postings")).select("shard", "key_column", "key_value", "n_rows", "pages", "sum_w")


QUERIES = {"p1_found": p1_found, "p1_key_totals": p1_key_totals}

_KEYS = """
WITH p AS (
  SELECT shard, 'term' AS key_column, term AS key_value, doc_id, w FROM postings
  UNION ALL
  SELECT shard, 'doc_id', CAST(doc_id AS VARCHAR), doc_id, w FROM postings),
k AS (
  SELECT shard, key_column, key_value, count(*) AS n_rows, count(DISTINCT doc_id) AS pages, sum(w) AS sum_w
  FROM p GROUP BY shard, key_column, key_value)
"""

SQL = {
    "p1_key_totals": _KEYS + "SELECT * FROM k",
    "p1_found": _KEYS
    + """, s AS (SELECT shard, key_column, sum(n_rows) AS all_rows, count(*) AS n_keys FROM k GROUP BY shard, key_column)
SELECT k.shard, k.key_column, k.key_value FROM k JOIN s USING (shard, key_column)
WHERE n_rows >= 0.005 * all_rows AND n_rows * n_keys >= 5 * all_rows""",
}
