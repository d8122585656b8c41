"""The index of a data directory, built once per session, and what the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpora.operators import graph
from korpora.operators.index import Index, build_bare_index, build_index, uncapped
from korpora.plans.sql_text import sql_stem, sql_words
from korpora.session import materialize
from korpora.sources.tables import table

NOW = "2026-08-01 00:00:00"

_indexes: dict[tuple[str, str], Index] = {}
_bare: dict[tuple[str, str], Index] = {}
_authority: dict[tuple[str, str], DataFrame] = {}


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def index(spark: SparkSession, sf_dir: str) -> Index:
    """Index of the ``docs`` table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = build_index(table(spark, sf_dir, "docs"))
    return _indexes[key]


def bare_index(spark: SparkSession, sf_dir: str) -> Index:
    """The same without a cap and what is only shown; ``index`` where it is built."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _indexes:
        return uncapped(_indexes[key])
    if key not in _bare:
        _bare[key] = build_bare_index(table(spark, sf_dir, "docs"))
    return _bare[key]


def authority(spark: SparkSession, sf_dir: str, ix: Index | None = None) -> DataFrame:
    """Authority of the pages of the ``docs`` table, by an index of it that is at hand."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _authority:
        ix = ix or index(spark, sf_dir)
        _authority[key] = materialize(graph.pagerank(ix.docs, ix.edges), "authority")
    return _authority[key]


# The same in SQL, from the base tables.

_TRACKING = "(utm_[^=&]*|fbclid[^=&]*|gclid[^=&]*|mc_cid[^=&]*|mc_eid[^=&]*|ref)"


def sql_url(u: str) -> str:
    """Normalised absolute URL without ports and credentials."""
    bare = f"regexp_replace(trim({u}), '#.*$', '')"
    origin = f"lower(regexp_extract({bare}, '^(?i:https?)://[^/?#\\s]+'))"
    path = f"regexp_replace(regexp_replace({bare}, '^(?i:https?)://[^/?#\\s]+', ''), '\\?.*$', '')"
    query = f"array_to_string(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^{_TRACKING}(=|$)')), '&')"
    return f"""CASE WHEN {origin} = '' THEN NULL WHEN {path} = '/' AND {query} = '' THEN {origin}
      ELSE {origin} || CASE WHEN {path} = '' AND {query} <> '' THEN '/' ELSE {path} END || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"""


LIVE = f"""raw AS (SELECT * REPLACE ({sql_url('url')} AS url) FROM docs),
live AS (
  SELECT id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS domain, title, description, text, links, lang, fetched_at
  FROM raw WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1)"""

def sql_postings(source: str) -> str:
    """CTEs ``words``, ``stream``, ``posts`` and ``wposts`` of whole texts from ``source`` (id, title, description, text)."""
    return f"""words AS (SELECT id, list_concat(list_transform(w0, lambda x: {{'field': 0, 'word': x}}), list_transform(w1, lambda x: {{'field': 1, 'word': x}}), list_transform(w2, lambda x: {{'field': 2, 'word': x}})) AS ws
  FROM (SELECT id, {sql_words('title')} AS w0, {sql_words('description')} AS w1, {sql_words('text')} AS w2 FROM {source})),
stream AS (SELECT * FROM ({sql_stem("SELECT id, u.field AS field, u.word AS word, pos FROM (SELECT id, unnest(ws) AS u, unnest(range(len(ws))) AS pos FROM words)")})),
posts AS (SELECT term, id AS doc_id, count(*) FILTER (field = 0) AS f0, count(*) FILTER (field = 1) AS f1, count(*) FILTER (field = 2) AS f2,
  list_sort(list(pos))[1:24] AS pos, arg_min(word, pos) AS display FROM stream GROUP BY term, id),
wposts AS (SELECT *, 3.0 * f0 + 1.5 * f1 + f2 AS w FROM posts)"""


POSTINGS = f"""{LIVE},
{sql_postings('live')},
lens AS (SELECT doc_id, sum(f0 + f1 + f2) AS len FROM posts GROUP BY doc_id),
ldocs AS (SELECT live.*, coalesce(len, 0) AS len FROM live LEFT JOIN lens ON id = doc_id),
dict AS (SELECT term, arg_min(display, doc_id) AS display, count(*) AS df FROM posts GROUP BY term),
stats AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM ldocs)"""

EDGES = """edges AS (SELECT DISTINCT l.id AS src, d.id AS dst FROM (SELECT id, unnest(norm) AS url FROM (
  SELECT id, list_distinct(list_filter(list_transform(links, lambda u: """ + sql_url("u") + """), lambda u: u IS NOT NULL)) AS norm FROM live)) l
  JOIN live d ON d.url = l.url WHERE l.id <> d.id)"""
