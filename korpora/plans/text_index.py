"""Queries on text functions, the index and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpora.functions import html, urls
from korpora.functions.text import STEMMED_STOPWORDS, content_terms, stem_all, tokenize
from korpora.operators import graph
from korpora.operators import index as ix
from korpora.plans.corpus import EDGES, LIVE, POSTINGS, authority, index, sql_postings, sql_url
from korpora.plans.sql_text import sql_stem, sql_words
from korpora.sources.tables import table


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    words = tokenize(F.col("text"))
    return table(spark, d, "docs").select("id", F.size(words).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))


def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = tokenize(F.col("text"))
    pair = F.explode(F.arrays_zip(words.alias("word"), stem_all(words).alias("term"))).alias("p")
    return table(spark, d, "docs").select(pair).groupBy("p.word", "p.term").agg(F.count("*").alias("n"))


def stopword_content_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = stem_all(tokenize(F.col("q")))
    return table(spark, d, "searches").select("search_id", F.array_join(content_terms(terms), " ").alias("content"))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "docs").select("id", F.explode("links").alias("raw"))
    noisy = F.concat("raw", F.lit("?utm_source=feed&page=2&REF=x#top"))
    return links.select("id", "raw", urls.normalize_url(F.col("raw")).alias("url"), urls.normalize_url(noisy).alias("noisy_url")).distinct()


def url_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("id", urls.domain(F.col("url")).alias("host"))


#: Pages as HTML, made from the stored ones in both engines.
PAGE = (
    "concat('<!doctype html><html lang=\"', coalesce(lang, ''), '\"><head><title>', coalesce(title, ''), ' &amp; more</title>', "
    "'<meta name=\"description\" content=\"', replace(coalesce(description, ''), '\"', ''), '\"><meta name=\"robots\" content=\"', CASE WHEN id % 7 = 0 THEN 'noindex' ELSE 'all' END, '\">', "
    "'<link rel=\"canonical\" href=\"', url, '\"><style>p {color: red}</style></head><body><nav>Home <a href=\"/home\">x</a></nav><script>var a = 1;</script><!-- note -->', "
    "'<p>', replace(coalesce(text, ''), chr(10), '</p><p>'), '</p><a href=\"', url, '?page=2\">next</a><a rel=\"nofollow\" href=\"https://ads.example/\">ad</a><footer>&copy; site</footer></body></html>')"
)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("id", F.expr(PAGE).alias("html"))


#: A link as a page may write it, by the page's id, and what it means.
RELATIVE = "CASE pmod(id, 6) WHEN 0 THEN '/home?ref=1' WHEN 1 THEN '?page=2' WHEN 2 THEN '//Other.example/x#top' WHEN 3 THEN 'next.html' WHEN 4 THEN '../up/./here' ELSE 'mailto:a@b.example' END"


def links_resolved(spark: SparkSession, d: str) -> DataFrame:
    rows = ix.latest_by_url(table(spark, d, "docs")).select("id", "url", F.expr(RELATIVE).alias("raw"))
    return rows.select("id", "raw", urls.resolve_url(F.col("raw"), F.col("url")).alias("link"))


def html_title_lang(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", html.title(F.col("html")).alias("title"), html.lang(F.col("html")).alias("lang"))


def html_visible_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", html.visible_text(F.col("html")).alias("text"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", F.array_join(html.links(F.col("html")), " ").alias("links"))


def html_meta_flags(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return _pages(spark, d).select("id", html.noindex(h).alias("noindex"), html.canonical(h).alias("canonical"), (html.description(h) != "").alias("described"))


def indexable_pages(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    parts = _pages(spark, d).select("id", html.title(h).alias("title"), html.visible_text(h).alias("text"), html.noindex(h).alias("noindex"))
    return parts.where(html.indexable(F.col("title"), F.col("text"), F.col("noindex"))).select("id")


def postings_weighted(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).postings.select("term", "doc_id", "w", *[F.col(f"f{k}").cast("bigint").alias(f"f{k}") for k in range(3)])


def postings_positions(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).postings.select("term", "doc_id", F.array_join("pos", ",").alias("positions"))


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).docs.select(F.col("id").alias("doc_id"), "len")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).stats.select("n_docs", "total_len", F.round("avg_len", 6).alias("avg_len"))


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).terms.select("term", "df")


def term_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).terms.select("term", "display", "df")


def top_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return ix.top_vocabulary(index(spark, d).terms, 500).select("term", "df")


def postings_capped(spark: SparkSession, d: str) -> DataFrame:
    return ix.capped_postings(index(spark, d).postings, 50).select("term", "doc_id", "w")


def postings_limited(spark: SparkSession, d: str) -> DataFrame:
    return ix.limited_terms(index(spark, d).terms, 50).select("term", "df")


def postings_of_terms(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).postings.where(F.col("term").isin("lighthous", "beehiv", "telescop")).select("term", "doc_id", "w")


def _whole_texts(spark: SparkSession, d: str) -> ix.Index:
    """The index of ``documents``, whose texts go far beyond what is stored of a page."""
    texts = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.format_string("https://long.example/%d", "doc_id").alias("url"), F.lit("").alias("title"), F.lit(None).cast("string").alias("description"),
        "text", F.array().cast("array<string>").alias("links"), "lang", "fetched_at",
    )
    return ix.build_index(texts)


def whole_text_postings(spark: SparkSession, d: str) -> DataFrame:
    return _whole_texts(spark, d).postings.select("term", "doc_id", "w", F.element_at("pos", 1).cast("bigint").alias("first"))


def whole_text_pages(spark: SparkSession, d: str) -> DataFrame:
    return _whole_texts(spark, d).docs.select(F.col("id").alias("doc_id"), F.length("text").cast("bigint").alias("stored"), "len")


def upsert_latest_by_url(spark: SparkSession, d: str) -> DataFrame:
    return ix.latest_by_url(table(spark, d, "docs")).select("url", "id")


def remove_documents(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    gone = i.docs.where("domain LIKE 'www.%'").select(F.col("id").alias("doc_id"))
    posts, _ = ix.remove_documents(i.postings, i.docs, gone)
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def sample_document(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).docs.agg(F.min("id").alias("doc_id"))


def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).edges


def inlink_counts(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return graph.inlink_counts(i.docs, i.edges)


def dangling_nodes(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return graph.dangling_nodes(i.docs, i.edges)


def pagerank_20(spark: SparkSession, d: str) -> DataFrame:
    return authority(spark, d).select("doc_id", F.round("authority", 6).alias("authority"))


def crawl_bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    seeds = graph.inlink_counts(i.docs, i.edges).where("inlinks = 0").select("doc_id")
    return graph.crawl_depths(i.edges, seeds, 4)


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, stem_vocabulary, stopword_content_terms, url_normalize, url_domain, html_title_lang, html_visible_text, html_links,
        html_meta_flags, indexable_pages, postings_weighted, postings_positions, doc_lengths, corpus_stats, document_frequency, term_dictionary,
        top_vocabulary, postings_capped, postings_limited, postings_of_terms, whole_text_postings, whole_text_pages, links_resolved, upsert_latest_by_url, remove_documents, sample_document,
        resolved_edges, inlink_counts, dangling_nodes, pagerank_20, crawl_bfs_depth,
    )
}

_P = f"WITH {POSTINGS}\n"
_LONG = f"long AS (SELECT doc_id AS id, '' AS title, NULL::VARCHAR AS description, text FROM documents), {sql_postings('long')}"
_E = f"WITH {LIVE}, {EDGES}\n"
_H = f"WITH h AS (SELECT id, {PAGE} AS html FROM docs),\n"
_STOP = "[" + ", ".join(f"'{w}'" for w in STEMMED_STOPWORDS) + "]"
# RE2 has no back-references: one replacement for each element.
_VISIBLE = "html"
for _name in ("script", "style", "noscript", "template", "svg"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_name}\\b.*?</{_name}>', ' ', 'g')"
_VISIBLE = f"regexp_replace({_VISIBLE}, '(?s)<!--.*?-->', ' ', 'g')"
for _name in ("nav", "footer", "aside"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_name}\\b.*?</{_name}>', ' ', 'g')"
_VISIBLE = f"regexp_replace(regexp_replace({_VISIBLE}, '(?i)<(?:p|div|br|li|h[1-6]|tr|td|th|section|article|blockquote)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"


def _sql_entities(text: str) -> str:
    for name, char in html.ENTITIES.items():
        if name != "amp":
            text = f"regexp_replace({text}, '(?i)&{name};', '{char.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"regexp_replace({text}, '(?i)&amp;', '&', 'g')"


_VISIBLE = f"trim(translate(trim(regexp_replace(regexp_replace({_sql_entities(_VISIBLE)}, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ' || chr(10)), chr(10), ' '))"
_RAW_TITLE = _sql_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_TITLE = rf"trim(regexp_replace({_RAW_TITLE}, '[\s\x{{a0}}]+', ' ', 'g'))"
_STEPS = ",\n".join(
    f"""r{i} AS (SELECT n.id, 0.15 / c.n + coalesce(s.share, 0) + 0.85 * l.mass / c.n AS rank FROM live n CROSS JOIN c
  CROSS JOIN (SELECT coalesce(sum(rank), 0) AS mass FROM r{i - 1} WHERE id NOT IN (SELECT src FROM edges)) l
  LEFT JOIN (SELECT e.dst AS id, sum(0.85 * r.rank / o.deg) AS share FROM r{i - 1} r JOIN o ON o.src = r.id JOIN edges e ON e.src = r.id GROUP BY e.dst) s ON s.id = n.id)"""
    for i in range(1, 21)
)
PAGERANK = f"""c AS MATERIALIZED (SELECT count(*) AS n FROM live), o AS MATERIALIZED (SELECT src, count(*) AS deg FROM edges GROUP BY src), r0 AS (SELECT id, 1.0 / c.n AS rank FROM live, c),
{_STEPS.replace(' AS (SELECT n.id', ' AS MATERIALIZED (SELECT n.id')},
authority AS (SELECT id AS doc_id, rank / max(rank) OVER () AS authority FROM r20)"""

SQL = {
    "tokenize_counts": f"SELECT id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT id, {sql_words('text')} AS w FROM docs)",
    "stem_vocabulary": f"SELECT word, term, count(*) AS n FROM ({sql_stem(f'SELECT unnest({sql_words(chr(116) + chr(101) + chr(120) + chr(116))}) AS word FROM docs')}) GROUP BY word, term",
    "stopword_content_terms": f"""WITH t AS ({sql_stem(f"SELECT search_id, unnest({sql_words('q')}) AS word, generate_subscripts({sql_words('q')}, 1) AS nth FROM (SELECT DISTINCT search_id, q FROM searches)")}),
      g AS (SELECT search_id, list(term ORDER BY nth) AS terms FROM t GROUP BY search_id)
      SELECT search_id, coalesce(array_to_string(CASE WHEN len(list_filter(terms, lambda x: NOT list_contains({_STOP}, x))) > 0 THEN list_filter(terms, lambda x: NOT list_contains({_STOP}, x)) ELSE terms END, ' '), '') AS content
      FROM searches LEFT JOIN g USING (search_id)""",
    "url_normalize": f"SELECT DISTINCT id, raw, {sql_url('raw')} AS url, {sql_url('noisy')} AS noisy_url FROM (SELECT id, raw, raw || '?utm_source=feed&page=2&REF=x#top' AS noisy FROM (SELECT id, unnest(links) AS raw FROM docs))",
    "url_domain": "SELECT id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '') AS host FROM docs",
    "html_title_lang": _H + f"x AS (SELECT 1) SELECT id, {_TITLE} AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\\blang\\s*=\\s*[\"'']?([a-zA-Z-]+)', 1), '') AS lang FROM h",
    "html_visible_text": _H + f"x AS (SELECT 1) SELECT id, {_VISIBLE} AS text FROM h",
    "html_links": "SELECT id, '/home ' || url || '?page=2' AS links FROM docs",
    "html_meta_flags": "SELECT id, id % 7 = 0 AS noindex, url AS canonical, trim(regexp_replace(replace(coalesce(description, ''), '\"', ''), '[\\s\\x{a0}]+', ' ', 'g')) <> '' AS described FROM docs",
    "indexable_pages": "SELECT id FROM docs WHERE id % 7 <> 0",
    "postings_weighted": _P + "SELECT term, doc_id, CAST(w AS DOUBLE) AS w, f0, f1, f2 FROM wposts",
    "postings_positions": _P + "SELECT term, doc_id, array_to_string(pos, ',') AS positions FROM posts",
    "doc_lengths": _P + "SELECT id AS doc_id, CAST(len AS BIGINT) AS len FROM ldocs",
    "corpus_stats": _P + "SELECT count(*) AS n_docs, CAST(sum(len) AS BIGINT) AS total_len, round(avg(len), 6) AS avg_len FROM ldocs",
    "document_frequency": _P + "SELECT term, df FROM dict",
    "term_dictionary": _P + "SELECT term, display, df FROM dict",
    "top_vocabulary": _P + "SELECT term, df FROM dict ORDER BY df DESC, term LIMIT 500",
    "postings_capped": _P + "SELECT term, doc_id, CAST(w AS DOUBLE) AS w FROM wposts QUALIFY row_number() OVER (PARTITION BY term ORDER BY w DESC, doc_id) <= 50",
    "postings_limited": _P + "SELECT term, df FROM dict WHERE df >= 50",
    "postings_of_terms": _P + "SELECT term, doc_id, CAST(w AS DOUBLE) AS w FROM wposts WHERE term IN ('lighthous', 'beehiv', 'telescop')",
    "whole_text_postings": f"WITH {_LONG} SELECT term, doc_id, CAST(w AS DOUBLE) AS w, pos[1] AS first FROM wposts",
    "whole_text_pages": f"WITH {_LONG} SELECT id AS doc_id, least(length(coalesce(text, '')), 6000) AS stored, CAST(coalesce(n, 0) AS BIGINT) AS len FROM long LEFT JOIN (SELECT doc_id, sum(f2) AS n FROM posts GROUP BY doc_id) ON doc_id = id",
    "links_resolved": f"""WITH {LIVE}, p AS (SELECT id, regexp_extract(url, '^https?://[^/?#]+') AS origin, regexp_replace(url, '[?#].*$', '') AS bare FROM live),
      f AS (SELECT *, CASE WHEN bare = origin THEN bare || '/' ELSE regexp_replace(bare, '[^/]*$', '') END AS folder FROM p),
      u AS (SELECT *, CASE WHEN folder = origin || '/' THEN folder ELSE regexp_replace(folder, '[^/]+/$', '') END AS above FROM f)
      SELECT id, {RELATIVE.replace('pmod(id, 6)', 'id % 6')} AS raw, CASE id % 6 WHEN 0 THEN origin || '/home' WHEN 1 THEN CASE WHEN bare = origin THEN bare || '/' ELSE bare END || '?page=2'
        WHEN 2 THEN regexp_extract(origin, '^https?:') || '//other.example/x' WHEN 3 THEN folder || 'next.html' WHEN 4 THEN above || 'up/here' END AS link FROM u""",
    "upsert_latest_by_url": f"WITH {LIVE} SELECT url, id FROM live",
    "remove_documents": _P + "SELECT term, count(*) AS df FROM posts WHERE doc_id NOT IN (SELECT id FROM live WHERE domain LIKE 'www.%') GROUP BY term",
    "sample_document": f"WITH {LIVE} SELECT min(id) AS doc_id FROM live",
    "resolved_edges": _E + "SELECT src, dst FROM edges",
    "inlink_counts": _E + "SELECT l.id AS doc_id, count(e.src) AS inlinks FROM live l LEFT JOIN edges e ON e.dst = l.id GROUP BY l.id",
    "dangling_nodes": _E + "SELECT id AS doc_id FROM live WHERE id NOT IN (SELECT src FROM edges)",
    "pagerank_20": f"WITH {LIVE}, {EDGES.replace('edges AS', 'edges AS MATERIALIZED')},\n{PAGERANK} SELECT doc_id, round(authority, 6) AS authority FROM authority",
    "crawl_bfs_depth": f"""WITH RECURSIVE {LIVE}, {EDGES},
      walk(doc_id, depth) AS (SELECT id, 0 FROM live WHERE id NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.doc_id WHERE w.depth < 4)
      SELECT doc_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY doc_id""",
}
