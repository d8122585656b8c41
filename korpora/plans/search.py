"""Queries on searching, ranking and explaining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpora.functions.text import STEMMED_STOPWORDS, stem_all, tokenize
from korpora.operators import batch, explain, query, rank
from korpora.operators import graph as graph_ops
from korpora.operators.index import Index, limited_terms, recapped
from korpora.plans.corpus import EDGES, NOW, POSTINGS, authority, bare_index, index, now
from korpora.plans.sql_text import sql_stem, sql_words
from korpora.plans.text_index import PAGERANK
from korpora.session import materialize
from korpora.sources.tables import table

#: The queries that the catalogue answers; operators, stopwords, repeats and unknown words among them.
ASKED = (
    "old lighthouse",
    "the ferry timetable and the bread oven",
    '"copper kettle" river',
    "telescope compass -beehive",
    "night train site:example",
    "what is the tide table",
    "weather station weather map",
    "zzzunknown lighthouse",
)
SITE_QUERY = 'garden site:nimviksol-ka0.example'


def _asked(spark: SparkSession, texts: tuple[str, ...] = ASKED) -> DataFrame:
    return query.query_table(spark, [query.parse(t) for t in (*texts, SITE_QUERY)])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return rank.score(_asked(spark), index(spark, d), authority(spark, d), now())


def parsed_queries(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark).select("qid", F.array_join("terms", " ").alias("terms"), F.array_join("required", " ").alias("required"), F.size("phrases").cast("bigint").alias("n_phrases"), F.array_join("excluded", " ").alias("excluded"), "site")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("bm25", 4)), F.col("doc_id").cast("string")))).where("_n <= 10").select("qid", "doc_id", F.round("bm25", 4).alias("bm25"))


def bm25f_field_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("qid", "doc_id", F.round("bm25", 4).alias("bm25"))


def candidates_soft_and(spark: SparkSession, d: str) -> DataFrame:
    c = rank.candidates(_asked(spark), index(spark, d))
    return c.where(F.col("n_needed") >= F.greatest(F.ceil(0.6 * F.size("required") - 1e-9), F.lit(1))).select("qid", "doc_id", F.col("n_needed").alias("n_matched"))


def relaxed_pool(spark: SparkSession, d: str) -> DataFrame:
    return rank.pool(rank.candidates(_asked(spark), index(spark, d))).select("qid", "doc_id")


def _only(spark: SparkSession, d: str, text: str) -> DataFrame:
    return rank.candidates(query.query_table(spark, [query.parse(text)]), index(spark, d)).select("doc_id")


def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return _only(spark, d, '"search index"')


def exclude_term(spark: SparkSession, d: str) -> DataFrame:
    return _only(spark, d, "lighthouse -telescope")


def site_filter(spark: SparkSession, d: str) -> DataFrame:
    return _only(spark, d, SITE_QUERY)


def proximity_factor(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("qid", "doc_id", F.round("proximity_factor", 4).alias("proximity_factor"))


def freshness_factor(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).docs.select(F.col("id").alias("doc_id"), F.round(rank.freshness(F.col("fetched_at"), now()), 6).alias("fresh_factor"))


def full_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("qid", "doc_id", F.round("score", 4).alias("score"))


def _rounded(spark: SparkSession, d: str) -> DataFrame:
    """Scores as shown, so that both engines break ties alike."""
    return _scored(spark, d).withColumn("score", F.round("score", 4))


def domain_diversity(spark: SparkSession, d: str) -> DataFrame:
    return rank.diversify(_rounded(spark, d)).select("qid", "place", "doc_id")


def _page(spark: SparkSession, d: str, page: int) -> DataFrame:
    return rank.page_of(_rounded(spark, d), page).select("qid", "place", "doc_id", "score", "total", "total_pages")


def search_page_1(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, 1)


def search_page_2(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, 2)


def suggest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return query.suggest(index(spark, d).terms, "old li")


def nearest_term(spark: SparkSession, d: str) -> DataFrame:
    terms = index(spark, d).terms
    words = F.explode(stem_all(tokenize(F.col("q")))).alias("term")
    unknown = table(spark, d, "searches").select(words).distinct().join(terms, "term", "left_anti")
    return query.nearest_terms(unknown, terms).select("term", "near", F.col("distance").cast("bigint").alias("distance"), "df")


def correct_query(spark: SparkSession, d: str) -> DataFrame:
    """Every different query of the log that a correction changes."""
    asked = table(spark, d, "searches").where("trim(q) <> ''").select("q").distinct()
    return query.corrections(asked, index(spark, d).terms)


def answered(searches: DataFrame, index: Index, authority: DataFrame, at: Column, first: int = 10) -> DataFrame:
    """(search_id, place, doc_id, score): the first hits of every search (search_id, q), operators included.

    Equal queries are answered once. A search that is there twice counts once;
    one without a hit gives no row. All postings are weighed, whatever the cap
    of the index.
    """
    asked = searches.select("search_id", "q").where("search_id IS NOT NULL AND trim(q) <> ''").distinct()
    distinct = materialize(query.query_table_of(asked.groupBy("q").agg(F.min("search_id").alias("qid"))), "asked")
    hits = batch.first_hits(distinct, index, authority, at, first)
    by_query = asked.select("search_id", F.min("search_id").over(W.partitionBy("q")).alias("qid"))
    return by_query.join(hits, "qid").select("search_id", "place", "doc_id", "score")


def batch_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every search of the log whose id is divisible by 20, all answered in one plan."""
    ix = bare_index(spark, d)
    return answered(table(spark, d, "searches").where("search_id % 20 = 0"), ix, authority(spark, d, ix), now())


#: A cap that binds at every size of the test tables.
SMALL_CAP = 12


def search_capped(spark: SparkSession, d: str) -> DataFrame:
    """Scores where a search weighs only so many pages of a term."""
    scored = rank.score(_asked(spark), recapped(index(spark, d), SMALL_CAP), authority(spark, d), now())
    return scored.select("qid", "doc_id", F.round("score", 4).alias("score"))


def search_limited(spark: SparkSession, d: str) -> DataFrame:
    """What the capped searches have to report: their terms that stand on more pages than they weigh."""
    terms = _asked(spark).select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    return terms.join(limited_terms(index(spark, d).terms, SMALL_CAP), "term").select("qid", "term", "df")


def explain_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("qid", "doc_id", F.array_join("matched_needed", " ").alias("matched"), F.array_join(F.array_sort(F.array_except("required", "matched_needed")), " ").alias("missing"), F.array_join("in_title", " ").alias("in_title"))


def early_hit_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("qid", "doc_id", explain.early_hit_class(F.col("first_hit")).alias("early"))


def freshness_bucket(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).docs.select(F.col("id").alias("doc_id"), explain.freshness_class(F.col("fetched_at"), now()).alias("class"))


def score_factors(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("qid", "doc_id", *[F.round(c, 3).alias(c) for c in ("authority_factor", "proximity_factor", "fresh_factor")])


def explain_reason_codes(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    links = graph_ops.inlink_counts(i.docs, i.edges)
    told = explain.reasons(_scored(spark, d), _asked(spark), links, now())
    each = F.transform("reasons", lambda r: F.concat(r["code"], F.lit("("), F.array_join(r["args"], "|"), F.lit(")")))
    return told.select("qid", "doc_id", F.array_join(each, " ").alias("codes"))


def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    page = rank.page_of(_rounded(spark, d), 1, 10).select("qid", "place", "doc_id")
    docs = index(spark, d).docs.select(F.col("id").alias("doc_id"), explain.snippet_source(F.col("description"), F.col("text")).alias("source"))
    rows = page.join(docs, "doc_id").join(_asked(spark).select("qid", "terms"), "qid")
    return explain.with_snippet(rows, "source", "terms").select("qid", "place", "doc_id", "snippet")


def ranking_manifest(spark: SparkSession, d: str) -> DataFrame:
    return explain.ranking_manifest(spark)


QUERIES = {
    f.__name__: f
    for f in (
        parsed_queries, bm25_topk, bm25f_field_weighted, candidates_soft_and, relaxed_pool, phrase_search, exclude_term, site_filter,
        proximity_factor, freshness_factor, full_score, domain_diversity, search_page_1, search_page_2, suggest_prefix, nearest_term,
        correct_query, batch_search_topk, search_capped, search_limited, explain_coverage, explain_reason_codes, early_hit_bucket, freshness_bucket, score_factors,
        snippet_window, ranking_manifest,
    )
}


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]::VARCHAR[]"


def _asked_sql() -> str:
    rows = []
    for i, q in enumerate(map(query.parse, (*ASKED, SITE_QUERY))):
        phrases = "[" + ", ".join(_list(p) for _, p in q.phrases) + "]::VARCHAR[][]"
        rows.append(f"({i}, {_list(q.terms)}, {_list(q.required)}, {phrases}, {_list(t for _, t in q.excluded)}, {'NULL' if not q.site else chr(39) + q.site + chr(39)})")
    return f"asked(qid, terms, required, phrases, excluded, site) AS (VALUES {', '.join(rows)})"


_PH, _SITE, _EX = '"([^"]+)"|“([^”]+)”', r"(?i)(?:^|\s)site:([a-z0-9.-]+\.[a-z]{2,})", r'(?:^|\s)-([^\s"]+)'
_BATCH = f"""sq AS (SELECT DISTINCT search_id, q FROM searches WHERE search_id % 20 = 0 AND trim(q) <> ''),
nq AS (SELECT q, min(search_id) AS qid FROM sq GROUP BY q),
c1 AS (SELECT qid, regexp_extract_all(q, '{_PH}', 0) AS ph, regexp_replace(q, '{_PH}', ' ', 'g') AS q1 FROM nq),
c2 AS (SELECT qid, ph, lower(regexp_extract_all(q1, '{_SITE}', 1)[-1]) AS site, regexp_replace(q1, '{_SITE}', ' ', 'g') AS q2 FROM c1),
c3 AS (SELECT qid, ph, site, regexp_extract_all(q2, '{_EX}', 1) AS ex, regexp_replace(q2, '{_EX}', ' ', 'g') AS q3 FROM c2),
pieces AS (SELECT qid, 0 AS part, q3 AS t FROM c3 UNION ALL SELECT qid, part, ph[part] FROM (SELECT qid, ph, unnest(range(1, len(ph) + 1)) AS part FROM c3)
  UNION ALL SELECT qid, -part, ex[part] FROM (SELECT qid, ex, unnest(range(1, len(ex) + 1)) AS part FROM c3)),
qw AS ({sql_stem(f"SELECT qid, part, unnest({sql_words('t')}) AS word, generate_subscripts({sql_words('t')}, 1) AS nth FROM pieces")}),
ql AS (SELECT qid, part, list(term ORDER BY nth) AS ts FROM qw GROUP BY qid, part),
qx AS (SELECT c3.qid, c3.site, coalesce((SELECT flatten(list(ts ORDER BY part)) FROM ql WHERE ql.qid = c3.qid AND part >= 0), []) AS terms,
  coalesce((SELECT list(ts ORDER BY part) FROM ql WHERE ql.qid = c3.qid AND part > 0), []) AS phrases, coalesce((SELECT list(ts[1]) FROM ql WHERE ql.qid = c3.qid AND part < 0), []) AS excluded FROM c3),
qu AS (SELECT *, list_distinct(terms) AS u, list_filter(list_distinct(terms), lambda x: NOT list_contains({_list(STEMMED_STOPWORDS)}, x)) AS cont FROM qx),
asked AS MATERIALIZED (SELECT qid, terms, CASE WHEN len(cont) > 0 THEN cont ELSE u END AS required, phrases, excluded, site FROM qu)"""

_CORE = """
qt AS (SELECT DISTINCT qid, unnest(terms) AS term FROM asked),
pt AS (SELECT qid, k, unnest(p) AS term, unnest(range(len(p))) AS i, len(p) AS n FROM (SELECT qid, k, phrases[k] AS p FROM (SELECT qid, phrases, unnest(range(1, len(phrases) + 1)) AS k FROM asked))),
said AS (SELECT qid, doc_id, count(*) AS n FROM (SELECT DISTINCT qid, k, doc_id FROM (
  SELECT pt.qid, pt.k, x.doc_id, x.at - pt.i AS start, pt.i, pt.n FROM pt JOIN (SELECT term, doc_id, unnest(pos) AS at FROM hposts) x ON x.term = pt.term) GROUP BY qid, k, doc_id, start, n HAVING count(DISTINCT i) = n) GROUP BY qid, doc_id),
banned AS (SELECT DISTINCT qid, doc_id FROM (SELECT qid, unnest(excluded) AS term FROM asked) JOIN wposts USING (term)),
cand AS (SELECT a.qid, p.doc_id, count(*) FILTER (list_contains(a.required, p.term)) AS n_matched FROM asked a JOIN qt ON qt.qid = a.qid JOIN hposts p ON p.term = qt.term GROUP BY a.qid, p.doc_id),
kept AS (SELECT c.qid, c.doc_id, c.n_matched, a.required, a.terms, a.phrases FROM cand c JOIN asked a USING (qid) JOIN ldocs d ON d.id = c.doc_id LEFT JOIN said s ON s.qid = c.qid AND s.doc_id = c.doc_id
  WHERE (a.site IS NULL OR d.domain = a.site OR d.domain LIKE '%.' || a.site) AND coalesce(s.n, 0) = len(a.phrases) AND (c.qid, c.doc_id) NOT IN (SELECT (qid, doc_id) FROM banned)),
strict AS (SELECT *, greatest(1, ceil(0.6 * len(required) - 1e-9)) AS enough FROM kept),
pooled AS (SELECT * FROM (SELECT *, count(*) FILTER (n_matched >= enough) OVER (PARTITION BY qid) AS n_strict FROM strict) WHERE CASE WHEN n_strict < 5 THEN n_matched >= 1 ELSE n_matched >= enough END),
bm AS (SELECT o.qid, o.doc_id, sum(ln(1 + (s.n_docs - t.df + 0.5) / (t.df + 0.5)) * p.w / (p.w + 1.2 * (0.25 + 0.75 * d.len / s.avg_len))) AS bm25,
  min(p.pos[1]) FILTER (list_contains(o.required, p.term)) AS first_hit,
  list_sort(list(p.term) FILTER (list_contains(o.required, p.term))) AS matched, coalesce(list_sort(list(p.term) FILTER (list_contains(o.required, p.term) AND p.f0 > 0)), []) AS in_title,
  coalesce(list_sort(list(p.term) FILTER (list_contains(o.required, p.term) AND p.f0 = 0 AND p.f1 > 0)), []) AS in_description
  FROM pooled o JOIN qt ON qt.qid = o.qid JOIN hposts p ON p.term = qt.term AND p.doc_id = o.doc_id JOIN dict t ON t.term = p.term JOIN ldocs d ON d.id = o.doc_id CROSS JOIN stats s GROUP BY o.qid, o.doc_id),
qpairs AS (SELECT qid, i, terms[i] AS a, terms[i + 1] AS b FROM (SELECT qid, terms, unnest(range(1, len(terms))) AS i FROM asked)),
prox AS (SELECT o.qid, o.doc_id, count(x.i) * 1.0 / greatest(1, any_value(len(o.terms)) - 1) AS proximity, min(x.i) - 1 AS first_pair FROM pooled o LEFT JOIN (
  SELECT q.qid, q.i, pa.doc_id FROM qpairs q JOIN hposts pa ON pa.term = q.a JOIN hposts pb ON pb.term = q.b AND pb.doc_id = pa.doc_id WHERE list_has_any(list_transform(pa.pos, lambda v: v + 1), pb.pos)) x
  ON x.qid = o.qid AND x.doc_id = o.doc_id GROUP BY o.qid, o.doc_id),
"""
_FRESH = f"CASE WHEN fetched_at IS NULL THEN 1.0 ELSE 1 + 0.05 * exp(-greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(fetched_at)) / 86400000000.0 / 365) END"


def _with(asked: str, cap: int | None = 50_000) -> str:
    parts = POSTINGS.replace("wposts AS (", "wposts AS MATERIALIZED (").replace("stream AS (", "stream AS MATERIALIZED (").replace("live AS (", "live AS MATERIALIZED (", 1)
    heads = f"hposts AS MATERIALIZED (SELECT * FROM wposts{f' QUALIFY row_number() OVER (PARTITION BY term ORDER BY w DESC, doc_id) <= {cap}' if cap else ''})"
    return f"""WITH {asked}, {parts}, {heads}, {EDGES.replace('edges AS', 'edges AS MATERIALIZED')}, {PAGERANK},{_CORE}
full_ AS (SELECT b.*, x.proximity, x.first_pair, 1 + 0.35 * u.authority AS authority_factor, 1 + 0.2 * x.proximity AS proximity_factor, {_FRESH} AS fresh_factor, d.domain, d.fetched_at, o.required, o.phrases
  FROM bm b JOIN prox x USING (qid, doc_id) JOIN pooled o USING (qid, doc_id) JOIN ldocs d ON d.id = b.doc_id JOIN authority u ON u.doc_id = b.doc_id),
scored AS (SELECT *, bm25 * authority_factor * proximity_factor * fresh_factor AS score FROM full_),
shown AS (SELECT * REPLACE (round(score, 4) AS score) FROM scored),
capped AS (SELECT *, row_number() OVER (PARTITION BY qid, domain ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS nth FROM shown),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY nth > 3, score DESC, CAST(doc_id AS VARCHAR)) AS place, count(*) OVER (PARTITION BY qid) AS total FROM capped)
"""


_S = _with(_asked_sql())
_DAYS = f"((epoch_us(TIMESTAMP '{NOW}') - epoch_us(fetched_at)) / 86400000000.0)"
_CLASS = f"CASE WHEN fetched_at IS NULL THEN NULL WHEN {_DAYS} < 1 THEN 'today' WHEN {_DAYS} < 2 THEN 'yesterday' WHEN {_DAYS} < 60 THEN 'days' WHEN {_DAYS} < 365 THEN 'months' ELSE 'over_a_year' END"
_EARLY = "CASE WHEN first_hit <= 40 THEN 'opening' WHEN first_hit <= 120 THEN 'near_top' END"


def _page_sql(n: int) -> str:
    return _S + f"SELECT qid, CAST(place AS INTEGER) AS place, doc_id, score, total, CAST(greatest(1, ceil(total / 10.0)) AS BIGINT) AS total_pages FROM placed WHERE place BETWEEN {10 * n - 9} AND {10 * n}"


#: What the queries mean, written by hand: terms, needed terms, number of phrases, excluded terms, site.
_MEANT = (
    ("old lighthous", "old lighthous", 0, "", None),
    ("the ferry timetabl and the bread oven", "ferry timetabl bread oven", 0, "", None),
    ("river copper kettl", "river copper kettl", 1, "", None),
    ("telescop compas", "telescop compas", 0, "beehiv", None),
    ("night train sit exampl", "night train sit exampl", 0, "", None),
    ("what is the tid tabl", "tid tabl", 0, "", None),
    ("weather station weather map", "weather station map", 0, "", None),
    ("zzzunknown lighthous", "zzzunknown lighthous", 0, "", None),
    ("garden", "garden", 0, "", "nimviksol-ka0.example"),
)


_ONE = "WITH " + POSTINGS
_NEAR = "n AS (SELECT w.term, v.term AS near, v.display, levenshtein(w.term, v.term) AS distance, v.df FROM w JOIN dict v ON w.term[1] = v.term[1] AND abs(len(w.term) - len(v.term)) <= 2)"
_CLOSE = "distance <= CASE WHEN len(term) <= 6 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY term ORDER BY distance, df DESC, near) = 1"
_HAS = "SELECT DISTINCT doc_id FROM posts WHERE term = "
SQL = {
    "parsed_queries": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{r}', CAST({n} AS BIGINT), '{x}', {repr(site) if site else 'NULL'})" for i, (t, r, n, x, site) in enumerate(_MEANT)) + ") t(qid, terms, required, n_phrases, excluded, site)",
    "bm25_topk": _S + "SELECT qid, doc_id, round(bm25, 4) AS bm25 FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 4) DESC, CAST(doc_id AS VARCHAR)) <= 10",
    "bm25f_field_weighted": _S + "SELECT qid, doc_id, round(bm25, 4) AS bm25 FROM bm",
    "candidates_soft_and": _S + "SELECT qid, doc_id, n_matched FROM strict WHERE n_matched >= enough",
    "relaxed_pool": _S + "SELECT qid, doc_id FROM pooled",
    "phrase_search": _ONE + " SELECT a.doc_id FROM posts a JOIN posts b USING (doc_id) WHERE a.term = 'search' AND b.term = 'index' AND list_has_any(list_transform(a.pos, lambda v: v + 1), b.pos)",
    "exclude_term": _ONE + f" {_HAS}'lighthous' AND doc_id NOT IN ({_HAS}'telescop')",
    "site_filter": _ONE + f" {_HAS}'garden' AND doc_id IN (SELECT id FROM live WHERE domain = 'nimviksol-ka0.example' OR domain LIKE '%.nimviksol-ka0.example')",
    "proximity_factor": _S + "SELECT qid, doc_id, round(1 + 0.2 * proximity, 4) AS proximity_factor FROM prox",
    "freshness_factor": _ONE + f" SELECT id AS doc_id, round({_FRESH}, 6) AS fresh_factor FROM live",
    "full_score": _S + "SELECT qid, doc_id, score FROM shown",
    "domain_diversity": _S + "SELECT qid, CAST(place AS INTEGER) AS place, doc_id FROM placed",
    "search_page_1": _page_sql(1),
    "search_page_2": _page_sql(2),
    "suggest_prefix": _ONE + " SELECT display, df FROM (SELECT * FROM dict WHERE term LIKE 'li%' QUALIFY row_number() OVER (PARTITION BY display ORDER BY df DESC, term) = 1) ORDER BY df DESC, term LIMIT 8",
    "nearest_term": _ONE + f""", w AS (SELECT DISTINCT term FROM ({sql_stem(f"SELECT unnest({sql_words('q')}) AS word FROM searches")}) WHERE term NOT IN (SELECT term FROM dict)), {_NEAR}
      SELECT term, near, distance, df FROM n WHERE {_CLOSE}""",
    "batch_search_topk": _with(_BATCH, None) + "SELECT search_id, CAST(place AS INTEGER) AS place, doc_id, score FROM placed JOIN nq USING (qid) JOIN sq USING (q) WHERE place <= 10",
    "search_capped": _with(_asked_sql(), SMALL_CAP) + "SELECT qid, doc_id, score FROM shown",
    "search_limited": _S + f"SELECT qid, term, df FROM qt JOIN dict USING (term) WHERE df >= {SMALL_CAP}",
    "explain_coverage": _S + "SELECT qid, doc_id, array_to_string(matched, ' ') AS matched, array_to_string(list_sort(list_filter(required, lambda x: NOT list_contains(matched, x))), ' ') AS missing, array_to_string(in_title, ' ') AS in_title FROM full_",
    "explain_reason_codes": _S + f"""SELECT qid, doc_id, array_to_string(list_filter([
      CASE WHEN len(matched) = len(required) THEN CASE WHEN len(required) = 1 THEN 'matches_word()' ELSE 'matches_all()' END
        ELSE 'matches_some(' || array_to_string(list_filter(required, lambda x: NOT list_contains(matched, x)), '|') || ')' END,
      CASE WHEN len(in_title) > 0 THEN 'in_title(' || array_to_string(in_title[1:3], '|') || ')' WHEN len(in_description) > 0 THEN 'in_description(' || array_to_string(in_description[1:3], '|') || ')' END,
      CASE WHEN len(f.phrases) > 0 THEN 'phrase(' || array_to_string(list_transform(f.phrases, lambda p: array_to_string(p, ' ')), '|') || ')' END, 'site(' || a.site || ')',
      CASE WHEN len(a.excluded) > 0 THEN 'excluded(' || array_to_string(a.excluded, '|') || ')' END,
      CASE WHEN first_pair IS NOT NULL AND len(f.phrases) = 0 THEN 'adjacent(' || CAST(first_pair AS BIGINT) || ')' END, CASE WHEN len(in_title) = 0 THEN {_EARLY} || '()' END,
      'inlinks(' || i.n || ')', {_CLASS} || '()'], lambda x: x IS NOT NULL), ' ') AS codes
      FROM full_ f JOIN (SELECT qid, site, excluded FROM asked) a USING (qid) LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = doc_id""",
    "correct_query": _ONE + f""", c0 AS (SELECT DISTINCT q FROM searches WHERE trim(q) <> ''),
      c1 AS (SELECT q, regexp_replace(q, '{_PH}', ' ', 'g') AS q1 FROM c0), c2 AS (SELECT q, regexp_replace(q1, '{_SITE}', ' ', 'g') AS q2 FROM c1), c3 AS (SELECT q, regexp_replace(q2, '{_EX}', ' ', 'g') AS q3 FROM c2),
      cf AS (SELECT * FROM (SELECT q, trim(regexp_replace(regexp_replace(q3, '["“”]', ' ', 'g'), '\\s+', ' ', 'g')) AS free FROM c3) WHERE free <> '' AND contains(q, free)),
      ct AS ({sql_stem(f"SELECT q, free, k, typed, {sql_words('typed')}[1] AS word FROM (SELECT q, free, unnest(string_split(free, ' ')) AS typed, generate_subscripts(string_split(free, ' '), 1) AS k FROM cf)")}),
      w AS (SELECT DISTINCT term FROM ct WHERE term IS NOT NULL AND term NOT IN (SELECT term FROM dict)), {_NEAR},
      near AS (SELECT term, display FROM n WHERE {_CLOSE}),
      fx AS (SELECT q, free, string_agg(coalesce(display, typed), ' ' ORDER BY k) AS text, count(display) AS n FROM ct LEFT JOIN near USING (term) GROUP BY q, free)
      SELECT q, trim(left(q, instr(q, free) - 1) || text || substr(q, instr(q, free) + length(free))) AS corrected FROM fx WHERE n > 0 AND lower(corrected) <> lower(trim(q))""",
    "snippet_window": _S + """, pg AS (SELECT qid, place, doc_id FROM placed WHERE place <= 10),
      src AS (SELECT pg.*, (SELECT list_distinct(terms) FROM asked a WHERE a.qid = pg.qid) AS ts, left(coalesce(description, ''), 500) AS ds, left(coalesce(text, ''), 6000) AS tx FROM pg JOIN live ON live.id = doc_id),
      cl AS (SELECT *, trim(regexp_replace(CASE WHEN length(trim(ds)) > 40 THEN trim(ds) || ' — ' || tx WHEN tx <> '' THEN tx ELSE trim(ds) END, '[\\s\\x{a0}]+', ' ', 'g')) AS clean FROM src),
      parts AS (SELECT qid, place, doc_id, term, unnest(string_split(low, term)) AS part, generate_subscripts(string_split(low, term), 1) AS k, len(string_split(low, term)) AS n
        FROM (SELECT qid, place, doc_id, lower(clean) AS low, unnest(ts) AS term FROM cl) WHERE length(term) >= 2),
      offs AS (SELECT qid, place, doc_id, term, k, n, CAST(sum(length(part)) OVER (PARTITION BY qid, doc_id, term ORDER BY k) AS BIGINT) + (k - 1) * length(term) AS p FROM parts),
      hits AS (SELECT qid, doc_id, list(DISTINCT p) AS hs, list(p) AS every FROM offs WHERE k < n GROUP BY qid, doc_id),
      best AS (SELECT qid, doc_id, list_sort(list_transform(hs, lambda p: {'n': -len(list_filter(every, lambda q: q >= p AND q < p + 220)), 'p': p}))[1] AS b FROM hits),
      st AS (SELECT cl.*, greatest(0, b.p - 40) AS start FROM cl LEFT JOIN best USING (qid, doc_id)),
      sn AS (SELECT *, CASE WHEN start > 0 AND instr(substr(clean, start + 1, 30), ' ') > 0 THEN start + instr(substr(clean, start + 1, 30), ' ') ELSE start END AS begins FROM st)
      SELECT qid, CAST(place AS INTEGER) AS place, doc_id, CASE WHEN length(clean) <= 220 THEN clean WHEN start IS NULL THEN rtrim(left(clean, 219)) || '…'
        ELSE CASE WHEN begins > 0 THEN '…' ELSE '' END || rtrim(substr(clean, begins + 1, 220)) || CASE WHEN begins + 220 < length(clean) THEN '…' ELSE '' END END AS snippet FROM sn""",
    "early_hit_bucket": _S + f"SELECT qid, doc_id, {_EARLY} AS early FROM bm",
    "freshness_bucket": _ONE + f" SELECT id AS doc_id, {_CLASS} AS class FROM live",
    "score_factors": _S + "SELECT qid, doc_id, round(authority_factor, 3) AS authority_factor, round(proximity_factor, 3) AS proximity_factor, round(fresh_factor, 3) AS fresh_factor FROM full_",
    "ranking_manifest": "SELECT * FROM (VALUES " + ", ".join(f"('signal', '{i}', '{x}')" for i, x in explain.SIGNALS) + ", " + ", ".join(f"('excluded', '{x}', 'never an input')" for x in explain.EXCLUDED_SIGNALS) + ") t(kind, id, description)",
}
