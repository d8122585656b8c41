"""Queries of the operators on training text, and SQL where it can express them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpora.llm import boilerplate, distinctive, encode, forms, language, lines, packing, splitting, truncation
from korpora.session import materialize
from korpora.sources.tables import table


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_languages(table(spark, sf_dir, "docs"), table(spark, sf_dir, "lang_samples"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_issues(materialize(p2_pages(spark, sf_dir), "languages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture(table(spark, sf_dir, "docs"))


def p3_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_content(table(spark, sf_dir, "docs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "docs")).select("id", "line_no")


def p4_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, sf_dir, "docs"))


def p4_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.tested_lines(table(spark, sf_dir, "docs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "docs")).select("id", "field").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "docs"))


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.consistent_forms(*(table(spark, sf_dir, t) for t in ("docs", "terms", "lang_samples")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_forms(spark, sf_dir).where("size(issues) > 0").select("place", "shard", "row_key").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = F.expr("w >= 6 AND df_shard BETWEEN 2 AND 6")
    return distinctive.characteristic_terms(table(spark, sf_dir, "postings"), table(spark, sf_dir, "docs"), heavy).select("doc_id", "term")


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = distinctive.term_scores(table(spark, sf_dir, "postings"), table(spark, sf_dir, "docs"))
    return scores.withColumn("score", F.round("score", 6))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(encode.token_counts(table(spark, sf_dir, "documents")), "sizes")
    return packing.pack(sizes, table(spark, sf_dir, "size_profiles"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir), table(spark, sf_dir, "size_profiles"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(table(spark, sf_dir, "documents"), table(spark, sf_dir, "size_profiles"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pages, p3_found, p3_articles, p4_found, p4_clean_pages, p4_excess, p5_found, p5_rates, p6_found, p6_forms, p7_found, p7_scores, p8_ids, p9_containers, p9_fill, p10_pieces)}



# Ranges with compatibility forms of letters.
_RANGES = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2070, 0x2190), (0x2460, 0x24FF), (0xFB00, 0xFB07), (0xFF00, 0xFFEF), (0x1D400, 0x1D800))


def _sql_nfkc(text: str) -> str:
    """NFKC for DuckDB, which has NFC: single compatibility forms by table, the few longer ones with letters one by one."""
    one, to, longer = [], [], []
    for a, b in _RANGES:
        for c in map(chr, range(a, b)):
            form = unicodedata.normalize("NFKC", c)
            if form != c and len(form) == 1 and form != "'":
                one.append(c)
                to.append(form)
            elif form != c and c in "ﬀﬁﬂﬃﬄﬅﬆĲĳŉǄǅǆǇǈǉǊǋǌǱǲǳ№℡™":
                longer.append((c, form.replace("'", "")))
    out = f"translate({text}, '{''.join(one)}', '{''.join(to)}')"
    for c, form in longer:
        out = f"replace({out}, '{c}', '{form}')"
    return f"nfc_normalize({out})"


_LINES = f"""
WITH l AS (SELECT id, domain, shard, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT id, domain, shard, string_split({_sql_nfkc("text")}, chr(10)) AS ls FROM docs)),
k AS (SELECT id, coalesce(domain, '') AS domain, coalesce(shard, -1) AS shard, line_no, regexp_replace(lower(line), '\\P{{L}}+', '', 'g') AS key FROM l),
n AS (SELECT coalesce(domain, '') AS domain, coalesce(shard, -1) AS shard, count(*) AS pages FROM docs GROUP BY 1, 2),
c AS (SELECT domain, shard, key, count(DISTINCT id) AS on_pages FROM k WHERE key <> '' GROUP BY ALL),
found AS (SELECT id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN c USING (domain, shard, key) JOIN n USING (domain, shard) WHERE on_pages >= 4 AND on_pages >= 0.05 * pages)"""

SQL = {
    "p4_found": _LINES + " SELECT id, line_no FROM found",
    "p4_clean_pages": _LINES + """, gone AS (SELECT id, list(line_no) AS nos FROM found GROUP BY id), raw AS (SELECT id, text, string_split(text, chr(10)) AS ls FROM docs)
SELECT id, CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(nos, CAST(i AS INTEGER))), chr(10)) END AS text FROM raw LEFT JOIN gone USING (id)""",
    "p7_scores": """
WITH live AS (SELECT DISTINCT shard, doc_id, term, w, coalesce(f0, 0) + coalesce(f1, 0) + coalesce(f2, 0) AS f, pos FROM postings WHERE doc_id <> 0 AND term <> ''),
tok AS (SELECT DISTINCT shard, doc_id, term, unnest(pos) AS at FROM live),
near AS (SELECT a.shard, a.doc_id, a.term, b.term AS other FROM tok a JOIN (SELECT *, unnest([1, 2, 3]) AS k FROM tok) b ON a.shard = b.shard AND a.doc_id = b.doc_id AND a.at = b.at - b.k WHERE a.term <> b.term),
edges AS (SELECT shard, doc_id, term, other FROM near UNION SELECT shard, doc_id, other, term FROM near),
deg AS (SELECT shard, doc_id, term, count(*) AS degree FROM edges GROUP BY ALL),
len AS (SELECT shard, doc_id, sum(f) AS page_len FROM live GROUP BY ALL),
ds AS (SELECT shard, term, count(*) AS df_shard FROM live GROUP BY ALL),
dt AS (SELECT term, count(*) AS df FROM live GROUP BY term),
c AS (SELECT count(DISTINCT id) AS pages, avg(len) FILTER (len > 0) AS mean FROM docs)
SELECT shard, doc_id, term, w, coalesce(degree, 0) AS degree, df_shard, df, round(coalesce(degree, 0) / (1 - 0.003 + 0.003 * page_len / mean) * ln((pages + 1) / df), 6) AS score
FROM live LEFT JOIN deg USING (shard, doc_id, term) JOIN len USING (shard, doc_id) JOIN ds USING (shard, term) JOIN dt USING (term) CROSS JOIN c""",
    "p7_found": """
WITH live AS (SELECT DISTINCT shard, doc_id, term, w FROM postings WHERE doc_id <> 0 AND term <> ''),
df AS (SELECT shard, term, count(DISTINCT doc_id) AS n FROM live GROUP BY shard, term)
SELECT DISTINCT doc_id, term FROM live JOIN df USING (shard, term) WHERE w >= 6 AND n BETWEEN 2 AND 6""",
}
