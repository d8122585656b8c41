"""Queries on keeping an index current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpora.operators import index as ix
from korpora.operators import maintenance, rank
from korpora.plans.corpus import LIVE, POSTINGS, index, now, sql_postings
from korpora.plans.corpus import authority as authority_of
from korpora.plans.search import _S, _asked
from korpora.sources.tables import table


def _grown(spark: SparkSession, d: str) -> ix.Index:
    """Pages of even ids first, those of odd ids added: what building the index at once gives."""
    latest = ix.latest_by_url(table(spark, d, "docs"))
    first = ix.build_index(latest.where("pmod(id, 2) = 0"))
    return maintenance.upsert(first, latest.where("pmod(id, 2) = 1"))


def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    return _grown(spark, d).postings.select("term", "doc_id", "w", F.array_join("pos", ",").alias("positions"))


def upsert_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _grown(spark, d).terms.select("term", "df")


def compacted(spark: SparkSession, d: str) -> DataFrame:
    """Postings after pages were crawled again, others removed, and the tables written anew."""
    docs = ix.latest_by_url(table(spark, d, "docs"))
    again = docs.where("pmod(id, 3) = 0").withColumn("title", F.lit("crawled again")).withColumn("id", F.col("id") + 10_000_000)
    index = maintenance.upsert(ix.build_index(docs), again)
    return maintenance.compact(maintenance.remove(index, docs.where("pmod(id, 3) = 1").select("url"))).postings.select("term", "doc_id", "w")


def crawl_stats(spark: SparkSession, d: str) -> DataFrame:
    outcome = maintenance.crawl_outcome(F.col("title"), F.col("text"), F.pmod("id", F.lit(7)) == 0, F.col("url").isNull()).alias("outcome")
    return table(spark, d, "docs").groupBy(outcome).agg(F.count("*").alias("n"))


def weak_answers(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark)
    return maintenance.weak_answers(rank.score(asked, index(spark, d), authority_of(spark, d), now()), asked)


def owner_keys(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("owner")
    mail = F.concat(o, F.when(F.length(o) > 4, "@mail.example").otherwise(" @x"))
    return table(spark, d, "searches").where("owner IS NOT NULL").select(
        "owner", maintenance.hash_key(o).alias("hash"), maintenance.clean_name(F.concat(F.lit("<b>"), o, F.lit("</b>   x"))).alias("name"), maintenance.is_email(mail).alias("is_email")
    ).distinct()


QUERIES = {f.__name__: f for f in (upsert_documents, upsert_dictionary, compacted, crawl_stats, weak_answers, owner_keys)}

SQL = {
    "upsert_documents": f"WITH {POSTINGS} SELECT term, doc_id, CAST(w AS DOUBLE) AS w, array_to_string(pos, ',') AS positions FROM wposts",
    "upsert_dictionary": f"WITH {POSTINGS} SELECT term, df FROM dict",
    "compacted": f"""WITH {LIVE}, again AS (SELECT id + CASE WHEN id % 3 = 0 THEN 10000000 ELSE 0 END AS id, CASE WHEN id % 3 = 0 THEN 'crawled again' ELSE title END AS title, description, text FROM live WHERE id % 3 <> 1),
      {sql_postings('again')} SELECT term, doc_id, CAST(w AS DOUBLE) AS w FROM wposts""",
    "crawl_stats": "SELECT CASE WHEN url IS NULL THEN 'error' WHEN id % 7 = 0 OR (coalesce(title, '') = '' AND length(coalesce(text, '')) < 80) THEN 'skipped' ELSE 'indexed' END AS outcome, count(*) AS n FROM docs GROUP BY outcome",
    "weak_answers": _S + """, best AS (SELECT qid, count(*) AS total, arg_max(len(matched) * 1.0 / len(required), (score, -doc_id)) AS coverage FROM scored GROUP BY qid)
      SELECT qid FROM asked LEFT JOIN best USING (qid) WHERE total IS NULL OR total < 3 OR coverage < 0.6""",
    "owner_keys": "SELECT DISTINCT owner, sha256(owner) AS hash, left('b' || owner || '/b x', 60) AS name, length(owner) > 4 AS is_email FROM searches WHERE owner IS NOT NULL",
}
