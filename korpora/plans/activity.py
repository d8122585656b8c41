"""Queries on the search history and related tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpora.operators import activity, robots
from korpora.plans.corpus import LIVE, NOW, index, now, sql_url
from korpora.sources.tables import table
from korpora.streaming import jobs

FAIR_LIMIT = 5


def _searches(spark: SparkSession, d: str) -> DataFrame:
    return activity.delivered_once(table(spark, d, "searches"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return activity.collapse_history(_searches(spark, d))


def searches_once(spark: SparkSession, d: str) -> DataFrame:
    return _searches(spark, d).select("search_id", "owner", "q", "searched_at")


def history_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d)


def history_recent_capped(spark: SparkSession, d: str) -> DataFrame:
    return activity.recent_history(_entries(spark, d), now()).select("owner", "q", "last_at", F.col("nth").cast("bigint").alias("nth"))


def history_retention(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where(F.col("last_at") >= now() - F.expr("INTERVAL 90 DAYS")).groupBy("owner").agg(F.count("*").alias("n"))


def history_merge_owners(spark: SparkSession, d: str) -> DataFrame:
    return activity.merge_owners(_entries(spark, d), "anon", "u00017").groupBy("owner").agg(F.count("*").alias("n"), F.max("last_at").alias("last_at"))


def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return activity.usage_daily(_searches(spark, d))


def usage_retention(spark: SparkSession, d: str) -> DataFrame:
    return activity.retention(activity.usage_daily(_searches(spark, d)), F.to_date(F.lit("2026-07-20")))


def fair_use_refusals(spark: SparkSession, d: str) -> DataFrame:
    return activity.fair_use_refusals(_searches(spark, d), FAIR_LIMIT).select("search_id", "owner", "day", F.col("nth").cast("bigint").alias("nth"))


def cooldown_decisions(spark: SparkSession, d: str) -> DataFrame:
    return activity.cooldown_runs(_searches(spark, d))


def thin_result_queries(spark: SparkSession, d: str) -> DataFrame:
    return activity.thin_searches(_searches(spark, d)).groupBy("q").agg(F.count("*").alias("n"))


#: Patches of settings, answers of providers, robots files and statuses made of the tables' rows, the same text for both engines.
PATCH = """CASE pmod(search_id, 5) WHEN 0 THEN 'resultsPerPage' WHEN 1 THEN 'theme' WHEN 2 THEN 'saveHistory' WHEN 3 THEN 'suggestions' ELSE 'constructor' END AS key,
  CASE pmod(search_id, 5) WHEN 0 THEN CAST(pmod(total, 70) AS VARCHAR(9)) WHEN 1 THEN CASE pmod(search_id, 4) WHEN 0 THEN 'dark' WHEN 1 THEN 'light' WHEN 2 THEN 'blue' ELSE 'system' END
    ELSE CASE pmod(search_id, 3) WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'TRUE' END END AS value"""
ROBOTS = """CASE pmod(length(domain), 3)
  WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /a', chr(10), 'Allow: /ab # more', chr(10), 'Disallow: /*1$', chr(10), 'Crawl-delay: 2')
  WHEN 1 THEN concat('User-agent: Some', chr(10), 'User-agent: other', chr(13), chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow:')
  ELSE concat('# all', chr(10), 'user-agent: KORPORA', chr(10), 'DISALLOW: /*o*e', chr(10), 'allow: /', chr(10), 'User-agent: *', chr(10), 'Disallow: /') END"""
ANSWER_COLUMNS = ["pmod(k + search_id, 3) AS priority", "pmod(search_id + 2 * k, 5) <> 0 AS ok", "coalesce(pmod(total, k + 2), 0) AS n"]
STATUS = "CASE pmod(id, 7) WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 301 WHEN 3 THEN 404 WHEN 4 THEN 500 WHEN 5 THEN 503 END"


def settings_effective(spark: SparkSession, d: str) -> DataFrame:
    patches = _searches(spark, d).where("owner IS NOT NULL").selectExpr("owner", "search_id AS at", *[f"{x} AS {n}" for x, n in _parts(PATCH)])
    return activity.effective_settings(patches)


def _parts(text: str) -> list[tuple[str, str]]:
    """The two columns of PATCH."""
    key, value = text.split(" AS key,")
    return [(key, "key"), (value.rsplit(" AS value", 1)[0], "value")]


def provider_failover(spark: SparkSession, d: str) -> DataFrame:
    rows = _searches(spark, d).select("search_id", "total", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    return activity.provider_choice(rows.selectExpr("search_id AS request", "concat('p', k) AS provider", *ANSWER_COLUMNS))


def provider_last_good(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "searches").groupBy("search_id").agg(F.max("total").alias("total")).select("search_id", "total", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    answers = rows.selectExpr("search_id AS request", "search_id AS at", "concat('p', k) AS provider", *ANSWER_COLUMNS)
    return activity.failover(answers, "wide").select("request", "provider")


def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").where("domain IS NOT NULL AND url IS NOT NULL")
    rules = robots.choose_group(robots.parse(docs.select(F.col("domain").alias("origin")).distinct().withColumn("text", F.expr(ROBOTS.replace("domain", "origin")))), "korporabot/1.0")
    paths = docs.select(F.col("domain").alias("origin"), F.regexp_extract("url", "^https?://[^/]+(.*)$", 1).alias("path")).distinct()
    return robots.allowed(paths, rules)


def fetch_policies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("id", robots.fetch_policy(F.expr(STATUS)).alias("policy"))


def fresh_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = index(spark, d).docs
    return activity.fresh_candidates(docs.select(F.explode("links").alias("url")), docs)


def stream_daily_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.read_table(spark, f"{d}/searches.parquet")
    return jobs.run_to_table(jobs.daily_usage(rows, "400 days"), "usage")


def stream_session_history(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_to_table(jobs.search_sessions(jobs.read_table(spark, f"{d}/searches.parquet"), late="400 days"), "sessions")


def stream_dedupe_urls(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_to_table(jobs.distinct_urls(jobs.read_table(spark, f"{d}/docs.parquet"), "9999 days"), "urls", "append")


QUERIES = {
    f.__name__: f
    for f in (
        searches_once, history_collapsed, history_recent_capped, history_retention, history_merge_owners, usage_daily, usage_retention,
        fair_use_refusals, cooldown_decisions, thin_result_queries, settings_effective, provider_failover, provider_last_good, robots_allowed, fetch_policies,
        fresh_candidates, stream_daily_usage, stream_session_history, stream_dedupe_urls,
    )
}



def _sql_mod(text: str) -> str:
    """The same expression for DuckDB, whose modulo of what is not negative is that of Spark."""
    return re.sub(r"pmod\(([^,()]+), ([^()]+?)\)", r"((\1) % (\2))", text)


_ONCE = "WITH once AS (SELECT DISTINCT * FROM searches)"
_RUNS = (
    _ONCE
    + """, m AS (SELECT *, CASE WHEN q IS DISTINCT FROM lag(q) OVER o OR row_number() OVER o = 1 THEN 1 ELSE 0 END AS new FROM once WHERE owner IS NOT NULL WINDOW o AS (PARTITION BY owner ORDER BY searched_at, search_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY owner ORDER BY searched_at, search_id) AS run FROM m),
entries AS (SELECT owner, q, min(searched_at) AS first_at, max(searched_at) AS last_at, CAST(sum(n) AS BIGINT) AS times, arg_max_null(total, (searched_at, search_id)) AS total FROM r GROUP BY owner, run, q)"""
)
_ORDER = "ORDER BY last_at DESC, first_at DESC, q"
SQL = {
    "searches_once": _ONCE + " SELECT search_id, owner, q, searched_at FROM once",
    "history_collapsed": _RUNS + " SELECT owner, q, first_at, last_at, times, total FROM entries",
    "history_recent_capped": _RUNS + f" SELECT owner, q, last_at, row_number() OVER (PARTITION BY owner {_ORDER}) AS nth FROM entries WHERE last_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY QUALIFY nth <= 200",
    "history_retention": _RUNS + f" SELECT owner, count(*) AS n FROM entries WHERE last_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY GROUP BY owner",
    "history_merge_owners": _RUNS + f""", moved AS (SELECT * REPLACE ('u00017' AS owner) FROM entries WHERE owner IN ('anon', 'u00017') QUALIFY row_number() OVER ({_ORDER}) <= 200)
      SELECT owner, count(*) AS n, max(last_at) AS last_at FROM (SELECT * FROM entries WHERE owner NOT IN ('anon', 'u00017') UNION ALL SELECT * FROM moved) GROUP BY owner""",
    "usage_daily": _ONCE + " SELECT CAST(searched_at AS DATE) AS day, owner, count(*) AS used FROM once WHERE owner IS NOT NULL AND searched_at IS NOT NULL GROUP BY day, owner",
    "usage_retention": _ONCE + " SELECT CAST(searched_at AS DATE) AS day, owner, count(*) AS used FROM once WHERE owner IS NOT NULL AND CAST(searched_at AS DATE) >= DATE '2026-07-13' GROUP BY day, owner",
    "fair_use_refusals": _ONCE + f" SELECT search_id, owner, CAST(searched_at AS DATE) AS day, row_number() OVER (PARTITION BY owner, CAST(searched_at AS DATE) ORDER BY searched_at, search_id) AS nth FROM once WHERE owner IS NOT NULL QUALIFY nth > {FAIR_LIMIT}",
    "cooldown_decisions": """WITH RECURSIVE a AS (SELECT DISTINCT lower(trim(q)) AS q, searched_at AS t FROM searches WHERE trim(q) <> '' AND searched_at IS NOT NULL),
      runs(q, run_at) AS (SELECT q, min(t) FROM a GROUP BY q UNION ALL SELECT r.q, (SELECT min(x.t) FROM a x WHERE x.q = r.q AND x.t >= r.run_at + INTERVAL 6 HOUR) FROM runs r WHERE r.run_at IS NOT NULL)
      SELECT q, run_at FROM runs WHERE run_at IS NOT NULL""",
    "thin_result_queries": _ONCE + " SELECT q, count(*) AS n FROM once WHERE total < 3 GROUP BY q",
    "settings_effective": f"""{_ONCE}, p AS (SELECT owner, search_id AS nth, {_sql_mod(PATCH)} FROM once WHERE owner IS NOT NULL),
      e AS (SELECT *, CASE WHEN key = 'constructor' THEN 'unknown_setting' WHEN NOT coalesce(CASE key WHEN 'resultsPerPage' THEN try_cast(value AS INT) BETWEEN 5 AND 50 WHEN 'theme' THEN value IN ('system', 'light', 'dark')
        ELSE value IN ('true', 'false') END, false) THEN 'invalid_setting_value' END AS error FROM p),
      d(key, fallback) AS (VALUES ('resultsPerPage', '10'), ('openInNewTab', 'false'), ('autoExpandWhy', 'false'), ('suggestions', 'true'), ('saveHistory', 'true'), ('theme', 'system')),
      l AS (SELECT owner, key, arg_max(value, nth) AS value FROM e WHERE error IS NULL GROUP BY owner, key)
      SELECT o.owner, d.key, coalesce(l.value, d.fallback) AS value, NULL::VARCHAR AS error FROM (SELECT DISTINCT owner FROM p) o CROSS JOIN d LEFT JOIN l ON l.owner = o.owner AND l.key = d.key
      UNION ALL SELECT owner, key, value, error FROM e WHERE error IS NOT NULL""",
    "provider_failover": f"""{_ONCE}, r AS (SELECT search_id AS request, 'p' || k AS provider, {_sql_mod(', '.join(ANSWER_COLUMNS))} FROM (SELECT *, unnest([0, 1, 2]) AS k FROM once))
      SELECT request, arg_min(provider, priority) AS provider FROM r WHERE ok AND n > 0 GROUP BY request""",
    "provider_last_good": f"""WITH RECURSIVE s AS (SELECT search_id, max(total) AS total FROM searches GROUP BY search_id),
      r AS (SELECT search_id AS request, 'p' || k AS provider, {_sql_mod(', '.join(ANSWER_COLUMNS))} FROM (SELECT *, unnest([0, 1, 2]) AS k FROM s)),
      a AS (SELECT request, row_number() OVER (ORDER BY request) AS nth, arg_min(provider, priority) FILTER (ok AND n > 0) AS best, list(provider) FILTER (ok AND n > 0) AS good FROM r GROUP BY request),
      w(nth, instance) AS (SELECT CAST(0 AS BIGINT), NULL::VARCHAR UNION ALL SELECT a.nth, CASE WHEN a.best IS NULL OR list_contains(a.good, instance) THEN instance ELSE a.best END FROM w JOIN a ON a.nth = w.nth + 1)
      SELECT request, CASE WHEN best IS NULL THEN 'wide' ELSE instance END AS provider FROM a JOIN w USING (nth)""",
    "robots_allowed": r"""WITH p AS (SELECT DISTINCT domain AS origin, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS path FROM docs WHERE domain IS NOT NULL AND url IS NOT NULL)
      SELECT origin, path, CASE length(origin) % 3 WHEN 0 THEN starts_with(path, '/ab') OR NOT (starts_with(path, '/a') OR (path LIKE '/%1')) AND true WHEN 1 THEN true ELSE NOT regexp_matches(path, '^/.*o.*e') END AS allowed FROM p""",
    "fresh_candidates": f"WITH {LIVE} SELECT DISTINCT u AS url FROM (SELECT unnest(list_transform(links, lambda x: {sql_url('x')})) AS u FROM live) WHERE u IS NOT NULL AND u NOT IN (SELECT url FROM live)",
    "fetch_policies": f"SELECT id, CASE WHEN s BETWEEN 200 AND 299 THEN 'parse' WHEN s >= 500 THEN 'deny_all' ELSE 'allow_all' END AS policy FROM (SELECT id, {_sql_mod(STATUS)} AS s FROM docs)",
    "stream_daily_usage": "SELECT CAST(searched_at AS DATE) AS day, owner, count(*) AS used FROM searches WHERE owner IS NOT NULL AND searched_at IS NOT NULL GROUP BY day, owner",
    "stream_dedupe_urls": f"WITH {LIVE} SELECT url FROM live",
    "stream_session_history": """WITH t AS (SELECT owner, searched_at AS t, CASE WHEN searched_at - lag(searched_at) OVER o < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM searches WHERE owner IS NOT NULL AND searched_at IS NOT NULL WINDOW o AS (PARTITION BY owner ORDER BY searched_at)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY owner ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM t)
      SELECT owner, min(t) AS started_at, max(t) + INTERVAL 30 MINUTE AS ended_at, count(*) AS searches FROM s GROUP BY owner, k""",
}
