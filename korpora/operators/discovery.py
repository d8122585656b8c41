"""Growing an index from discovered URLs: which are new, when a polite fetcher gets to them, what they add."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpora.functions.urls import domain, normalize_url
from korpora.operators import index as ix
from korpora.operators import maintenance
from korpora.session import materialize

# Pause between two requests to a host, and time for all of them, in milliseconds.
HOST_GAP, BUDGET = 300, 2500

#: Requests of a host that one task orders.
SLICE_ROWS = 100_000


def fetch_schedule(requests: DataFrame, gap: int = HOST_GAP, budget: int | None = BUDGET) -> DataFrame:
    """(url, host, at, starts, ends, outcome) of requests (url, at, ms) to many hosts at once.

    Hosts are asked side by side, each in the order of ``at`` and one request at
    a time, ``gap`` milliseconds from start to start at least. What would not
    have ended within the ``budget`` is 'remaining', all else is 'fetched';
    without a budget nothing remains. A null ``ms`` counts 0, URLs without a host
    are left out. A busy host is ordered in slices of ``at``.
    """
    rows = requests.select("url", domain(F.col("url")).alias("host"), F.col("at").cast("long").alias("at"), F.coalesce(F.col("ms").cast("long"), F.lit(0)).alias("ms")).where("host IS NOT NULL")
    rows = rows.withColumn("_slice", F.floor(F.col("at") / SLICE_ROWS)).withColumn("_busy", F.greatest("ms", F.lit(gap)))
    slices = rows.groupBy("host", "_slice").agg(F.sum("_busy").alias("_busy"))
    earlier = W.partitionBy("host").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    ahead = slices.select("host", "_slice", F.coalesce(F.sum("_busy").over(earlier), F.lit(0)).alias("_ahead"))
    before = W.partitionBy("host", "_slice").orderBy("at", "url").rowsBetween(W.unboundedPreceding, -1)
    starts = F.col("_ahead") + F.coalesce(F.sum("_busy").over(before), F.lit(0))
    timed = rows.join(ahead, ["host", "_slice"]).withColumn("starts", starts).withColumn("ends", F.col("starts") + F.col("ms"))
    late = F.lit(False) if budget is None else F.col("ends") > budget
    return timed.select("url", "host", "at", "starts", "ends", F.when(late, "remaining").otherwise("fetched").alias("outcome"))


@dataclass
class Expansion:
    """An index after discovery, and what became of each discovered URL (url, outcome)."""

    index: ix.Index
    outcomes: DataFrame


def expand(current: ix.Index, found: DataFrame, stored: DataFrame, gap: int = HOST_GAP, budget: int | None = BUDGET) -> Expansion:
    """The index with the pages of discovered URLs (url, at) that it does not hold yet.

    ``stored`` is the web as fetched: (url, ms, error, noindex, id, title,
    description, text, links, lang, fetched_at). Outcomes are 'known' (indexed
    before), 'remaining' (past the budget), 'error' (not stored, or its fetch
    failed), 'skipped' (noindex or thin) and 'indexed'. Authority is not
    computed anew.
    """
    asked = found.select(normalize_url(F.col("url")).alias("url"), "at").where("url IS NOT NULL").groupBy("url").agg(F.min("at").alias("at"))
    known = asked.join(current.docs.select("url"), "url", "left_semi").select("url", F.lit("known").alias("outcome"))
    fresh = asked.join(current.docs.select("url"), "url", "left_anti")
    pages = stored.withColumn("url", normalize_url(F.col("url"))).dropDuplicates(["url"])
    tried = fresh.join(pages, "url", "left")
    times = fetch_schedule(tried.select("url", "at", "ms"), gap, budget).select("url", F.col("outcome").alias("reached"))
    told = maintenance.crawl_outcome(F.col("title"), F.col("text"), F.col("noindex"), F.coalesce("error", F.lit(False)) | F.col("id").isNull())
    judged = materialize(tried.join(times, "url").withColumn("outcome", F.when(F.col("reached") == "remaining", "remaining").otherwise(told)), "discovered")
    grown = maintenance.upsert(current, judged.where("outcome = 'indexed'").select("id", "url", "title", "description", "text", "links", "lang", "fetched_at"))
    return Expansion(grown, judged.select("url", "outcome").unionByName(known))
