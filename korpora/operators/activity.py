"""Search history, usage limits, cooldowns, settings and providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpora.session import materialize

# Limits.
HISTORY_CAP, RETENTION_DAYS, LIST_DEFAULT = 200, 90, 20
USAGE_DAYS, FAIR_USE = 7, 2000
COOLDOWN_HOURS = 6
THIN_TOTAL = 3

#: Requests that one task puts in order.
SLICE = 100_000
# Settings and their defaults.
DEFAULT_SETTINGS = {"resultsPerPage": "10", "openInNewTab": "false", "autoExpandWhy": "false", "suggestions": "true", "saveHistory": "true", "theme": "system"}


def delivered_once(searches: DataFrame) -> DataFrame:
    """Searches without the rows that were delivered twice."""
    return searches.dropDuplicates()


def collapse_history(searches: DataFrame) -> DataFrame:
    """(owner, q, first_at, last_at, times, total): searches of an owner that repeat in a row are one entry.

    ``total`` is that of the last search; order is (searched_at, search_id).
    Rows of a null owner belong to no history. A busy owner is cut into days:
    runs are numbered within a day and offset by the runs of the days before, so
    no task holds all of an owner's searches.
    """
    rows = searches.where("owner IS NOT NULL").withColumn("_day", F.to_date("searched_at"))
    order = W.partitionBy("owner", "_day").orderBy("searched_at", "search_id")
    first = F.row_number().over(order) == 1
    changed = F.when(first, 0).otherwise((~F.col("q").eqNullSafe(F.lag("q").over(order))).cast("int"))
    local = rows.withColumn("_first", first).withColumn("_new", changed)
    ends = F.struct("searched_at", "search_id")
    days = local.groupBy("owner", "_day").agg(F.min_by("q", ends).alias("_q0"), F.max_by("q", ends).alias("_q1"), F.sum("_new").alias("_changes"))
    by_day = W.partitionBy("owner").orderBy("_day")
    opens = (F.lag("_day").over(by_day).isNull() | ~F.col("_q0").eqNullSafe(F.lag("_q1").over(by_day))).cast("int")
    offsets = days.withColumn("_opens", opens).withColumn("_offset", F.sum(F.col("_changes") + F.col("_opens")).over(by_day) - F.col("_changes"))
    numbered = local.join(offsets.select("owner", "_day", "_offset"), ["owner", "_day"]).withColumn("_run", F.col("_offset") + F.sum("_new").over(order))
    return numbered.groupBy("owner", "_run", "q").agg(
        F.min("searched_at").alias("first_at"), F.max("searched_at").alias("last_at"), F.sum("n").alias("times"),
        F.max_by("total", ends).alias("total"),
    ).drop("_run")


def recent_history(entries: DataFrame, now: Column, cap: int = HISTORY_CAP, days: int = RETENTION_DAYS) -> DataFrame:
    """Entries within the retention, the last ``cap`` of each owner, with ``nth`` from the newest."""
    order = W.partitionBy("owner").orderBy(F.desc("last_at"), F.desc("first_at"), "q")
    kept = entries.where(F.col("last_at") >= now - F.make_interval(days=F.lit(days)))
    return kept.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap)


def merge_owners(entries: DataFrame, old: str, new: str, cap: int = HISTORY_CAP) -> DataFrame:
    """History after an anonymous owner becomes another: the two lists in order of time, the newest ``cap`` kept."""
    moved = entries.where(F.col("owner").isin(old, new)).withColumn("owner", F.lit(new))
    order = W.partitionBy("owner").orderBy(F.desc("last_at"), F.desc("first_at"), "q")
    merged = moved.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap)
    return entries.where(~F.col("owner").isin(old, new)).unionByName(merged.drop("nth"))


def usage_daily(searches: DataFrame) -> DataFrame:
    """(day, owner, used) by UTC day."""
    return searches.where("owner IS NOT NULL").groupBy(F.to_date("searched_at").alias("day"), "owner").agg(F.count("*").alias("used"))


def fair_use_refusals(searches: DataFrame, limit: int = FAIR_USE) -> DataFrame:
    """(search_id, owner, day, nth) of the searches beyond an owner's daily limit."""
    day = F.to_date("searched_at")
    order = W.partitionBy("owner", day).orderBy("searched_at", "search_id")
    return searches.where("owner IS NOT NULL").select("search_id", "owner", day.alias("day"), F.row_number().over(order).alias("nth")).where(F.col("nth") > limit)


def _next_allowed(asked: DataFrame, step: int) -> DataFrame:
    """(q, t, next): the first search of the query at least ``step`` after each one.

    Times are cut into blocks of ``step``: the next search is found in the block
    ``step`` later, or else it is the first one of a later block, so that no
    task holds all searches of a query.
    """
    block = F.floor(F.col("x") / step)
    sought = asked.select("q", "t", (F.col("t") + step).alias("x"), F.lit(None).cast("long").alias("found"))
    held = asked.select("q", F.lit(None).cast("long").alias("t"), F.col("t").alias("x"), F.col("t").alias("found"))
    both = held.unionByName(sought).withColumn("block", block)
    within = W.partitionBy("q", "block").orderBy(F.desc("x"), F.col("found").isNull()).rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("here", F.min("found").over(within)).where("t IS NOT NULL").select("q", "block", "t", "here")
    later = W.partitionBy("q").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = both.groupBy("q", "block").agg(F.min("found").alias("first")).withColumn("after", F.last("first", ignorenulls=True).over(later))
    return met.join(blocks.select("q", "block", "after"), ["q", "block"]).select("q", "t", F.coalesce("here", "after").alias("next")).where("next IS NOT NULL")


def cooldown_runs(searches: DataFrame, hours: int = COOLDOWN_HOURS) -> DataFrame:
    """(q, run_at) of the searches that would start a discovery run: none of the same query ran in the hours before.

    Each search points to the one that may run next if it does; runs are what
    the pointers reach from a query's first search. Pointers are doubled, so a
    query with n runs takes log n joins, and its searches are spread over tasks.
    Equal times of a query are one.
    """
    q = F.lower(F.trim("q"))
    asked = searches.where("trim(q) <> ''").select(q.alias("q"), F.unix_micros(F.col("searched_at").cast("timestamp")).alias("t")).where("t IS NOT NULL").distinct()
    asked = materialize(asked, "asked")
    runs = _reached(asked.groupBy("q").agg(F.min("t").alias("t")), _next_allowed(asked, hours * 3_600_000_000), "q")
    return runs.select("q", F.timestamp_micros("t").alias("run_at"))


def _reached(starts: DataFrame, jump: DataFrame, key: str) -> DataFrame:
    """(key, t) that pointers (key, t, next) lead to from the starts (key, t), the starts included; pointers are doubled each round."""
    jump, met = materialize(jump, "jumps"), materialize(starts, "reached")
    while True:
        ahead = met.join(jump, [key, "t"]).select(key, F.col("next").alias("t"))
        added = materialize(ahead.join(met, [key, "t"], "left_anti"), "reached")
        if added.isEmpty():
            return met
        met = materialize(met.unionByName(added), "reached")
        further = jump.select(key, F.col("t").alias("next"), F.col("next").alias("far"))
        jump = materialize(jump.join(further, [key, "next"]).select(key, "t", F.col("far").alias("next")), "jumps")


def thin_searches(searches: DataFrame) -> DataFrame:
    """Searches with fewer results than an answer needs; an unknown total is none."""
    return searches.where(F.col("total") < THIN_TOTAL)


def retention(usage: DataFrame, today: Column, days: int = USAGE_DAYS) -> DataFrame:
    """Usage counters of the days still kept."""
    return usage.where(F.col("day") >= F.date_sub(today, days))


def effective_settings(patches: DataFrame) -> DataFrame:
    """(owner, key, value, error) from patches (owner, at, key, value): the last valid value of each key, else the default.

    A patch with an unknown key or an invalid (or null) value is an error row and changes nothing.
    """
    v = F.coalesce("value", F.lit(""))
    valid = (
        F.when(F.col("key") == "resultsPerPage", v.rlike(r"^\d{1,2}$") & v.try_cast("int").between(5, 50))
        .when(F.col("key") == "theme", v.isin("system", "light", "dark"))
        .when(F.col("key").isin(*DEFAULT_SETTINGS), v.isin("true", "false"))
    )
    marked = patches.withColumn("error", F.when(valid.isNull(), "unknown_setting").when(~valid, "invalid_setting_value"))
    last = marked.where("error IS NULL").groupBy("owner", "key").agg(F.max_by("value", "at").alias("value"))
    defaults = F.explode(F.create_map(*[F.lit(x) for pair in DEFAULT_SETTINGS.items() for x in pair])).alias("key", "fallback")
    full = patches.select("owner").distinct().select("owner", defaults).join(last, ["owner", "key"], "left")
    good = full.select("owner", "key", F.coalesce("value", "fallback").alias("value"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(marked.where("error IS NOT NULL").select("owner", "key", "value", "error"))


def provider_choice(results: DataFrame) -> DataFrame:
    """(request, provider) of provider results (request, provider, priority, ok, n): the first in priority that answered with something."""
    return results.where("ok AND n > 0").groupBy("request").agg(F.min_by("provider", F.struct("priority", "provider")).alias("provider"))


def failover(results: DataFrame, fallback: str) -> DataFrame:
    """(request, at, provider) from what each instance would answer a request (request, at, provider, priority, ok, n); ``at`` orders the requests.

    The instance that answered last is tried first, then the others by priority;
    an answer with nothing in it is a failure. What none of them answers goes to
    the ``fallback``, which changes nothing for the next. An instance is thus
    left at the first request that it fails and another one answers: each
    request points to where the instance chosen there is left, and what these
    pointers reach from the first answer are the changes of instance.
    """
    held = results.select("request", "at", "provider", "priority", (F.col("ok") & (F.col("n") > 0)).alias("good"))
    best = F.min_by("provider", F.when(F.col("good"), F.struct("priority", "provider")))
    failed = F.collect_set(F.when(~F.coalesce("good", F.lit(False)), F.col("provider"))).alias("failed")  # of the few instances
    asked = materialize(held.groupBy("request", "at").agg(best.alias("best"), failed), "asked")
    answered = asked.where("best IS NOT NULL").select(F.lit(0).alias("log"), F.col("at").alias("t"), "best", "failed", F.floor(F.col("at") / SLICE).alias("slice"))
    fails = answered.select(F.explode("failed").alias("provider"), "t", "slice")
    # The next failure of an instance: within the slice of requests, or the first one of a later slice.
    firsts = fails.groupBy("provider", "slice").agg(F.min("t").alias("first"))
    both = fails.select("provider", "slice", "t", F.col("t").alias("failed")).unionByName(answered.select(F.col("best").alias("provider"), "slice", "t", F.lit(None).cast("bigint").alias("failed")))
    slices = both.select("provider", "slice").distinct()
    later = W.partitionBy("provider").orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    after = slices.join(firsts, ["provider", "slice"], "left").select("provider", "slice", F.min("first").over(later).alias("after"))
    within = W.partitionBy("provider", "slice").orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, -1)
    found = both.withColumn("here", F.min("failed").over(within)).where("failed IS NULL").join(after, ["provider", "slice"])
    jump = found.select(F.lit(0).alias("log"), "t", F.coalesce("here", "after").alias("next")).where("next IS NOT NULL")
    changes = _reached(answered.groupBy("log").agg(F.min("t").alias("t")), jump, "log").join(answered.select("t", "best"), "t").select("t", "best")
    return asked.join(_in_force(asked, changes), "at").select("request", "at", F.when(F.col("best").isNull(), fallback).otherwise(F.col("instance")).alias("provider"))


def _in_force(asked: DataFrame, changes: DataFrame) -> DataFrame:
    """(at, instance): the instance of the last change (t, best) up to each request; null before the first."""
    slice_of = lambda c: F.floor(F.col(c) / SLICE).alias("slice")
    known = changes.select(F.col("t").alias("at"), "best", slice_of("t"))
    rows = known.withColumn("asks", F.lit(False)).unionByName(asked.select("at", F.lit(None).cast("string").alias("best"), slice_of("at"), F.lit(True).alias("asks")).distinct())
    within = W.partitionBy("slice").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # one row for each slice
    ends = rows.groupBy("slice").agg(F.max_by("best", F.when(F.col("best").isNotNull(), F.col("at"))).alias("end")).select("slice", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    told = rows.withColumn("here", F.last("best", ignorenulls=True).over(within)).where("asks").join(ends, "slice")
    return told.select("at", F.coalesce("here", "before").alias("instance"))


def fresh_candidates(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Discovered URLs (url) that are not indexed yet, once each."""
    return found.select("url").where("url IS NOT NULL").distinct().join(docs.select("url"), "url", "left_anti")
