"""Robots rules: parsing, choosing the group, matching paths, fetch policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(origin, group_no, agents, allow, path, crawl_delay) of the rules of robots files (origin, text).

    A group is a run of user-agent lines and the rules after it; its delay is the
    last one given. A group without rules has one row with a null path.
    """
    line = F.trim(F.regexp_replace(F.col("line"), r"#.*$", ""))
    rows = files.select("origin", F.posexplode(F.split(text_col, r"\r?\n")).alias("at", "line")).select(
        "origin", "at", F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"), line.contains(":").alias("ok")
    ).where("ok")
    order = W.partitionBy("origin").orderBy("at")
    agent = F.col("field") == "user-agent"
    starts = (agent & ~F.coalesce(F.lag(agent).over(order), F.lit(False))).cast("int")
    grouped = rows.withColumn("_start", starts).withColumn("group_no", F.sum("_start").over(order)).where("group_no > 0")
    delay = F.when((F.col("field") == "crawl-delay") & F.col("value").rlike(r"^[0-9]+(\.[0-9]+)?$"), F.struct("at", F.col("value").cast("double").alias("d")))
    rules = F.filter(F.collect_list(F.when(F.col("field").isin("allow", "disallow") & (F.col("value") != ""), F.struct("at", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path")))), lambda r: r.isNotNull())
    groups = grouped.groupBy("origin", "group_no").agg(
        F.collect_set(F.when(agent, F.lower("value"))).alias("agents"), rules.alias("rules"), F.max(delay)["d"].alias("crawl_delay")
    )
    return groups.select("origin", "group_no", "agents", F.explode_outer("rules").alias("r"), "crawl_delay").select("origin", "group_no", "agents", "r.allow", "r.path", "crawl_delay")


def choose_group(rules: DataFrame, user_agent: str) -> DataFrame:
    """Rules of each origin's group for an agent: the first that names a part of its token, else the first for all."""
    token = user_agent.split("/")[0].lower()
    named = F.exists("agents", lambda a: (a != "*") & F.contains(F.lit(token), a))
    for_all = F.array_contains("agents", "*")
    ranked = rules.withColumn("_rank", F.when(named, 0).when(for_all, 1)).where("_rank IS NOT NULL")
    best = ranked.groupBy("origin").agg(F.min(F.struct("_rank", "group_no")).alias("b")).select("origin", F.col("b.group_no").alias("group_no"))
    return ranked.join(best, ["origin", "group_no"]).drop("_rank")


def rule_regex(path: Column) -> Column:
    """A rule's path as an expression anchored at the start: '*' is anything, '$' the end."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(path, r"([.+?^{}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")))


def allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(origin, path, allowed): the longest matching rule decides, allow wins a tie, no rule allows."""
    held = rules.where("path IS NOT NULL").select("origin", F.col("path").alias("rule"), "allow")
    hits = paths.select("origin", "path").distinct().join(held, "origin").where(F.rlike("path", rule_regex(F.col("rule"))))
    best = hits.groupBy("origin", "path").agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("allow"))
    return paths.join(best, ["origin", "path"], "left").select("origin", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))


def fetch_policy(status: Column) -> Column:
    """What a robots fetch means: 'parse', 'deny_all' for server errors, else 'allow_all' (a null status is a network error)."""
    return F.when(status.between(200, 299), "parse").when(status >= 500, "deny_all").otherwise("allow_all")
