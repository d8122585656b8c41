"""Why a page was found: reason codes with their arguments, freshness classes and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that define explanations and snippets.
OPENING, NEAR_TOP, LISTED = 40, 120, 3
SNIPPET, LEAD, SNAP, MAX_HITS = 220, 40, 30, 200
SIGNALS = (
    ("text_relevance", "field-weighted BM25: title 3, description 1.5, text 1"),
    ("phrase_proximity", "query words next to each other, in order"),
    ("link_authority", "links from other indexed pages"),
    ("freshness", "a small gain for pages fetched lately"),
)
EXCLUDED_SIGNALS = ("payment", "advertising", "partnership", "viewpoint")


def freshness_class(fetched_at: Column, now: Column) -> Column:
    """'today', 'yesterday', 'days', 'months', 'over_a_year', or null for an unknown time."""
    days = (F.unix_micros(now) - F.unix_micros(fetched_at.cast("timestamp"))) / 86_400_000_000
    return F.when(fetched_at.isNull(), None).when(days < 1, "today").when(days < 2, "yesterday").when(days < 60, "days").when(days < 365, "months").otherwise("over_a_year")


def early_hit_class(first_hit: Column) -> Column:
    """'opening', 'near_top' or null."""
    return F.when(first_hit <= OPENING, "opening").when(first_hit <= NEAR_TOP, "near_top")


def list_join(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(
        F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, F.lit(-1)))
    )


def _reason(signal: str, code: Column | str, args: Column) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(F.lit(signal).alias("signal"), code.alias("code"), F.coalesce(args, F.array().cast("array<string>")).alias("args"))


def reasons(scored: DataFrame, queries: DataFrame, inlinks: DataFrame, now: Column) -> DataFrame:
    """Adds ``reasons`` (signal, code, args) in their fixed order, and the terms that are missing.

    Order: coverage, title or description, operators, proximity (unless a phrase
    was asked for), an early hit (unless something is in the title), links,
    freshness. Codes and arguments are the contract; the wording is the caller's.
    """
    asked = queries.select("qid", "phrases", "excluded", "site")
    rows = scored.join(asked, "qid").join(inlinks.select("doc_id", "inlinks"), "doc_id", "left").withColumn(
        "missing", F.array_except("required", "matched_needed")
    )
    none = F.array().cast("array<string>")
    all_found = F.size("missing") == 0
    fresh, early = freshness_class(F.col("fetched_at"), now), early_hit_class(F.col("first_hit"))
    listed = [
        _reason("text_relevance", F.when(all_found & (F.size("required") == 1), "matches_word").when(all_found, "matches_all").otherwise("matches_some"), F.when(all_found, none).otherwise(F.col("missing"))),
        F.when(F.size("in_title") > 0, _reason("text_relevance", "in_title", F.slice("in_title", 1, LISTED)))
        .when(F.size("in_description") > 0, _reason("text_relevance", "in_description", F.slice("in_description", 1, LISTED))),
        F.when(F.size("phrases") > 0, _reason("operator", "phrase", F.transform("phrases", lambda p: F.array_join(p, " ")))),
        F.when(F.col("site").isNotNull(), _reason("operator", "site", F.array("site"))),
        F.when(F.size("excluded") > 0, _reason("operator", "excluded", F.col("excluded"))),
        F.when(F.col("first_pair").isNotNull() & (F.size("phrases") == 0), _reason("phrase_proximity", "adjacent", F.array(F.col("first_pair").cast("string")))),
        F.when(early.isNotNull() & (F.size("in_title") == 0), _reason("text_relevance", early, none)),
        F.when(F.col("inlinks") > 0, _reason("link_authority", "inlinks", F.array(F.col("inlinks").cast("string")))),
        F.when(fresh.isNotNull(), _reason("freshness", fresh, none)),
    ]
    return rows.withColumn("reasons", F.array_compact(F.array(*listed)))


def snippet_source(description: Column, text: Column) -> Column:
    """What a snippet is cut from: a description of more than 40 characters before the text, else the text, else the description."""
    d, t = F.coalesce(description, F.lit("")), F.coalesce(text, F.lit(""))
    return F.when(F.length(d) > 40, F.concat(d, F.lit(" — "), t)).when(t != "", t).otherwise(d)


def with_snippet(rows: DataFrame, source: str, terms: str, most: int = SNIPPET) -> DataFrame:
    """Adds ``snippet``: the window of ``most`` characters where most stems lie, the first of equals.

    Meant for the rows of one page of results. Offsets come from splitting the
    lower-case text at each stem; each step is a column of its own, so that it
    is computed once. A null or blank source gives ''; a short one stays whole.
    """

    def offsets(term: Column) -> Column:
        parts = F.split("_low", F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1)
        runs = F.aggregate(
            F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<int>"),
            lambda acc, p: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)) + F.length(term), F.lit(0)) + F.length(p)).cast("int"))),
        )
        return F.when(F.length(term) >= 2, runs).otherwise(F.array().cast("array<int>"))

    clean, hits = F.col("_clean"), F.col("_hits")
    dense = F.transform(hits, lambda p: F.struct((-F.size(F.filter(hits, lambda q: (q >= p) & (q < p + most)))).alias("n"), p.alias("p")))
    space = F.instr(F.substr(clean, F.col("_start") + 1, F.lit(SNAP)), " ")
    at = F.col("_at")
    window = F.rtrim(F.substr(clean, at + 1, F.lit(most)))
    cut = F.concat(F.when(at > 0, "…").otherwise(""), window, F.when(at + most < F.length(clean), "…").otherwise(""))
    return (
        rows.withColumn("_clean", F.trim(F.regexp_replace(F.col(source), r"[\s\x{a0}]+", " "))).withColumn("_low", F.lower("_clean"))
        .withColumn("_hits", F.array_sort(F.slice(F.flatten(F.transform(F.array_distinct(F.col(terms)), offsets)), 1, MAX_HITS)))
        .withColumn("_start", F.greatest(F.array_min(dense)["p"] - LEAD, F.lit(0)))
        .withColumn("_at", F.when((F.col("_start") > 0) & (space > 0), F.col("_start") + space).otherwise(F.col("_start")))
        .withColumn(
            "snippet",
            F.when(clean.isNull() | (clean == ""), "").when(F.length(clean) <= most, clean)
            .when(F.size(hits) == 0, F.concat(F.rtrim(F.substr(clean, F.lit(1), F.lit(most - 1))), F.lit("…"))).otherwise(cut),
        )
        .drop("_clean", "_low", "_hits", "_start", "_at")
    )


def ranking_manifest(spark: SparkSession) -> DataFrame:
    """(kind, id, description): the signals that scores are made of, and those that never will be."""
    rows = [("signal", i, d) for i, d in SIGNALS] + [("excluded", x, "never an input") for x in EXCLUDED_SIGNALS]
    return spark.createDataFrame(rows, "kind string, id string, description string")
