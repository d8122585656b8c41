"""Ranking a batch of queries in one plan.

A table of queries goes to every task, so it holds up to some ten thousand rows;
the first hits of larger sets come from ``batch.first_hits``. Candidates are
never partitioned by their query alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpora.functions.urls import of_site
from korpora.operators.index import Index

# Fixed values that define scores.
K1, B = 1.2, 0.75
AUTHORITY, PHRASE, FRESH = 0.35, 0.20, 0.05
SOFT_SHARE, RELAX_UNDER = 0.6, 5
PER_DOMAIN = 3


def freshness(fetched_at: Column, now: Column) -> Column:
    """1 + 0.05 e^(-age in days / 365); 1 for an unknown time, and no age under 0."""
    days = F.greatest((F.unix_micros(now) - F.unix_micros(fetched_at.cast("timestamp"))) / 86_400_000_000, F.lit(0.0))
    return F.when(fetched_at.isNull(), 1.0).otherwise(1 + FRESH * F.exp(-days / 365))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def query_postings(queries: DataFrame, index: Index) -> DataFrame:
    """(qid, term, idf, needed, doc_id, w, f0, f1, pos) of every term of every query, up to the cap of the index."""
    asked = queries.select("qid", "required", F.explode(F.array_distinct("terms")).alias("term"))
    known = asked.join(index.terms.select("term", "df"), "term").join(F.broadcast(index.stats.select("n_docs")))  # one row
    terms = known.select("qid", "term", idf(F.col("n_docs"), F.col("df")).alias("idf"), F.array_contains("required", F.col("term")).alias("needed"))
    return F.broadcast(terms).join(index.postings.where("head").select("term", "doc_id", "w", "f0", "f1", "pos"), "term")


def has_phrase(places: Column, phrase: Column) -> Column:
    """Whether the positions by term hold the phrase's terms one after the other."""
    first = F.element_at(places, F.element_at(phrase, 1))
    at_each = F.transform(phrase, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.coalesce(
        F.exists(first, lambda p: F.forall(at_each, lambda x: F.coalesce(F.array_contains(F.element_at(places, x["t"]), (p + x["i"]).cast("int")), F.lit(False)))), F.lit(False)
    )


def adjacent_pairs(terms: Column, places: Column) -> Column:
    """For each pair of neighbouring query terms, whether they stand next to each other."""
    def pair(i: Column) -> Column:
        a, b = F.element_at(places, F.element_at(terms, i)), F.element_at(places, F.element_at(terms, i + 1))
        return F.coalesce(F.arrays_overlap(F.transform(a, lambda p: p + 1), b), F.lit(False))

    return F.when(F.size(terms) > 1, F.transform(F.sequence(F.lit(1), F.size(terms) - 1), pair)).otherwise(F.array().cast("array<boolean>"))


def candidates(queries: DataFrame, index: Index) -> DataFrame:
    """(qid, doc_id, terms, required, phrases, site, hits, n_needed, domain, len, fetched_at) after the site, excluded words and phrases.

    ``hits`` are the matched terms with their weights and positions. Exclusion
    looks at uncapped postings.
    """
    found = query_postings(queries, index)
    grouped = found.groupBy("qid", "doc_id").agg(
        F.collect_list(F.struct("term", "idf", "w", "f0", "f1", "needed", "pos")).alias("hits"), F.sum(F.col("needed").cast("int")).alias("n_needed")
    )
    docs = index.docs.select(F.col("id").alias("doc_id"), "domain", "len", "fetched_at")
    placed = grouped.join(F.broadcast(queries.drop("excluded")), "qid").join(docs, "doc_id").where(F.col("site").isNull() | of_site(F.col("domain"), F.col("site")))
    ruled_out = F.broadcast(queries.select("qid", F.explode("excluded").alias("term"))).join(index.postings.select("term", "doc_id"), "term").select("qid", "doc_id")
    kept = placed.join(ruled_out, ["qid", "doc_id"], "left_anti")
    return kept.where(F.forall("phrases", lambda p: has_phrase(_places(F.col("hits")), p)))


def _places(hits: Column) -> Column:
    """The positions by term."""
    return F.map_from_entries(F.transform(hits, lambda h: F.struct(h["term"], h["pos"])))


def enough(required: Column) -> Column:
    """How many of the needed terms a page must have: 60 % of them."""
    return F.greatest(F.ceil(SOFT_SHARE * F.size(required) - 1e-9), F.lit(1))


def pool(cands: DataFrame) -> DataFrame:
    """Candidates with enough of the needed terms, or with one of them where that leaves a query fewer than five; and their ``total``.

    The candidates of a query are counted before they move, and the counts, one
    row a query, join them; no task holds all of a query's candidates.
    """
    fit = F.col("n_needed") >= enough(F.col("required"))
    counts = cands.groupBy("qid").agg(F.count_if(fit).alias("_strict"), F.count_if(F.col("n_needed") >= 1).alias("_any"))
    relaxed = F.col("_strict") < RELAX_UNDER
    kept = cands.join(F.broadcast(counts), "qid").where(F.col("n_needed") >= F.when(relaxed, 1).otherwise(enough(F.col("required"))))
    return kept.withColumn("total", F.when(relaxed, F.col("_any")).otherwise(F.col("_strict"))).drop("_strict", "_any")


def score(queries: DataFrame, index: Index, authority: DataFrame, now: Column) -> DataFrame:
    """One row per query and page of its pool, with the factors of the score and what explains it.

    ``authority`` is (doc_id, authority); pages without one count 0.
    """
    rows = pool(candidates(queries, index)).join(authority, "doc_id", "left").join(F.broadcast(index.stats.select("avg_len")))  # one row
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    # In order of terms, so that equal pages get equal sums.
    bm25 = F.aggregate(F.array_sort("hits"), F.lit(0.0), lambda s, h: s + h["idf"] * h["w"] / (h["w"] + norm))
    needed = F.filter("hits", lambda h: h["needed"])
    titled = F.array_sort(F.transform(F.filter(needed, lambda h: h["f0"] > 0), lambda h: h["term"]))
    return (
        rows.withColumn("bm25", bm25)
        .withColumn("pairs", F.when(F.size("terms") > 1, adjacent_pairs(F.col("terms"), _places(F.col("hits")))).otherwise(F.array().cast("array<boolean>")))
        .withColumn("authority_factor", 1 + AUTHORITY * F.coalesce("authority", F.lit(0.0)))
        .withColumn("proximity", F.when(F.size("pairs") > 0, F.size(F.filter("pairs", lambda x: x)) / F.size("pairs")).otherwise(0.0))
        .withColumn("proximity_factor", 1 + PHRASE * F.col("proximity"))
        .withColumn("fresh_factor", freshness(F.col("fetched_at"), now))
        .withColumn("score", F.col("bm25") * F.col("authority_factor") * F.col("proximity_factor") * F.col("fresh_factor"))
        .select(
            "qid", "doc_id", "domain", "score", "bm25", "authority_factor", "proximity_factor", "fresh_factor", "required", "n_needed", "len", "fetched_at", "total",
            F.array_sort(F.transform("hits", lambda h: h["term"])).alias("matched"),
            F.array_sort(F.transform(needed, lambda h: h["term"])).alias("matched_needed"),
            titled.alias("in_title"),
            F.array_sort(F.array_except(F.transform(F.filter(needed, lambda h: h["f1"] > 0), lambda h: h["term"]), titled)).alias("in_description"),
            F.array_min(F.transform(needed, lambda h: F.element_at(h["pos"], 1))).alias("first_hit"),
            F.when(F.array_position("pairs", True) > 0, F.array_position("pairs", True) - 1).alias("first_pair"),
        )
    )


def by_score() -> list[Column]:
    """Best first; equal scores by id as a string."""
    return [F.desc("score"), F.col("doc_id").cast("string")]


def diversify(scored: DataFrame, first: int | None = None) -> DataFrame:
    """Adds ``place``: the first three hits of each domain by score, then the others.

    With ``first`` only so many places of each query come out, and only so many
    rows of a query leave each task; without it all places are numbered, which
    puts a query's hits in order in one task.
    """
    nth = F.row_number().over(W.partitionBy("qid", "domain").orderBy(*by_score()))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.col("_later"), *by_score()))
    placed = scored.withColumn("_later", nth > PER_DOMAIN).withColumn("place", place)
    return (placed if first is None else placed.where(F.col("place") <= first)).drop("_later")


def page_of(scored: DataFrame, page: int = 1, per_page: int = 10) -> DataFrame:
    """The rows of one page of diversified results, with the total and the number of pages of each query."""
    rows = diversify(scored, page * per_page).where(F.col("place") > (page - 1) * per_page)
    return rows.withColumn("total_pages", F.greatest(F.ceil(F.col("total") / per_page), F.lit(1)))
