"""Keeping an index current: upserts, removals, compaction, rebuilding, crawl outcomes, small checks of input."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpora.functions.html import THIN
from korpora.functions.urls import normalize_url
from korpora.operators import index as ix
from korpora.operators.graph import resolved_edges
from korpora.session import materialize


def upsert(current: ix.Index, pages: DataFrame) -> ix.Index:
    """The index after adding pages, each in place of the one of its URL.

    Only the new pages are tokenised, and only their postings are written; what
    they replace is left out by an anti-join when the index is read, until
    ``compact`` writes the tables again. A new page always gets its own id, so
    ids of ``pages`` must not be in use. A term keeps the display form it has.
    """
    live = ix.latest_by_url(pages)
    made = ix.clustered(ix.postings(live.select("id", "title", "description", "text")).withColumn("head", F.lit(True)))
    fresh = materialize(ix.with_lengths(ix.store_form(live), made), "docs")
    kept = _without(current, current.docs.join(fresh.select("url"), "url", "left_semi").select(F.col("id").alias("doc_id")), ix.dictionary(made))
    docs = kept.docs.unionByName(fresh)
    return replace(kept, docs=docs, postings=kept.postings.unionByName(made), stats=ix.corpus_stats(docs), edges=resolved_edges(docs))


def remove(current: ix.Index, urls: DataFrame) -> ix.Index:
    """The index without the pages of the given URLs (url); nothing but their ids is written until ``compact``."""
    wanted = urls.select(normalize_url(F.col("url")).alias("url")).distinct()
    return _without(current, current.docs.join(wanted, "url", "left_semi").select(F.col("id").alias("doc_id")))


def _without(current: ix.Index, gone: DataFrame, added: DataFrame | None = None) -> ix.Index:
    """The index without some pages (doc_id), its dictionary counted anew from what goes and what is ``added`` (term, display, df)."""
    gone = materialize(gone, "removed")
    lost = current.postings.join(gone, "doc_id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
    changes = lost.select("term", F.lit(None).cast("string").alias("display"), "df")
    both = current.terms.unionByName(changes if added is None else changes.unionByName(added))
    counted = both.groupBy("term").agg(F.sum("df").alias("df"), F.max("display").alias("any"))
    terms = counted.where("df > 0").join(current.terms.select("term", "display"), "term", "left").select("term", F.coalesce("display", "any").alias("display"), "df")
    posts, docs = ix.remove_documents(current.postings, current.docs, gone)
    return replace(current, docs=docs, postings=posts, terms=materialize(terms, "terms"), stats=ix.corpus_stats(docs), edges=resolved_edges(docs))


def compact(current: ix.Index) -> ix.Index:
    """The index written anew: removed pages and terms without a page go, postings are clustered and marked under the cap."""
    docs = materialize(current.docs, "docs")
    terms = materialize(current.terms.where("df > 0"), "terms")
    posts = ix.clustered(ix.with_head(current.postings, terms, current.cap))
    return replace(current, docs=docs, postings=posts, terms=terms, stats=ix.corpus_stats(docs), edges=materialize(resolved_edges(docs), "edges"))


def rebuild(stored: DataFrame) -> ix.Index:
    """An index from stored pages, as a change of store needs. Texts were cut when they were stored, so later words are lost."""
    return ix.build_index(stored)


def crawl_outcome(title: Column, text: Column, noindex: Column, error: Column) -> Column:
    """'error', 'skipped' (noindex or thin) or 'indexed'."""
    thin = (F.coalesce(title, F.lit("")) == "") & (F.length(F.coalesce(text, F.lit(""))) < THIN)
    return F.when(error, "error").when(F.coalesce(noindex, F.lit(False)) | thin, "skipped").otherwise("indexed")


def weak_answers(scored: DataFrame, queries: DataFrame, least: int = 3, coverage: float = 0.6) -> DataFrame:
    """(qid) of the queries that few pages answer, or whose best hit covers too few of the needed words."""
    best = scored.groupBy("qid").agg(
        F.count("*").alias("total"), F.max_by(F.col("n_needed") / F.greatest(F.size("required"), F.lit(1)), F.struct("score", (-F.col("doc_id")).alias("d"))).alias("coverage")
    )
    known = queries.select("qid").join(best, "qid", "left")
    return known.where(F.col("total").isNull() | (F.col("total") < least) | (F.col("coverage") < coverage)).select("qid")


def hash_key(key: Column) -> Column:
    """SHA-256 of a key as hexadecimal digits."""
    return F.sha2(key, 256)


# What a name may not hold, and what an address looks like.
_TAGS, _ADDRESS = "[<>]", r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def clean_name(name: Column) -> Column:
    """A name without angle brackets, white space collapsed, at most 60 characters."""
    return F.substr(F.trim(F.regexp_replace(F.regexp_replace(name, _TAGS, ""), r"\s+", " ")), F.lit(1), F.lit(60))


def is_email(text: Column) -> Column:
    """Whether a text is a simple address: something, @, a domain with a dot, no white space."""
    return text.rlike(_ADDRESS)
