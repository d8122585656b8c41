"""How distinctive a term is of its page: graph-of-words weighting.

The weight of a term in a page is not its frequency but the number of distinct
terms it stands next to, in a window that slides over the page's positions. It
is divided by a length norm and multiplied by the term's rarity in the whole
collection:

    score = degree / (1 - b + b * len / mean len) * ln((pages + 1) / df)

All rows of a page meet in one partition (one shuffle of the postings), where
numpy builds the graphs of many pages at once. Pages with so many rows that a
task should not hold them take another way: their tokens are spread by position
and their edges are counted by a distributed distinct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpora.session import materialize

#: Positions in a window: each term meets the terms up to WINDOW - 1 positions on.
WINDOW = 4
#: Slope of the length norm.
B = 0.003
#: Pages with more postings than this are spread over tasks by position.
PAGE_ROWS = 1_000_000

_OUT = "shard int, doc_id bigint, term string, w double, degree bigint, page_len bigint"
_NAMES = ["shard", "doc_id", "term", "w", "degree", "page_len"]


def _degrees(rows: pa.Table, window: int) -> pa.Table:
    """Rows of whole pages, sorted by (shard, doc_id, key): one row per term with its degree and the page's length."""
    n = rows.num_rows
    shard, doc, key = (rows.column(c).to_numpy() for c in ("shard", "doc_id", "key"))
    new_page = np.ones(n, bool)
    new_page[1:] = (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1])
    first = new_page.copy()
    first[1:] |= key[1:] != key[:-1]
    keep = np.flatnonzero(first)
    rows = rows.take(pa.array(keep))
    page = (np.cumsum(new_page) - 1)[keep]
    m = len(keep)
    pos = rows.column("pos").combine_chunks()
    pos = pos if isinstance(pos, pa.ListArray) else pos.chunk(0)
    sizes = pc.fill_null(pc.list_value_length(pos), 0).to_numpy(zero_copy_only=False)
    flat = pos.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(m), sizes)
    order = np.lexsort((flat, page[owner]))
    owner, at = owner[order], flat[order]
    edges = []
    for k in range(1, window):
        a, b = owner[:-k], owner[k:]
        near = (page[a] == page[b]) & (at[k:] - at[:-k] < window) & (a != b)
        a, b = a[near], b[near]
        edges += [a * m + b, b * m + a]
    ends = np.unique(np.concatenate(edges)) // m if edges else np.zeros(0, np.int64)
    degree = np.bincount(ends, minlength=m).astype(np.int64)
    length = np.bincount(page, weights=rows.column("f").to_numpy())[page].astype(np.int64) if m else np.zeros(0, np.int64)
    return pa.table(
        [rows.column("shard"), rows.column("doc_id"), rows.column("term"), rows.column("w"), pa.array(degree), pa.array(length)], _NAMES
    )


def _stream(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def cut(table: pa.Table) -> int:
            """Where the last page of the table begins."""
            doc, shard = table.column("doc_id").to_numpy(), table.column("shard").to_numpy()
            other = np.flatnonzero((doc != doc[-1]) | (shard != shard[-1]))
            return int(other[-1]) + 1 if len(other) else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 100_000:
                continue
            table = pa.Table.from_batches(held)
            at = cut(table)
            if at:
                yield from _degrees(table.slice(0, at), window).to_batches()
            held = table.slice(at).combine_chunks().to_batches()
            rows = table.num_rows - at
        if held:
            yield from _degrees(pa.Table.from_batches(held), window).to_batches()

    return run


def _degrees_by_position(rows: DataFrame, window: int) -> DataFrame:
    """The same for pages of any size: edges from an equi-join on position, made distinct."""
    page = ["shard", "doc_id"]
    one = rows.groupBy(*page, "term").agg(F.max("w").alias("w"), F.max("pos").alias("pos"), F.max("f").alias("f"))
    tokens = one.select(*page, "term", F.explode("pos").alias("at"))
    ahead = tokens.select(*page, F.col("term").alias("near"), F.explode(F.array(*[F.col("at") - k for k in range(1, window)])).alias("at"))
    pairs = tokens.join(ahead, [*page, "at"]).where("term <> near")
    both = pairs.select(*page, "term", "near").unionByName(pairs.select(*page, F.col("near").alias("term"), F.col("term").alias("near")))
    degree = both.distinct().groupBy(*page, "term").agg(F.count("*").alias("degree"))
    length = one.groupBy(*page).agg(F.sum("f").cast("bigint").alias("page_len"))
    return one.join(degree, [*page, "term"], "left").join(length, page).select(
        *page, "term", "w", F.coalesce("degree", F.lit(0)).alias("degree"), "page_len"
    ).select(*_NAMES)


def term_degrees(postings: DataFrame, window: int = WINDOW, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(shard, doc_id, term, w, degree, page_len) of each term of each live page.

    Rows that stand there twice count once; doc_id 0, null doc_id, term '' and
    null terms are left out; a null ``shard`` counts as -1, a null or empty
    ``pos`` gives degree 0, and a null ``w`` stays null. ``page_len`` is the
    number of tokens by the term counts of the page.
    """
    live = postings.where("doc_id <> 0 AND term <> ''").select(
        F.coalesce("shard", F.lit(-1)).alias("shard"), "doc_id", "term", F.xxhash64("term").alias("key"), "w",
        (F.coalesce("f0", F.lit(0)) + F.coalesce("f1", F.lit(0)) + F.coalesce("f2", F.lit(0))).alias("f"),
        F.filter("pos", lambda p: p.isNotNull()).alias("pos"),
    )
    sizes = live.groupBy("shard", "doc_id").count().where(F.col("count") > page_rows)
    huge = materialize(sizes.select("shard", "doc_id"), "huge_pages")
    if huge.isEmpty():
        rest = live
    else:
        rest = live.join(huge, ["shard", "doc_id"], "left_anti")
    by_page = rest.repartition("shard", "doc_id").sortWithinPartitions("shard", "doc_id", "key")
    out = by_page.mapInArrow(_stream(window), _OUT)
    return out if huge.isEmpty() else out.unionByName(_degrees_by_position(live.join(huge, ["shard", "doc_id"], "left_semi"), window))


class _Collection:
    """What scores need of the whole collection."""

    def __init__(self, postings: DataFrame, docs: DataFrame, window: int, b: float):
        known = docs.agg(F.countDistinct("id").alias("pages"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("mean")).first()
        self.pages, self.mean, self.b = max(known["pages"], 1), known["mean"] or 1.0, b
        self.terms = materialize(term_degrees(postings, window), "degrees")
        per_shard = self.terms.groupBy("shard", "term").agg(F.count("*").alias("df_shard"))
        self.per_term = per_shard.groupBy("term").agg(
            F.sum("df_shard").alias("df"), F.map_from_entries(F.collect_list(F.struct("shard", "df_shard"))).alias("by_shard")
        )

    def scored(self, terms: DataFrame) -> DataFrame:
        norm = 1 - self.b + self.b * F.col("page_len") / F.lit(self.mean)
        return terms.join(self.per_term, "term").select(
            "shard", "doc_id", "term", "w", "degree",
            F.element_at("by_shard", F.col("shard")).alias("df_shard"), "df",
            (F.col("degree") / norm * F.log((F.lit(self.pages) + 1) / F.col("df"))).alias("score"),
        )


def term_scores(postings: DataFrame, docs: DataFrame, window: int = WINDOW, b: float = B) -> DataFrame:
    """(shard, doc_id, term, w, degree, df_shard, df, score) of each term of each live page.

    ``df`` counts the pages with the term over all shards, ``df_shard`` those of
    the shard; both are counted in the postings, as listed numbers go stale.
    The collection's pages and mean length come from ``docs`` (``id``, ``len``;
    a null or non-positive ``len`` is left out of the mean); the page's own
    length is counted in its postings, as ``len`` may be stale. Empty postings
    give no rows.
    """
    whole = _Collection(postings, docs, window, b)
    return whole.scored(whole.terms)


def characteristic_terms(postings: DataFrame, docs: DataFrame, where: Column, window: int = WINDOW, b: float = B) -> DataFrame:
    """The rows of ``term_scores`` whose score reaches the mean of their page's terms (page_mean), of those that fulfil ``where``.

    Means are made of all terms of a page; only pages with a row that fulfils
    ``where`` need one.
    """
    whole = _Collection(postings, docs, window, b)
    page = ["shard", "doc_id"]
    asked = materialize(whole.scored(whole.terms).where(where), "asked_terms")
    means = whole.scored(whole.terms.join(asked.select(*page).distinct(), page, "left_semi")).groupBy(*page).agg(F.avg("score").alias("page_mean"))
    return asked.join(means, page).where(F.col("score") >= F.col("page_mean"))
