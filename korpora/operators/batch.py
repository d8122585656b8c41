"""The first hits of a table of queries of any size, answered by blocks of pages.

A block holds some pages with their postings of the words that are asked for,
and one task answers every query over it, in numpy: a pair of query and page
never becomes a row. Only the first hits of a query leave a block, and they are
enough: no page stands further back in its block than over all pages. What is
moved is packed, many rows in one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpora.operators import rank
from korpora.operators.index import Index
from korpora.session import materialize

#: Postings and pages of a block at most, on average; a task holds one block, some hundred bytes a posting.
BLOCK_POSTINGS, BLOCK_PAGES = 2_000_000, 500_000
#: Rows that are packed together, and queries that are answered between two batches of hits.
PACKED, ASKED = 200_000, 2_000
#: Numbers that a block keeps of positions and of neighbours before it starts anew.
KEPT = 4_000_000

_PAGES, _POSTINGS, _QUERIES = range(3)
_STRICT, _ANY = 1, 2


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _packed(rows: DataFrame, kind: int, at_once: int) -> DataFrame:
    """(block, kind, blob): the rows of a table (block, ...), many of a block in one."""

    def blobs(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.take(pc.sort_indices(table["block"])).combine_chunks()
        block = table["block"].to_numpy()
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
        for start, end in zip(starts, [*starts[1:], len(block)]):
            part = table.slice(start, end - start).drop_columns(["block"])
            if kind == _POSTINGS:
                part = part.set_column(part.column_names.index("term"), "term", part["term"].dictionary_encode())
            yield pa.RecordBatch.from_arrays([pa.array([block[start]], pa.int32()), pa.array([kind], pa.int32()), pa.array([_pack(part)], pa.binary())], ["block", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                held.append(batch.slice(at, at_once))
                if sum(b.num_rows for b in held) >= at_once:
                    yield from blobs(held)
                    held = []
        if held:
            yield from blobs(held)

    return rows.mapInArrow(run, "block int, kind int, blob binary")


def _read(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


def _in(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the ascending ``of``."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return a[_in(a, b)]


def _round(x: np.ndarray) -> np.ndarray:
    """Positive numbers to 4 digits, halves up."""
    y = x * 1e4
    whole = np.floor(y)
    return (whole + (y - whole >= 0.5)) / 1e4


class Block:
    """Pages with their postings of some words; pages and words are numbers from 0."""

    def __init__(self, pages: pa.Table, posts: pa.Table | None, first: int):
        self.first = first
        self.ids, self.domains = pages["doc_id"].combine_chunks(), pages["domain"].combine_chunks()
        hosts = self.domains.dictionary_encode()
        self.hosts = hosts.dictionary.to_pylist()
        self.host = pc.fill_null(hosts.indices, len(self.hosts)).to_numpy().astype(np.int64)
        self.norm, self.authority, self.fresh = (pages[c].to_numpy() for c in ("norm", "authority_factor", "fresh_factor"))
        self.by_name = np.empty(len(self.ids), np.int64)
        self.by_name[pc.sort_indices(self.ids.cast(pa.string())).to_numpy()] = np.arange(len(self.ids))
        self.words: dict[str, int] = {}
        self._sites: dict[str, np.ndarray] = {}
        self._ordered: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._keys: dict[int, np.ndarray] = {}
        self._next: dict[tuple[int, int], np.ndarray] = {}
        self._kept = 0
        if posts is None:
            return
        page = pc.index_in(posts["doc_id"], value_set=self.ids)
        posts, page = posts.filter(page.is_valid()), page.drop_null()
        terms = posts["term"].unify_dictionaries().combine_chunks()
        self.words = {w: i for i, w in enumerate(terms.dictionary.to_pylist())}
        word, doc = terms.indices.to_numpy().astype(np.int64), page.to_numpy().astype(np.int64)
        order = np.argsort(word * max(1, len(self.ids)) + doc, kind="stable")
        self.docs, self.starts = doc[order], np.searchsorted(word[order], np.arange(len(self.words) + 1))
        w, idf = posts["w"].to_numpy()[order], posts["idf"].to_numpy()[order]
        self.part = idf * w / (w + self.norm[self.docs])
        pos = posts["pos"].combine_chunks()
        sizes, at, flat = pos.value_lengths().to_numpy(), np.asarray(pos.offsets)[:-1][order].astype(np.int64), np.asarray(pos.values)
        sizes = sizes[order].astype(np.int64)
        self.pos_starts = np.append(0, np.cumsum(sizes))
        self.pos = flat[np.repeat(at - self.pos_starts[:-1], sizes) + np.arange(self.pos_starts[-1])].astype(np.int64)

    def of(self, t: int) -> np.ndarray:
        """The pages of a word, ascending."""
        return self.docs[self.starts[t] : self.starts[t + 1]]

    def _keep(self, store: dict, key: object, value: np.ndarray) -> np.ndarray:
        self._kept += len(value)
        if self._kept > KEPT:
            self._keys.clear()
            self._next.clear()
            self._kept = len(value)
        store[key] = value
        return value

    def keys(self, t: int) -> np.ndarray:
        """Page and position of each place of a word, in one ascending number."""
        if t in self._keys:
            return self._keys[t]
        a, b = self.starts[t], self.starts[t + 1]
        page = np.repeat(self.docs[a:b], np.diff(self.pos_starts[a : b + 1]))
        return self._keep(self._keys, t, page << 32 | self.pos[self.pos_starts[a] : self.pos_starts[b]])

    def follow(self, phrase: list[int]) -> np.ndarray:
        """The pages that hold words one after the other, ascending."""
        key = tuple(phrase)
        if key in self._next:
            return self._next[key]
        places = self.keys(phrase[0])
        for i, t in enumerate(phrase[1:], 1):
            places = _both(places + i, self.keys(t)) - i
        pages = places >> 32
        return self._keep(self._next, key, pages[np.append(True, pages[1:] != pages[:-1])] if len(pages) else pages)

    def site(self, site: str) -> np.ndarray:
        if site not in self._sites:
            if len(self._sites) >= 1000:
                self._sites.clear()
            fit = [h is not None and (h == site or h.endswith("." + site)) for h in self.hosts]
            self._sites[site] = np.array([*fit, False])
        return self._sites[site]

    def score(self, docs: np.ndarray, words: list[int], terms: list[int | None]) -> np.ndarray:
        """The scores of pages; ``words`` are in the order of their letters, so that equal pages get equal sums."""
        bm25, near = np.zeros(len(docs)), np.zeros(len(docs))
        for t in words:
            own = self.of(t)
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            bm25 = bm25 + np.where(own[at] == docs, self.part[self.starts[t] + at], 0.0)
        pairs = max(1, len(terms) - 1)
        for a, b in zip(terms, terms[1:]):
            if a is not None and b is not None:
                near += _in(docs, self.follow([a, b]))
        return _round(bm25 * self.authority[docs] * (1 + rank.PHRASE * (near / pairs)) * self.fresh[docs])

    def top(self, docs: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first pages and their scores: three of each domain by score, then the others."""
        n, k = len(docs), 256
        while True:
            some = np.flatnonzero(score >= np.partition(score, n - k)[n - k]) if k < n else np.arange(n)
            some = some[np.lexsort((self.by_name[docs[some]], -score[some]))]
            placed = self._diverse(docs[some], k >= n)
            if placed is not None:
                return docs[some[placed]], score[some[placed]]
            k *= 16

    def _diverse(self, ordered: np.ndarray, whole: bool) -> np.ndarray | None:
        """The first places of pages by score; None if pages after them may come first."""
        host = self.host[ordered]
        order = np.argsort(host, kind="stable")
        new = np.append(True, np.diff(host[order]) != 0)[: len(host)]
        group = np.maximum.accumulate(np.where(new, np.arange(len(host)), 0))
        nth = np.empty(len(host), np.int64)
        nth[order] = np.arange(len(host)) - group
        early = np.flatnonzero(nth < rank.PER_DOMAIN)
        if len(early) >= self.first:
            return early[: self.first]
        return np.append(early, np.flatnonzero(nth >= rank.PER_DOMAIN))[: self.first] if whole else None

    def alone(self, t: int, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first pages of a word, and their scores, where no other word of the query is found; not those of ``without``."""
        if t not in self._ordered:
            docs = self.of(t)
            score = _round(self.part[self.starts[t] : self.starts[t + 1]] * self.authority[docs] * 1.0 * self.fresh[docs])
            order = np.lexsort((self.by_name[docs], -score))
            self._ordered[t] = docs[order], score[order]
        docs, score = self._ordered[t]
        k = 64
        while True:
            some = np.flatnonzero(~_in(docs[:k], without)) if len(without) else np.arange(min(k, len(docs)))
            placed = self._diverse(docs[some], k >= len(docs))
            if placed is not None:
                return docs[some[placed]], score[some[placed]]
            k *= 16

    def hits(self, terms: list[str], required: list[str], phrases: list[list[str]], excluded: list[str], site: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """The first hits of a query: pages, scores and the pools they are the first of.

        Those of the pages with one needed word or more come out only where
        fewer than five pages have enough of them.
        """
        known = [self.words[t] for t in sorted(set(terms)) if t in self.words]
        needed = [self.words[t] for t in dict.fromkeys(required) if t in self.words]
        ts = [self.words.get(t) for t in terms]
        lists = sorted((self.of(t) for t in needed), key=len)
        enough = max(math.ceil(rank.SOFT_SHARE * len(required) - 1e-9), 1)
        if not lists:
            return
        said = [[self.words.get(t) for t in p] for p in phrases]
        if any(None in p for p in said):
            return

        def fit(docs: np.ndarray) -> np.ndarray:
            for p in said:
                docs = docs[_in(docs, self.follow(p))]
            for t in excluded:
                if t in self.words:
                    docs = docs[~_in(docs, self.of(self.words[t]))]
            return docs if site is None else docs[self.site(site)[self.host[docs]]]

        if enough > 1:
            strict = self._with(lists, enough)
            strict = fit(strict)
            if len(strict):
                yield *self.top(strict, self.score(strict, known, ts)), _STRICT
            if len(strict) >= rank.RELAX_UNDER:
                return
        pools = _ANY if enough > 1 else _STRICT | _ANY
        if phrases or excluded or site is not None or any(a == b for a, b in zip(ts, ts[1:])):
            docs = fit(self._with(lists, 1))
            if len(docs):
                yield *self.top(docs, self.score(docs, known, ts)), pools
            return
        # Pages with one word of the query stand in the order of that word, whatever the query.
        several = self._several(known, needed)
        found = [self.alone(t, several) for t in needed]
        if len(several):
            found.append(self.top(several, self.score(several, known, ts)))
        docs, score = (np.concatenate(x) for x in zip(*found))
        if len(docs):
            yield *self.top(docs, score), pools

    def _with(self, lists: list[np.ndarray], n: int) -> np.ndarray:
        """The pages in so many of the lists, ascending."""
        if n > len(lists):
            return np.zeros(0, np.int64)
        if n == len(lists):
            docs = lists[0]
            for other in lists[1:]:
                docs = docs[_in(docs, other)]
            return docs
        return np.flatnonzero(np.bincount(np.concatenate(lists), minlength=len(self.ids)) >= n)

    def _several(self, known: list[int], needed: list[int]) -> np.ndarray:
        """The pages of two words of a query or more, a needed one among them, ascending."""
        *rest, longest = sorted((self.of(t) for t in known), key=len)
        if not rest:
            return np.zeros(0, np.int64)
        others, n = (rest[0], np.ones(len(rest[0]), np.int64)) if len(rest) == 1 else np.unique(np.concatenate(rest), return_counts=True)
        docs = others[n + _in(others, longest) > 1]
        if len(needed) == len(known):
            return docs
        return docs[np.logical_or.reduce([_in(docs, self.of(t)) for t in needed])]


def _answers(first: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def answer(block: Block, queries: pa.Table) -> pa.RecordBatch:
        of, docs, scores, pools = [], [np.zeros(0, np.int64)], [np.zeros(0)], []
        columns = (queries[c].to_pylist() for c in ("terms", "required", "phrases", "excluded", "site"))
        for i, asked in enumerate(zip(*columns)):
            for found, score, pool in block.hits(*asked):
                docs.append(found)
                scores.append(score)
                of += [i] * len(found)
                pools += [pool] * len(found)
        at = pa.array(np.concatenate(docs))
        qid = queries["qid"].combine_chunks().take(pa.array(of, pa.int64()))
        return pa.RecordBatch.from_arrays([qid, block.ids.take(at), block.domains.take(at), pa.array(np.concatenate(scores)), pa.array(pools, pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, {}, None
        for batch in batches:
            for number, kind, blob in zip(*(batch.column(c) for c in ("block", "kind", "blob"))):
                if number.as_py() != now:
                    now, held, block = number.as_py(), {_PAGES: [], _POSTINGS: []}, None
                if kind.as_py() != _QUERIES:
                    held[kind.as_py()].append(blob.as_py())
                    continue
                if held and held[_PAGES]:
                    block = Block(_read(held[_PAGES]), _read(held[_POSTINGS]) if held[_POSTINGS] else None, first)
                    held = {}
                if block is not None:
                    yield answer(block, _read([blob.as_py()]))

    return run


def first_hits(queries: DataFrame, index: Index, authority: DataFrame, now: Column, first: int = 10) -> DataFrame:
    """(qid, place, doc_id, score): the first places of each query (as of ``query_table_of``) after diversifying, scores to 4 digits.

    The same as ``rank.diversify`` of the rounded ``rank.score`` over all
    postings. The words that are asked for go to every task, at most the
    dictionary; queries are read in a stream, once for each block.
    """
    words = queries.select(F.explode(F.array_distinct(F.concat("terms", "excluded"))).alias("term")).distinct()
    idf = rank.idf(F.col("n_docs"), F.col("df")).alias("idf")
    known = materialize(words.join(index.terms.select("term", "df"), "term").join(F.broadcast(index.stats.select("n_docs"))).select("term", "df", idf), "vocabulary")
    size = known.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).join(F.broadcast(index.stats)).first()
    n = max(queries.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // BLOCK_POSTINGS), -(-size["n_docs"] // BLOCK_PAGES))

    block = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block")
    norm = rank.K1 * (1 - rank.B + rank.B * F.col("len") / F.lit(size["avg_len"]))
    factor = 1 + rank.AUTHORITY * F.coalesce("authority", F.lit(0.0))
    docs = index.docs.select(F.col("id").alias("doc_id"), "domain", norm.alias("norm"), rank.freshness(F.col("fetched_at"), now).alias("fresh_factor")).join(authority, "doc_id", "left")
    pages = docs.select(block, "doc_id", "domain", "norm", factor.alias("authority_factor"), "fresh_factor")
    posts = index.postings.select("term", "doc_id", "w", "pos").join(F.broadcast(known.select("term", "idf")), "term").select(block, "term", "doc_id", "idf", "w", "pos")
    asked = _packed(queries.select(F.lit(0).alias("block"), "qid", "terms", "required", "phrases", "excluded", "site"), _QUERIES, ASKED)
    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), "kind", "blob")
    rows = _packed(pages, _PAGES, PACKED).unionByName(_packed(posts, _POSTINGS, PACKED)).unionByName(everywhere)

    like = queries.select("qid").join(index.docs.select(F.col("id").alias("doc_id"), "domain").limit(0)).select("qid", "doc_id", "domain", F.lit(0.0).alias("score"), F.lit(0).alias("pool"))
    found = rows.repartitionById(n, F.col("block")).sortWithinPartitions("block", "kind").mapInArrow(_answers(first, _arrow(like)), like.schema)
    strict = F.count_if(F.col("pool").bitwiseAND(_STRICT) > 0).over(W.partitionBy("qid"))
    pool = F.when(F.col("_strict") < rank.RELAX_UNDER, _ANY).otherwise(_STRICT)
    kept = found.repartition("qid").withColumn("_strict", strict).where(F.col("pool").bitwiseAND(pool) > 0)
    return rank.diversify(kept.select("qid", "doc_id", "domain", "score"), first).select("qid", "place", "doc_id", "score")


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
