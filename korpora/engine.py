"""One object that answers queries, for callers who want results and not plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.operators import explain, graph, query, rank
from korpora.operators.index import POSTING_CAP, Index, limited_terms, recapped
from korpora.session import materialize

MAX_PER_PAGE, MAX_PAGE = 50, 100


@dataclass
class Answer:
    """A page of results with what is to be said about the query."""

    query: str
    terms: list[str]
    total: int
    page: int
    per_page: int
    total_pages: int
    correction: str | None
    limited: list[str]
    operators: dict | None
    results: list[dict] = field(default_factory=list)


class SearchEngine:
    """Searches over one index; authority is computed once."""

    def __init__(self, index: Index, cap: int = POSTING_CAP):
        self.index = index if index.cap == cap else recapped(index, cap)
        self.authority = materialize(graph.pagerank(index.docs, index.edges), "authority")
        self.inlinks = materialize(graph.inlink_counts(index.docs, index.edges), "inlinks")
        self._answers: dict[tuple, Answer] = {}

    def search(self, text: str, now: str, page: int = 1, per_page: int = 10, allow_correction: bool = True) -> Answer:
        """Rank, diversify, explain and cut out one page; a repeated call is answered from memory (of 200 calls)."""
        if len(text) > query.MAX_QUERY:
            raise ValueError("query_too_long")
        page, per_page = min(max(page, 1), MAX_PAGE), min(max(per_page, 1), MAX_PER_PAGE)
        key = (text, now, page, per_page, allow_correction)
        if key not in self._answers:
            while len(self._answers) >= 200:
                del self._answers[next(iter(self._answers))]
            self._answers[key] = self._search(*key)
        return self._answers[key]

    def _search(self, text: str, now: str, page: int, per_page: int, allow_correction: bool) -> Answer:
        spark, index = self.index.docs.sparkSession, self.index
        asked = query.parse(text)
        correction = query.correct(asked, index.terms) if allow_correction else None
        if correction:
            asked = query.parse(correction)
        queries, at = query.query_table(spark, [asked]), F.lit(now).cast("timestamp")
        scored = rank.score(queries, index, self.authority, at)
        hits = explain.reasons(rank.page_of(scored, page, per_page), queries, self.inlinks, at)
        # Wide columns join the rows of one page alone.
        wide = index.docs.select(F.col("id").alias("doc_id"), "url", "title", explain.snippet_source(F.col("description"), F.col("text")).alias("source"))
        shown = explain.with_snippet(hits.join(wide, "doc_id").withColumn("terms", F.lit(asked.terms)), "source", "terms").orderBy("place")
        rows = [r.asDict(recursive=True) for r in shown.select("place", "doc_id", "url", "domain", "title", "snippet", F.round("score", 4).alias("score"), "matched", "missing", "reasons", "total").collect()]
        total = rows[0]["total"] if rows else 0 if page == 1 else scored.count()
        capped = limited_terms(index.terms, index.cap).where(F.col("term").isin(asked.unique)) if asked.terms else None
        operators = {"phrases": [s for s, _ in asked.phrases], "excluded": [s for s, _ in asked.excluded], "site": asked.site} if asked.has_operators else None
        return Answer(
            text, asked.terms, total, page, per_page, max(1, -(-total // per_page)), correction, [r["term"] for r in capped.collect()] if capped is not None else [], operators,
            [r | {"title": r["title"] or r["url"]} for r in rows],
        )

    def suggest(self, typed: str) -> list[str]:
        return [r["display"] for r in query.suggest(self.index.terms, typed).collect()]

    def stats(self) -> dict:
        return self.index.stats.first().asDict() | {"n_terms": self.index.terms.count()}

    def doc(self, url: str) -> DataFrame:
        """The stored page of a URL."""
        return self.index.docs.where(F.col("url") == url)
