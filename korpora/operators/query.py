"""The query language, correction of unknown words, and suggestions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpora.functions.text import STEMMED_STOPWORDS, WORD, normalize, py_tokens, stem_all
from korpora.session import materialize

# The operators' syntax.
_PHRASE = re.compile(r'"([^"]+)"|“([^”]+)”')
_SITE = re.compile(r"(?:^|\s)site:([a-z0-9.-]+\.[a-z]{2,})", re.I)
_EXCLUDE = re.compile(r'(?:^|\s)-([^\s"]+)')
MAX_QUERY = 500
# The same for the JVM, where white space is to be that of all scripts and case is to be ignored.
_SITE_J, _EXCLUDE_J = "(?iU)" + _SITE.pattern, "(?U)" + _EXCLUDE.pattern
_BREAK = "\x01"


@dataclass
class Query:
    """A parsed query; ``surfaces`` are the words of ``terms`` as typed."""

    raw: str
    free: str = ""
    terms: list[str] = field(default_factory=list)
    surfaces: list[str] = field(default_factory=list)
    phrases: list[tuple[str, list[str]]] = field(default_factory=list)
    excluded: list[tuple[str, str]] = field(default_factory=list)
    site: str | None = None

    @property
    def unique(self) -> list[str]:
        return list(dict.fromkeys(self.terms))

    @property
    def required(self) -> list[str]:
        content = [t for t in self.unique if t not in STEMMED_STOPWORDS]
        return content or self.unique

    @property
    def has_operators(self) -> bool:
        return bool(self.phrases or self.excluded or self.site)


def parse(raw: str | None) -> Query:
    """Phrases first, so that operators within them stay literal; then the site (the last wins), then excluded words."""
    q = Query(raw or "")

    def phrase(m: re.Match) -> str:
        surface = (m[1] if m[1] is not None else m[2]).strip()
        words = py_tokens(surface)
        if words:
            q.phrases.append((surface, [t for t, _ in words]))
            phrase_words.extend(words)
        return " "

    def site(m: re.Match) -> str:
        q.site = m[1].lower()
        return " "

    def exclude(m: re.Match) -> str:
        words = py_tokens(m[1])
        if words:
            q.excluded.append((m[1], words[0][0]))
        return " "

    phrase_words: list[tuple[str, str]] = []
    text = _EXCLUDE.sub(exclude, _SITE.sub(site, _PHRASE.sub(phrase, q.raw)))
    q.free = re.sub(r"\s+", " ", re.sub(r'["“”]', " ", text)).strip()
    words = py_tokens(q.free) + phrase_words
    q.terms, q.surfaces = [t for t, _ in words], [s for _, s in words]
    return q


def nearest_terms(unknown: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, near, display, distance, df): the closest indexed term of each unknown one.

    A term of up to 6 letters may be 1 edit away, a longer one 2; the first
    letter must agree. Of the closest, the most frequent wins, then the first in
    order. The first letter and the length are an equi-join key, so a term meets
    only its own block of the vocabulary; unknown terms are few (those of
    queries) and the edit distance stops at its bound.
    """
    n = F.length("term")
    most = F.when(n <= 6, 1).otherwise(2)
    wanted = (
        unknown.select("term").where("term <> ''").distinct().withColumn("most", most)
        .select("term", "most", F.substr("term", F.lit(1), F.lit(1)).alias("first"), F.explode(F.sequence(n - F.col("most"), n + F.col("most"))).alias("n"))
    )
    vocabulary = terms.where("df > 0").select(F.col("term").alias("near"), "display", "df", F.substr("term", F.lit(1), F.lit(1)).alias("first"), n.alias("n"))
    apart = F.levenshtein("term", "near")
    found = wanted.join(vocabulary, ["first", "n"]).withColumn("distance", apart).where("distance <= most")
    best = F.min_by(F.struct("near", "display", "distance", "df"), F.struct("distance", -F.col("df"), "near"))
    return found.groupBy("term").agg(best.alias("b")).select("term", "b.near", "b.display", "b.distance", "b.df")


def correct(query: Query, terms: DataFrame) -> str | None:
    """The query with unknown words of its free text replaced by the display form of the nearest term; None if nothing changes."""
    words = list(dict.fromkeys(py_tokens(query.free)))
    stems = list(dict.fromkeys(t for t, _ in words))
    if not stems:
        return None
    known = {r["term"] for r in terms.where(F.col("term").isin(stems) & (F.col("df") > 0)).select("term").collect()}
    missing = [t for t in stems if t not in known]
    if not missing:
        return None
    asked = terms.sparkSession.createDataFrame([(t,) for t in missing], "term string")
    fixes = {r["term"]: r["display"] for r in nearest_terms(asked, terms).collect()}
    if not fixes:
        return None

    def fixed(word: str) -> str:
        own = py_tokens(word)
        return fixes.get(own[0][0], word) if own else word

    free = " ".join(fixed(w) for w in query.free.split())
    rewritten = query.raw.replace(query.free, free, 1).strip()
    return None if rewritten.lower() == query.raw.strip().lower() else rewritten


def corrections(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(q, corrected) of the different queries (q) that ``correct`` changes, for a table of any size.

    A word of the free text whose stem is not indexed becomes the display form
    of the nearest term. As the rewritten free text takes the place of the old
    one in the query, a query that does not hold it letter for letter (operators
    within, two spaces) stays as it is.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.col("q3"), "[\"“”]", " "), r"(?U)\s+", " "))
    free = (
        texts.select("q").where("q IS NOT NULL").distinct().withColumn("q1", F.regexp_replace("q", _PHRASE.pattern, " ")).withColumn("q2", F.regexp_replace("q1", _SITE_J, " "))
        .withColumn("q3", F.regexp_replace("q2", _EXCLUDE_J, " ")).select("q", bare.alias("free")).where(F.contains("q", "free") & (F.col("free") != ""))
    )
    words = free.select("q", "free", F.posexplode(F.split("free", " ")).alias("at", "word"))
    stemmed = words.withColumn("term", F.try_element_at(stem_all(F.regexp_extract_all(normalize(F.col("word")), F.lit(WORD), 0)), F.lit(1)))
    stems = materialize(stemmed, "words")
    unknown = stems.select("term").where("term IS NOT NULL").distinct().join(terms.where("df > 0").select("term"), "term", "left_anti")
    fixes = nearest_terms(unknown, terms).select("term", "display")
    fixed = stems.join(fixes, "term", "left").groupBy("q", "free").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("display", "word").alias("w")))).alias("ws"), F.count("display").alias("n"))
    text = F.array_join(F.transform("ws", lambda w: w["w"]), " ")
    start = F.instr("q", F.col("free"))
    whole = F.trim(F.concat(F.substr("q", F.lit(1), start - 1), text, F.substr("q", start + F.length("free"))))
    return fixed.where("n > 0").select("q", whole.alias("corrected")).where(F.lower("corrected") != F.lower(F.trim("q")))


def suggest(terms: DataFrame, typed: str, n: int = 8) -> DataFrame:
    """(display, df): up to ``n`` words that continue the last one typed, the most frequent first."""
    words = py_tokens(typed)
    prefix = words[-1][0] if words else None
    if not prefix:
        return terms.where(F.lit(False)).select("display", "df")
    order = W.partitionBy("display").orderBy(F.desc("df"), "term")
    return (
        terms.where(F.col("term").startswith(prefix)).withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
        .orderBy(F.desc("df"), "term").limit(n).select("display", "df")
    )


def query_table(spark: SparkSession, queries: list[Query]) -> DataFrame:
    """(qid, terms, required, phrases, excluded, site) of a list of queries, qid from 0; the list is the driver's own."""
    rows = [(i, q.terms, q.required, [p for _, p in q.phrases], [t for _, t in q.excluded], q.site) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "qid int, terms array<string>, required array<string>, phrases array<array<string>>, excluded array<string>, site string")


def query_table_of(texts: DataFrame) -> DataFrame:
    """The same for a table (qid, q) of queries of any size, read as ``parse`` does but without Python; a null query is an empty one."""

    def removed(text: str, pattern: str) -> Column:
        return F.regexp_replace(text, pattern, " ")

    def words(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(WORD), 0)

    def normal(parts: Column) -> Column:
        # One text, so that all parts are normalised in one step.
        return F.split(normalize(F.array_join(parts, _BREAK)), _BREAK)

    none = F.array().cast("array<string>")
    split = (
        texts.select("qid", F.coalesce("q", F.lit("")).alias("q0"))
        .withColumn("ph", F.regexp_extract_all("q0", F.lit(_PHRASE.pattern), 0)).withColumn("q1", removed("q0", _PHRASE.pattern))
        .withColumn("sites", F.regexp_extract_all("q1", F.lit(_SITE_J), 1)).withColumn("q2", removed("q1", _SITE_J))
        .withColumn("ex", F.regexp_extract_all("q2", F.lit(_EXCLUDE_J), 1)).withColumn("q3", removed("q2", _EXCLUDE_J))
        .select(
            "qid", F.lower(F.try_element_at("sites", F.lit(-1))).alias("site"), normal(F.col("ph")).alias("ph"), normal(F.col("ex")).alias("ex"), normalize(F.col("q3")).alias("free"),
        )
    )
    read = split.select(
        "qid", "site", F.filter(F.transform("ph", lambda p: stem_all(words(p))), lambda p: F.size(p) > 0).alias("phrases"),
        stem_all(F.filter(F.transform("ex", lambda e: F.try_element_at(words(e), F.lit(1))), lambda e: e.isNotNull())).alias("excluded"), stem_all(words(F.col("free"))).alias("free"),
    ).withColumn("terms", F.concat("free", F.flatten("phrases")))
    unique = F.array_distinct("terms")
    content = F.filter(unique, lambda t: ~t.isin(*STEMMED_STOPWORDS))
    return read.select("qid", "terms", F.when(F.size(content) > 0, content).otherwise(F.coalesce(unique, none)).alias("required"), "phrases", "excluded", "site")


__all__ = ["Query", "correct", "corrections", "nearest_terms", "parse", "query_table", "query_table_of", "suggest"]
