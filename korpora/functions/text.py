"""Normalising, tokenising and stemming as column expressions (no Python workers)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not count towards a query's coverage.
STOPWORDS = (
    "a an and are as at be by for from has have how i in is it its of on or that the their "
    "this to was were what when where which who will with you your"
).split()

WORD = r"[\p{L}\p{N}]+"
_ASCII = r"^[\x00-\x{7f}]*$"
_ACCENTS = r"[\x{300}-\x{36f}]+"


def _icu(method: str, text: Column) -> Column:
    """A normalisation form by the ICU library that Spark ships, so that no text leaves the JVM."""
    return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(True))


def decomposed(text: Column) -> Column:
    """NFKD of a text; null stays null."""
    return F.when(text.rlike(_ASCII), text).otherwise(F.when(text.isNotNull(), _icu("decompose", text)))


def composed(text: Column) -> Column:
    """NFKC of a text; null stays null."""
    return F.when(text.rlike(_ASCII), text).otherwise(F.when(text.isNotNull(), _icu("compose", text)))


def normalize(text: Column) -> Column:
    """Compatibility-decomposed text without accents, in lower case; null becomes ''."""
    held = F.coalesce(text, F.lit(""))
    return F.lower(F.when(held.rlike(_ASCII), held).otherwise(F.regexp_replace(_icu("decompose", held), _ACCENTS, "")))


def tokenize(text: Column) -> Column:
    """All runs of letters and digits of the normalised text, in order."""
    return F.regexp_extract_all(normalize(text), F.lit(WORD), 0)


def _cut(w: Column, n: int) -> Column:
    return F.substr(w, F.lit(1), F.length(w) - n)


def _plural(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when(n <= 3, w).when(w.endswith("sses"), _cut(w, 2)).when(w.endswith("ies") & (n > 4), F.concat(_cut(w, 3), F.lit("y")))
        .when(w.endswith("s") & ~w.rlike("[sui]s$"), _cut(w, 1)).otherwise(w)
    )


def _verb(w: Column) -> Column:
    n = F.length(w)
    return F.when((n > 5) & w.endswith("ing"), _cut(w, 3)).when((n > 4) & w.rlike("(ed|ly)$"), _cut(w, 2)).otherwise(w)


def _final_e(w: Column) -> Column:
    return F.when((F.length(w) > 3) & w.endswith("e"), _cut(w, 1)).otherwise(w)


def _double(w: Column) -> Column:
    last = F.right(w, F.lit(1))
    return F.when((F.length(w) > 3) & (last == F.substr(w, F.length(w) - 1, F.lit(1))) & ~last.isin(*"aeiou"), _cut(w, 1)).otherwise(w)


def stem_all(words: Column) -> Column:
    """Light stems of an array of words; one pass per stage, so that no stage repeats the one before."""
    short = F.transform(words, _plural)
    for stage in (_verb, _final_e, _double):
        short = F.transform(short, stage)
    return short


def stem(word: Column) -> Column:
    """The stem of one word."""
    return F.element_at(stem_all(F.array(word)), 1)


def py_normalize(text: str) -> str:
    """``normalize`` for the driver."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(c) <= 0x36F).lower()


def py_stem(w: str) -> str:
    """``stem`` for the driver, where a single query is parsed."""
    if len(w) <= 3:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies") and len(w) > 4:
        w = w[:-3] + "y"
    elif w[-1] == "s" and w[-2] not in "sui":
        w = w[:-1]
    if len(w) > 5 and w.endswith("ing"):
        w = w[:-3]
    elif len(w) > 4 and w.endswith(("ed", "ly")):
        w = w[:-2]
    if len(w) > 3 and w[-1] == "e":
        w = w[:-1]
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    return w


def py_tokens(text: str) -> list[tuple[str, str]]:
    """[(stem, surface), ...] of a text."""
    words, run = [], ""
    for c in py_normalize(text) + " ":
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            words.append(run)
            run = ""
    return [(py_stem(w), w) for w in words]


STEMMED_STOPWORDS = sorted({py_stem(w) for w in STOPWORDS})


def content_terms(terms: Column) -> Column:
    """The terms that are no stopwords, repeats kept; all of them if none is left."""
    content = F.filter(terms, lambda t: ~t.isin(*STEMMED_STOPWORDS))
    return F.when(F.size(content) > 0, content).otherwise(terms)
