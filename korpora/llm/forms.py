"""One consistent form of text that looks the same.

A value is compatibility-normalised, ignorable characters are deleted and every
space becomes the ordinary one. A word of Latin letters with letters of another
script among them is then searched as a lattice: every letter may stay, become
the Latin letter it looks like, or, of a Latin one, a look-alike in the other
scripts of the word. Viterbi's algorithm finds the most likely reading under
character bigrams of Latin words, even chances for letters of other scripts, and
a price for each change of script.
Values of plain characters alone never leave the JVM.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alikes of Latin letters.
LOOK_ALIKES = {
    "a": "аαɑ", "b": "Ьь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "f": "ƒ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "кκ", "l": "ӏ",
    "m": "м", "n": "пη", "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "гг", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝωш", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Ꮮ",
    "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "R": "Ꭱ", "S": "Ѕ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    "ë": "ё", "ï": "ї", "ó": "ό", "ä": "ӓ", "ö": "ӧ",
}
LATIN_OF = {other: latin for latin, others in LOOK_ALIKES.items() for other in others}

# Fixed value: printable ASCII, line ends, tab, and letters and marks that no rule changes.
PLAIN = r"^[\t\n\r -~\x{a1}-\x{a7}\x{a9}\x{ab}\x{ac}\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2039}\x{203a}\x{20ac}\x{25a0}-\x{25ff}]*$"

_ACCENTS = ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
_INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_UNCHANGED = "…‥․"
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=100_000)
def kind(c: str) -> str | None:
    """'compat', 'accent', 'invisible' or 'space' of a character that is a case by itself."""
    code, cat = ord(c), unicodedata.category(c)
    if any(a <= code <= b for a, b in _ACCENTS):
        return "accent"
    if cat == "Cf" or code in _INVISIBLE or cat == "Cc" and c not in "\t\n\r\x0b\x0c\x85\x1c\x1d\x1e":
        return "invisible"
    if cat == "Zs":
        return None if c == " " else "space"
    if c not in _UNCHANGED:
        form = unicodedata.normalize("NFKC", c)
        if form != c and (cat[0] in "LN" or form.isalnum()):
            return "compat"
    return None


@lru_cache(maxsize=100_000)
def script(c: str) -> str:
    """Script of a letter by its name; '' for anything else."""
    return unicodedata.name(c, "?").split(" ")[0] if c.isalpha() else ""


def mixed(word: str) -> bool:
    scripts = {script(c) for c in word} - {""}
    return "LATIN" in scripts and len(scripts) > 1


def common(c: str) -> bool:
    """Whether a letter is of the Greek or Russian alphabet."""
    return "Α" <= c <= "ω" or "А" <= c <= "я" or c in "Ёё"


#: The look-alike of a Latin letter in another alphabet.
OTHER_OF = {(latin, script(x)): x for latin, others in LOOK_ALIKES.items() for x in reversed(others) if common(x)}


class Lattice:
    """Readings of mixed words under bigrams of Latin words."""

    #: Log prices of a change of script, of replacing a letter, and of a letter of another alphabet, a common one or not.
    SWITCH, REPLACE, FOREIGN, RARE = 6.0, 0.7, math.log(40), math.log(400)
    #: Log price of the end of a word of another alphabet.
    END = math.log(5)

    def __init__(self, pairs: Mapping[tuple[str, str], int]):
        firsts: Counter = Counter()
        for (a, _), n in pairs.items():
            firsts[a] += n
        self.pairs, self.firsts = dict(pairs), dict(firsts)

    def price(self, a: str, b: str) -> float:
        """-ln of the probability that b follows a, mixed with even chances."""
        return -math.log(0.9 * self.pairs.get((a, b), 0) / max(1, self.firsts.get(a, 0)) + 0.1 / 40)

    def read(self, word: str) -> str:
        """The most likely reading of a word, of one script if its letters allow it."""
        paths = {("^", "LATIN"): (0.0, "")}
        others = {script(c) for c in word} - {"", "LATIN"}
        for c in word:
            reach: dict[tuple[str, str], tuple[float, str]] = {}
            like = [LATIN_OF[c]] if c in LATIN_OF else [OTHER_OF[c, s] for s in others if (c, s) in OTHER_OF]
            options = [(c, 0.0), *((x, self.REPLACE) for x in like)]
            for option, cost in options:
                kind_of = script(option)
                for (a, before), (total, path) in paths.items():
                    step = total + cost + (self.SWITCH if kind_of and kind_of != before and a != "^" else 0.0)
                    step += self.price(a, option.lower()) if kind_of in ("LATIN", "") else self.FOREIGN if common(option) else self.RARE
                    state = (option.lower(), kind_of or before)
                    if state not in reach or step < reach[state][0]:
                        reach[state] = (step, path + option)
            paths = reach
        ends = [(total + (self.price(a, "$") if s == "LATIN" else self.END), path) for (a, s), (total, path) in paths.items()]
        return min(ends)[1] if ends else word


def consistent(text: str, lattice: Lattice) -> tuple[str, list[str]]:
    """The consistent form of a text and the issues found in it, sorted."""
    found = {k for k in map(kind, set(text)) if k}
    form = unicodedata.normalize("NFKC", "".join(c for c in text if kind(c) != "invisible"))
    form = "".join(" " if kind(c) == "space" else c for c in form if kind(c) != "invisible")

    def read(match: re.Match) -> str:
        word = match.group()
        if not mixed(word):
            return word
        reading = lattice.read(word)
        if reading != word or mixed(reading):
            found.add("mixed")
        return reading

    if not form.isascii():
        form = unicodedata.normalize("NFKC", _WORD.sub(read, form))
    return form, sorted(found)


_RESULT = T.StructType([T.StructField("form", T.StringType()), T.StructField("issues", T.ArrayType(T.StringType()))])


def pair_counts(samples: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, n): how often b follows a in the words of all sample texts, with '^' before and '$' after a word.

    Of a word without Latin letters only the start is counted: it counts towards
    '^', and no reading is priced by its other pairs. So the rows are as many as
    pairs of Latin letters and first letters, however many texts there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(_WORD.findall(text.lower()))
            for word, n in words.items():
                if word.isalpha() and not mixed(word):
                    for pair in zip("^" + word, word + "$") if script(word[0]) == "LATIN" else [("^", word[0])]:
                        pairs[pair] += n
        yield pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "n": list(pairs.values())}, pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))

    texts = samples.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def fit_lattice(samples: DataFrame, text_col: str = "text") -> Lattice:
    """Bigrams of all sample texts."""
    return Lattice({(r["a"], r["b"]): r["n"] for r in pair_counts(samples, text_col).collect()})


def form_of(value: Column, lattice: Lattice) -> tuple[Column, Column]:
    """Columns with the consistent form of ``value`` and its issues.

    Null stays null without issues; '' and plain values are their own form.
    Issues are 'compat' (compatibility variant of a letter or digit), 'accent'
    (apart from its letter), 'invisible', 'space' and 'mixed' (a word of Latin
    letters with letters of another script among them).
    """

    @F.pandas_udf(_RESULT)
    def work(values: pd.Series) -> pd.DataFrame:
        out = [(None, None) if v is None else consistent(v, lattice) for v in values]
        return pd.DataFrame({"form": [o[0] for o in out], "issues": [o[1] for o in out]})

    done = work(F.when(~value.rlike(PLAIN), value))
    return F.coalesce(done["form"], value), F.coalesce(done["issues"], F.array().cast("array<string>"))


def text_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(place, shard, row_key, value) of docs.title, docs.text and terms.display; one row per value, null values too."""
    places = F.explode(
        F.array(F.struct(F.lit("docs.title").alias("place"), F.col("title").alias("value")), F.struct(F.lit("docs.text").alias("place"), F.col("text").alias("value")))
    )
    d = docs.select("shard", F.col("id").cast("string").alias("row_key"), places.alias("p")).select("p.place", "shard", "row_key", "p.value")
    return d.unionByName(terms.select(F.lit("terms.display").alias("place"), "shard", F.col("term").alias("row_key"), F.col("display").alias("value")))


def consistent_forms(docs: DataFrame, terms: DataFrame, samples: DataFrame) -> DataFrame:
    """(place, shard, row_key, form, issues) of every title, text and display form.

    One row per value of the tables, repeated rows and null values included
    (null form, no issues); extra columns are ignored. Nothing is shuffled but the
    counts of pairs of letters in the samples.
    """
    form, issues = form_of(F.col("value"), fit_lattice(samples))
    return text_places(docs, terms).select("place", "shard", "row_key", form.alias("form"), issues.alias("issues"))
