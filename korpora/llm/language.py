"""Languages of pages and of their parts by error-correcting output codes.

Every language has a codeword; one binary classifier over hashed n-grams
predicts each bit. A sentence gets the language whose codeword loses least
against the predicted bits, with each bit weighted by how reliable its
classifier proved on held-out samples, and is ambiguous if the runner-up loses
little more. N-grams never cross words, so a word adds a fixed vector to the
bits: the distinct words of many pages are scored at once, and a sentence is a
sum.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpora.llm.boilerplate import SAMPLE_PAGES, FurnitureModel, Lines, _flat, on_pages

#: Labelled sample texts that the classifiers are fitted on, at most.
SAMPLE_ROWS = 5000
#: Bits of the hashed n-grams, and bytes of the longest.
HASH_BITS, LONGEST = 14, 5
DIMENSIONS = 1 << HASH_BITS
#: Confidence under which a text is ambiguous; letters that a sentence needs.
AMBIGUOUS, LEAST_LETTERS = 0.6, 12
#: Consecutive whole sentences in another language that make a page mixed.
RUN = 2

# Codes and names that a label may spell a language by.
NAMES = {
    "en": "en eng english englisch anglais inglese inglés", "de": "de deu ger german deutsch allemand tedesco alemán",
    "fr": "fr fra fre french français francais französisch francese francés", "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo",
    "it": "it ita italian italiano italienisch italien", "pt": "pt por portuguese português", "nl": "nl nld dut dutch nederlands",
    "pl": "pl pol polish polski", "sv": "sv swe swedish svenska", "da": "da dan danish dansk", "no": "no nb nn nor norwegian norsk",
    "fi": "fi fin finnish suomi", "cs": "cs ces cze czech čeština", "ru": "ru rus russian русский", "uk": "uk ukr ukrainian українська",
    "el": "el ell gre greek ελληνικά", "tr": "tr tur turkish türkçe", "ar": "ar ara arabic العربية", "he": "he heb hebrew עברית",
    "ja": "ja jpn japanese 日本語", "zh": "zh zho chi chinese 中文", "ko": "ko kor korean 한국어", "hu": "hu hun hungarian magyar",
    "ro": "ro ron rum romanian română", "ca": "ca cat catalan català", "hi": "hi hin hindi हिन्दी",
}
LANGUAGE_OF = {name: code for code, names in NAMES.items() for name in names.split()}

def named_language(label: Column) -> Column:
    """The language that a label names, in whatever spelling; null if it names none."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}\p{M}]+)", 1)
    return F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])[base]


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 for each of n classes: the exhaustive code up to 7 classes, then fixed random columns."""
    if n <= 7:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    random = np.random.default_rng(7)
    columns: set[tuple] = set()
    while len(columns) < 15 * n:
        c = random.choice((1.0, -1.0), n)
        c *= c[0]
        if (c < 0).any():
            columns.add(tuple(c))
    return np.array(sorted(columns), float).T


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, starts, counts) of lower-case words with their edges.

    ``grams`` has a row for each byte and a column for each length of n-grams
    that begin there, and for the word as a whole at its first byte; places
    without one hold DIMENSIONS. ``starts`` is each word's first row, ``counts``
    the number of its n-grams.
    """
    marked = pc.cast(pc.binary_join_element_wise("<", words, ">", ""), pa.large_binary())
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32)
    starts = offsets[:-1] - offsets[0]
    size = np.diff(offsets)
    left = np.repeat(offsets[1:] - offsets[0], size) - np.arange(len(data))  # bytes to the word's end

    def dimension(h: np.ndarray, salt: int) -> np.ndarray:
        h = (h ^ np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        return ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - HASH_BITS)

    grams = np.full((len(data), LONGEST + 1), DIMENSIONS, np.int32)
    h = np.zeros(len(data), np.uint32)
    padded = np.append(data, np.zeros(LONGEST, np.uint32))
    for n in range(1, LONGEST + 1):
        h = h * np.uint32(257) + padded[n - 1 : n - 1 + len(data)] + np.uint32(1)
        grams[:, n - 1] = np.where(left >= n, dimension(h, n), DIMENSIONS)
    if len(data):
        power = np.cumprod(np.append(np.uint32(1), np.full(max(size.max() - 1, 0), 1_000_003, np.uint32)), dtype=np.uint32)
        whole = np.add.reduceat((data + np.uint32(1)) * power[np.repeat(size, size) - left], starts, dtype=np.uint32)
        grams[starts, LONGEST] = dimension(whole, 99)
    counts = 1 + sum(np.maximum(size - n + 1, 0) for n in range(1, LONGEST + 1))
    return grams, starts, counts


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-case words of texts, and the text of each; '' where there is none."""
    flat, of = _flat(pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " "), " "), " "))
    return flat.dictionary_encode(), of


class OutputCodes:
    """The fitted classifiers: a column of weights per bit."""

    def __init__(self, texts: list[str], labels: list[str], ridge: float = 1.0):
        self.languages = sorted(set(labels))
        if len(self.languages) < 2:  # nothing to tell apart
            return
        self.code = codewords(len(self.languages))
        words, of = _words(pa.array(texts, pa.string()))
        grams, starts, _ = word_grams(words.dictionary)
        ends = np.append(starts[1:], len(grams))
        x = np.zeros((len(texts), DIMENSIONS + 1), np.float32)
        for row, word in zip(of, words.indices.to_numpy()):
            np.add.at(x[row], grams[starts[word] : ends[word]].ravel(), 1.0)
        x = x[:, :DIMENSIONS]
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        y = self.code[[self.languages.index(label) for label in labels]]
        inverse = np.linalg.inv((x @ x.T).astype(float) + ridge * np.eye(len(texts)))
        dual = inverse @ y
        # Least squares gives the held-out prediction of each sample from the full fit.
        held_out = y - dual / np.diag(inverse)[:, None]
        self.weights = np.zeros((DIMENSIONS + 1, y.shape[1]), np.float32)
        self.weights[:DIMENSIONS] = x.T @ dual
        self.reliability = np.maximum(((held_out * y) > 0).mean(0) - 0.5, 0.01)
        self.reliability /= self.reliability.sum()

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the sums of the words' bits, the number of n-grams, the number of letters."""
        n = len(texts)
        if not n:
            return np.zeros((0, len(self.reliability))), np.zeros(0), np.zeros(0)
        words, of = _words(texts)
        grams, starts, counts = word_grams(words.dictionary)
        per_byte = sum(self.weights[grams[:, k]] for k in range(grams.shape[1]))
        bits = np.add.reduceat(per_byte, starts, axis=0)
        letters = pc.utf8_length(words.dictionary).to_numpy()
        bits[letters == 0], counts = 0, np.where(letters == 0, 0, counts)
        first = np.searchsorted(of, np.arange(n))
        code = words.indices.to_numpy()
        return np.add.reduceat(bits[code], first, axis=0).astype(float), np.add.reduceat(counts[code], first), np.add.reduceat(letters[code], first)

    def decide(self, sums: np.ndarray, grams: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, confidence) per text from its sums; -1 and 0 for too few letters."""
        bits = sums / np.sqrt(np.maximum(grams, 1))[:, None]
        loss = np.stack([np.exp(-2 * bits * word) @ self.reliability for word in self.code], 1)
        likely = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        enough = letters >= LEAST_LETTERS
        return np.where(enough, loss.argmin(1), -1), np.where(enough, likely.max(1) / likely.sum(1), 0.0)

    def language_of(self, text: str) -> tuple[str | None, float]:
        """(language, confidence) of one text."""
        if len(self.languages) < 2:
            return None, 0.0
        lang, sure = self.decide(*self.sums(pa.array([text], pa.string())))
        return (self.languages[lang[0]] if lang[0] >= 0 else None), float(sure[0])


def fit(samples: DataFrame, rows: int = SAMPLE_ROWS) -> OutputCodes:
    """Classifiers from at most ``rows`` labelled samples (lang, text), as many of each language as there are."""
    known = samples.where("lang IS NOT NULL AND text <> ''").select("lang", "text")
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    chosen = known.withColumn("nth", nth).where(F.col("nth") <= rows).orderBy("nth", "lang").limit(rows).collect()
    return OutputCodes([r["text"] for r in chosen], [r["lang"] for r in chosen])


def judge(page: np.ndarray, number: np.ndarray, text: pa.Array, pages: int, codes: OutputCodes) -> list[tuple[str | None, float, list[tuple]]]:
    """(language, confidence, segments) of each of ``pages`` pages, from their lines in order.

    A segment is (language, first line, last line, sentences, confidence,
    ambiguous): a run of whole sentences in another language than most of the
    text. Sentences of too few letters neither count nor break a run; an
    ambiguous sentence does not either, and is a segment of its own, so marked.
    """
    nothing: list[tuple[str | None, float, list[tuple]]] = [(None, 0.0, []) for _ in range(pages)]
    if len(codes.languages) < 2 or not len(text):
        return nothing
    marked = pc.replace_substring_regex(text, r"([.!?…][\"'”’»)\]]*)\s+", "\\1\n")
    sentences, line = _flat(pc.split_pattern(marked, "\n"))
    whole = pc.match_substring_regex(sentences, r"[.!?][\"'”’»)\]]*\s*$").to_numpy(zero_copy_only=False)
    of, number = page[line], number[line]
    sums, grams, letters = codes.sums(sentences)
    lang, sure = codes.decide(sums, grams, letters)
    n = len(codes.languages)
    told = lang >= 0
    cell = of[told] * n + lang[told]
    weight = np.bincount(cell, letters[told], pages * n).reshape(pages, n)
    trust = np.bincount(cell, letters[told] * sure[told], pages * n).reshape(pages, n)
    main = n - 1 - weight[:, ::-1].argmax(1)
    total = weight.sum(1)
    confidence = trust[np.arange(pages), main] / np.maximum(total, 1)
    unknown = total == 0
    if unknown.any():  # no sentence has enough letters: all of them together
        joined = [np.bincount(of, v, pages) for v in (*sums.T, grams, letters)]
        all_lang, all_sure = codes.decide(np.stack(joined[:-2], 1), joined[-2], joined[-1])
        main, confidence = np.where(unknown, all_lang, main), np.where(unknown, all_sure, confidence)
    out = [(codes.languages[m] if m >= 0 else None, float(c), []) for m, c in zip(main, confidence)]
    other = told & whole & (lang != main[of])
    for p in np.unique(of[other]):
        a, b = np.searchsorted(of, [p, p + 1])
        out[p][2].extend(_segments(lang[a:b], sure[a:b], whole[a:b], number[a:b], int(main[p]), codes.languages))
    return out


def _segments(lang, sure, whole, number, main: int, languages: list[str]) -> list[tuple]:
    found, run = [], []

    def close() -> None:
        if run:
            found.append((languages[lang[run[0]]], int(number[run[0]]), int(number[run[-1]]), len(run), float(np.mean(sure[run])), False))
            run.clear()

    for i in range(len(lang)):
        if lang[i] < 0:
            continue
        if sure[i] < AMBIGUOUS:
            if whole[i] and lang[i] != main:
                found.append((languages[lang[i]], int(number[i]), int(number[i]), 1, float(sure[i]), True))
            continue
        if run and (lang[i] != lang[run[0]] or not whole[i]):
            close()
        if whole[i] and lang[i] != main:
            run.append(i)
    close()
    return sorted(found, key=lambda s: s[1:3])


_SEGMENT = ("lang", "first_line", "last_line", "sentences", "confidence", "ambiguous")
_SEGMENTS = "array<struct<lang: string, first_line: int, last_line: int, sentences: int, confidence: double, ambiguous: boolean>>"
_ARROW_SEGMENTS = pa.list_(pa.struct(list(zip(_SEGMENT, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())))))


def page_languages(docs: DataFrame, samples: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(id, label, named, lang, confidence, ambiguous, segments) of every page with a text.

    ``label`` is the stored one and ``named`` the language it names, if any;
    ``lang`` is that of most of the page's article (of its lines without the
    page's furniture, or of all lines if nothing else is there), ``ambiguous``
    whether its confidence is under AMBIGUOUS. A text without enough letters
    has no ``lang`` and confidence 0, as has every page if the samples are of
    fewer than two languages. Pages with a null or blank text give no row;
    equal rows of an id count once.
    """
    codes = fit(samples)

    def work(part: pa.RecordBatch, lines: Lines, found: np.ndarray, model: FurnitureModel) -> pa.RecordBatch:
        own = np.bincount(lines.page, ~found, lines.pages) > 0
        keep = ~found | ~own[lines.page]
        told = judge(lines.page[keep], lines.number[keep], lines.text.filter(pa.array(keep)), lines.pages, codes)
        rows = np.unique(lines.page)
        kept = [told[r] for r in rows]
        return pa.RecordBatch.from_arrays(
            [
                part.column("id").take(pa.array(rows)), pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.float64()),
                pa.array([k[1] < AMBIGUOUS for k in kept], pa.bool_()), pa.array([[dict(zip(_SEGMENT, s)) for s in k[2]] for k in kept], _ARROW_SEGMENTS),
            ],
            ["id", "lang", "confidence", "ambiguous", "segments"],
        )

    kind = docs.schema["id"].dataType.simpleString()
    judged = on_pages(docs, work, f"id {kind}, lang string, confidence double, ambiguous boolean, segments {_SEGMENTS}", sample_pages).dropDuplicates(["id"])
    labels = docs.select("id", F.col("lang").alias("label")).dropDuplicates(["id"])
    return judged.join(labels, "id").select("id", "label", named_language(F.col("label")).alias("named"), "lang", "confidence", "ambiguous", "segments")


def language_issues(pages: DataFrame) -> DataFrame:
    """(id, issue, lang) from ``page_languages``: missing and wrong labels, and each other language of a page with a run of RUN sentences in it."""
    label = pages.where("lang IS NOT NULL AND (named IS NULL OR named <> lang)").select(
        "id", F.when(F.col("named").isNull(), "missing").otherwise("wrong").alias("issue"), "lang"
    )
    runs = F.filter("segments", lambda s: (s["sentences"] >= RUN) & ~s["ambiguous"])
    mixed = pages.select("id", F.lit("mixed").alias("issue"), F.explode(F.array_distinct(F.transform(runs, lambda s: s["lang"]))).alias("lang"))
    return label.unionByName(mixed)
