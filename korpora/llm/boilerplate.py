"""The page's own article without the furniture around it.

A page is a tree: the page, its blocks (lines without a blank line between, or
runs of lines of one build where every line stands alone) and the lines. Lines
get features of their own, of their siblings and of their block, the tokens'
leaning towards furniture, and how many pages of the site repeat them.
Gradient-boosted trees give each line a score, a second model sees the scores of
the neighbours, and a decoder over the tree takes the best labelling in which a
block that is furniture holds no article lines and the other way round.

No page is labelled. The models learn from a bounded sample of pages on which a
few sure signs label some of the lines: lines that the site repeats, long
sentences that it does not, the title, and what stands outside of the two.

Pages are worked on many at a time: the lines of a batch are one Arrow array, and
their features come from its string kernels and from sums by page and block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpora.functions.text import composed
from korpora.llm.gbt import BoostedTrees
from korpora.llm.lines import letters
from korpora.session import materialize

#: Pages that the models are fitted on, at most.
SAMPLE_PAGES = 2500
#: Share of a site's pages beyond which a line is a sure sign, and pages at least.
SURE_RATE, SURE_PAGES = 0.08, 3
#: Price of a block with lines of both kinds.
MIXED_PRICE = 1.5
#: Words of an entry of a menu at most, and the share of its lines that are furniture at least.
ENTRY_WORDS, ENTRY_RATE = 4, 0.8
#: Pages of a batch that are scored together.
BATCH_PAGES = 1000

# Patterns that Arrow reads: a sentence's end, separators, bullets, what closes a line.
_ENDS = r"[.!?…][\"'”’»)\]]*(?:\s|$)"
_CLOSED = r"[.!?…:][\"'”’»)\]]*$"
_SEPARATORS = r"[|·›»>/•▸→]|\s{2,}"
_BULLET = r"^[»›▸•*–\-→·]"
# Patterns that the JVM reads: where a sentence ends, and what stands between the entries of a menu.
_PART = r"(?<=[.!?…])[\"'”’»)\]]*\s+"
_BETWEEN = r"\s*[|·›»>/•▸→]\s*|\s{2,}"

_AGAIN = "array<struct<line_no: int, pages: bigint>>"


def repeats_of_pages(docs: DataFrame) -> DataFrame:
    """(id, site_pages, again[(line_no, pages)]): how many pages its site has, and how many of them have each of its repeated lines.

    Lines meet by hashes of their letters; pages of one URL count once (the one
    of the lowest id). Texts do not move: only hashes of lines do, joined first
    within a task.
    """
    url = F.coalesce(F.xxhash64("url"), F.xxhash64("id"))
    keys = F.transform(F.split(letters(F.coalesce("text", F.lit(""))), "\n"), lambda k: F.when(k != "", F.xxhash64(k)))
    base = materialize(docs.select("id", F.coalesce("domain", F.lit("")).alias("domain"), url.alias("url"), keys.alias("keys")), "line_keys")
    twice = base.groupBy("domain", "url").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = base.select("domain", "url", "id").join(twice, ["domain", "url"]).where("id > first OR id IS NULL").select("id")
    once = base.join(later, "id", "left_anti")
    own = once.select("domain", F.explode(F.array_distinct("keys")).alias("key")).where("key IS NOT NULL")
    stats = own.groupBy("domain", "key").agg(F.count("*").alias("pages")).where("pages > 1")
    sites = once.groupBy("domain").agg(F.count("*").alias("site_pages"))
    lines = base.select("id", "domain", F.posexplode("keys").alias("at", "key")).where("key IS NOT NULL")
    met = lines.join(stats, ["domain", "key"]).select("id", F.struct((F.col("at") + 1).alias("line_no"), "pages").alias("again"), F.lit(None).cast("bigint").alias("site_pages"))
    sized = base.select("id", "domain").join(sites, "domain").select("id", F.lit(None).cast("struct<line_no: int, pages: bigint>").alias("again"), "site_pages")
    # Rows of one id share their numbers, so a repeated row changes nothing.
    return met.unionByName(sized).groupBy("id").agg(F.max("site_pages").alias("site_pages"), F.collect_set("again").alias("again"))


def page_table(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """(id, title, description, text, site_pages, again) of each row: the text moves once, to the numbers of its lines."""
    base = docs.select(F.col("id"), "title", "description", F.coalesce("text", F.lit("")).alias("text"))
    held = repeats.select(F.col("id").alias("_id"), "site_pages", "again").hint("shuffle_hash")
    return base.join(held, F.col("id").eqNullSafe(F.col("_id")), "left").select(
        "id", "title", "description", "text", F.coalesce("site_pages", F.lit(1)).alias("site_pages"), F.coalesce("again", F.array().cast(_AGAIN)).alias("again")
    )


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The items of a list array and the row of each."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _keys(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(pc.utf8_normalize(text, "NFKC")), r"[^\p{L}]+", "")


def _builds(text: pa.Array, short: np.ndarray) -> pa.DictionaryArray:
    """How ``short`` lines are built: words by their case, numbers as one, marks as they are; long lines are one build."""
    some = text.filter(pa.array(short)).dictionary_encode()
    form = some.dictionary
    for pattern, by in ((r"(^|[^\p{L}])\p{Lu}\p{L}*", r"\1A"), (r"(^|[^\p{L}])[\p{Ll}\p{Lo}\p{Lm}]\p{L}*", r"\1a"), (r"\p{N}+", "0"), (r"\s+", "")):
        form = pc.replace_substring_regex(form, pattern, by)
    names = pa.concat_arrays([pc.binary_join_element_wise("<", pc.utf8_slice_codeunits(form, 0, 12), ">", ""), pa.array(["<long>"])])
    at = np.full(len(text), len(form))
    at[short] = some.indices.to_numpy()
    return names.take(pa.array(at)).dictionary_encode()


class Lines:
    """The lines that hold something of a batch of pages (title, description, text, site_pages, again), in order.

    ``page`` is the row of each line in the batch, ``number`` its place in the text.
    """

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        column = lambda name: _one(rows.column(name))
        raw, page = _flat(pc.split_pattern(column("text"), "\n"))
        starts = np.searchsorted(page, np.arange(rows.num_rows))
        number = np.arange(len(page)) - starts[page] + 1
        text = pc.utf8_trim_whitespace(raw)
        held = pc.greater(pc.binary_length(text), 0)
        keep = np.flatnonzero(held.to_numpy(zero_copy_only=False))
        repeats = np.ones(len(page))
        again, of = _flat(column("again"))
        if len(again):
            at = starts[of] + again.field("line_no").to_numpy(zero_copy_only=False) - 1
            repeats[at] = again.field("pages").to_numpy(zero_copy_only=False)
        self.pages = rows.num_rows
        self.text, self.page, self.number, self.repeats = text.filter(held), page[keep], number[keep], repeats[keep]
        n = len(self.page)
        self.first = np.append(True, self.page[1:] != self.page[:-1]) if n else np.zeros(0, bool)
        self.keys = _keys(self.text)
        self.lettered = pc.greater(pc.binary_length(self.keys), 0).to_numpy(zero_copy_only=False)
        self.site_pages = column("site_pages").to_numpy(zero_copy_only=False).astype(float)[self.page]
        self.rate = np.where(self.lettered, self.repeats / np.maximum(self.site_pages, 1), 0.0)
        self.length = self._number(pc.utf8_length(self.text))
        words = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(self.text), r"[^\p{L}]+", " "), " ")
        flat, self.word_line = _flat(pc.split_pattern(words, " "))
        self.words = flat.dictionary_encode()
        self.build = _builds(self.text, self.length <= 60)
        self.ends = self._number(pc.count_substring_regex(self.text, _ENDS))
        self.closed = self._number(pc.match_substring_regex(self.text, _CLOSED))
        self.titles = pc.fill_null(_keys(column("title")), "").to_pylist()
        self.descriptions = pc.fill_null(_keys(column("description")), "").to_pylist()
        key = self.keys.to_pylist()
        self.is_title = np.array([_title(k, self.titles[p]) for k, p in zip(key, self.page)], float)
        self.in_description = np.array([len(k) >= 10 and k in self.descriptions[p] for k, p in zip(key, self.page)], float)
        # Blocks: broken by blank lines; where all lines stand alone, by a change of build.
        gap = np.append(False, np.diff(self.number) > 1) if n else np.zeros(0, bool)
        inner = self.page[~self.first]
        gaps, of = np.bincount(inner, gap[~self.first], self.pages), np.bincount(inner, minlength=self.pages)
        alone = (gaps > 0.9 * np.maximum(of, 1))[self.page]
        long = self.length > 100
        change = np.append(False, long[1:] != long[:-1]) if n else np.zeros(0, bool)
        self.block = np.cumsum(self.first | np.where(alone, change, gap)) - 1 if n else np.zeros(0, np.int64)

    @staticmethod
    def _number(x: pa.Array) -> np.ndarray:
        return x.cast(pa.int32()).to_numpy(zero_copy_only=False).astype(float)

    def __len__(self) -> int:
        return len(self.page)

    def shifted(self, v: np.ndarray, by: int, other: float) -> np.ndarray:
        """The value ``by`` lines before (or after) in the page."""
        out = np.full(len(v), other)
        if 0 < by < len(v):
            out[by:] = np.where(self.page[by:] == self.page[:-by], v[:-by], other)
        elif 0 < -by < len(v):
            out[:by] = np.where(self.page[:by] == self.page[-by:], v[-by:], other)
        return out

    def page_sum(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.page, v, self.pages)

    def before(self, v: np.ndarray) -> np.ndarray:
        """The sum over the lines of the page before each one."""
        total = np.cumsum(v) - v
        return total - total[np.flatnonzero(self.first)][np.cumsum(self.first) - 1]

    def block_mean(self, v: np.ndarray) -> np.ndarray:
        return (np.bincount(self.block, v) / np.maximum(np.bincount(self.block), 1))[self.block]


def _title(key: str, title: str) -> float:
    if len(key) < 6 or not title:
        return 0.0
    if key == title or title.startswith(key) and len(title) - len(key) <= max(16, 0.3 * len(key)):
        return 1.0
    return 0.5 if len(title) >= 24 and key.startswith(title[:24]) else 0.0


def teach(lines: Lines) -> np.ndarray:
    """Sure labels: 1 furniture, 0 article, -1 unknown."""
    labels = np.full(len(lines), -1)
    often = (lines.rate >= SURE_RATE) & (lines.repeats >= SURE_PAGES)
    rare = lines.rate < SURE_RATE / 2 + 1 / np.maximum(lines.site_pages, 1)
    labels[often] = 1
    # The last line may be cut.
    whole, last = (lines.closed > 0) & (lines.length >= 50), np.append(lines.first[1:], True) & (lines.ends >= 2) & (lines.length >= 100)
    labels[(lines.ends >= 1) & (whole | last) & ~often & rare] = 0
    labels[(lines.is_title == 1) & (labels != 1)] = 0
    starts = np.append(np.flatnonzero(lines.first), len(lines))
    for a, b in zip(starts[:-1], starts[1:]):
        labels[a:b] = _teach_between(labels[a:b])
    return labels


def _teach_between(y: np.ndarray) -> np.ndarray:
    """Labels of one page, with those of the lines outside of and between sure lines."""
    anchors = np.flatnonzero(y == 0)
    if not len(anchors):
        return y
    first, last = anchors[0], anchors[-1]
    y[:first] = 1
    tail = y[last + 1 :]
    tail[np.logical_or.accumulate(tail == 1) & (tail < 0)] = 1
    i = first
    while i < last:  # between the anchors: runs of lines without a label
        if y[i] >= 0:
            i += 1
            continue
        j = i
        while y[j] < 0:
            j += 1
        if y[i - 1] == y[j]:
            y[i:j] = y[j]
        elif y[i - 1] == 1 and j - i >= 2:
            y[i : j - 1] = 1
        i = j
    return y


def token_lean(lines: Lines, labels: np.ndarray) -> dict[str, float]:
    """Log odds of furniture by word and build, from labelled lines; those of fewer than 4 lines are left out."""
    lean: dict[str, float] = {}
    pair = np.unique(lines.word_line * np.int64(len(lines.words.dictionary)) + lines.words.indices.to_numpy())
    line, word = np.divmod(pair, max(1, len(lines.words.dictionary)))
    seen = [
        (lines.words.dictionary, [np.bincount(word[labels[line] == k], minlength=len(lines.words.dictionary)) for k in (0, 1)]),
        (lines.build.dictionary, [np.bincount(lines.build.indices.to_numpy()[labels == k], minlength=len(lines.build.dictionary)) for k in (0, 1)]),
    ]
    totals = [max(1, sum(int(counts[k].sum()) for _, counts in seen)) for k in (0, 1)]
    for names, (article, furniture) in seen:
        odds = np.log((furniture + 0.5) / totals[1]) - np.log((article + 0.5) / totals[0])
        lean |= {w: float(o) for w, o, n in zip(names.to_pylist(), odds, article + furniture) if n >= 4 and w}
    return lean


def features(lines: Lines, lean: dict[str, float]) -> np.ndarray:
    """One row per line."""
    n = len(lines)
    if not n:
        return np.zeros((0, 37))
    of_word = np.array([lean.get(w, 0.0) for w in lines.words.dictionary.to_pylist()])[lines.words.indices.to_numpy()]
    starts = np.flatnonzero(np.append(True, np.diff(lines.word_line) > 0))
    count = np.diff(np.append(starts, len(of_word)))
    mean = np.add.reduceat(of_word, starts) / count
    high, low, head = np.maximum.reduceat(of_word, starts), np.minimum.reduceat(of_word, starts), of_word[starts]
    built = np.array([lean.get(b, 0.0) for b in lines.build.dictionary.to_pylist()])[lines.build.indices.to_numpy()]
    n_words = np.where(lines.lettered, count, 0).astype(float)
    number, text = lines._number, lines.text
    capital = number(pc.count_substring_regex(text, r"(?:^|[^\p{L}])\p{Lu}")) / np.maximum(n_words, 1)
    digits = number(pc.count_substring_regex(text, r"\p{Nd}")) / lines.length
    separators = number(pc.count_substring_regex(text, _SEPARATORS))
    bullet, sign, colon = number(pc.match_substring_regex(text, _BULLET)), number(pc.match_substring(text, "©")), number(pc.match_substring(text, ":"))
    sentence = ((lines.ends >= 1) & (lines.closed > 0) & (lines.length >= 40)).astype(float)
    # Siblings and block.
    block_size = np.bincount(lines.block)[lines.block].astype(float)
    before = lines.before(sentence)
    after = lines.page_sum(sentence)[lines.page] - before - sentence
    at = lines.before(np.ones(n))
    size = lines.page_sum(np.ones(n))[lines.page]
    near = [lines.shifted(v, by, -1.0) for v in (lines.length, lines.rate, mean, sentence) for by in (1, -1)]
    return np.stack(
        [
            np.log1p(lines.length), n_words, lines.closed, lines.ends, separators, digits, bullet, capital, sign, colon,
            lines.rate, np.log1p(lines.repeats), np.log1p(lines.site_pages), at / size, size - 1 - at, at, lines.is_title, lines.in_description,
            mean, high, low, head, built, block_size, lines.block_mean(lines.length), lines.block_mean(sentence), lines.block_mean(mean),
            np.minimum(before, 3), np.minimum(after, 3), *near,
        ],
        1,
    )


def with_neighbours(x: np.ndarray, logit: np.ndarray, lines: Lines) -> np.ndarray:
    """Features of the second model: those of the first, and the first scores around a line, in its block and in the rest of its page."""
    if not len(logit):
        return np.zeros((0, x.shape[1] + 9))
    z = np.clip(logit, -6, 6)
    around = [lines.shifted(z, by, 0.0) for by in (3, 2, 1)] + [z] + [lines.shifted(z, by, 0.0) for by in (-1, -2, -3)]
    one = np.ones(len(z))
    rest = lines.page_sum(z)[lines.page] - lines.before(z)
    left = lines.page_sum(one)[lines.page] - lines.before(one)
    return np.column_stack([x, *around, lines.block_mean(z), rest / left])


def decode(logit: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The best labelling of the tree: blocks of one kind, or mixed at a price."""
    total = lambda v: np.bincount(block, v) if len(block) else np.zeros(0)
    article, furniture = -total(np.logaddexp(0, logit)), -total(np.logaddexp(0, -logit))
    free = -total(np.logaddexp(0, -np.abs(logit))) - MIXED_PRICE
    pure = (np.bincount(block) > 1) & (np.maximum(article, furniture) >= free) if len(block) else np.zeros(0, bool)
    return np.where(pure[block], (furniture > article)[block], logit > 0) if len(block) else logit > 0


class FurnitureModel:
    """The fitted models of a corpus."""

    def __init__(self, lines: Lines):
        y = teach(lines)
        self.lean = token_lean(lines, y)
        known = y >= 0
        self.fitted = bool(len(y)) and 0 < (y[known] == 1).sum() < known.sum()
        if not self.fitted:
            return
        x = features(lines, self.lean)
        self.first = BoostedTrees().fit(x[known], y[known].astype(float))
        second = with_neighbours(x, self.first.logits(x), lines)
        self.second = BoostedTrees().fit(second[known], y[known].astype(float))

    def furniture(self, lines: Lines) -> np.ndarray:
        """Whether each line is furniture."""
        if not self.fitted or not len(lines):
            return (lines.rate >= SURE_RATE) & (lines.repeats >= SURE_PAGES)
        x = features(lines, self.lean)
        return decode(self.second.logits(with_neighbours(x, self.first.logits(x), lines)), lines.block)

    def descriptions(self, rows: pa.RecordBatch, lines: Lines, found: np.ndarray) -> np.ndarray:
        """Of each page, whether its description consists of furniture or contains some, by the page's lines or the description's words."""
        out = np.zeros(lines.pages, bool)
        at = np.flatnonzero(found & lines.lettered & ((lines.repeats > 1) | (lines.ends == 0)))
        for p, key in zip(lines.page[at], lines.keys.take(pa.array(at)).to_pylist()):
            if len(key) >= 6 and key in lines.descriptions[p]:
                out[p] = True
        if self.fitted:
            marked = pc.replace_substring_regex(rows.column("description"), r"([.!?…][\"'”’»)\]]*)\s+", "\\1\n")
            parts, page = _flat(pc.split_pattern(pc.coalesce(marked, ""), "\n"))
            words = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(parts), r"[^\p{L}]+", " "), " ")
            flat, part = _flat(pc.split_pattern(words, " "))
            coded = flat.dictionary_encode()
            lean = np.array([self.lean.get(w, 0.0) for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
            real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
            count = np.bincount(part[real], minlength=len(page))
            mean = np.bincount(part[real], lean[real], len(page)) / np.maximum(count, 1)
            # One or two words may be the rest of a cut sentence, unless they are all.
            least = np.where(np.bincount(page, minlength=lines.pages) == 1, 1, 3)[page]
            out[page[(count >= least) & (mean > 1.0)]] = True
        return out


def fit(docs: DataFrame, repeats: DataFrame, sample: int = SAMPLE_PAGES) -> FurnitureModel:
    """Models from at most ``sample`` pages, the first by a hash of their id."""
    chosen = docs.select("id").where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    some = docs.join(F.broadcast(chosen), "id", "left_semi")  # bounded by the sample
    known = repeats.join(F.broadcast(chosen), "id", "left_semi")
    rows = page_table(some.dropDuplicates(["id"]), known).orderBy(F.xxhash64("id"), "id").toArrow().combine_chunks()
    return FurnitureModel(Lines(rows))


def on_pages(docs: DataFrame, work: Callable[[pa.RecordBatch, Lines, np.ndarray, FurnitureModel], pa.RecordBatch], schema: str, sample: int = SAMPLE_PAGES) -> DataFrame:
    """What ``work`` makes of each batch of pages, its lines and their labels; the pages' table, model and one pass over the texts."""
    repeats = materialize(repeats_of_pages(docs), "repeats")
    model = fit(docs, repeats, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(at, BATCH_PAGES)
                lines = Lines(part)
                yield work(part, lines, model.furniture(lines), model)

    return page_table(docs, repeats).mapInArrow(run, schema)


def _labelled(part: pa.RecordBatch, lines: Lines, found: np.ndarray, model: FurnitureModel) -> pa.RecordBatch:
    """Lines (text only of those that come back), and descriptions as line 0."""
    held = np.flatnonzero(pc.greater(pc.binary_length(pc.coalesce(part.column("description"), "")), 0).to_numpy(zero_copy_only=False))
    ids = part.column("id").take(pa.array(np.append(lines.page, held)))
    number = np.append(lines.number, np.zeros(len(held), np.int64)).astype(np.int32)
    text = pc.if_else(pa.array(lines.repeats > 1), lines.text, pa.scalar(None, pa.string()))
    text = pa.concat_arrays([text, _one(part.column("description")).take(pa.array(held))])
    flags = np.append(found, model.descriptions(part, lines, found)[held])
    return pa.RecordBatch.from_arrays([ids, pa.array(number), text, pa.array(flags)], ["id", "line_no", "line", "furniture"])


def _parts(line: Column) -> Column:
    """Hashes of a line's sentences, by their letters; those of under 6 letters tell nothing."""
    keys = F.transform(F.split(composed(line), _PART), lambda p: F.regexp_replace(F.lower(p), r"\P{L}+", ""))
    return F.transform(F.filter(keys, lambda k: F.length(k) >= 6), lambda k: F.xxhash64(k))


def furniture_parts(vocabulary: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(id) of the descriptions with a sentence that is furniture wherever else it stands.

    The labels of all repeated lines of all sites with the sentence are counted:
    more of them, and at least two, must be furniture.
    """
    asked = descriptions.select("id", F.explode(F.array_distinct(_parts(F.col("line")))).alias("part"))
    said = vocabulary.select("n", "of", F.explode(_parts(F.col("line"))).alias("part"))
    votes = said.groupBy("part").agg(F.sum("n").alias("n"), F.sum("of").alias("of")).where("n >= 2 AND 2 * n > of")
    return asked.join(votes, "part", "left_semi").select("id")


def menu_entries(vocabulary: DataFrame) -> DataFrame:
    """(entry) of what menus consist of: short lines, and parts of lines of three or more, that are furniture on several pages."""
    split = F.filter(F.split(F.regexp_replace(composed(F.col("line")), r"\p{Cf}+", ""), _BETWEEN), lambda p: p != "")
    of = vocabulary.select("n", "of", "a", "b", split.alias("p")).where("size(p) <> 2").select("n", "of", "a", "b", F.explode("p").alias("entry"))
    short = of.where(F.col("entry").rlike(r"\p{L}") & ~F.col("entry").rlike(r"\p{N}") & (F.size(F.split("entry", " ")) <= ENTRY_WORDS))
    counted = short.groupBy("entry").agg(F.sum("n").alias("n"), F.sum("of").alias("of"), F.min("a").alias("a"), F.max("b").alias("b"))
    return counted.where((F.col("n") >= SURE_PAGES) & (F.col("n") >= ENTRY_RATE * F.col("of")) & (F.col("a") != F.col("b"))).select("entry")


def starting_with_menus(descriptions: DataFrame, entries: DataFrame) -> DataFrame:
    """(id) of the descriptions with a sentence that follows, or is, two entries of menus; of entries that fit, the longest is taken."""
    plain = F.regexp_replace(composed(F.col("line")), r"\p{Cf}+", "")
    part = descriptions.select("id", F.posexplode(F.split(plain, _PART)).alias("part", "p"))
    words = part.select("id", "part", F.filter(F.split(F.regexp_replace("p", _BETWEEN, " "), r"\s+"), lambda w: w != "").alias("w"))

    def longest(rows: DataFrame, start: Column) -> DataFrame:
        """Rows with the number of words of the longest entry that begins after ``start`` words."""
        size = F.explode(F.sequence(F.lit(1), F.lit(ENTRY_WORDS))).alias("k")
        tried = rows.select("id", "part", "w", start.alias("start"), size).where(F.col("start") + F.col("k") <= F.size("w"))
        found = tried.withColumn("entry", F.array_join(F.slice("w", F.col("start") + 1, F.col("k")), " ")).join(entries, "entry", "left_semi")
        return found.groupBy("id", "part", "start").agg(F.max("k").alias("k"), F.first("w").alias("w"))

    return longest(longest(words, F.lit(0)), F.col("start") + F.col("k")).select("id")


def _labels(docs: DataFrame, sample: int) -> tuple[DataFrame, DataFrame]:
    """(id, line_no, furniture) with descriptions as line 0, and the ids of further descriptions that are furniture; repeated rows as often as they occur."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, line_no int, line string, furniture boolean"
    judged = materialize(on_pages(docs, _labelled, schema, sample), "judged_lines")
    is_one = F.col("furniture").cast("long")
    counts = (F.sum(is_one).alias("n"), F.count("*").alias("of"), F.min("id").alias("a"), F.max("id").alias("b"))
    vocabulary = materialize(judged.where("line_no > 0 AND line IS NOT NULL").groupBy("line").agg(*counts).where("n > 0"), "furniture_lines")
    rest = judged.where("line_no = 0 AND NOT furniture").select("id", "line")
    told = furniture_parts(vocabulary, rest).unionByName(starting_with_menus(rest, menu_entries(vocabulary)))
    return judged.select("id", "line_no", "furniture"), told


def label_lines(docs: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(id, line_no, furniture) of the lines of every page, and (id, 0, furniture) of its description.

    A description is furniture if any of its parts is: by the page's own lines
    or the part's words, by the labels that the same sentence has in repeated
    lines of all sites, or by entries of menus at its head.
    Blank lines and null or empty fields give no rows; equal rows of an id
    count once; pages of a null domain are one site; extra columns are ignored.
    With no page to learn from, only repeated lines are furniture.
    """
    judged, told = _labels(docs, sample)
    both = judged.unionByName(told.select("id", F.lit(0).alias("line_no"), F.lit(True).alias("furniture")))
    return both.groupBy("id", "line_no").agg(F.max("furniture").alias("furniture"))


def _furniture_lines(docs: DataFrame, sample: int) -> DataFrame:
    """(id, line_no) of what ``label_lines`` calls furniture."""
    judged, told = _labels(docs, sample)
    return judged.where("furniture").select("id", "line_no").unionByName(told.select("id", F.lit(0).alias("line_no"))).distinct()


def furniture(docs: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(id, field, line_no) of the lines of ``text`` that are furniture, and of descriptions (line_no 1) that are or contain it."""
    is_line = F.col("line_no") > 0
    return _furniture_lines(docs, sample).select(
        "id", F.when(is_line, "text").otherwise("description").alias("field"), F.when(is_line, F.col("line_no")).otherwise(1).alias("line_no")
    )


def main_content(docs: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(id, text, description) of every page: its text without the furniture's lines, and the description unless it is furniture.

    All other lines stay as they stood, blank ones and white space included.
    """
    no = F.col("line_no")
    gone = _furniture_lines(docs, sample).groupBy(F.col("id").alias("_id")).agg(F.collect_set(no).alias("gone"))
    base = docs.select("id", "text", "description").dropDuplicates(["id"])
    numbered = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    held = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter(numbered, lambda x: ~F.array_contains(held, x["no"]))
    description = F.when((F.col("description") != "") & ~F.array_contains(held, F.lit(0)), F.col("description"))
    return base.join(gone, F.col("id").eqNullSafe(F.col("_id")), "left").select(
        "id", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"), description.alias("description")
    )
