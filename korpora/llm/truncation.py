"""Values that were cut before their end.

A field limit leaves a spike at the greatest length of a source's values, in
characters or in bytes; a value at a spike that does not end as a sentence does
was cut there. Cuts in mid-transfer leave no spike: a value without closing
punctuation is held against the other fields of its page (what follows where
the value ends?) and, if they do not show it, against how the corpus continues
after the value's last words.

One pass over the texts measures every value and counts words and lines by
hashes, many pages at a time and joined within a task; all that follows works on
these numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpora.functions.text import composed
from korpora.llm.boilerplate import _flat
from korpora.llm.forms import LATIN_OF
from korpora.llm.lines import letters
from korpora.session import materialize

FIELDS = ("title", "description", "text")

#: A spike: at least so many values, so many times the mean count of the lengths
#: just below, and at most so large a share of longer values (edits after the cut).
SPIKE_VALUES, SPIKE_TIMES, SPIKE_BELOW, SPIKE_ABOVE = 5, 4.0, 40, 0.12
#: Share of ends among the occurrences of the last words under which a value is open.
OPEN_RATE = 0.02
#: Different values with the same line that show a last line to be whole, and letters that the line needs.
LINE_VALUES, LINE_LETTERS = 3, 6
#: Occurrences of exact words that tell more than those of their kind, if none is an end.
EXACT_COUNT = 10
#: Pages that are measured together, and counts that a task holds at most before it hands them on.
BATCH_PAGES, HELD_COUNTS = 2000, 2_000_000

# Marks of omission, closing punctuation, what may follow either, and what Java does not call white space.
_TAIL = r"[\s\x{a0}\x{200b}\x{feff}]*$"
_MARK = r"(?:\.\.\.|&hellip;|\[(?:\.\.\.|&hellip;)\]|\(\.\.\.\)|\x{fffd})" + _TAIL
_CLOSED = r"[.!?\x{3002}:][\"'\x{201d}\x{2019}\x{bb})\]]*" + _TAIL
_INNER = r"[\p{L}\p{N}]{2,}[.!?][\"'”’»)\]]*\s+\S"  # a sentence's end within a line
_SENTENCE = re.compile(r"[^\W\d_]{2,}[.!?] ")
_ASCII = r"^[\x00-\x{7f}]*$"


def length_spikes(values: DataFrame) -> DataFrame:
    """(source, field, unit, length) at which values pile up with hardly any longer ones.

    Histograms of lengths per source and field, in characters and in bytes, and
    one over all sources ('*') for limits of the store itself.
    """
    units = F.explode(
        F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))
    )
    per = values.select("source", "field", units.alias("u")).groupBy("source", "field", "u.unit", F.col("u.n").alias("length")).count()
    pooled = per.groupBy("field", "unit", "length").agg(F.sum("count").alias("count")).select(F.lit("*").alias("source"), "field", "unit", "length", "count")
    by, down = (W.partitionBy("source", "field", "unit").orderBy(F.col("length") if up else F.col("length").desc()) for up in (True, False))
    return (
        per.select("source", "field", "unit", "length", "count").unionByName(pooled)
        .withColumn("below", F.coalesce(F.sum("count").over(by.rangeBetween(-SPIKE_BELOW, -1)), F.lit(0)) / SPIKE_BELOW)
        .withColumn("above", F.coalesce(F.sum("count").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .where((F.col("count") >= SPIKE_VALUES) & (F.col("count") >= SPIKE_TIMES * F.col("below")) & (F.col("above") <= SPIKE_ABOVE * F.col("count")))
        .select("source", "field", "unit", "length")
    )


def plain(value: Column) -> Column:
    """Compatibility form without invisible characters and look-alikes, so that words count as what they look like."""
    other = F.translate(F.regexp_replace(composed(value), r"\p{Cf}+", ""), "".join(LATIN_OF), "".join(LATIN_OF.values()))
    return F.when(value.rlike(_ASCII), value).otherwise(other)


def field_values(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(source, field) of the values that hold something."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) != "").alias("held")) for f in fields])).alias("f")
    return docs.select(F.coalesce("domain", F.lit("")).alias("source"), each).where("f.held").select("source", "f.field")


def _hashes(text: pa.Array) -> np.ndarray:
    """64 bits for each string."""
    return pd.util.hash_array(np.array(text.to_pylist(), object), categorize=False) if len(text) else np.zeros(0, np.uint64)


def _mixed(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(level + 1)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


class Words:
    """The words, numbers (all as 0) and marks of lines, with the keys that they are counted by.

    ``line`` is the line of each token; a line without any has none. Keys of a
    token and the one before: both as they are, the token alone, and both with
    capitalised words alike; tokens with numbers are one.
    """

    def __init__(self, lines: pa.Array):
        x = pc.replace_substring_regex(lines, r"\p{N}+", "0")
        x = pc.replace_substring_regex(x, r"([\p{L}\p{M}\p{N}])['’-]([\p{L}\p{M}\p{N}])", "\\1\ue000\\2")
        x = pc.replace_substring_regex(x, r"([^\s\p{L}\p{M}\p{N}\x{e000}])", r" \1 ")
        flat, line = _flat(pc.utf8_split_whitespace(x))
        held = pc.greater(pc.binary_length(flat), 0)
        self.line = line[held.to_numpy(zero_copy_only=False)]
        coded = flat.filter(held).dictionary_encode()
        self.code = coded.indices.to_numpy()
        names = coded.dictionary.to_pylist()
        shapes = ["<n>" if "0" in t else t.lower() for t in names]
        kinds = ["<n>" if "0" in t else "<C>" if t[0].lower() != t[0] else t for t in names]
        shape, kind = (np.append(_hashes(pa.array(v, pa.string())), np.uint64(1)) for v in (shapes, kinds))
        self.first = np.append(True, np.diff(self.line) > 0) if len(self.line) else np.zeros(0, bool)
        before = np.where(self.first, len(names), np.append(0, self.code[:-1])) if len(self.code) else self.code
        self.keys = np.stack([_mixed(0, kind[before], kind[self.code]), _mixed(1, np.zeros(len(self.code), np.uint64), shape[self.code]), _mixed(2, shape[before], shape[self.code])])
        self.stops = np.array([t in (".", "!", "?") for t in names] + [False])[self.code] if names else np.zeros(0, bool)
        self.last = np.append(self.first[1:], True) if len(self.line) else self.first


class _Counts:
    """Sums by key, joined when they grow."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        joined, at = np.unique(keys, return_inverse=True)
        self.parts.append((joined, *(np.bincount(at, v, len(joined)).astype(np.int64) for v in values)))
        self.size += len(joined)
        if self.size > HELD_COUNTS and len(self.parts) > 1:
            self.join()

    def join(self) -> tuple[np.ndarray, ...]:
        keys, *values = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else [np.zeros(0, np.int64)] * 3
        self.parts, self.size = [], 0
        if len(keys):
            self.add(keys, *values)
            keys, *values = self.parts[0]
        return keys, *values


# One row per value (key is null), per word key (level 0 to 2 in the key) and per line (is_line).
_NUMBERS = (
    ("source", pa.string(), "string"), ("field", pa.string(), "string"), ("chars", pa.int32(), "int"), ("bytes", pa.int32(), "int"), ("mark", pa.bool_(), "boolean"),
    ("closed", pa.bool_(), "boolean"), ("after", pa.string(), "string"), ("k0", pa.int64(), "bigint"), ("k1", pa.int64(), "bigint"), ("k2", pa.int64(), "bigint"),
    ("line", pa.int64(), "bigint"), ("form", pa.string(), "string"), ("n_tokens", pa.int32(), "int"), ("within", pa.bool_(), "boolean"),
    ("is_line", pa.bool_(), "boolean"), ("key", pa.int64(), "bigint"), ("ends", pa.int64(), "bigint"), ("goes_on", pa.int64(), "bigint"),
)


def _after_title(bare: str | None, hay: str) -> str | None:
    """What the page has right after its title: where a line begins with it, two characters from its end."""
    at = hay.find("\n" + bare)
    return None if at < 0 else hay[at + 1 + len(bare) :][:2]


def _after_description(bare: str, hay: str) -> str | None:
    at = hay.find(bare[-60:])
    return None if at < 0 else hay[at + len(bare[-60:]) :][:2]


def _measure(part: pa.RecordBatch, fields: tuple[str, ...], words: _Counts, lines: _Counts) -> pa.RecordBatch:
    """The value rows of some pages; their words and lines are added to the counts."""
    text = pc.fill_null(part.column("p_text"), "")
    pages = None
    out = []
    for f in fields:
        value = pc.fill_null(part.column(f"p_{f}"), "")
        held = pc.greater(pc.fill_null(part.column(f"chars_{f}"), 0), 0).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(held)
        if not len(rows):
            continue
        value = value.take(pa.array(rows))
        n = len(rows)
        tail = pc.utf8_slice_codeunits(value, -400, None)
        mark = pc.match_substring_regex(tail, _MARK).to_numpy(zero_copy_only=False)
        closed = pc.match_substring_regex(tail, _CLOSED).to_numpy(zero_copy_only=False)
        bare = pc.replace_substring_regex(value, r"[\s\x{a0}\x{200b}\x{feff}]+$", "")
        size = pc.utf8_length(bare).to_numpy()
        after: list[str | None] = [None] * n
        if f != "text":
            sought = np.flatnonzero(~mark & ((f == "title") | ~closed) & (size >= 8))
            pages = pages or text.to_pylist()
            some = bare.take(pa.array(sought)).to_pylist()
            find = _after_title if f == "title" else _after_description
            for i, b in zip(sought, some):
                after[i] = find(b, "\n" + pages[rows[i]] + "\n")
            if f == "description":  # one of short lines in a row ends where one of these lines does
                menu = np.array([i for i, b in zip(sought, some) if not _SENTENCE.search(b)], np.int64)
                form = pc.replace_substring_regex(pc.utf8_lower(bare.take(pa.array(menu))), r"[^\p{L}]+", "").to_pylist()
                hays = pc.replace_substring_regex(pc.utf8_lower(text.take(pa.array(rows[menu]))), r"[^\p{L}\n]+", "").to_pylist()
                for i, b, hay in zip(menu, form, hays):
                    if len(b) >= 8 and b[-24:] + "\n" in hay + "\n":
                        after[i] = "\n"
        raw, of = _flat(pc.split_pattern(value, "\n"))
        is_last = np.append(of[1:] != of[:-1], True)
        last_line = pc.replace_substring_regex(raw.filter(pa.array(is_last)), r"[\s\x{a0}\x{200b}\x{feff}]+$", "")
        last_line = pc.if_else(pa.array(pc.match_substring(bare, "\n").to_numpy(zero_copy_only=False)), pc.replace_substring_regex(bare, r"(?s)^.*\n", ""), bare) if f == "text" else last_line
        token = Words(last_line)
        keys, count = np.zeros((3, n), np.int64), np.bincount(token.line, minlength=n)
        keys[:, token.line[token.last]] = token.keys[:, token.last]
        form = pc.replace_substring_regex(pc.utf8_lower(last_line), r"[^\p{L}]+", "")
        open_ = pa.array(~mark & ~closed)
        out.append(
            [
                part.column("id").take(pa.array(rows)), part.column("source").take(pa.array(rows)), pa.array([f] * n), *(part.column(f"{u}_{f}").take(pa.array(rows)) for u in ("chars", "bytes")),
                pa.array(mark), pa.array(closed), pa.array(after, pa.string()), *map(pa.array, keys), pa.array(_hashes(form).view(np.int64)), pc.if_else(open_, form, pa.scalar(None, pa.string())),
                pa.array(count.astype(np.int32)), pc.match_substring_regex(last_line, _INNER), *(pa.nulls(n, t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.int64())),
            ]
        )
        # Equal values count once: the others are copies of one with a lower id.
        own = ~pc.fill_null(part.column(f"copy_{f}"), False).to_numpy(zero_copy_only=False)[rows]
        whole = (~is_last | (closed | (f == "title"))[of])[own[of]]
        counted = raw.filter(pa.array(own[of]))
        each = Words(counted)
        ahead = np.where(each.last, True, np.append(each.stops[1:], False)) if len(each.line) else each.last
        keep = ~each.last | whole[each.line]
        for k in range(3):
            words.add(each.keys[k, keep], ahead[keep], ~ahead[keep])
        sure = pc.replace_substring_regex(pc.utf8_lower(counted.filter(pa.array(whole))), r"[^\p{L}]+", "")
        sure = sure.filter(pc.greater_equal(pc.utf8_length(sure), LINE_LETTERS))
        lines.add(_hashes(sure).view(np.int64), np.ones(len(sure)), np.zeros(len(sure)))
    names = ["id", *(x[0] for x in _NUMBERS)]
    schema = pa.schema([part.schema.field("id"), *((name, kind) for name, kind, _ in _NUMBERS)])
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, names) for x in out], schema).combine_chunks().to_batches()[0] if out else pa.RecordBatch.from_pylist([], schema)


def _counted(counts: _Counts, is_line: bool, id_type: pa.DataType) -> pa.RecordBatch:
    keys, ends, goes_on = counts.join()
    n = len(keys)
    empty = [pa.nulls(n, kind) for name, kind, _ in _NUMBERS[:-4]]
    return pa.RecordBatch.from_arrays([pa.nulls(n, id_type), *empty, pa.array([is_line] * n, pa.bool_()), *(pa.array(x.astype(np.int64)) for x in (keys, ends, goes_on))], ["id", *(x[0] for x in _NUMBERS)])


def copies(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, copy_<field> for each field) of the pages with a value that another page of a lower id has too."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.xxhash64(f).alias("hash"), (F.col(f) != "").alias("held")) for f in fields])).alias("f")
    held = docs.select("id", each).where("f.held AND id IS NOT NULL").select("id", "f.field", "f.hash")
    twice = held.groupBy("field", "hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    later = held.join(twice, ["field", "hash"]).where("id > first")
    return later.groupBy("id").agg(*[F.max(F.col("field") == f).alias(f"copy_{f}") for f in fields])


def measured(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The numbers of all values, words and lines (see ``_NUMBERS``), from one pass over the texts."""
    known = docs.join(copies(docs, fields), "id", "left")
    rows = known.select(
        "id", F.coalesce("domain", F.lit("")).alias("source"), *[plain(F.col(f)).alias(f"p_{f}") for f in {*fields, "text"}],
        *[F.length(f).alias(f"chars_{f}") for f in fields], *[F.octet_length(f).alias(f"bytes_{f}") for f in fields], *[f"copy_{f}" for f in fields],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lines, kind = _Counts(), _Counts(), pa.int64()
        for batch in batches:
            kind = batch.schema.field("id").type
            for at in range(0, batch.num_rows, BATCH_PAGES):
                yield _measure(batch.slice(at, BATCH_PAGES), fields, words, lines)
        yield _counted(words, False, kind)
        yield _counted(lines, True, kind)

    return rows.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, " + ", ".join(f"{name} {kind}" for name, _, kind in _NUMBERS))


def whole_lines(docs: DataFrame, fields: tuple[str, ...], numbers: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line) of the ``wanted`` lines (line, form) that the corpus shows to be whole.

    At least ``LINE_VALUES`` values have the line, not cut themselves, and these
    are not few beside the lines that go on after the same letters. A line of
    few letters shows nothing.
    """
    forms = wanted.where(F.length("form") >= LINE_LETTERS).select("line", "form").distinct()
    counted = numbers.where("is_line").groupBy(F.col("key").alias("line")).agg(F.sum("ends").alias("ends")).where(F.col("ends") >= LINE_VALUES)
    ends = materialize(forms.join(counted, "line").withColumn("head", F.left("form", F.lit(LINE_LETTERS))), "line_ends")
    lines = F.array_distinct(F.flatten(F.array(*[F.split(letters(F.coalesce(f, F.lit(""))), "\n") for f in fields])))
    longer = docs.select(F.explode(lines).alias("other")).where(F.length("other") > LINE_LETTERS).withColumn("head", F.left("other", F.lit(LINE_LETTERS)))
    goes_on = longer.join(ends.select("line", "form", "head"), "head").where(F.startswith("other", "form") & (F.length("other") > F.length("form"))).groupBy("line").agg(F.count("*").alias("goes_on"))
    rate = F.col("ends") / (F.col("ends") + F.coalesce("goes_on", F.lit(0)))
    return ends.join(goes_on, "line", "left").where(rate >= OPEN_RATE).select("line")


def truncated(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, why) of the values that hold only the beginning of a longer one.

    ``why`` is 'mark' (ends in a mark of omission), 'spike' (at a spike of
    lengths without closing punctuation), 'page' (the page's text goes on where
    the value ends) or 'open' (ends within a paragraph's sentence, or in words
    that the corpus goes on after).
    Null and empty values are no cases; a null domain is a source of its own;
    repeated rows come out as often as they occur.
    """
    numbers = materialize(measured(docs, fields), "values")
    values = numbers.where("field IS NOT NULL")
    narrow = values.select("id", "source", "field", "chars", "bytes", "mark", "closed", "after", "k0", "k1", "k2", "line", "form", "n_tokens", "within")
    spikes = materialize(length_spikes(values), "spikes")
    for unit in ("chars", "bytes"):
        own = spikes.where((F.col("unit") == unit) & (F.col("source") != "*")).select("source", "field", F.col("length").alias(unit), F.lit(True).alias(f"own_{unit}"))
        all_ = spikes.where((F.col("unit") == unit) & (F.col("source") == "*")).select("field", F.col("length").alias(unit), F.lit(True).alias(f"all_{unit}"))
        narrow = narrow.join(own, ["source", "field", unit], "left").join(all_, ["field", unit], "left")
    is_title, is_description = F.col("field") == "title", F.col("field") == "description"
    judged = narrow.withColumn(
        "why",
        F.when(F.col("mark"), "mark")
        .when(F.col("closed") & ~is_title, "")
        .when(F.col("after").rlike(r"^[\n.!?]|^$"), "")
        .when(F.coalesce("own_chars", "own_bytes", "all_chars", "all_bytes", F.lit(False)), "spike")
        .when(is_title & F.col("after").rlike(r"^[\p{L}\p{N} ,:;(\x{2013}-]"), "page")
        .when(is_description & F.col("after").rlike(r"^[\p{L}\p{N},;]|^ [\p{Ll}\p{N}]"), "page"),
    )
    judged = materialize(judged.where("why IS NULL OR why <> ''").select("id", "field", "why", "k0", "k1", "k2", "line", "form", "n_tokens", "within"), "judged")
    sure = judged.where("why IS NOT NULL").select("id", "field", "why")
    open_ = judged.where("why IS NULL AND n_tokens > 0")
    left = materialize(open_.join(whole_lines(docs, fields, numbers, open_), "line", "left_anti"), "open_values")
    # A paragraph of a text whose sentences end in marks closes its last one too.
    paragraph = (F.col("field") == "text") & F.col("within")
    broken = left.where(paragraph)
    keyed = materialize(left.where(~paragraph).select("id", "field", F.posexplode(F.array("k0", "k1", "k2")).alias("level", "key")), "open_keys")
    counts = numbers.where("NOT is_line").select("key", "ends", "goes_on").join(keyed.select("key").distinct(), "key", "left_semi")
    seen = keyed.join(counts.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")), "key", "left").groupBy("id", "field").agg(
        *[F.max(F.when(F.col("level") == k, F.coalesce(c, F.lit(0)))).alias(f"{c}{k}") for k in range(3) for c in ("ends", "goes_on")]
    )
    own = F.when(F.col("field") == "title", 1).otherwise(0)  # a title is counted as whole itself
    rate = F.lit(0.0)
    for k in (0, 1, 2):  # the most exact key that the corpus has often enough decides
        ends = F.col(f"ends{k}") - own
        n = ends + F.col(f"goes_on{k}")
        rate = F.when((ends > 0) | (n >= (EXACT_COUNT if k > 0 else 1)), ends / n).otherwise(rate)
    return sure.unionByName(seen.where(rate < OPEN_RATE).unionByName(broken, allowMissingColumns=True).select("id", "field", F.lit("open").alias("why")))


def truncation_rates(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(domain, field, n_values, n_truncated, rate) per source and field with values."""
    values = field_values(docs, fields)
    per = values.groupBy("source", "field").agg(F.count("*").alias("n_values"))
    cut = truncated(docs, fields).join(docs.select("id", F.coalesce("domain", F.lit("")).alias("source")).dropDuplicates(["id"]), "id")
    found = cut.groupBy("source", "field").agg(F.count("*").alias("n_truncated"))
    n = F.coalesce("n_truncated", F.lit(0))
    return per.join(found, ["source", "field"], "left").select(
        F.col("source").alias("domain"), "field", "n_values", n.alias("n_truncated"), F.round(n / F.col("n_values"), 4).alias("rate")
    )
