"""Lines that come back on many pages of one source.

Lines are compared by their letters alone. For each (source, line) the pages of
the source with it are set against the pages of all other sources by a
log-likelihood ratio, and Benjamini and Hochberg's rule bounds the share of
false discoveries among those called excessive. A line that many other sources
carry too is still repeated on each of them, so where lines are to leave the
pages the rate outside only excuses a line up to ``tolerated``: what ordinary
text repeats by chance. Excessive lines leave the pages by an anti-join, and the rest of
each page is put together again by line number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpora.functions.text import composed
from korpora.session import materialize

#: Rate on other sources' pages beyond which a line is not excused any further.
TOLERATED = 0.005
#: Pages of its source that a line must stand on to be tested, and to be called repeated.
TESTED_PAGES, LEAST_PAGES = 2, 4
#: Bound on the share of false discoveries.
FALSE_RATE = 0.05
#: Steps of the log-likelihood ratio in which discoveries are counted.
STEPS_PER_UNIT, STEPS = 20, 4000

def letters(text: Column) -> Column:
    """The letters of each line of a text in one form, lines parted as in the text."""
    return F.regexp_replace(F.lower(composed(text)), r"[^\p{L}\n]+", "")


def line_table(docs: DataFrame, id_col: str = "id", text_col: str = "text", source: tuple[str, ...] = ("domain", "shard")) -> DataFrame:
    """(id, source columns, line_no, key): lines split at newlines, counted from 1; lines without letters are left out.

    Normalisation never adds or removes a newline, so lines are numbered as in
    the stored text.
    """
    keys = F.posexplode(F.split(letters(F.col(text_col)), "\n")).alias("at", "key")
    return docs.select(F.col(id_col).alias("id"), *source, keys).where("key <> ''").select("id", *source, (F.col("at") + 1).alias("line_no"), "key")


def key_bytes(key: Column) -> Column:
    """16 bytes that stand for a key wherever rows move."""
    return F.unhex(F.md5(key))


def _ratio(k: Column, n: Column, p0: Column) -> Column:
    """Signed log-likelihood ratio of k in n against the rate p0; 0 unless the rate is higher."""
    p = k / n
    gain = k * F.log(p / p0) + F.when(k < n, (n - k) * F.log((1 - p) / (1 - p0))).otherwise(0.0)
    return F.when(p > p0, 2 * gain).otherwise(0.0)


def line_excess(docs: DataFrame, lines: DataFrame, source: tuple[str, ...] = ("domain", "shard"), tolerated: float = TOLERATED, least: int = TESTED_PAGES) -> DataFrame:
    """(source columns, key, pages, source_pages, outside_pages, ratio) of each line on at least ``least`` pages of its source.

    ``ratio`` is twice the log-likelihood ratio of the source's rate against the
    rate on all other pages, where that is lower, or against ``tolerated``, where
    they have the line more often; with 1 the outside rate always counts.
    """
    held = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in source]
    sizes = docs.groupBy(*held).agg(F.count("*").alias("source_pages"))
    every = docs.count()
    per = (
        lines.select(*held, key_bytes(F.col("key")).alias("key"), "id").distinct()
        .groupBy(*source, "key").agg(F.count("*").alias("pages"))
    )
    all_pages = per.groupBy("key").agg(F.sum("pages").alias("all_pages"))
    tested = per.where(F.col("pages") >= least).join(sizes, list(source)).join(all_pages, "key")
    outside = F.greatest(F.lit(every) - F.col("source_pages"), F.lit(1))
    rate = (F.col("all_pages") - F.col("pages") + 0.5) / (outside + 1)
    return tested.select(
        *source, "key", "pages", "source_pages", (F.col("all_pages") - F.col("pages")).alias("outside_pages"),
        _ratio(F.col("pages"), F.col("source_pages"), F.least(rate, F.lit(tolerated), F.lit(1 - 1e-9))).alias("ratio"),
    )


def excessive(excess: DataFrame, false_rate: float = FALSE_RATE) -> DataFrame:
    """The rows that Benjamini and Hochberg's rule discovers.

    The counts of a fixed number of steps of the ratio go to the driver, which
    finds the lowest ratio that keeps the bound; p-values are those of the
    chi-squared distribution with one degree of freedom.
    """
    step = F.least(F.floor(F.col("ratio") * STEPS_PER_UNIT), F.lit(STEPS)).cast("int")
    counts = {r["step"]: r["count"] for r in excess.groupBy(step.alias("step")).count().collect()}
    total, above, lowest = sum(counts.values()), 0, None
    for s in sorted(counts, reverse=True):
        above += counts[s]
        if math.erfc(math.sqrt(s / STEPS_PER_UNIT / 2)) <= false_rate * above / total:
            lowest = s / STEPS_PER_UNIT
    return excess.where(F.lit(False)) if lowest is None else excess.where(F.col("ratio") >= lowest)


def repeated_lines(
    docs: DataFrame, id_col: str = "id", text_col: str = "text", source: tuple[str, ...] = ("domain", "shard"),
    least: int = LEAST_PAGES, share: float = 0.05, false_rate: float = FALSE_RATE,
) -> DataFrame:
    """(id, line_no) of the lines that are excessive in their source.

    After the statistical test an exact check keeps those on at least ``least``
    rows and ``share`` of all rows of the source. A null source column is a
    source of its own ('' and null are one); null and empty texts have no lines
    with letters; repeated rows count each time and come out each time only once
    per id.
    """
    lines = line_table(docs, id_col, text_col, source)
    found = excessive(materialize(line_excess(docs, lines, source, least=min(least, TESTED_PAGES)), "excess"), false_rate)
    found = found.where((F.col("pages") >= least) & (F.col("pages") >= share * F.col("source_pages")))
    held = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in source]
    at = lines.select("id", "line_no", *held, key_bytes(F.col("key")).alias("key"))
    return at.join(found.select(*source, "key"), [*source, "key"], "left_semi").select("id", "line_no").distinct()


def tested_lines(docs: DataFrame, tolerated: float = 1.0, false_rate: float = FALSE_RATE) -> DataFrame:
    """(domain, shard, key, pages, source_pages, outside_pages, ratio, excess) of every line on two pages of its source or more.

    ``excess`` says whether the test calls it more frequent in its source than
    outside. By default the outside rate counts in full, so that what all
    sources share is no excess of any of them.
    """
    tested = materialize(line_excess(docs, line_table(docs), tolerated=tolerated), "excess")
    found = excessive(tested, false_rate).select("domain", "shard", "key", F.lit(True).alias("excess"))
    return tested.join(found, ["domain", "shard", "key"], "left").select(
        "domain", "shard", F.lower(F.hex("key")).alias("key"), "pages", "source_pages", "outside_pages", F.round("ratio", 4).alias("ratio"), F.coalesce("excess", F.lit(False)).alias("excess")
    )


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """(id, text): each page without the repeated lines, in the order of its lines.

    Every row of ``docs`` with a distinct id comes out; a page of repeated lines
    alone becomes '', a null text stays null.
    """
    id_col, text_col = options.get("id_col", "id"), options.get("text_col", "text")
    gone = repeated_lines(docs, **options).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id"])
    kept = F.filter(F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line"))), lambda x: ~F.array_contains("gone", x["no"]))
    return base.join(gone, "id", "left").select(
        "id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("text")
    )
