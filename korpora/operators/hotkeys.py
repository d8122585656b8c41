"""Per-key results when a few keys hold most of the rows.

``key_totals`` is built by exact offset chunking:

1. every input partition counts its keys into cells (partition, key) with rows,
   weight and pages, so that a hot key leaves a partition as one row;
2. cells get exact row offsets from a prefix sum over the keys of a bucket; a
   bucket is a hash range of keys, so no global sort is needed;
3. the numbered rows of a bucket are cut into chunks of equal size, a cell that
   lies over an edge being cut there; each chunk is reduced on its own;
4. keys within one chunk are done; the states of a key that runs over edges are
   merged in the order of the chunks.

The unit of work is a chunk, and all chunks hold the same number of rows, however
many of them belong to one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpora.session import materialize

#: Rows of one chunk, the unit that is reduced on its own.
CHUNK_ROWS = 1 << 15
#: Hash ranges the keys are numbered in, for each shuffle partition of the session.
BUCKETS_PER_PARTITION = 4

_KEY = ["shard", "key_column", "key_value"]


def key_cells(postings: DataFrame, pages: bool = True) -> DataFrame:
    """Cells (pid, bucket, shard, key_column, key_value) with their rows, w and pages.

    ``pages`` counts distinct doc_id, for which rows of one (term, doc_id) have
    to meet first; without it every cell is of one input partition and its
    ``pages`` is 0. A null ``w`` counts 0, a null term or doc_id is a key of its
    own whose ``key_value`` is null.
    """
    buckets = BUCKETS_PER_PARTITION * int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = F.coalesce("w", F.lit(0.0)).alias("w")
    rows = postings.select("shard", "term", "doc_id", F.lit(1).cast("long").alias("n"), w)
    if pages:
        # One row per (shard, term, doc_id): it adds one page to its term.
        rows = rows.groupBy("shard", "term", "doc_id").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    page = F.col("doc_id").isNotNull().cast("long") if pages else F.lit(0).cast("long")
    keys = F.array(
        F.struct(F.lit("term").alias("c"), F.col("term").alias("v"), page.alias("p")),
        F.struct(F.lit("doc_id").alias("c"), F.col("doc_id").cast("string").alias("v"), F.lit(0).cast("long").alias("p")),
    )
    each = rows.select(F.spark_partition_id().alias("pid"), "shard", "n", "w", F.explode(keys).alias("k"))
    cells = each.groupBy("pid", "shard", F.col("k.c").alias("key_column"), F.col("k.v").alias("key_value"))
    return cells.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("k.p").alias("pages")).withColumn("bucket", F.pmod(F.xxhash64(*_KEY), F.lit(buckets)).cast("int"))


def chunk_parts(cells: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cells with ``first_row``, their exact offset in the bucket, cut at the edges of chunks (chunk).

    Of a cell that is cut, the first part takes its weight and pages.
    """
    before = W.partitionBy("bucket").orderBy(*_KEY, "pid").rowsBetween(W.unboundedPreceding, -1)
    numbered = cells.withColumn("first_row", F.coalesce(F.sum("n").over(before), F.lit(0)))
    a, b = F.col("first_row"), F.col("first_row") + F.col("n")
    lies = F.sequence(F.floor(a / chunk_rows), F.floor((b - 1) / chunk_rows))
    parts = numbered.select("bucket", *_KEY, "n", "w", "pages", "first_row", F.posexplode(lies).alias("part", "chunk"))
    start = F.greatest(a, F.col("chunk") * chunk_rows)
    is_first = F.col("part") == 0
    return parts.select(
        "bucket", "chunk", *_KEY, start.alias("first_row"), (F.least(b, (F.col("chunk") + 1) * chunk_rows) - start).alias("n"),
        F.when(is_first, F.col("w")).otherwise(0.0).alias("w"), F.when(is_first, F.col("pages")).otherwise(0).alias("pages"),
    )


def chunk_states(parts: DataFrame) -> DataFrame:
    """(bucket, chunk, shard, key_column, key_value, n, w, pages, from_row, to_row): each chunk reduced to its keys."""
    return parts.repartition("bucket", "chunk").groupBy("bucket", "chunk", *_KEY).agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("pages").alias("pages"), F.min("first_row").alias("from_row"), F.max(F.col("first_row") + F.col("n")).alias("to_row")
    )


def key_totals(postings: DataFrame, chunk_rows: int = CHUNK_ROWS, pages: bool = True) -> DataFrame:
    """(shard, key_column, key_value, n_rows, pages, sum_w, chunks) of every key.

    Keys are the values of ``term`` and of ``doc_id`` per shard; the
    placeholders '' and 0 are keys like others, repeated rows count each time.
    ``pages`` is the number of distinct non-null doc_id (1 for a doc_id key, 0
    for a null one), or null if it is not asked for; ``chunks`` the number of
    chunks the key's rows lie in. An empty table gives no rows; extra columns
    are ignored.
    """
    cells = key_cells(postings.select("shard", "term", "doc_id", "w"), pages)
    states = materialize(chunk_states(chunk_parts(cells, chunk_rows)), "chunks")
    # Only the first and the last key of a chunk can run over its edges.
    at_edge = (F.col("from_row") == F.col("chunk") * chunk_rows) & (F.col("chunk") > 0) | (F.col("to_row") == (F.col("chunk") + 1) * chunk_rows)
    done = states.where(~at_edge).select(*_KEY, F.col("n").alias("n_rows"), "pages", F.col("w").alias("sum_w"), F.lit(1).cast("long").alias("chunks"))
    merged = states.where(at_edge).groupBy(*_KEY).agg(
        F.sum("n").alias("n_rows"), F.sum("pages").alias("pages"), F.sum("w").alias("sum_w"), F.count("*").alias("chunks")
    )
    is_doc = F.col("key_column") == "doc_id"
    counted = F.when(is_doc, F.col("key_value").isNotNull().cast("long")).otherwise(F.col("pages")) if pages else F.lit(None).cast("long")
    return done.unionByName(merged).select("shard", "key_column", "key_value", "n_rows", counted.alias("pages"), "sum_w", "chunks")


def hot_keys(totals: DataFrame, share: float = 0.005, times_mean: float = 5.0) -> DataFrame:
    """Keys with at least ``share`` of their shard's rows and ``times_mean`` times the mean key."""
    per_shard = totals.groupBy("shard", "key_column").agg(
        F.sum("n_rows").alias("all_rows"), F.count(F.lit(1)).alias("n_keys")
    )
    t, s = totals.alias("t"), per_shard.alias("s")
    joined = t.join(s, F.col("t.shard").eqNullSafe(F.col("s.shard")) & (F.col("t.key_column") == F.col("s.key_column")))
    return joined.where(
        (F.col("n_rows") >= share * F.col("all_rows")) & (F.col("n_rows") * F.col("n_keys") >= times_mean * F.col("all_rows"))
    ).select("t.shard", "t.key_column", "t.key_value")
