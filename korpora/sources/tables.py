"""Reading and writing the tables that operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("lang", T.StringType()),
        T.StructField("fetchedAt", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Input documents from files that each hold one JSON array.

    Rows of all files are concatenated; ``fetchedAt`` becomes the timestamp
    ``fetched_at`` (null where missing or malformed), absent fields are null.
    """
    raw = spark.read.option("multiLine", True).schema(DOCUMENT_SCHEMA).json(list(paths))
    return raw.withColumn("fetched_at", F.try_to_timestamp("fetchedAt")).drop("fetchedAt")


def seed_corpus(docs: DataFrame, fetched_at: str) -> DataFrame:
    """Give every document one fetch time, as a bulk seed load does."""
    return docs.withColumn("fetched_at", F.lit(fetched_at).cast("timestamp"))


def write_clustered(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """Write a table range-clustered by ``key``.

    Row-group statistics then prune nearly all of it for point and ``IN``
    lookups on the key. The old table is deleted before the new one is there;
    ``index_store`` keeps versions for tables that are read meanwhile.
    """
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(path)
