"""Structured Streaming counterparts of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from korpora.session import shared_dir


def read_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream of files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name.endswith(".parquet"):
        return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}")
    return reader.parquet(path)


def daily_usage(searches: DataFrame, late: str = "3 days") -> DataFrame:
    """(day, owner, used): tumbling days with a watermark; rows later than ``late`` are dropped."""
    timed = searches.where("owner IS NOT NULL").withColumn("at", F.col("searched_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w"), "owner").agg(F.count("*").alias("used")).select(F.to_date("w.start").alias("day"), "owner", "used")


def search_sessions(searches: DataFrame, gap: str = "30 minutes", late: str = "3 days") -> DataFrame:
    """(owner, started_at, ended_at, searches): sessions that a pause of ``gap`` ends."""
    timed = searches.where("owner IS NOT NULL").withColumn("at", F.col("searched_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("s"), "owner").agg(F.count("*").alias("searches")).select(
        "owner", F.col("s.start").alias("started_at"), F.col("s.end").alias("ended_at"), "searches"
    )


def distinct_urls(docs: DataFrame, late: str = "400 days") -> DataFrame:
    """(url): each URL once; the state of a URL goes when the watermark passes it."""
    from korpora.functions.urls import normalize_url

    timed = docs.select(normalize_url(F.col("url")).alias("url"), F.coalesce(F.col("fetched_at"), F.lit("1970-01-01").cast("timestamp_ntz")).cast("timestamp").alias("at"))
    return timed.where("url IS NOT NULL").withWatermark("at", late).dropDuplicates(["url"]).select("url")


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run what is available now to its end and return the result as a table in the shared folder.

    Results of complete and update mode are written per batch; the last complete
    batch, or all appended ones, are the result.
    """
    spark = stream.sparkSession
    import uuid

    path = f"{shared_dir(spark)}/korpora-stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/data")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def incremental_index(docs: DataFrame, path: str, checkpoint: str, fold: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Feed new pages to ``fold`` batch by batch (an upsert by URL), with progress kept at ``checkpoint``."""
    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fold).start()
