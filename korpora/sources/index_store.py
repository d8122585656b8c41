"""An index in a folder of its own: saved, opened, and kept in memory if asked."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from korpora.operators.index import Index

PARTS = ("docs", "postings", "terms", "stats", "edges")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def save_index(index: Index, folder: str) -> str:
    """Write all tables as a new version; the last step names it as the current one, so a reader sees the old index or the new one.

    Returns the version. Older versions stay until ``drop_versions``.
    """
    spark = index.docs.sparkSession
    version = uuid.uuid4().hex
    for part in PARTS:
        getattr(index, part).write.option("compression", "zstd").parquet(f"{folder}/{version}/{part}")
    system, path = _file_system(spark, f"{folder}/current.json")
    out = system.create(path, True)
    out.write(bytearray(json.dumps({"version": version, "cap": index.cap}).encode()))
    out.close()
    return version


def _current(spark: SparkSession, folder: str) -> dict | None:
    system, path = _file_system(spark, f"{folder}/current.json")
    return json.loads("".join(r[0] for r in spark.read.text(f"{folder}/current.json").collect())) if system.exists(path) else None


def open_index(spark: SparkSession, folder: str, cached: bool = False) -> Index:
    """The current version; ``cached`` keeps its postings, pages' numbers and dictionary in memory after their first use."""
    known = _current(spark, folder)
    if known is None:
        raise FileNotFoundError(f"no index in {folder}")
    tables = {part: spark.read.parquet(f"{folder}/{known['version']}/{part}") for part in PARTS}
    if cached:
        for part in ("postings", "terms", "stats"):
            tables[part].cache()
    return Index(**tables, cap=known["cap"])


def drop_versions(spark: SparkSession, folder: str) -> int:
    """Delete all versions but the current one; how many they were."""
    known = _current(spark, folder)
    system, path = _file_system(spark, folder)
    gone = [f.getPath() for f in system.listStatus(path) if f.isDirectory() and known and f.getPath().getName() != known["version"]]
    for old in gone:
        system.delete(old, True)
    return len(gone)
