"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "korpora", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use your own.

    Executors run operator code in Python workers, so call ``ship`` on a session
    of your own unless the package is installed there.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KORPORA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """A stored table on at least as many partitions as there are cores.

    A few small files would leave a step that is dear per row to a few tasks; a
    table of many splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far, once no result that reads them is needed; how many they were."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    count = len(_written)
    _written.clear()
    return count


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Operators that need Python import their functions from it there.
    """
    context = spark.sparkContext
    if getattr(context, "_korpora_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="korpora-package-")) / "korpora.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._korpora_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local tests) a folder of our own is chosen and
    remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("spark.korpora.shared.dir", None)
    if not own:
        folder = tempfile.mkdtemp(prefix="korpora-shared-")
        atexit.register(shutil.rmtree, folder, True)
        own = "file://" + folder
        spark.conf.set("spark.korpora.shared.dir", own)
    return own


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor, and lets several
    consumers read a result that was computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/korpora-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)
