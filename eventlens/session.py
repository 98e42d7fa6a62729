"""Session settings, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they may be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key must be split even where the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone and adaptive execution; sizing stays with the cluster."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "eventlens") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


# Removed when the driver's Python ends.
_local_scratch: dict[str, tempfile.TemporaryDirectory] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine: executors
    of a cluster could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.TemporaryDirectory(prefix="eventlens-", ignore_cleanup_errors=True)
    return _local_scratch[context.applicationId].name


def scratch_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder."""
    return f"{scratch_root(spark)}/eventlens/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Remove all that this application has written as intermediate data, once none of its results is read any more.

    False if there was nothing. Files of other applications stay.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever reused."""
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Remove what ``materialize`` has written for these tables, which nothing may read any more."""
    for df in tables:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Remove the shuffle files of jobs that are over: Spark does so when the driver's garbage is collected, which may come late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written
