"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "demandloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE on, skew handling on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session that does not name one gets a temporary folder, remembered in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("demandloom.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[\d*,]+\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = tempfile.mkdtemp(prefix="demandloom-")
        spark.conf.set("demandloom.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_dir(spark), "demandloom", f"{name}-{uuid.uuid4().hex}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of a file below the shared folder. A task takes as many files as the session's open cost allows (32 by default), so
#: its rows are bounded also where they compress so well that millions fit into one split.
FILE_ROWS = 100_000


#: Rows of a task that puts rows in order by their digests, however well these compress.
TASK_ROWS = 250_000


def parts_for(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


#: With it a job's shuffle files go when the job ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is written or started in the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def short_shuffles(spark: SparkSession):
    """For jobs whose rows are in files when they end: nobody reads their shuffles again, and those of several jobs would add up."""
    return setting(spark, CLEANUP, "true")


@contextmanager
def materialize(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The frame written once to the shared folder and read back, for as long as the block runs.

    For a result that several branches of a plan use: column pruning gives each branch a slightly
    different plan, so Spark would scan and shuffle the source again for every one of them. Results
    that outlive the block go through ``checkpoint``.
    """
    path = scratch_path(df.sparkSession, name)
    with short_shuffles(df.sparkSession):
        df.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_path(df.sparkSession, path)


def checkpoint(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut, its rows in the shared checkpoint folder.

    For a lazy result that several branches of a plan use. Spark removes the files with the frame
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``build_session`` does.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()
