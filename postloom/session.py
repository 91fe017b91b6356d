"""Session helpers: shared scratch folders, lineage cuts, input fan-out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    A session on one machine that names none gets a fresh temporary folder; on
    a cluster that would be one machine's own disk, so there it is an error.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    if not _local_fallback:
        _local_fallback.append(tempfile.mkdtemp(prefix="postloom-"))
    return _local_fallback[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go at their end, not when the driver collects garbage.

    Only for queries whose result is written or collected: nothing reads their shuffles again.
    """
    before = spark.conf.get(_CLEANUP_KEY, "false")
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_KEY, before)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` reliably and go on from the files, without its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with shuffles_dropped(spark):
        return df.select("*").checkpoint(eager=True)  # planned anew, under the setting above


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and go on from the files.

    Smaller than what ``settle`` writes, and Spark plans joins from the size of the files.
    """
    path = scratch_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove what was written below the shared folder and is not read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-bound work every core when the input came in fewer splits than cores.

    A small file with one row group is one task's work. The number of splits
    never falls; larger inputs are split at the read and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
