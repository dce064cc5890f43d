"""Where jobs put the tables they write on the way to a result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    global _local
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local is None:
        _local = tempfile.TemporaryDirectory(prefix="calzada-")
    return _local.name


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a table written on the way, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Folders that a task of a partitioned write keeps open at a time; rows of further ones are sorted. Without it, all rows are sorted first.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def short_lived_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries that end inside leave no shuffle files behind; what they wrote stands for them."""
    return _set(spark, CLEANUP, "true")


def unsorted_writes(spark: SparkSession, folders: int = 64) -> AbstractContextManager[None]:
    """Partitioned writes inside do not sort (and spill) their rows. For text files, whose writers hold little; a higher number of the session's own stays."""
    return _set(spark, OPEN_FILES, str(max(folders, int(spark.conf.get(OPEN_FILES, None) or 0))))


def tasks_side_by_side(spark: SparkSession) -> AbstractContextManager[None]:
    """Unions run inside keep the tasks of their parts; else parts of one task each would become one task in all."""
    return _set(spark, "spark.sql.unionOutputPartitioning", "false")


def stored(df: DataFrame, name: str, codec: str | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """The frame as a written table, and its folder for ``drop_folder`` once nothing reads it any more. ``by``: columns to partition by."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    with short_lived_shuffles(spark):
        df.write.partitionBy(*by).parquet(path, compression=codec)
    kept = spark.read.schema(df.schema).parquet(path)
    return kept.select(*df.columns) if by else kept, path


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The frame as a written table: lineage ends here and Catalyst plans with its real size."""
    return stored(df, name, codec)[0]
