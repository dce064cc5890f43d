"""Session defaults for local runs; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


# The JVM does not compile methods over 8000 bytes; a wide cleaning projection fused into one such method would be interpreted, on every row.
METHOD_LIMIT = 8_000


def compile_in_parts(spark: SparkSession) -> None:
    """Past this size, Spark splits the generated code into small methods; a lower limit of the session's own stays."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535")) > METHOD_LIMIT:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_LIMIT))


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shuffles_of(spark: SparkSession, pieces: int) -> None:
    """Shuffles start with at least this many partitions, of which adaptive execution puts small ones together; a higher number of the session's own stays."""
    if int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")) < pieces:
        spark.conf.set(INITIAL_PARTITIONS, str(pieces))


def local_session(app: str = "calzada", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A ``local[cpus]`` session with the settings the library is tested with."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.hugeMethodLimit", str(METHOD_LIMIT))
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
