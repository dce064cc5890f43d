"""Sinks: CSV and Parquet by year, unified Parquet, append, reload, summary tables, row counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calzada.operators.clustering import BITS, clustered
from calzada.sources.workspace import tasks_side_by_side, unsorted_writes


def by_year(df: DataFrame, year: str = "anio", balanced: bool = False) -> DataFrame:
    """Rows placed for a per-year write.

    Left as it is, every task writes the years it holds, which for input kept in year folders is one.
    ``balanced`` shuffles the rows by year into files of the advisory partition size: adaptive
    execution splits a hot year over many tasks and puts small ones together.
    """
    return df.hint("rebalance", year) if balanced else df


def write_csv_by_year(df: DataFrame, path: str, year: str = "anio", balanced: bool = False,
                      mode: str = "overwrite", compression: str | None = None) -> None:
    """One header per file, every year in its own folder; NULL and empty text are both blank cells, quotes are doubled."""
    with unsorted_writes(df.sparkSession):
        (by_year(df, year, balanced).write.mode(mode).option("header", "true").option("escape", '"')
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
         .partitionBy(year).csv(path, compression=compression))


def write_csv_file_by_year(stored: DataFrame, path: str, year: str = "anio") -> None:
    """As :func:`write_csv_by_year`, in one file for each year, from a table stored by year; one task reads and writes a year.

    Nothing is shuffled or sorted: whole text rows take several times the room there that they take in a packed table.
    """
    years = [r[0] for r in stored.select(year).distinct().orderBy(year).collect()]
    parts = [stored.where(F.col(year).eqNullSafe(F.lit(y))).coalesce(1) for y in years]
    with tasks_side_by_side(stored.sparkSession):
        write_csv_by_year(reduce(DataFrame.union, parts) if parts else stored, path, year)


def write_parquet_by_year(df: DataFrame, path: str, year: str = "anio", balanced: bool = False,
                          sort_by: str | None = "corredor") -> None:
    """Replaces only the years present in ``df``.

    Sorting inside each task keeps row-group statistics narrow, which takes the place of an index.
    """
    out = by_year(df, year, balanced)
    if sort_by and sort_by in df.columns:
        out = out.sortWithinPartitions(year, sort_by)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
     .partitionBy(year).parquet(path))


def write_clustered_by_year(df: DataFrame, path: str, columns: Sequence[str], year: str = "anio", bits: int = BITS, partitions: int | None = None) -> None:
    """As :func:`write_parquet_by_year`, with the rows of each year along a curve through several columns.

    A filter on any of ``columns`` then leaves out blocks by their statistics, where a sort helps its first column only. Cuts are
    those of all rows given, and every year uses the same ones.
    """
    (clustered(df, columns, (year,), bits, partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "snappy").partitionBy(year).parquet(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    write_parquet(df, path, mode="append")


def reload_table(df: DataFrame, path: str) -> None:
    """Truncate and load in one step."""
    write_parquet(df, path, mode="overwrite")


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_rows: int = 1_000,
               **extra: str) -> None:
    (df.write.format("jdbc").mode(mode)
     .options(url=url, dbtable=table, batchsize=str(batch_rows), **{k: str(v) for k, v in extra.items()}).save())


def export_table(source: DataFrame, path: str, expected_rows: int | None = None) -> DataFrame:
    """Copy a table (for example :func:`read_jdbc`) to Parquet; compares the row count if one is given."""
    write_parquet(source, path)
    copied = source.sparkSession.read.parquet(path)
    if expected_rows is not None:
        found = copied.count()
        if found != expected_rows:
            raise RuntimeError(f"{found} rows written, {expected_rows} expected")
    return copied


def create_table_as(df: DataFrame, name: str, path: str | None = None) -> None:
    """A summary kept as a table; ``path`` makes it external."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def load_audit(year: str = "anio", **tables: DataFrame) -> DataFrame:
    """Rows per table and year."""
    out = None
    for name, df in tables.items():
        part = df.groupBy(F.col(year).alias("anio")).agg(F.count("*").alias("filas")).select(
            F.lit(name).alias("tabla"), "anio", "filas")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables")
    return out
