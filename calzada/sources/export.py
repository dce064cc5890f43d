"""Export of a table in balanced ranges of a key, which goes on where it was ended."""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calzada.operators.brackets import bracketed_quantiles, finite, fractions, sketch
from calzada.operators.cleaning import NARROW, narrow_types, smallest_integers

PLAN = "tramo int, desde double, hasta double, filas bigint, tipos string"
DONE = "tramo int, filas bigint"


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def range_cuts(source: DataFrame, key: str, chunks: int) -> list[float]:
    """Upper ends of ranges with about equal numbers of rows: exact quantiles of the key, each once.

    A key value that many rows share is never split, so there may be fewer ranges than asked for.
    """
    qs = [i / chunks for i in range(1, chunks)]
    v = finite(key)
    head = source.agg(F.count(v).alias("n"), sketch(v, fractions(qs or [0.5])).alias("points")).first()
    found = bracketed_quantiles(source, [key], qs, {(None, key): (head.n, head.points)})
    return sorted(set(found.values()))


def _tramo(key: str, cuts: list[float]):
    """Number of the range: 0 for rows without a key, then from 1 up."""
    v = F.col(key).cast("double")
    ends = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    return F.when(v.isNull(), 0).otherwise(F.size(F.filter(ends, lambda c: c < v)) + 1)


def _plan(source: DataFrame, path: str, key: str, chunks: int, narrow: bool) -> DataFrame:
    """The ranges with the rows each must have and the types of the export; worked out once, then read."""
    if not _exists(source, path):
        cuts = range_cuts(source, key, chunks)
        types = {}
        if narrow:
            order = ("tinyint", "smallint", "int", "bigint")
            needed = smallest_integers(source.select(*[c for c in NARROW if c in source.columns]))
            types = {c: max(t, needed.get(c, t), key=order.index) for c, t in NARROW.items() if c in source.columns}
        counted = {r.tramo: r.filas for r in source.groupBy(_tramo(key, cuts).alias("tramo")).agg(F.count("*").alias("filas")).collect()}
        ends = [None, *cuts, None]
        rows = [(0, None, None, counted.get(0, 0), json.dumps(types))]
        rows += [(i, ends[i - 1], ends[i], counted.get(i, 0), json.dumps(types)) for i in range(1, len(cuts) + 2)]
        source.sparkSession.createDataFrame(rows, PLAN).coalesce(1).write.parquet(path)
    return source.sparkSession.read.schema(PLAN).parquet(path)


def exported(source: DataFrame, path: str) -> DataFrame:
    """(tramo, filas) of the ranges that are written and counted."""
    at = f"{path.rstrip('/')}_hecho"
    if not _exists(source, at):
        return source.sparkSession.createDataFrame([], DONE)
    return source.sparkSession.read.schema(DONE).parquet(at).distinct()


def export_ranges(source: DataFrame, path: str, key: str, chunks: int = 16, chunks_per_job: int = 8, narrow: bool = True) -> DataFrame:
    """Copy a table to Parquet, one folder ``tramo=<n>`` for each range of ``key``; the copy.

    Ranges, types and expected counts are planned before anything is written. A job writes some ranges, is counted against the plan and noted in a
    manifest beside the table; a run that was ended is started again and writes only what the manifest lacks. The source must not
    change meanwhile: a count that differs ends the export with an error. Doubles become floats and small integers the
    smallest type that holds them all, if ``narrow``.
    """
    path, spark = path.rstrip("/"), source.sparkSession
    plan = sorted(_plan(source, f"{path}_plan", key, chunks, narrow).collect())
    cuts = [r.hasta for r in plan if r.hasta is not None]
    rows = source.withColumn("tramo", _tramo(key, cuts))
    if narrow:
        rows = narrow_types(rows, json.loads(plan[0].tipos))
    done = {r.tramo for r in exported(source, path).collect()}
    todo = [r for r in plan if r.tramo not in done and r.filas]
    for at in range(0, len(todo), chunks_per_job):
        part = todo[at:at + chunks_per_job]
        wanted = {r.tramo: r.filas for r in part}
        (rows.where(F.col("tramo").isin(list(wanted))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "snappy").partitionBy("tramo").parquet(path))
        # Only the footers of the new folders are read.
        written = spark.read.parquet(path).where(F.col("tramo").isin(list(wanted))).groupBy("tramo").agg(F.count("*").alias("n"))
        found = {r.tramo: r.n for r in written.collect()}
        if found != wanted:
            raise RuntimeError(f"rows written {found}, planned {wanted}")
        spark.createDataFrame(list(found.items()), DONE).coalesce(1).write.mode("append").parquet(f"{path}_hecho")
    return spark.read.schema(rows.schema).parquet(path).drop("tramo")


def place_of(cuts: list[float], key: float | None) -> int:
    """The range of one key, as :func:`export_ranges` numbers them."""
    return 0 if key is None else bisect.bisect_left(cuts, key) + 1
