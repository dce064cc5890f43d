"""Telling apart rows that share an identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calzada.sources.workspace import materialise


def told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text, copy): rows with one doc_id and different text, and all rows without a doc_id, differ in ``copy``.

    Rows that repeat doc_id and text are one document. Rows without a doc_id are numbered in a written table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = docs.where("doc_id IS NOT NULL").withColumn("copy", F.xxhash64("text"))
    unknown = docs.where("doc_id IS NULL").withColumn("copy", F.monotonically_increasing_id())
    return known.unionByName(materialise(unknown, "rows-unknown", "zstd"))
