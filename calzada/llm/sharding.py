"""Sharding by jump consistent hashing.

A stable key alone decides the shard: a 64-bit draw of the key seeds a chain of jumps to ever higher shard numbers, and the last one
below the number of shards counts. No table of a ring is kept, and adding a shard moves only those rows whose chain reaches it.
Rows are numbered inside their shard over one distributed sort of narrow rows; texts move only when shards are written.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from calzada.sources.workspace import materialise

# The generator of the jump method: multiplier of its 64-bit congruence.
MULTIPLIER = np.uint64(2862933555777941757)
ROWS_TO_A_TASK = 200_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; all keys jump together until each has passed the last shard."""
    state = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    while len(going):
        shard[going] = ahead[going]
        state[going] = state[going] * MULTIPLIER + np.uint64(1)
        step = 2.0 ** 31 / ((state[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[going] = np.minimum((shard[going] + 1) * step, 2.0 ** 62).astype(np.int64)
        going = going[ahead[going] < shards]
    return shard


@F.arrow_udf(IntegerType())
def _jump(high: pa.Array, low: pa.Array, shards: pa.Array) -> pa.Array:
    keys = high.to_numpy().astype(np.uint64) << np.uint64(32) | low.to_numpy().astype(np.uint64)
    return pa.array(jump(keys, shards[0].as_py()) if len(keys) else [], pa.int32())


def draw(key: Column) -> Column:
    """16 hex digits drawn from a key; all NULL keys draw alike."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 16)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key among ``shards`` ones."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    half = lambda at: F.conv(F.substring(draw(key), at, 8), 16, 10).cast("long")
    return _jump(half(1), half(9), F.lit(shards))


def numbered(rows: DataFrame, group: str, order: Sequence[str], number: str, per_task: int = ROWS_TO_A_TASK) -> DataFrame:
    """``rows`` with their place from 0 in their group, by ``order``.

    Rows are sorted by range, equal ones told apart by a row number, so neither a large group nor many equal rows fall to one
    task; what the tasks before hold of a group, one figure for each task and group, is added. Rows equal in ``order`` come in any order.
    """
    # The number is written before it decides anything, so a task that runs again finds the same one.
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-rows", "zstd")
    parts = max(1, -(-rows.count() // per_task))
    by = [F.col(group).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order], F.col("_row")]
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = materialise(placed.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "shard-order", "zstd")
    held = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_held"))
    # One row for each task and group it meets: ranges of a sort overlap at one group each.
    before = F.sum("_held").over(Window.partitionBy(group).orderBy("_part")) - F.col("_held")
    starts = materialise(held.select(F.col(group).alias("_group"), F.col("_part").alias("_own"), (before - F.col("_first")).alias("_shift")), "shard-starts")
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_own")))
    return joined.withColumn(number, F.col("_at") + F.col("_shift")).drop("_row", "_at", "_part", "_group", "_own", "_shift")


def shard_documents(docs: DataFrame, shards: int = 16, per_task: int = ROWS_TO_A_TASK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``shard`` follows from doc_id and the number of shards alone, ``grown_shard`` is the one with one shard more; all rows of a
    doc_id, NULL included, share them. ``slot`` counts the rows of a shard from 0, in the order of a draw of doc_id,
    then doc_id, size and checksum; a NULL text has no bytes (size 1, checksum 0). Repeated rows keep a slot each.
    An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       draw(key).alias("_draw"), shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"))
    out = numbered(rows, "shard", ["_draw", "doc_id", "size", "text_crc32"], "slot", per_task)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", file_rows: int = 100_000) -> None:
    """All columns of the documents, one folder ``shard=<n>`` for each shard, files of at most ``file_rows`` rows.

    Adaptive execution deals a large shard, and so a hot key, to many tasks. The folder must not exist yet. Any column
    ``shard`` of the documents is replaced.
    """
    rows = docs.withColumn("shard", shard_of(F.col(key), shards)).hint("rebalance", "shard")
    rows.write.mode("error").option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
