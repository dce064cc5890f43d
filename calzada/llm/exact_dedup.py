"""Exact deduplication with stateful streaming: disk-backed keyed state that never expires.

The state keeps, per digest of the normalised text, how many rows had it and the row that stays: its code
points, identifier and locator. Digests are trusted only as candidates: rows that hit an existing entry are
compared with the full text of the row that stays, and groups in which bytes differ are regrouped by text.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calzada.sources.workspace import materialise, new_folder

BLANKS = r"[\x20\x09-\x0D]+"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Digests that may be sent to all tasks: 32 MB.
SENT = 1_000_000
KEYS = "doc_id bigint, digest binary, sha binary, points int, row bigint"


def body(text: str = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def normalised(text: str = "text") -> Column:
    """The text without blanks (space, tab to carriage return)."""
    return F.regexp_replace(body(text), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def row_keys(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One small row per document; ``row`` tells apart rows that repeat an identifier once this is written."""
    text = normalised()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).cast("binary").alias("digest"),
                       sha256(text).alias("sha"), F.char_length(body()).alias("points"),
                       F.monotonically_increasing_id().alias("row"))


@contextmanager
def _disk_backed_state(spark: SparkSession):
    """RocksDB as the state store; without preallocated files, which cost megabytes per partition however little it holds."""
    wanted = {"providerClass": ROCKSDB, "rocksdb.allowFAllocate": "false"}
    wanted = {f"spark.sql.streaming.stateStore.{k}": v for k, v in wanted.items()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def update_state(spark: SparkSession, keys_path: str, state_path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Feed the key files not seen so far into the state at ``state_path`` and return the state.

    Run again after more key files have arrived, it goes on from the stored state. Columns: digest,
    group_size, keep_id, keep_row. The row with the most code points stays, then the smallest doc_id
    (NULL last), then the earliest row.
    """
    best = F.max(F.struct("points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("low"),
                          F.bitwise_not("row").alias("first")))
    rows = spark.readStream.schema(KEYS).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(keys_path)
    with _disk_backed_state(spark):
        (rows.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best"))
         .writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path)
         .trigger(availableNow=True).start().awaitTermination())
    state = spark.read.format("statestore").load(state_path)
    return state.select("key.digest", F.col("value.count").alias("group_size"),
                        F.bitwise_not("value.max.low").alias("keep_id"), F.bitwise_not("value.max.first").alias("keep_row"))


def unequal_digests(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests that texts of different bytes share (collisions).

    Whole texts are compared as grouping keys: equal ones become one in the task that reads them, so a text that a third of all rows have
    moves once from each task, and no task holds its copies. Where the digests that were hit are few they choose the texts first.
    """
    text = normalised()
    rows = docs.select(digest(text).cast("binary").alias("digest"), text.alias("bytes"))
    shared = state.where("group_size > 1").select("digest")
    # The digests are counted before they are broadcast; many of them would move every text once more to be chosen.
    if shared.limit(SENT + 1).count() <= SENT:
        rows = rows.join(F.broadcast(shared), "digest", "left_semi")
    return rows.groupBy("digest", "bytes").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")


def _by_bytes(docs: DataFrame, digests: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The documents under colliding digests, grouped by their whole normalised text."""
    text = normalised()
    rows = materialise(
        docs.select(F.col("doc_id").cast("long"), text.alias("bytes"), F.char_length(body()).alias("points"),
                    digest(text).cast("binary").alias("digest"), F.monotonically_increasing_id().alias("row"))
        .join(digests, "digest", "left_semi"), "colliding")
    best = rows.groupBy("bytes").agg(F.count("*").alias("group_size"), F.max(F.struct(
        "points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("low"),
        F.bitwise_not("row").alias("first"))).alias("best"))
    return rows.join(best, "bytes").select(
        "doc_id", F.bitwise_not("best.low").alias("keep_id"), "group_size",
        (F.col("row") == F.bitwise_not("best.first")).alias("kept"), F.sha2("bytes", 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256,
                 files_per_trigger: int = 1_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    NULL and empty texts (and texts of blanks only) are equal to each other. A repeated row is a copy like any
    other: exactly one row of a group has ``kept``. A NULL doc_id loses every tie. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    keys_path = new_folder(spark, "exact-keys")
    row_keys(docs, digest).write.parquet(keys_path)
    keys = spark.read.schema(KEYS).parquet(keys_path)
    state = materialise(update_state(spark, keys_path, new_folder(spark, "exact-state"), files_per_trigger), "exact-groups")
    rows = keys.join(state, "digest")
    unequal = materialise(unequal_digests(docs, state, digest), "unequal")
    collided = not unequal.isEmpty()
    if collided:
        rows = rows.join(unequal, "digest", "left_anti")
    out = rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))
    return out.unionByName(_by_bytes(docs, unequal, digest)) if collided else out


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    def key(sha: Column) -> Column:
        return F.concat_ws(":", sha, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))

    kept = exact_groups(docs).where("kept").select(key(F.col("text_sha256")).alias("key"))
    rows = docs.select(F.struct("*").alias("doc"), F.char_length(body()).alias("points"),
                       key(F.sha2(normalised(), 256)).alias("key"))
    # Rows that repeat identifier and text become one in the task that reads them; the join finds the rest where the grouping has put it.
    return rows.groupBy("key").agg(F.max_by("doc", "points").alias("doc")).join(kept, "key", "left_semi").select("doc.*")
