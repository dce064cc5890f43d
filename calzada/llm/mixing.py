"""Mixing sources to target weights by Sainte-Lague apportionment.

The words to take are dealt out as equal blocks, of one word each, so that small sources meet their targets as well: to sources by the
highest quotients target / (2 * blocks so far + 1), then in the same way to the shards of each source. Inside a shard the
documents stand in a seeded order, and a seeded run of blocks, wrapping around, meets the shard's quota.
Everything after the word count works on a few numbers per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calzada.llm.sharding import numbered
from calzada.sources.workspace import materialise

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3


def seeded(seed: int, *parts: Column) -> Column:
    """A repeatable number below 2**60; MD5, so that other engines can compute the same."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def apportion(votes: DataFrame, group: str, item: str) -> DataFrame:
    """``blocks`` for every row of (group, item, vote, seats, and cap if there is one): each group's seats by highest quotients.

    A row's share rounded by the divisor total / seats is off the answer by at most the number of rows times
    the row's share, plus one. Seats below that are certain; only quotients in between are ranked, which
    makes a few rows per item however many seats there are, in one sort by range over all groups. No item gets more than its
    ``cap``, which is not below its share, so only rounding can pass it; that goes to the next quotients. Ties go to the smaller item; NULL is last.
    """
    cap = F.col("cap") if "cap" in votes.columns else F.lit(2**62)
    votes = materialise(votes.withColumn("cap", cap.cast("long")), "mix-votes")
    whole = votes.groupBy(F.col(group).alias("_g")).agg(F.sum("vote").alias("total"), F.count("*").alias("n"))
    share = F.coalesce(F.try_divide(F.col("vote"), F.col("total")), F.lit(0.0))
    near = F.floor(share * F.col("seats") + 0.5)
    reach = F.ceil(share * F.col("n")) + 1
    bounds = materialise(
        votes.join(whole, F.col(group).eqNullSafe(F.col("_g")))
        .select(group, item, "vote", "seats", "cap", F.least(F.greatest(F.lit(0), near - reach), "cap").alias("sure"), (near + reach).alias("most")), "mix-bounds")
    open_ = bounds.groupBy(F.col(group).alias("_g")).agg((F.max("seats") - F.sum("sure")).alias("open"))
    quotients = bounds.select(group, item, "sure", "vote", "cap", F.explode(F.sequence("sure", "most")).alias("seat"))
    allowed = F.col("seat") < F.col("cap")
    ranked = numbered(quotients.select(group, item, "sure", "seat", allowed.alias("allowed"), F.when(allowed, -F.col("vote") / (2 * F.col("seat") + 1)).alias("order")),
                      group, ["order", item, "seat"], "place")
    won = F.col("allowed") & (F.col("place") < F.col("open"))
    return (ranked.join(open_, F.col(group).eqNullSafe(F.col("_g"))).groupBy(group, item)
            .agg((F.max("sure") + F.count_if(won)).alias("blocks")))


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, source_size, n_docs): weights 1, 2, 3 in turn over sources by code point.

    A target stops at three times its source's size; the rest is shared again by weight, in rounds that each sum up
    the sources left, until none is above. Only sums come to the driver.
    """
    placed = numbered(sources.withColumn("all", F.lit(0)), "all", ["source"], "place")
    sources = materialise(placed.select("source", "source_size", "n_docs", (F.col("place") % 3 + 1).alias("weight"),
                                        (MOST_REPEATS * F.col("source_size")).cast("double").alias("cap")), "mix-sources")
    level, known = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        now = sources.agg(F.sum("source_size").alias("words"), F.sum(F.when(over, F.col("cap"))).alias("used"), F.count_if(over).alias("n"),
                          F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        if now.n == known or not now.weights:
            break
        level, known = (now.words - (now.used or 0.0)) / now.weights, now.n
    return sources.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).select("source", "source_size", "n_docs", "target")


def mix(docs: DataFrame, seed: int = 7, block_words: int = 16, shard_docs: int = 2_000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Words are dealt one by one to sources and to their shards, so every source, of whatever size, gets its target but for a word or
    so; ``block_words`` is where the run of words taken from a shard may begin. NULL and blank texts have size 0 and nothing
    is taken from them; a NULL source is a source of its own, the last. Rows that repeat a doc_id count each by itself. An empty
    table gives no rows. ``shard_docs`` bounds what one task has to order; a hot source has more shards. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spark_rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), seeded(seed, F.col("doc_id"), F.md5(text)).alias("draw"))
    sizes = materialise(spark_rows, "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = materialise(source_targets(sources), "mix-targets")
    words = targets.agg(F.sum("source_size").alias("n")).first().n or 0
    votes = targets.select(F.lit(0).alias("all"), "source", F.col("target").alias("vote"), F.lit(words).cast("long").alias("seats"),
                           (MOST_REPEATS * F.col("source_size")).alias("cap"))
    quotas = apportion(votes, "all", "source").select(F.col("source").alias("s"), F.col("blocks").alias("seats"))
    plan = materialise(
        targets.join(quotas, F.col("source").eqNullSafe(F.col("s")))
        .select("s", "source_size", "target", "seats", F.ceil(F.col("n_docs") / shard_docs).alias("shards")), "mix-plan")

    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("shard", F.col("draw") % F.col("shards"))
    shards = rows.groupBy("s", "shard").agg(F.sum("size").alias("words"), F.max("seats").alias("seats"))
    by_shard = apportion(shards.select("s", "shard", F.col("words").cast("double").alias("vote"), "seats", (MOST_REPEATS * F.col("words")).alias("cap")), "s", "shard")
    quota = materialise(by_shard.select(F.col("s").alias("qs"), F.col("shard").alias("qshard"), F.col("blocks").alias("wanted")), "mix-quotas")

    place = Window.partitionBy("s", "shard").orderBy("draw", "doc_id", "size")
    placed = (
        rows.withColumn("end", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("words", F.sum("size").over(Window.partitionBy("s", "shard")))
        .join(quota, F.col("s").eqNullSafe(F.col("qs")) & (F.col("shard") == F.col("qshard")))
    )
    full = F.coalesce(F.floor(F.try_divide(F.col("wanted"), F.col("words"))), F.lit(0))
    start = F.col("end") - F.col("size")
    drawn = (
        placed.withColumn("full", full).withColumn("rest", F.col("wanted") - F.col("full") * F.col("words"))
        .withColumn("from", block_words * (seeded(seed, F.col("source"), F.col("shard"))
                                           % F.greatest(F.lit(1), F.floor(F.col("words") / block_words))))
        .withColumn("to", F.col("from") + F.col("rest"))
    )

    def inside(shift: Column | int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end") + shift, F.col("to")) - F.greatest(start + shift, F.col("from")))

    taken = F.col("full") * F.col("size") + inside(0) + inside(F.col("words"))
    return drawn.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix as documents, with all their columns: each as often as its words are taken, to the nearest whole copy."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")

    def key(size: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), size,
                           F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())

    # Rows that agree in identifier, size and source share the copies that fall to them.
    copies = (mix(docs, seed).where("size > 0").groupBy(key(F.col("size")).alias("key"))
              .agg((F.sum("taken") / F.sum("size")).alias("times")))
    rows = docs.select(F.struct("*").alias("doc"), key(words).alias("key"))
    return (rows.join(copies, "key").withColumn("n", F.round("times").cast("int")).where("n > 0")
            .select(F.explode(F.array_repeat("doc", F.col("n"))).alias("doc")).select("doc.*"))
