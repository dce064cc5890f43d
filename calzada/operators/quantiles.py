"""Exact, linearly interpolated quantiles that never hold an unbounded group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calzada.operators.brackets import bracketed_quantiles, finite, fractions, sketch
from calzada.sources.workspace import materialise


# Groups whose sketches the driver will hold; beyond, the distinct values are put in order instead.
MOST_GROUPS = 1_000


def exact_quantiles(df: DataFrame, group: str, value: str, qs: Sequence[float], most_groups: int = MOST_GROUPS) -> DataFrame:
    """(group, q, valor) for each group and fraction, over finite values; runs when called.

    Up to ``most_groups`` groups take two scans, by :mod:`~calzada.operators.brackets`, and write nothing; more of them are
    counted by value and put in order (:func:`quantiles_of_counts`). Both ways are exact.
    """
    rows = df.where(F.col(group).isNotNull())
    v = finite(value)
    heads = rows.groupBy(group).agg(F.count(v).alias("n"), sketch(v, fractions(qs)).alias("points")).limit(most_groups + 1).collect()
    if len(heads) > most_groups:
        return quantiles_of_counts(rows.where(v.isNotNull()).groupBy(group, v.alias("v")).agg(F.count("*").alias("n")), group, qs)
    found = bracketed_quantiles(rows, [value], qs, {(r[group], value): (r.n, r.points) for r in heads}, group)
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame([(g, float(q), x) for (g, _, q), x in found.items()], f"`{group}` {kind}, q double, valor double")


def quantiles_of_counts(counts: DataFrame, group: str, qs: Sequence[float]) -> DataFrame:
    """The same from how often each value occurs: (group, v, n), each pair once.

    The pairs are put in order by range partitions, as many as the session has shuffle
    partitions. A running count over the partitions tells which of them hold a wanted rank, and only
    those are ordered value by value. No step depends on how many groups there are or how large they are.
    """
    counts = materialise(counts, "quantile-counts")
    placed = materialise(counts.repartitionByRange(group, "v").withColumn("tramo", F.spark_partition_id()), "quantile-order")

    whole = Window.partitionBy(group)
    earlier = whole.orderBy("tramo").rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        placed.groupBy(group, "tramo").agg(F.sum("n").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("total", F.sum("n").over(whole))
        .withColumn("wanted", F.filter(_wanted(qs), lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("n"))))
        .where(F.size("wanted") > 0).select(group, "tramo", "before", "wanted")
    )
    # Written first: it has a row or two per group and fraction, and the join should know that.
    hit = placed.join(materialise(ranks, "quantile-ranks"), [group, "tramo"])
    inside = Window.partitionBy(group, "tramo").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    values = (
        hit.withColumn("start", start)
        .select(group, "v", F.explode(F.filter("wanted", lambda w: (w["rank"] >= F.col("start")) & (w["rank"] < F.col("start") + F.col("n")))).alias("w"))
    )
    low, high = (F.max(F.when(F.col("w.side") == s, F.col("v"))) for s in (0, 1))
    found = values.groupBy(group, F.col("w.q").alias("q")).agg(low.alias("low"), high.alias("high"), F.max("w.part").alias("part"))
    return materialise(found.select(group, "q", _between(F.col("low"), F.col("high"), F.col("part")).alias("valor")), "quantiles")


def _between(low: Column, high: Column, part: Column) -> Column:
    """Linear interpolation; the second form is for neighbours whose distance is beyond a double."""
    step = high - low
    apart = F.when(step < float("inf"), low + step * part).otherwise(low * (1 - part) + high * part)
    return F.when((part == 0) | (low == high), low).otherwise(apart)


def _wanted(qs: Sequence[float]) -> Column:
    """The two neighbouring ranks of every fraction, and how far the quantile lies between them."""
    out = []
    for q in qs:
        at = (F.col("total") - 1) * F.lit(float(q))
        low = F.floor(at)
        for side, rank in ((0, low), (1, F.least(low + 1, F.col("total") - 1))):
            out.append(F.struct(F.lit(float(q)).alias("q"), F.lit(side).alias("side"),
                                rank.cast("long").alias("rank"), (at - low).alias("part")))
    return F.array(*out)
