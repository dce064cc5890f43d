"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calzada.sources.workspace import drop_folder, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that can be reached.

    Each round hangs every node's larger neighbours, then its smaller ones, under its smallest neighbour; the
    number of links never grows. Rounds are written tables and end when nothing changes, after a number
    of rounds about the logarithm of the longest chain; a round's table goes when the next is written. NULL ends and self-links are ignored.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, path = stored(ends.where("a <> b").select("u", "v").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == state or now.n == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = path
        edges, path = stored(rest.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_folder(links.sparkSession, done)
