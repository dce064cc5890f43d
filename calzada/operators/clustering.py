"""Rows placed along a curve through several columns, so that filters on any of them read few blocks of a file.

Every column is cut into equally full ranges; a row's ranges are numbers whose bits are interleaved. Neighbours on that curve
are near each other in every column, so the smallest and largest values of a block lie close together in all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calzada.sources.workspace import materialise

# Ranges of a column: 2 to this power.
BITS = 8
CURVE = "_curve"


def range_cuts(df: DataFrame, column: str, bits: int = BITS) -> list:
    """The 2**bits - 1 values at which the column's ranges begin, ascending; None from where there are no more. Runs when called.

    Ranges hold equally many of the rows that are not NULL; a value of more rows than that takes up several, and is found in
    the first of them. Values are counted map-side and put in order by range partitions; only the cuts come to the driver.
    """
    value = F.col(column)
    counts = materialise(df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n")), "curve-counts")
    placed = materialise(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "curve-order")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each shuffle partition.
    parts = placed.groupBy("part").agg(F.sum("n").alias("n"))
    parts = materialise(parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")), "curve-parts")
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    codes = placed.join(parts, "part").select("v", F.floor(below * 2**bits / F.col("total")).alias("code"))
    firsts = {r.code: r.v for r in codes.groupBy("code").agg(F.min("v").alias("v")).collect()}
    cuts, value = [], None
    for code in range(2**bits - 1, 0, -1):
        value = firsts.get(code, value)
        cuts.append(value)
    return cuts[::-1]


def range_number(value: Column, cuts: Sequence, kind: str) -> Column:
    """How many of the ascending cuts the value has reached, by halving: one comparison for each bit. NULL counts as 0."""
    bits = len(cuts).bit_length()
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
    known = F.array(*[F.lit(c).cast(kind) for c in cuts])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(value >= F.element_at(known, at + step), F.lit(False)), at + step).otherwise(at))


def interleaved(numbers: Sequence[Column], bits: int = BITS) -> Column:
    """One long of the numbers' bits, the highest of each first."""
    if bits * len(numbers) > 62:
        raise ValueError(f"{len(numbers)} columns of {bits} bits do not fit into a long")
    spread = [F.shiftleft(F.shiftright(n.cast("long"), b).bitwiseAND(F.lit(1)), b * len(numbers) + len(numbers) - 1 - i)
              for i, n in enumerate(numbers) for b in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), spread)


def on_curve(df: DataFrame, columns: Sequence[str], bits: int = BITS, name: str = CURVE) -> DataFrame:
    """The rows with their place on the curve through ``columns``; cuts are worked out when called. An empty table stays empty."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns}
    numbers = {f"_range_{i}": range_number(F.col(c), range_cuts(df, c, bits), kinds[c]) for i, c in enumerate(columns)}
    return df.withColumns(numbers).withColumn(name, interleaved([F.col(n) for n in numbers], bits)).drop(*numbers)


def clustered(df: DataFrame, columns: Sequence[str], first: Sequence[str] = (), bits: int = BITS, partitions: int | None = None) -> DataFrame:
    """The rows in range partitions along the curve, sorted inside; ``first`` (such as a folder's year) goes before it.

    Rows of one place are told apart by a hash of all their cells, so a place with more rows than a partition holds is split.
    """
    placed = on_curve(df, columns, bits).withColumn("_row", F.xxhash64(*df.columns))
    keys = [*first, CURVE, "_row"]
    dealt = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).drop(CURVE, "_row")


def blocks_read(written: DataFrame, ranges: dict[str, dict[str, tuple]], rows: int = 20_000) -> DataFrame:
    """(filter, blocks, may_match, match) of a Parquet table: its blocks of ``rows`` rows, those a reader cannot leave out by their smallest and largest
    values, and those that do hold a matching row. ``ranges``: for each filter the least and greatest value of its columns.
    """
    columns = sorted({c for r in ranges.values() for c in r})
    matches = {name: reduce(lambda a, b: a & b, [F.col(c).between(*ends) for c, ends in r.items()]) for name, r in ranges.items()}
    block = [F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / rows).alias("block")]
    seen = written.select(*columns, *block).groupBy("file", "block").agg(
        *[f(c).alias(f"{end}_{c}") for c in columns for end, f in (("low", F.min), ("high", F.max))],
        *[F.coalesce(F.bool_or(m), F.lit(False)).alias(f"match_{name}") for name, m in matches.items()])
    may = {name: reduce(lambda a, b: a & b, [(F.col(f"low_{c}") <= hi) & (F.col(f"high_{c}") >= lo) for c, (lo, hi) in r.items()]) for name, r in ranges.items()}
    rows_ = [F.struct(F.lit(n).alias("filter"), F.coalesce(may[n], F.lit(False)).alias("may"), F.col(f"match_{n}").alias("match")) for n in ranges]
    return (seen.select(F.explode(F.array(*rows_)).alias("r")).groupBy("r.filter")
            .agg(F.count("*").alias("blocks"), F.count_if("r.may").alias("may_match"), F.count_if("r.match").alias("match")))
