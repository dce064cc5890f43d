"""Sampling operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calzada.sources.workspace import materialise

# A draw has 60 bits; each pass over the counts settles 10 of them. Rows that are ordered one by one at the end, for each group.
BITS, STEP, ORDERED = 60, 10, 5_000
# Copies of one row that are made at a time.
COPIES = 1_000


def random_sample(df: DataFrame, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """Bernoulli sample without replacement; the number of rows varies around the fraction."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def modulus_sample(df: DataFrame, fraction: float, key: str = "id") -> DataFrame:
    """Every ``int(1 / fraction)``-th key; all rows from 1 up."""
    if fraction >= 1:
        return df
    return df.where(F.col(key) % int(1 / fraction) == 0)


def draw(columns: Sequence[str], seed: int) -> Column:
    """60 bits that follow from the seed and a row's cells, and from nothing else."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\u001f", F.lit(str(seed)), *cells)), 1, BITS // 4), 16, 10).cast("long")


def exact_sample(df: DataFrame, fraction: float = 0.15, seed: int = 42, group: str = "archivo") -> DataFrame:
    """Exactly ``fraction`` of the rows of each group (a file), to the nearest row, half to even, without replacement.

    The rows with the smallest draws are taken. A draw follows from the row's cells, so the same seed takes the same rows however
    the table is cut up; of equal rows, which draw alike, as many as are due. The cut of each group is found by counting
    draws in ever finer bins, a line for each group and bin, and ordering the few rows of the last one; the table is not sorted.
    NULL is a group of its own.
    """
    # As the one element of an array, so that the optimizer does not carry the long expression through every later condition.
    rows = df.select("*", F.explode(F.array(draw([c for c in df.columns if c != group], seed))).alias("_d"))
    # Two numbers a row are written, so that no pass looks at the cells again.
    draws = materialise(rows.select(F.col(group).alias("_g"), "_d"), "sample-draws")
    cuts = _cuts(draws, fraction)
    joined = rows.join(materialise(cuts, "sample-cuts"), F.col(group).eqNullSafe(F.col("_g")))
    below = joined.where(F.col("_d") < F.col("_cut")).select(*df.columns)
    at = joined.where((F.col("_d") == F.col("_cut")) & (F.col("_due") > 0))
    # Rows at the cut are copies of one row, unless two draws have met by chance.
    kinds = at.groupBy(*df.columns, "_due").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(group).orderBy(*[c for c in df.columns if c != group]).rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("_due", F.least("_n", F.greatest(F.lit(0), F.col("_due") - F.coalesce(F.sum("_n").over(order), F.lit(0)))))
    part = lambda n: F.explode(F.sequence(F.lit(1), n))
    heaps = kinds.where("_due > 0").withColumn("_k", part(F.ceil(F.col("_due") / COPIES)))
    copies = heaps.withColumn("_i", part(F.least(F.lit(COPIES).cast("long"), F.col("_due") - (F.col("_k") - 1) * COPIES)))
    return below.unionByName(copies.select(*df.columns))


def _cuts(draws: DataFrame, fraction: float) -> DataFrame:
    """(_g, _cut, _due) for each group of ``draws`` (_g, _d): every draw below the cut is taken, and so many of those at it."""
    sizes = draws.groupBy("_g").agg(F.count("*").alias("_n"))
    due = F.bround(F.lit(float(fraction)) * F.col("_n"), 0).cast("long")
    open_ = materialise(sizes.select("_g", due.alias("_due"), "_n", F.lit(0).cast("long").alias("_bin")).where("_due > 0"), "sample-open")
    for left in range(BITS - STEP, -1, -STEP):
        # Groups whose last bin is small enough are as they will be; the others are counted in its finer bins.
        if open_.where(F.col("_n") > ORDERED).isEmpty():
            return _holding(draws, open_, left + STEP, 0).select("_g", F.col("_bin").alias("_cut"), "_due")
        # At most 2 ** STEP lines for each group.
        open_ = materialise(_holding(draws, open_, left + STEP, left), "sample-open")
    # All bits are settled: a bin is one draw.
    return open_.select("_g", F.col("_bin").alias("_cut"), "_due")


def _holding(draws: DataFrame, open_: DataFrame, known: int, left: int) -> DataFrame:
    """The finer bin, of draws without their last ``left`` bits, that holds each group's cut, and how many are due from it."""
    inside = draws.withColumn("_bin", F.shiftright("_d", known)).withColumn("_fina", F.shiftright("_d", left))
    inside = inside.join(open_.drop("_n").withColumnRenamed("_g", "_h").withColumnRenamed("_bin", "_b"),
                         F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_bin") == F.col("_b")))
    bins = inside.groupBy("_g", "_due", F.col("_fina").alias("_bin")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_bin")) - F.col("_n")
    found = bins.withColumn("_antes", before).where((F.col("_antes") < F.col("_due")) & (F.col("_due") <= F.col("_antes") + F.col("_n")))
    return found.select("_g", (F.col("_due") - F.col("_antes")).alias("_due"), "_n", "_bin")
