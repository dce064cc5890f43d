"""The three definitions of the congestion index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calzada.functions.numbers import unit_clip, upper_clip
from calzada.operators.joins import join_summary
from calzada.operators.quantiles import exact_quantiles

METHODS = ("p95_year", "max_valid", "max")


def yearly_p95(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(anio, p95) of the occupancy; linear interpolation unless ``approximate``."""
    if approximate:
        return df.groupBy("anio").agg(F.percentile_approx("ocupacion", 0.95).cast("double").alias("p95"))
    return exact_quantiles(df, "anio", "ocupacion", [0.95]).select("anio", F.col("valor").alias("p95"))


def _share(occupancy: Column, divisor: Column) -> Column:
    return F.try_divide(occupancy, divisor)


def congestion_index(df: DataFrame, method: str = "p95_year", approximate: bool = False) -> DataFrame:
    """Adds ``indice_congestion``; a missing occupancy gives a missing index.

    ``p95_year``: occupancy over the year's 95th percentile in [0, 1], 0 in a year without a
    positive one. ``max_valid``: over the largest occupancy strictly between 0 and 1000 (1 if none),
    at most 1. ``max``: over the plain maximum in [0, 1].
    """
    occ = F.col("ocupacion")
    if method == "p95_year":
        joined = join_summary(df.drop("indice_congestion"), yearly_p95(df, approximate), "anio")
        value = F.when(F.coalesce(F.col("p95"), F.lit(0.0)) > 0, unit_clip(_share(occ, F.col("p95")))).otherwise(
            F.lit(0.0))
        return joined.withColumn("indice_congestion", value).drop("p95")
    if method == "max_valid":
        top = df.where((occ > 0) & (occ < 1000)).agg(F.coalesce(F.max("ocupacion"), F.lit(1.0)).alias("m")).scalar()
        return df.withColumn("indice_congestion", upper_clip(_share(occ, top)))
    if method == "max":
        top = df.agg(F.max("ocupacion").alias("m")).scalar()
        return df.withColumn("indice_congestion", unit_clip(_share(occ, top)))
    raise ValueError(f"method must be one of {METHODS}, not {method!r}")


def repair_index(df: DataFrame) -> DataFrame:
    """Recomputes an index that adds up to 0 although there is occupancy; leaves any other alone."""
    occ, idx = F.col("ocupacion"), F.col("indice_congestion")
    state = df.agg(F.struct(F.coalesce(F.sum("indice_congestion"), F.lit(0.0)).alias("total"),
                            F.max("ocupacion").alias("top")).alias("s")).scalar()
    broken = (state["total"] == 0) & (state["top"] > 0)
    return df.withColumn("indice_congestion", F.when(broken, unit_clip(_share(occ, state["top"]))).otherwise(idx))
