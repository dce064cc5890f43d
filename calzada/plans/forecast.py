"""Linear trend of the monthly flow and its projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calzada.functions.dates import month_end, month_index, month_start
from calzada.functions.numbers import finite, stable
from calzada.sources.workspace import materialise

HORIZON_MONTHS = 48


def monthly_points(trafico: DataFrame) -> DataFrame:
    """(anio, mes_num, intensidad, t) per month with a finite mean flow; t = 1 in the first January."""
    months = materialise(
        trafico.where(F.col("anio").isNotNull() & F.col("mes_num").isNotNull()).groupBy("anio", "mes_num").agg(
            F.avg("intensidad_veh_h").alias("intensidad")), "months")
    first = months.agg(F.min("anio").alias("a")).scalar()
    return (
        months.select("anio", "mes_num", "intensidad", month_index(F.col("anio"), F.col("mes_num"), first).alias("t"))
        .where(finite(F.col("intensidad")))
    )


def with_dates(points: DataFrame) -> DataFrame:
    """Observed points with the first day of their month."""
    return points.withColumn("fecha", month_start(F.col("anio"), F.col("mes_num")))


def trend(points: DataFrame) -> DataFrame:
    """One row: slope and intercept (0, 0 for fewer than two points), point count and ranges."""
    one = F.count("*") < 2
    slope, level = F.regr_slope("intensidad", "t"), F.regr_intercept("intensidad", "t")
    return points.agg(
        F.when(one, F.lit(0.0)).otherwise(F.coalesce(slope, F.lit(0.0))).alias("pendiente"),
        F.when(one, F.lit(0.0)).otherwise(F.coalesce(level, F.lit(0.0))).alias("ordenada"),
        F.count("*").alias("meses"), F.min("t").alias("t_min"), F.max("t").alias("t_max"),
        F.min(F.col("anio") - F.floor((F.col("t") - F.col("mes_num")) / 12)).cast("int").alias("anio_base"),
        F.max("anio").alias("anio_max"),
    )


def projection(points: DataFrame, horizon: int = HORIZON_MONTHS) -> DataFrame:
    """(t, fecha, intensidad, tipo) from the first month to ``horizon`` months past the last."""
    line = trend(points).where(F.col("meses") > 0)
    steps = line.select("*", F.explode(F.sequence(F.col("t_min"), F.col("t_max") + horizon)).alias("t"))
    dated = steps.withColumn("fecha", month_end(F.col("anio_base"), F.col("t")))
    label = F.when(F.year("fecha") <= F.col("anio_max"), F.lit("Histórico")).otherwise(F.lit("Pronóstico"))
    value = F.col("pendiente") * F.col("t") + F.col("ordenada")
    return dated.select("t", "fecha", stable(value, 6).alias("intensidad"), label.alias("tipo")).orderBy("t")
