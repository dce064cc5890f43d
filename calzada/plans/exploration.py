"""The tables of the exploratory notebook."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calzada.functions.dates import WEEKDAYS
from calzada.functions.numbers import stable
from calzada.functions.traffic import field_order
from calzada.operators.filters import known_keys, named_corridors
from calzada.operators.profile import describe, null_profile, top_nulls, value_counts
from calzada.plans.dashboard import top_by_volume


def preview(df: DataFrame, n: int = 3, order: str | None = None) -> DataFrame:
    """The first rows in the order of a column; as they come without one."""
    return (df.orderBy(order) if order else df).limit(n)


def summary_statistics(df: DataFrame) -> DataFrame:
    return describe(df)


def traffic_nulls(trafico: DataFrame) -> DataFrame:
    return top_nulls(trafico, 10)


def incident_nulls(incidentes: DataFrame) -> DataFrame:
    return null_profile(incidentes)


def yearly_evolution(trafico: DataFrame) -> DataFrame:
    def even(c):
        return F.bround(stable(c), 1)

    return known_keys(trafico, "anio").groupBy("anio").agg(
        F.count("velocidad_kmh").alias("registros"), even(F.avg("velocidad_kmh")).alias("velocidad_prom"),
        even(F.avg("intensidad_veh_h")).alias("flujo_prom"), even(F.avg("ocupacion")).alias("ocupacion_prom"),
        even(F.avg("indice_congestion") * 100).alias("congestion"),
    ).orderBy("anio")


def hourly_means(trafico: DataFrame) -> DataFrame:
    return known_keys(trafico, "hora").groupBy("hora").agg(
        F.avg("velocidad_kmh").alias("velocidad"), F.avg("intensidad_veh_h").alias("flujo")).orderBy("hora")


def weekday_means(trafico: DataFrame) -> DataFrame:
    day = F.col("dia_semana")
    return trafico.where(day.isin(*WEEKDAYS)).groupBy("dia_semana").agg(
        F.avg("intensidad_veh_h").alias("flujo"), F.avg("velocidad_kmh").alias("velocidad"),
    ).orderBy(field_order(day, WEEKDAYS))


def top_congested(trafico: DataFrame, min_count: int = 10_000, n: int = 10) -> DataFrame:
    return named_corridors(trafico).groupBy("corredor").agg(
        F.avg("velocidad_kmh").alias("velocidad"), stable(F.avg("indice_congestion") * 100).alias("congestion"),
        F.count("velocidad_kmh").alias("registros"),
    ).where(F.col("registros") > min_count).orderBy(F.desc("congestion"), "corredor").limit(n)


def top_volume(trafico: DataFrame, n: int = 10) -> DataFrame:
    return top_by_volume(trafico, n).withColumnRenamed("volumen_total", "volumen")


def incident_type_counts(incidentes: DataFrame) -> DataFrame:
    return value_counts(incidentes, "tipo_evento")


def incident_severity_counts(incidentes: DataFrame) -> DataFrame:
    return value_counts(incidentes, "gravedad")
