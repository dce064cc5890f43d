"""The SQL set: yearly, hourly and zonal traffic figures, incidents, views and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calzada.functions.dates import WEEKDAYS
from calzada.functions.numbers import percent
from calzada.functions.traffic import SEVERITIES, field_order, open_day_period, slower_than
from calzada.sources.workspace import materialise

SLOW_KMH = 30


def _mean(c: str, digits: int) -> Column:
    return F.round(F.avg(c), digits)


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("gravedad") == g).alias(name)
            for g, name in zip(SEVERITIES, ("criticos", "moderados", "leves"))]


def yearly_summary(trafico: DataFrame) -> DataFrame:
    return trafico.groupBy("anio").agg(
        F.count("*").alias("total_registros"), _mean("velocidad_kmh", 1).alias("velocidad_promedio"),
        F.sum("intensidad_veh_h").alias("total_vehiculos"),
        _mean("intensidad_veh_h", 0).alias("promedio_vehiculos_por_hora"),
    ).orderBy("anio")


def incidents_by_type(incidentes: DataFrame) -> DataFrame:
    return incidentes.groupBy("tipo_evento").agg(
        F.count("*").alias("total"), _mean("conteo_vehicular", 0).alias("avg_vehiculos_afectados"),
        _mean("velocidad_promedio", 1).alias("avg_velocidad"),
    ).orderBy(F.desc("total"), "tipo_evento")


def incidents_by_severity(incidentes: DataFrame) -> DataFrame:
    return incidentes.groupBy("gravedad").agg(
        F.count("*").alias("total"), _mean("conteo_vehicular", 0).alias("avg_vehiculos_afectados"),
    ).orderBy(field_order(F.col("gravedad"), SEVERITIES), "gravedad")


def congestion_by_zone(trafico: DataFrame, kmh: float = SLOW_KMH) -> DataFrame:
    slow = slower_than(F.col("velocidad_kmh"), kmh)
    return trafico.groupBy("comuna", "corredor").agg(
        F.count("*").alias("total_registros"), slow.alias("registros_congestion"),
        percent(slow, F.count("*")).alias("indice_congestion_pct"),
        _mean("velocidad_kmh", 1).alias("velocidad_promedio_kmh"),
    ).orderBy(F.desc("indice_congestion_pct"), "comuna", "corredor")


def speed_by_hour(trafico: DataFrame) -> DataFrame:
    return trafico.groupBy("hora").agg(
        _mean("velocidad_kmh", 1).alias("velocidad_promedio"), F.sum("intensidad_veh_h").alias("total_vehiculos"),
        F.count("*").alias("registros"),
    ).orderBy("hora")


def volume_by_weekday(trafico: DataFrame) -> DataFrame:
    return trafico.groupBy("dia_semana").agg(
        F.sum("intensidad_veh_h").alias("total_vehiculos"), _mean("intensidad_veh_h", 0).alias("promedio_diario"),
        _mean("velocidad_kmh", 1).alias("velocidad_promedio"),
    ).orderBy(field_order(F.col("dia_semana"), WEEKDAYS), "dia_semana")


def peak_hours(trafico: DataFrame, n: int = 10) -> DataFrame:
    return trafico.groupBy("periodo_dia", "hora").agg(
        _mean("velocidad_kmh", 1).alias("velocidad_promedio"), _mean("intensidad_veh_h", 0).alias("avg_vehiculos"),
        F.count("*").alias("registros"),
    ).orderBy(F.desc("avg_vehiculos"), "hora").limit(n)


def incidents_by_period(incidentes: DataFrame) -> DataFrame:
    period = open_day_period(F.hour("fecha_incidente")).alias("periodo")
    order = field_order(F.col("periodo"), ("Madrugada", "Mañana", "Tarde", "Noche"))
    return incidentes.groupBy(period, "gravedad").agg(F.count("*").alias("total_incidentes")).orderBy(
        order, field_order(F.col("gravedad"), SEVERITIES), "gravedad")


def top_incident_zones(incidentes: DataFrame, n: int = 15) -> DataFrame:
    return incidentes.groupBy("ubicacion").agg(
        F.count("*").alias("total_incidentes"), _mean("conteo_vehicular", 0).alias("avg_vehiculos_afectados"),
        _mean("velocidad_promedio", 1).alias("velocidad_promedio"),
    ).orderBy(F.desc("total_incidentes"), "ubicacion").limit(n)


def incidents_by_month(incidentes: DataFrame) -> DataFrame:
    return incidentes.groupBy(F.month("fecha_incidente").alias("mes")).agg(
        F.count("*").alias("total_incidentes"), *_severity_counts()).orderBy("mes")


def traffic_and_incidents(trafico: DataFrame, incidentes: DataFrame) -> DataFrame:
    """Per zone: traffic means, distinct incidents and mean vehicles affected.

    Both sides are reduced before the join. Every traffic row of a zone would meet the same
    incidents, so means and distinct counts are those of the unreduced join, without its fan-out.
    """
    zones = trafico.groupBy("comuna", "corredor").agg(
        _mean("velocidad_kmh", 1).alias("velocidad_trafico"), _mean("intensidad_veh_h", 0).alias("volumen_trafico"))
    places = incidentes.where(F.col("ubicacion").isNotNull()).groupBy(F.col("ubicacion").alias("corredor")).agg(
        F.countDistinct("id").alias("n"), _mean("conteo_vehicular", 0).alias("vehiculos_afectados_incidentes"))
    return zones.join(places, "corredor", "left").select(
        "comuna", "corredor", "velocidad_trafico", "volumen_trafico",
        F.coalesce("n", F.lit(0)).alias("total_incidentes"), "vehiculos_afectados_incidentes",
    ).orderBy(F.desc("total_incidentes"), "comuna", "corredor")


def slower_than_average(trafico: DataFrame) -> DataFrame:
    """Zones whose mean speed is below the mean of all readings.

    The overall mean follows from the zones' sums and counts. Both are read from the written zone
    summary: pruned separately, the two branches would each scan the readings.
    """
    zones = materialise(trafico.groupBy("corredor", "comuna").agg(
        F.sum("velocidad_kmh").alias("suma"), F.count("velocidad_kmh").alias("n"),
        F.avg("intensidad_veh_h").alias("volumen")), "zones")
    overall = zones.agg(F.try_divide(F.sum("suma"), F.sum("n")).alias("v")).scalar()
    mean = F.try_divide(F.col("suma"), F.col("n"))
    return zones.where(mean < overall).select(
        "corredor", "comuna", F.round(mean, 1).alias("velocidad_promedio"),
        F.round("volumen", 0).alias("volumen_promedio"),
    ).orderBy("velocidad_promedio", "corredor", "comuna")


def busiest_days(trafico: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` days with the highest volume in each district."""
    days = trafico.groupBy("fecha", "comuna").agg(F.sum("intensidad_veh_h").alias("volumen_diario"))
    ranking = Window.partitionBy("comuna").orderBy(F.desc("volumen_diario"), "fecha")
    return (
        days.withColumn("rank_pos", F.row_number().over(ranking)).where(F.col("rank_pos") <= n)
        .orderBy("comuna", "rank_pos").select("comuna", "fecha", "volumen_diario")
    )


def daily_summary(trafico: DataFrame, kmh: float = SLOW_KMH) -> DataFrame:
    slow = F.avg(F.when(F.col("velocidad_kmh") < kmh, 1).otherwise(0)) * 100
    return trafico.groupBy("fecha", "anio", "mes", "dia_semana").agg(
        F.sum("intensidad_veh_h").alias("total_vehiculos"), _mean("velocidad_kmh", 1).alias("velocidad_promedio"),
        F.round(slow, 1).alias("pct_congestion"))


def incidents_by_zone(incidentes: DataFrame) -> DataFrame:
    return incidentes.groupBy("ubicacion").agg(
        F.count("*").alias("total_incidentes"), *_severity_counts(),
        _mean("conteo_vehicular", 0).alias("avg_vehiculos_afectados"))


def general_kpis(trafico: DataFrame, incidentes: DataFrame) -> DataFrame:
    """One row; one aggregate per table."""
    inc = incidentes.agg(F.struct(F.count("*").alias("n"), _mean("conteo_vehicular", 0).alias("v")).alias("s")).scalar()
    return trafico.agg(
        F.count("*").alias("total_registros_trafico"),
        _mean("velocidad_kmh", 1).alias("velocidad_promedio_general"),
        F.sum("intensidad_veh_h").alias("volumen_vehicular_total"),
    ).select("total_registros_trafico", inc["n"].alias("total_incidentes"), "velocidad_promedio_general",
             "volumen_vehicular_total", inc["v"].alias("avg_vehiculos_afectados_incidentes"))


def critical_zones(trafico: DataFrame) -> DataFrame:
    return trafico.groupBy("corredor", "comuna").agg(
        F.count("*").alias("total_registros"), F.avg("velocidad_kmh").alias("velocidad_promedio"),
        F.avg("intensidad_veh_h").alias("intensidad_promedio"), F.avg("ocupacion").alias("ocupacion_promedio"))


def overall_means(trafico: DataFrame) -> DataFrame:
    return trafico.agg(
        F.avg("velocidad_kmh").alias("velocidad_media"), F.avg("intensidad_veh_h").alias("intensidad_media"),
        F.avg("ocupacion").alias("ocupacion_media"))


VIEWS = ("vw_resumen_diario", "vw_incidentes_por_zona", "vw_kpi_generales")


def create_views(spark: SparkSession, trafico: DataFrame, incidentes: DataFrame) -> tuple[str, ...]:
    """Registers the three dashboard views in the session."""
    frames = (daily_summary(trafico), incidents_by_zone(incidentes), general_kpis(trafico, incidentes))
    for name, frame in zip(VIEWS, frames):
        frame.createOrReplaceTempView(name)
    return VIEWS
